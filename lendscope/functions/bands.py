"""Binning and lookup expressions.

Boundary conventions differ per operator, so each has its own helper:

* ``cut``        right-closed, left-open bins ``(e[i], e[i+1]]``; outside -> NULL
* ``digitize``   left-closed ``e[i-1] <= x < e[i]``; returns 0..len(edges)
* ``equal_width_bin``  equal-width bins over [lo, hi], last bin right-closed
* ``lookup``     literal dictionary with a default
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def cut(col, edges: Sequence[float], labels: Sequence) -> Column:
    """Right-closed bins; values <= edges[0] or > edges[-1] (and NULL) give NULL."""
    x = _c(col)
    if len(labels) != len(edges) - 1:
        raise ValueError("cut needs len(labels) == len(edges) - 1")
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = x > F.lit(float(lo))
        if hi != float("inf"):
            cond = cond & (x <= F.lit(float(hi)))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def digitize(col, edges: Sequence[float]) -> Column:
    """Index of the first edge strictly greater than x (left-closed bins)."""
    x = _c(col)
    total = None
    for e in edges:
        term = (x >= F.lit(float(e))).cast("int")
        total = term if total is None else total + term
    return total


def equal_width_bin(col, lo, hi, n: int) -> Column:
    """1-based bin of x in ``n`` equal-width bins over [lo, hi] (last bin closed).

    ``lo``/``hi`` may be columns (a broadcast fit row).  Values outside [lo, hi]
    give NULL.  A zero-width range is widened by 0.5 on both sides, as the
    usual histogram routine does.
    """
    x = _c(col)
    lo_c, hi_c = _c(lo) if not isinstance(lo, (int, float)) else F.lit(float(lo)), \
        _c(hi) if not isinstance(hi, (int, float)) else F.lit(float(hi))
    same = lo_c == hi_c
    lo_e = F.when(same, lo_c - F.lit(0.5)).otherwise(lo_c)
    hi_e = F.when(same, hi_c + F.lit(0.5)).otherwise(hi_c)
    width = (hi_e - lo_e) / F.lit(float(n))
    raw = F.floor((x - lo_e) / width).cast("int") + F.lit(1)
    return F.when((x >= lo_e) & (x <= hi_e), F.least(raw, F.lit(n)))


def lookup(col, mapping: Mapping, default=None) -> Column:
    """Literal dictionary lookup as a CASE expression (codegen-friendly)."""
    x = _c(col)
    expr = None
    for k, v in mapping.items():
        cond = x == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default)) if default is not None else expr


def clip(col, lo=None, hi=None) -> Column:
    """``least``/``greatest`` that keeps NULL as NULL."""
    x = _c(col)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(out)


def null_if_nan(col) -> Column:
    x = _c(col)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def bin_edges(lo, hi, n: int) -> Column:
    """Array of the n + 1 edges ``lo + i * ((hi - lo) / n)``; a zero-width range is widened by 0.5."""
    lo_c = F.lit(float(lo)) if isinstance(lo, (int, float)) else _c(lo)
    hi_c = F.lit(float(hi)) if isinstance(hi, (int, float)) else _c(hi)
    same = lo_c == hi_c
    lo_e = F.when(same, lo_c - F.lit(0.5)).otherwise(lo_c)
    hi_e = F.when(same, hi_c + F.lit(0.5)).otherwise(hi_c)
    step = (hi_e - lo_e) / F.lit(float(n))
    return F.array(lo_e, *(lo_e + F.lit(float(i)) * step for i in range(1, n)), hi_e)


def bin_of(col, edges) -> Column:
    """1-based bin of x between the ready ``edges`` (an array): left-closed bins, the last one closed, outside gives NULL."""
    x, e = _c(col), _c(edges)
    inner = F.slice(e, F.lit(2), F.size(e) - 2)
    return F.when((x >= F.get(e, F.lit(0))) & (x <= F.element_at(e, -1)), F.size(F.filter(inner, lambda v: x >= v)) + 1)


def edge_bin(col, lo, hi, n: int) -> Column:
    """1-based histogram bin against the edges ``lo + i * ((hi - lo) / n)``.

    Same edges as an equal-width histogram over [lo, hi]: left-closed bins, the
    last bin closed, values outside give NULL, a zero-width range widened by 0.5.
    Where many rows share a range, ``bin_edges`` on its one row and ``bin_of`` give the same.
    """
    x = _c(col)
    lo_c = F.lit(float(lo)) if isinstance(lo, (int, float)) else _c(lo)
    hi_c = F.lit(float(hi)) if isinstance(hi, (int, float)) else _c(hi)
    same = lo_c == hi_c
    lo_e = F.when(same, lo_c - F.lit(0.5)).otherwise(lo_c)
    hi_e = F.when(same, hi_c + F.lit(0.5)).otherwise(hi_c)
    step = (hi_e - lo_e) / F.lit(float(n))
    idx = F.lit(1)
    for i in range(1, n):
        idx = idx + (x >= lo_e + F.lit(float(i)) * step).cast("int")
    return F.when((x >= lo_e) & (x <= hi_e), idx)


def edge_bin_sql(x: str, lo: str, hi: str, n: int) -> str:
    """DuckDB twin of ``edge_bin`` (for oracle SQL)."""
    lo_e = f"(CASE WHEN {lo} = {hi} THEN {lo} - 0.5E0 ELSE {lo} END)"
    hi_e = f"(CASE WHEN {lo} = {hi} THEN {hi} + 0.5E0 ELSE {hi} END)"
    step = f"(({hi_e} - {lo_e}) / {float(n)}E0)".replace(".0E0", ".0")
    terms = " + ".join(f"CAST({x} >= {lo_e} + {float(i)} * {step} AS INTEGER)" for i in range(1, n))
    return f"(CASE WHEN {x} >= {lo_e} AND {x} <= {hi_e} THEN 1 + {terms} END)"
