"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into 1, 4, 16, ... segments; a segment keeps its mean and deviation.  For two
segments of length n, ||a - b||^2 >= n ((mean_a - mean_b)^2 + (dev_a - dev_b)^2), so the sums over
the segments are lower bounds of the distance that grow tighter with the resolution.  In terms of
the inner product, <a, b> = (||a||^2 + ||b||^2 - ||a - b||^2) / 2, the bound says
<a, b> <= sum n (mean_a mean_b + dev_a dev_b): a product of two short vectors.  Levels go coarse to
fine, pairs whose bound lies below the query's k-th best score so far go, and survivors get exact
products.  Every row is scored against every query in blocks (``vector_blocks``, which states the
defined results); nothing is approximate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm import vector_blocks as vb

LEVELS = (1, 4, 16, 32)      # segments
DENSE = 0.25                 # share of pairs above which a whole block is cheaper than single pairs
SLACK = 1e-9                 # rounding of the bounds, relative to the norms


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(n) * mean and sqrt(n) * deviation of each segment: inner products of these bound those of the vectors."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    n = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / n
    gap = x - np.repeat(mean, n, axis=1)
    dev = np.sqrt(np.add.reduceat(gap * gap, edges[:-1], axis=1))
    return np.concatenate([mean * np.sqrt(n), dev], axis=1)


def bounded_products(q: np.ndarray, x: np.ndarray, lowest: np.ndarray) -> np.ndarray:
    """Exact products of the pairs that can reach the query's ``lowest``; LEAST for the others."""
    out = np.full((len(q), len(x)), vb.LEAST, np.int64)
    levels = [n for n in LEVELS if 2 * n <= q.shape[1]]
    norms = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :] if q.size and x.size else np.zeros(out.shape)
    if not np.isfinite(norms).all():
        levels = []                                  # squares beyond doubles: no bounds
    need = lowest[:, None].astype(np.float64)
    need = need - SLACK * np.maximum(norms, np.abs(need)) - 1e-3
    alive = np.ones(out.shape, bool)
    for n in levels:
        sq, sx = statistics(q, n), statistics(x, n)
        if alive.mean() > DENSE:
            alive &= sq @ sx.T >= need
        else:
            i, j = np.nonzero(alive)
            alive[i, j] = np.einsum("ij,ij->i", sq[i], sx[j]) >= need[i, j]
        if not alive.any():
            return out
    if alive.mean() > DENSE or _wide(q, x):
        out[alive] = vb.exact_products(q, x)[alive]
    else:
        i, j = np.nonzero(alive)
        out[i, j] = np.einsum("ij,ij->i", q[i], x[j]).astype(np.int64)
    return out


def _wide(q: np.ndarray, x: np.ndarray) -> bool:
    return float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1]) >= 2.0 ** 53


def top_k(vectors: DataFrame, k: int = 5, divisor: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the first ``k`` rows of every row whose id is divisible by ``divisor``.

    Highest inner product first, ties to the smaller id.  Rows, nulls, repeats and lengths: see
    ``vector_blocks``.  An empty table gives an empty result; other columns are not read."""
    table = vb.slices(vb.valid_rows(vectors, id_col, vector_col))
    asking = vb.queries(table, divisor)
    found = vb.search(asking, vb.one_ask(asking), table, bounded_products, k)
    return found.select(F.col("q_id").alias("query_id"), F.col("rank").cast("int").alias("rank"),
                        F.col("c_id").alias("vec_id"), "score")
