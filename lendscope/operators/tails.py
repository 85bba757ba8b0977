"""Distribution tails for test statistics, evaluated on tiny per-feature tables.

Only one number per (feature, test) reaches these functions, so a vectorised
pandas UDF over the result table is enough.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def kolmogorov_sf(x: float) -> float:
    """Survival function of the limiting Kolmogorov distribution."""
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return float("nan")
    if x <= 0:
        return 1.0
    if x < 0.2:
        return 1.0
    total = 0.0
    for k in range(1, 101):
        term = 2.0 * (-1) ** (k - 1) * math.exp(-2.0 * k * k * x * x)
        total += term
        if abs(term) < 1e-16:
            break
    return min(max(total, 0.0), 1.0)


def _gammainc_lower_reg(a: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = 1.0 / a
        s = term
        n = 1
        while n < 10000:
            term *= x / (a + n)
            s += term
            if abs(term) < abs(s) * 1e-15:
                break
            n += 1
        return s * math.exp(-x + a * math.log(x) - math.lgamma(a))
    return 1.0 - _gammainc_upper_reg_cf(a, x)


def _gammainc_upper_reg_cf(a: float, x: float) -> float:
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(stat: float, dof: float) -> float:
    """Upper tail of the chi-square distribution."""
    if stat is None or dof is None or dof <= 0 or math.isnan(stat):
        return float("nan")
    a, x = dof / 2.0, stat / 2.0
    if x <= 0:
        return 1.0
    if x < a + 1:
        return 1.0 - _gammainc_lower_reg(a, x)
    return _gammainc_upper_reg_cf(a, x)


@F.pandas_udf(DoubleType())
def ks_pvalue_udf(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    en = np.sqrt(n1.astype(float) * n2.astype(float) / (n1.astype(float) + n2.astype(float)))
    return pd.Series([kolmogorov_sf(float(e * v)) if pd.notna(v) else float("nan") for e, v in zip(en, d)])


@F.pandas_udf(DoubleType())
def chi2_pvalue_udf(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(float(s), float(k)) if pd.notna(s) and pd.notna(k) else float("nan")
                      for s, k in zip(stat, dof)])


def ks_pvalue(d: Column, n1: Column, n2: Column) -> Column:
    p = ks_pvalue_udf(d, n1, n2)
    return F.when(F.isnan(p), F.lit(None).cast("double")).otherwise(p)


def chi2_pvalue(stat: Column, dof: Column) -> Column:
    p = chi2_pvalue_udf(stat, dof)
    return F.when(F.isnan(p), F.lit(None).cast("double")).otherwise(p)
