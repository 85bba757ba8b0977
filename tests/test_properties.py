"""Property tests (hypothesis) for the order-statistic helpers and histograms."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lendscope.operators import metrics as mv
from lendscope.operators import rollups as ru
from lendscope.operators.prefix import average_rank_table, exact_quantiles

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
values = st.lists(st.integers(min_value=-5, max_value=5).map(float), min_size=1, max_size=40)


def _pandas_rank_pct(vals):
    import pandas as pd
    return pd.Series(vals).rank(pct=True).tolist()


@SETTINGS
@given(values)
def test_average_rank_matches_pandas(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    table = {r["x"]: r["pct_rank"] for r in average_rank_table(df, "x", n_buckets=4).collect()}
    assert [table[v] for v in vals] == pytest.approx(_pandas_rank_pct(vals))


@SETTINGS
@given(values, st.lists(st.floats(min_value=0, max_value=1), min_size=1, max_size=4))
def test_exact_quantiles_match_numpy(spark, vals, probs):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r["p"]: r["q"] for r in exact_quantiles(df, "x", probs, n_buckets=3).collect()}
    for p in probs:
        assert got[float(p)] == pytest.approx(float(np.percentile(vals, p * 100)), abs=1e-9)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 6).map(float), st.integers(0, 1)), min_size=2, max_size=40))
def test_auc_complement(spark, rows):
    ys = {y for _, y in rows}
    df = spark.createDataFrame(rows, "s double, y int")
    a = mv.auc(df, "s", "y").collect()[0]["auc"]
    if len(ys) < 2:
        assert a is None
        return
    from pyspark.sql import functions as F
    b = mv.auc(df.withColumn("s", -F.col("s")), "s", "y").collect()[0]["auc"]
    assert a + b == pytest.approx(1.0)
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert a == pytest.approx(brute)


@SETTINGS
@given(st.lists(st.floats(min_value=-0.5, max_value=1.5, allow_nan=False), min_size=1, max_size=50))
def test_fixed_histogram_totals(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    h = ru.fixed_histogram(df, "p", 10, 0.0, 1.0).collect()
    assert len(h) == 10
    assert sum(r["count"] for r in h) == sum(1 for v in vals if 0.0 <= v <= 1.0)


def _brute_ks(ref, cur):
    pts = sorted(set(ref) | set(cur))
    f1 = lambda v: sum(1 for x in ref if x <= v) / len(ref)
    f2 = lambda v: sum(1 for x in cur if x <= v) / len(cur)
    return max(abs(f1(v) - f2(v)) for v in pts)


def _brute_psi(ref, cur, bins=10):
    lo, hi = min(ref), max(ref)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    edges = np.linspace(lo, hi, bins + 1)
    rc, _ = np.histogram(ref, bins=edges)
    cc, _ = np.histogram(cur, bins=edges)
    if cc.sum() == 0:
        return None
    r = np.maximum(rc / rc.sum(), 1e-10)
    c = np.maximum(cc / cc.sum(), 1e-10)
    return float(np.sum((c - r) * np.log(c / r)))


samples = st.lists(st.integers(0, 30).map(lambda v: v / 4.0), min_size=100, max_size=160)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(samples, samples)
def test_ks_and_psi_match_brute_force(spark, ref, cur):
    from lendscope.operators import drift as dr
    rows = [("f", "reference", v, None) for v in ref] + [("f", "current", v, None) for v in cur]
    long = spark.createDataFrame(rows, "feature string, sample string, value double, category string")
    r = dr.feature_drift(long, ["f"], with_p_values=False).collect()[0]
    assert r["ks_statistic"] == pytest.approx(_brute_ks(ref, cur))
    want = _brute_psi(ref, cur)
    assert (r["psi"] is None and want is None) or r["psi"] == pytest.approx(want, rel=1e-9, abs=1e-12)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "b", "c", "d"]), min_size=100, max_size=150),
       st.lists(st.sampled_from(["a", "b", "c", "e"]), min_size=100, max_size=150))
def test_chi_square_matches_numpy(spark, ref, cur):
    from lendscope.operators import drift as dr
    rows = [("g", "reference", None, v) for v in ref] + [("g", "current", None, v) for v in cur]
    long = spark.createDataFrame(rows, "feature string, sample string, value double, category string")
    got = dr.chi_square(long).collect()[0]
    cats = sorted(set(ref) | set(cur))
    rf = np.array([ref.count(c) for c in cats], dtype=float)
    cf = np.array([cur.count(c) for c in cats], dtype=float)
    exp = np.maximum(rf / rf.sum() * cf.sum(), 1e-10)
    assert got["chi2_statistic"] == pytest.approx(float(np.sum((cf - exp) ** 2 / exp)))
    assert got["degrees_of_freedom"] == len(cats) - 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 40).map(float), min_size=1, max_size=60),
       st.lists(st.integers(-5, 45).map(float), min_size=1, max_size=30))
def test_asof_rank_against_training_distribution(spark, train, score):
    from lendscope.operators.prefix import asof_rank
    tr = spark.createDataFrame([(v,) for v in train], "x double")
    sc = spark.createDataFrame([(i, v) for i, v in enumerate(score)], "id long, x double")
    fit = average_rank_table(tr, "x", n_buckets=4)
    got = {r["id"]: r["p"] for r in asof_rank(sc, "x", "p", fit, n_buckets=4).collect()}
    n = len(train)
    for i, v in enumerate(score):
        below = sum(1 for t in train if t < v)
        eq = sum(1 for t in train if t == v)
        want = (below + (eq + 1) / 2) / n if eq else below / n
        assert got[i] == pytest.approx(want)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 400)), min_size=1, max_size=60))
def test_chunked_sliding_count_matches_brute_force(spark, rows):
    import datetime as dt
    from lendscope.operators.windows import sliding_count
    t0 = dt.datetime(2024, 1, 1)
    data = [(i, k, t0 + dt.timedelta(seconds=s)) for i, (k, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "rid long, k long, ts timestamp_ntz")
    got = {r["rid"]: r["n"] for r in sliding_count(df, "k", "ts", 60, "n", chunk_seconds=100).collect()}
    for rid, k, ts in data:
        want = sum(1 for _, k2, t2 in data if k2 == k and ts - dt.timedelta(seconds=60) <= t2 <= ts)
        assert got[rid] == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 5)), min_size=1, max_size=60), st.integers(1, 4))
def test_salted_top_n_matches_brute_force(spark, rows, n):
    from pyspark.sql import functions as F
    from lendscope.operators.windows import top_n_per_key
    data = [(i, k, v) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "rid long, k long, v long")
    got = sorted((r["k"], r["rid"], r["rn"]) for r in
                 top_n_per_key(df, ["k"], [F.col("v").desc()], n, tie_cols=["rid"], salt=3).collect())
    want = []
    for k in {k for _, k, _ in data}:
        ordered = sorted([d for d in data if d[1] == k], key=lambda d: (-d[2], d[0]))[:n]
        want += [(k, d[0], i + 1) for i, d in enumerate(ordered)]
    assert got == sorted(want)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 1), min_size=5, max_size=80))
def test_stratified_split_exact_proportions(spark, labels):
    import math
    from lendscope.ml.training import stratified_split
    df = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "app_id long, y_default int")
    rows = stratified_split(df, "y_default", "app_id", 0.2, 5).collect()
    assert len(rows) == len(labels)
    for cls in (0, 1):
        mine = [r for r in rows if r["y_default"] == cls]
        assert sum(r["is_test"] for r in mine) == math.floor(len(mine) * 0.2)
        folds = [sum(1 for r in mine if r["fold"] == f) for f in range(5)]
        assert max(folds) - min(folds) <= 1 if mine else True


def test_psi_history_matches_brute_force(spark):
    """Monthly PSI against the fixed reference sample, numpy replica per period."""
    import datetime as dt
    from lendscope.operators import drift as dr
    rng = np.random.default_rng(7)
    ref = [float(x) for x in rng.normal(0, 1, 300)]
    per = {dt.datetime(2024, m, 1): [float(x) for x in rng.normal(0.3 * m, 1, 120)] for m in (1, 2, 3)}
    rows = [("f", "reference", None, v, None) for v in ref]
    rows += [("f", "current", p, v, None) for p, vals in per.items() for v in vals]
    long = spark.createDataFrame(rows, "feature string, sample string, month timestamp_ntz, value double, category string")
    got = {r["month"]: r["drift_score"] for r in dr.psi_history(long, "month").collect()}
    for p, vals in per.items():
        assert got[p] == pytest.approx(_brute_psi(ref, vals), rel=1e-9)
