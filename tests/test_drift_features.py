"""The drift history holds every feature of the book."""

import datetime as dt
import math
from collections import Counter

import pytest

from lendscope.operators import drift as dr
from lendscope.plans.drift import FLOAT_FEATURES, drift_history
from lendscope.sources import adapters as ad


def _share_psi(ref, cur):
    r, c = Counter(ref), Counter(cur)
    out = 0.0
    for k in r.keys() | c.keys():
        a, b = max(r[k] / len(ref), 1e-10), max(c[k] / len(cur), 1e-10)
        out += (b - a) * math.log(b / a)
    return out


def test_drift_history_has_all_features(spark, tmp_path):
    rows = [(k, k % 9 + 1, 1000.0 + 37 * (k * k % 101), dt.datetime(1998, 1, 1) if k % 3 else dt.datetime(2000, 1 + k % 2, 5), f"{k % 5 + 1}-X")
            for k in range(1, 400)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string") \
        .write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(c, 100.0 * c, "BUILDING") for c in range(1, 10)], "c_custkey long, c_acctbal double, c_mktsegment string") \
        .write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r["feature"], r["month"]): r["drift_score"] for r in drift_history(spark, str(tmp_path)).collect()}
    months = [dt.datetime(2000, 1, 1), dt.datetime(2000, 2, 1)]
    assert set(got) == {(f, m) for f in ad.CONTINUOUS_FEATURES + ad.CATEGORICAL_FEATURES for m in months}

    def term(k):
        return ad.LOAN_TERMS[k % 10]
    for m in months:     # ten distinct terms: compared by their values
        want = _share_psi([term(r[0]) for r in rows if r[3].year == 1998], [term(r[0]) for r in rows if r[3].year == 2000 and r[3].month == m.month])
        assert got["loan_term", m] == pytest.approx(want, abs=1e-8)


def test_history_routes_numbers_by_their_distinct_reference_values(spark):
    month, rows = dt.datetime(2024, 1, 1), []
    for f, n in (("few", 20), ("many", 21), (FLOAT_FEATURES[0], 5)):
        rows += [(f, "reference", None, float(i % n), None) for i in range(420)]
        rows += [(f, "current", month, float(i % 7), None) for i in range(140)] + [(f, "current", month, 500.0, None)]
    long = spark.createDataFrame(rows, "feature string, sample string, month timestamp_ntz, value double, category string")
    got = {r["feature"]: r["drift_score"] for r in dr.psi_history(long, "month", float_features=FLOAT_FEATURES).collect()}
    plain = {r["feature"]: r["drift_score"] for r in dr.psi_history(long, "month").collect()}
    assert got["few"] == pytest.approx(_share_psi([i % 20 for i in range(420)], [i % 7 for i in range(140)] + [500]))
    assert got["few"] != pytest.approx(plain["few"])
    assert got["many"] == pytest.approx(plain["many"]) and got[FLOAT_FEATURES[0]] == pytest.approx(plain[FLOAT_FEATURES[0]])
