"""Alert intervals, predicates as text, plug-in detectors, JSON merge and performance records against plain Python."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendscope.functions import jsonx as jx
from lendscope.operators import alerts as al
from lendscope.operators import drift as dr
from lendscope.operators import registry as rg

T0 = dt.datetime(2024, 1, 1)


def _at(m):
    return None if m is None else T0 + dt.timedelta(minutes=m)


def test_status_at_any_time(spark):
    rnd = random.Random(5)
    events = []
    for a in range(40):
        events.append((a, "active", "system", None, 0, 0))
        for k in range(rnd.randint(0, 5)):
            status = rnd.choice(["acknowledged", "suppressed", "suppressed", "resolved", "active"])
            t = rnd.randint(0, 12) * 10
            until = rnd.choice([None, t - 10, t + 15, t + 60]) if status == "suppressed" else None
            events.append((a, status, "u", until, t, k + 1))
    frame = spark.createDataFrame([(f"a{a}", s, u, _at(x), _at(t), q) for a, s, u, x, t, q in events],
                                  "alert_id string, status string, actor string, suppressed_until timestamp_ntz, "
                                  "event_ts timestamp_ntz, seq int")
    times = [-5, 0, 25, 55, 60, 119, 500]
    got = {(r["alert_id"], r["as_of"]): (r["status"], r["is_active"]) for r in al.status_as_of(
        al.status_intervals(frame), [str(_at(t)) for t in times]).collect()}
    want = {}
    for t in times:
        for a in range(40):
            seen = [e for e in events if e[0] == a and e[4] <= t]
            if seen:
                _, status, _, until, _, _ = max(seen, key=lambda e: (e[4], e[5]))
                status = "active" if status == "suppressed" and until is not None and until <= t else status
                want[f"a{a}", _at(t)] = (status, status != "resolved")
    assert got == want


@pytest.fixture(scope="module")
def ticks(spark):
    return spark.createDataFrame([(T0, 1.0, 5, "a"), (_at(1), None, 7, "b"), (_at(2), 3.0, 2, None)],
                                 "ts timestamp_ntz, x double, n int, s string")


def test_predicates_as_text(spark, ticks):
    rules = {"r1": "x > 2", "r2": "n BETWEEN 3 AND 6 OR s LIKE 'b%'", "r3": "x IS NULL AND NOT (n IN (1, 2))",
             "r4": "CASE WHEN s = 'a' THEN abs(-x) ELSE coalesce(x, 0) END >= 1"}
    got = {(r["name"], r["ts"].minute): r["violated"] for r in al.match_predicates(ticks, "ts", rules).collect()}
    assert got == {("r1", 0): False, ("r1", 1): False, ("r1", 2): True, ("r2", 0): True, ("r2", 1): True, ("r2", 2): False,
                   ("r3", 0): False, ("r3", 1): True, ("r3", 2): False, ("r4", 0): True, ("r4", 1): False, ("r4", 2): True}


@pytest.mark.parametrize("text", [
    "rand() > 0.5", "max(x) > 1", "x > (SELECT 1)", "EXISTS (SELECT 1)", "java_method('java.lang.System', 'getProperty', 'user.home') = ''",
    "reflect('java.lang.Runtime', 'getRuntime') = ''", "explode(array(true, false))", "row_number() OVER (ORDER BY x) > 1",
    "given_udf(x)", "raise_error('no')", "x", "n + 1", "current_user() = 'root'", "transform(array(x), v -> v > 1)[0]"])
def test_forbidden_predicates_are_refused(spark, ticks, text):
    spark.udf.register("given_udf", lambda v: True, "boolean")
    with pytest.raises(al.ForbiddenPredicate):
        al.checked_predicate(ticks, text)


def _samples(spark, ref, cur, feature="f"):
    rows = [(feature, "reference", float(v)) for v in ref] + [(feature, "current", float(v)) for v in cur]
    return spark.createDataFrame(rows, "feature string, sample string, value double").withColumn("category", F.lit(None).cast("string"))


def _distance(a, b):
    x = np.unique(np.concatenate([a, b]))
    cdf = [np.searchsorted(np.sort(s), x, side="right") / len(s) for s in (a, b)]
    return float((np.abs(cdf[0] - cdf[1])[:-1] * np.diff(x)).sum())


def test_wasserstein_and_dispatch_by_name(spark):
    rnd = np.random.default_rng(4)
    sets = {"n": (rnd.normal(size=400), rnd.normal(0.7, 2, size=300)), "c": (np.array([5.0] * 200), np.array([5.0] * 90 + [8.0] * 10)),
            "s": (np.arange(50.0), np.arange(50.0)), "one": (np.array([1.0]), np.array([4.5]))}
    long = None
    for name, (a, b) in sets.items():
        s = _samples(spark, a, b, name)
        long = s if long is None else long.union(s)
    got = {(r["feature"], r["detector"]): r["drift_score"] for r in dr.run_detectors(["wasserstein", "ks_test"], long).collect()}
    for name, (a, b) in sets.items():
        assert got[name, "wasserstein"] == pytest.approx(_distance(a, b), abs=1e-9)
    assert got["one", "wasserstein"] == 3.5 and got["s", "ks_test"] == 0.0
    with pytest.raises(ValueError, match="unknown detector"):
        dr.run_detector("no_such", long)


def test_own_detector(spark):
    def mean_gap(values):
        v = dr.value_table(values) if "ref" not in values.columns else values
        mean = [F.sum(F.col("value") * F.col(c)) / F.sum(c) for c in ("ref", "cur")]
        return v.groupBy("feature").agg(F.abs(mean[0] - mean[1]).alias("gap"))

    dr.register_detector("mean_gap", mean_gap, "gap")
    try:
        out = dr.run_detectors(["mean_gap", "wasserstein"], _samples(spark, [1, 2, 3], [3, 4, 5])).collect()
        assert {r["detector"]: r["drift_score"] for r in out} == {"mean_gap": 2.0, "wasserstein": 2.0}
    finally:
        del dr.DETECTORS["mean_gap"]


def _merge(a, b):
    return {**a, **{k: _merge(a[k], v) if isinstance(a.get(k), dict) and isinstance(v, dict) else v for k, v in b.items()}}


def test_deep_merge_equals_recursion(spark):
    rnd = random.Random(9)

    def tree(depth):
        if depth == 0 or rnd.random() < 0.25:
            return rnd.choice([1, 2.5, "text", None, True, [1, {"a": 2}], [], {}])
        return {k: tree(depth - 1) for k in rnd.sample("abcd", rnd.randint(1, 3))}

    pairs = [({"k": tree(4)}, {"k": tree(4), "é\"": tree(1)}) for _ in range(150)]
    rows = [(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)]
    rows += [(900, None, '{"a": 1}'), (901, '{"a": 1}', None), (902, None, None), (903, "[1]", '{"a": 1}'), (904, '{"a": 1}', "3")]
    frame = spark.createDataFrame(rows, "i int, l string, r string")
    got = {r["i"]: None if r["m"] is None else json.loads(r["m"])
           for r in frame.select("i", F.to_json(jx.deep_merge(F.col("l"), F.col("r"))).alias("m")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == _merge(a, b)
    assert (got[900], got[901], got[902], got[903], got[904]) == ({"a": 1}, {"a": 1}, None, {"a": 1}, 3)


def test_deep_merge_refuses_what_is_too_deep(spark):
    frame = spark.createDataFrame([('{"a":{"b":{"c":1}}}', '{"a":{"b":{"d":2}}}')], "l string, r string")
    assert json.loads(frame.select(F.to_json(jx.deep_merge(F.col("l"), F.col("r"), 3))).first()[0]) == {"a": {"b": {"c": 1, "d": 2}}}
    with pytest.raises(Exception, match="nested deeper"):
        frame.select(F.to_json(jx.deep_merge(F.col("l"), F.col("r"), 2))).collect()


def test_performance_record(spark):
    metrics = [json.dumps({"accuracy_metrics": {"auc": 0.8}, "business_metrics": {"el": 0.1}, "other": {"x": 1}}), None, "not json"]
    reg = spark.createDataFrame([("m", f"v{i}", "active", T0, j) for i, j in enumerate(metrics)],
                                "model_name string, model_version string, status string, updated_at timestamp_ntz, performance_metrics string")
    stats = spark.createDataFrame([("v0", 10), ("v9", 3)], "model_version string, total_predictions long")
    rows = {r["model_version"]: r for r in rg.performance_record(reg, stats, ["v0", "v9", "v1", "v2", "v0"]).collect()}
    assert len(rows) == 4 and [rows[v]["position"] for v in ("v0", "v9", "v1", "v2")] == [0, 1, 2, 3]
    assert rows["v0"]["accuracy_metrics"] == {"auc": 0.8} and rows["v0"]["validation_results"] == {} and rows["v0"]["total_predictions"] == 10
    assert rows["v1"]["accuracy_metrics"] == rows["v2"]["accuracy_metrics"] == {} and rows["v1"]["error"] is None
    assert rows["v9"]["error"] == "Model version v9 not found" and rows["v9"]["total_predictions"] is None


def test_active_model_and_history(spark):
    reg = spark.createDataFrame([("m", "v1", "t", "active", '{"a": 1.5}', T0, _at(1)), ("m", "v2", "t", "active", '{"a": 2.5}', T0, _at(2)),
                                 ("m", "v3", "t", "inactive", "{}", T0, _at(3))], rg.REGISTRY_SCHEMA)
    row = rg.active_model_info(reg, "m", ["x", "y"]).collect()[0]
    assert (row["model_version"], row["feature_count"], row["metrics"]) == ("v2", 2, {"a": 2.5})
    assert rg.active_model_info(reg, "none", []).collect() == []
    hist = spark.createDataFrame([("m", "v1", T0, 0.5, None), ("m", "v1", T0 - dt.timedelta(days=40), 0.4, 1.0), ("o", "v1", T0, 0.1, 1.0)],
                                 "model_name string, model_version string, timestamp timestamp_ntz, acc double, ms double")
    got = rg.performance_history(hist, ["acc", "ms"], "m", str(T0)).collect()
    assert [(r["metric_name"], r["metric_value"], r["timestamp"]) for r in got] == [("acc", 0.5, T0)]


def test_health_issues(spark):
    from lendscope.operators import health as hl
    rows = [(0.05, 0.0, 10.0, 10.0, 0.9), (0.5, 0.05, 50.0, 85.0, 0.7), (None, 0.125, 95.0, None, 0.85)]
    df = spark.createDataFrame(rows, "api_response_time double, error_rate double, cpu_usage double, memory_usage double, model_accuracy double")
    a, b, c = hl.health_b(df).collect()
    assert (a["health_score"], a["status"], a["issues"]) == (100, "excellent", [])
    assert b["issues"] == ["Api Response Time is above target (0.50)", "Error Rate is critical (0.05)", "Cpu Usage is above target (50.00)",
                           "Memory Usage is critical (85.00)", "Model Accuracy is critical (0.70)"]
    assert c["issues"] == ["Error Rate is critical (0.12)", "Cpu Usage is critical (95.00)", "Model Accuracy is below target (0.85)"]
    got = hl.health_c(df.withColumn("up", F.col("error_rate") < 0.1), F.col("up"), F.lit(False)).collect()
    assert (got[0]["health_score"], got[0]["status"], got[0]["issues"]) == (75, "warning", ["Database not initialized"])
    assert (got[2]["health_score"], got[2]["status"]) == (25, "critical")
    assert got[2]["issues"] == ["High CPU usage: 95.0%", "API server not running", "Database not initialized"]
    drift = hl.health_a(df.select("error_rate", F.lit(0.1).alias("avg_response_time"), F.lit(1.0).alias("memory_usage"), "cpu_usage",
                                  F.lit(0).alias("critical_alerts"), (F.col("error_rate") > 0.1).alias("d")), "d").collect()
    assert (drift[0]["health_score"], drift[0]["issues"]) == (100, [])
    assert (drift[2]["health_score"], drift[2]["status"], drift[2]["issues"][-1]) == (35, "critical", "Performance drift detected")


def test_calendar_with_a_wrong_date(spark):
    from lendscope.operators import rollups as ru
    far = T0 + dt.timedelta(days=70)
    b = spark.createDataFrame([("a", T0, 1), ("a", far, 2), ("b", _at(5), 3)], "k string, t timestamp_ntz, n int")
    got = ru.gap_fill(b, "t", 60, {"n": 0}, ["k"])
    assert got.where("k = 'b'").count() == 1 and got.where("k = 'a'").count() == 70 * 1440 + 1
    assert got.agg(F.sum("n"), F.count_distinct("t")).first() == (6, 70 * 1440 + 1)


def test_texts(spark):
    from lendscope.functions import text as tx
    df = spark.createDataFrame([(1, 1234567.5, 0.12345, ["a", "b"], "executive", "more"), (None, None, None, None, "other", None)],
                               "i int, amount double, share double, factors array<string>, who string, ctx string")
    block = tx.profile_text("P", [("Id", F.col("i"), "text"), ("Amount", F.col("amount"), "currency"), ("Count", F.col("i") * 5000, "currency"),
                                  ("Share", F.col("share"), "percent"), ("Ratio", F.col("share"), "ratio"), ("Factors", F.col("factors"), "list")])
    a, b = [r[0] for r in df.select(block).collect()]
    assert a == "P:\n- Id: 1\n- Amount: $1,234,567.5\n- Count: $5,000\n- Share: 12.35%\n- Ratio: 0.12\n- Factors: a, b"
    assert b == "P:\n- Id: N/A\n- Amount: N/A\n- Count: N/A\n- Share: N/A\n- Ratio: N/A\n- Factors: "
    a, b = [r[0] for r in df.select(tx.with_context(tx.for_audience(F.lit("t"), F.col("who")), F.col("ctx"))).collect()]
    assert a == "t\n\nAUDIENCE FOCUS: Provide high-level strategic perspective with actionable recommendations.\n\nADDITIONAL CONTEXT:\nmore"
    assert b == "t"


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 7), (3, None, 9)], "i int, s string, n int")

    def ids(wanted):
        return [r["i"] for r in df.where(rg.filters(wanted)).collect()]

    assert ids({"s": ["a", "b"], "n": (5, 6)}) == [1] and ids({"n": (None, 7)}) == [1, 2] and ids({"n": (7, None)}) == [2, 3]
    assert ids({"s": "b"}) == [2] and ids({}) == [1, 2, 3] and ids({"s": []}) == []


def test_drift_sections(spark):
    rows = [(_at(60 * h + m), t, s) for h in range(5) for m, t, s in ((0, "feature_drift_x", 0.1 * h), (30, "feature_drift_x", 0.0), (0, "performance_drift", h * 1.0))]
    got = dr.drift_sections(spark.createDataFrame(rows, "timestamp timestamp_ntz, drift_type string, drift_score double"), 4).collect()
    assert {r["section"]: r["value"] for r in got if r["timestamp"] is None} == {"total": 15.0, "feature": 10.0, "performance": 5.0}
    assert len([r for r in got if r["section"] == "trend"]) == 10 and sum(r["value"] for r in got if r["section"] == "trend") == 15
    assert [(r["timestamp"], r["drift_type"]) for r in got if r["section"] == "recent"] == [
        (_at(270), "feature_drift_x"), (_at(240), "feature_drift_x"), (_at(240), "performance_drift"), (_at(210), "feature_drift_x")]


def test_card_file_leaves_out_unreadable_rows(spark, tmp_path):
    from lendscope.sources import files as sf
    (tmp_path / "cards.csv").write_text("ID,LIMIT_BAL,BILL_AMT1,PAY_0,PAY_2,EDUCATION,default payment next month\n"
                                        "1,1000,500,1,0,2,1\n2,abc,500,0,0,2,0\nx,1000,500,0,0,2,0\n4,,,,,,\n5,1000.0,20,0,0,2.0,0.0\n")
    got = {r["customer_id"]: r for r in sf.credit_card_defaults(spark, str(tmp_path / "cards.csv")).collect()}
    assert sorted(got) == ["CC_1", "CC_4", "CC_5"] and got["CC_1"]["is_default"] and not got["CC_5"]["is_default"]
    assert got["CC_4"]["loan_amount"] == 10000.0 and got["CC_4"]["income"] == 100000.0
