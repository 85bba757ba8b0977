"""Formatting / JSON / validation helpers against the plain-Python semantics they mirror."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lendscope.functions import jsonx as jx
from lendscope.functions import text as tx
from lendscope.operators import quality as vq
from lendscope.operators import registry as rg


def py_large(v):
    if abs(v) >= 1e9:
        return f"{v / 1e9:.1f}B"
    if abs(v) >= 1e6:
        return f"{v / 1e6:.1f}M"
    if abs(v) >= 1e3:
        return f"{v / 1e3:.1f}K"
    return f"{v:.1f}"


def py_duration(t):
    if t < 60:
        return f"{t}s"
    if t < 3600:
        return f"{t // 60}m {t % 60}s" if t % 60 else f"{t // 60}m"
    if t < 86400:
        m = (t % 3600) // 60
        return f"{t // 3600}h {m}m" if m else f"{t // 3600}h"
    h = (t % 86400) // 3600
    return f"{t // 86400}d {h}h" if h else f"{t // 86400}d"


def py_size(b):
    for u in ["B", "KB", "MB", "GB", "TB"]:
        if b < 1024.0:
            return f"{b:.1f} {u}"
        b /= 1024.0
    return f"{b:.1f} PB"


def test_number_formats(spark):
    vals = [12.0, 999.0, 1234.0, 2_500_000.0, 7_300_000_000.0, -45_000.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(tx.format_large_number("v")).collect()]
    assert got == [py_large(v) for v in vals]
    got = [r[0] for r in df.select(tx.format_currency("v")).collect()]
    assert got[2] == "$1,234.00" and got[3] == "$2,500,000.00"
    got = [r[0] for r in df.select(tx.format_percentage(F.col("v") / 10000.0, 1)).collect()]
    assert got[0] == f"{12.0 / 10000 * 100:.1f}%"


def test_durations_sizes(spark):
    secs = [0, 45, 60, 185, 3600, 7800, 86400, 100800]
    df = spark.createDataFrame([(s,) for s in secs], "s long")
    assert [r[0] for r in df.select(tx.format_duration("s")).collect()] == [py_duration(s) for s in secs]
    sizes = [0, 1023, 1024, 1536, 5 * 1024 ** 3, 3 * 1024 ** 5]
    df2 = spark.createDataFrame([(s,) for s in sizes], "b long")
    assert [r[0] for r in df2.select(tx.file_size_human("b")).collect()] == [py_size(float(s)) for s in sizes]
    df3 = spark.createDataFrame([("1h",), ("30m",), ("45s",), ("2d",), ("15",), (" 5M ",)], "d string")
    assert [r[0] for r in df3.select(tx.parse_duration_seconds("d")).collect()] == [3600, 1800, 45, 172800, 15, 300]


def test_strings(spark):
    df = spark.createDataFrame([("a<b>c:d.txt",), (" .hidden name. ",), ("x" * 300 + ".csv",)], "f string")
    got = [r[0] for r in df.select(tx.clean_filename("f")).collect()]
    assert got[0] == "a_b_c_d.txt" and got[1] == "hidden name"
    assert len(got[2]) == 255 and got[2].endswith(".csv")
    df2 = spark.createDataFrame([("short",), ("a much longer sentence here",)], "t string")
    assert [r[0] for r in df2.select(tx.truncate_string("t", 10)).collect()] == ["short", "a much ..."]
    df3 = spark.createDataFrame([("avg_response_time",)], "m string")
    assert df3.select(tx.title_case_metric("m")).collect()[0][0] == "Avg Response Time"


def test_json_helpers(spark):
    df = spark.createDataFrame([('{"k": 3}',), ("not json",)], "j string")
    got = [r[0] for r in df.select(jx.safe_json("j", "k int")).collect()]
    assert got[0]["k"] == 3 and (got[1] is None or got[1]["k"] is None)
    h = spark.createDataFrame([({"Authorization": "x", "accept": "y"},)], "h map<string,string>")
    red = h.select(jx.redact_headers(F.col("h"))).collect()[0][0]
    assert red == {"Authorization": "[REDACTED]", "accept": "y"}
    nested = spark.createDataFrame([((1, (2, 3)),)], "a struct<x:int, b:struct<y:int, z:int>>")
    flat = jx.flatten(nested)
    assert flat.columns == ["a.x", "a.b.y", "a.b.z"]
    back = jx.unflatten(flat)
    assert back.collect()[0]["a"]["b"]["z"] == 3
    m = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "9", "c": "3"})], "l map<string,string>, r map<string,string>")
    assert m.select(jx.deep_merge_maps(F.col("l"), F.col("r"))).collect()[0][0] == {"a": "1", "b": "9", "c": "3"}
    ip = spark.createDataFrame([("1.2.3.4, 5.6.7.8", None, "h"), (None, None, None)], "f string, r string, h string")
    assert [r[0] for r in ip.select(jx.client_ip(F.col("f"), F.col("r"), F.col("h"))).collect()] == ["1.2.3.4", "unknown"]


def test_economic_validation(spark):
    as_of = F.lit("2024-06-10 00:00:00").cast("timestamp")
    snap = spark.createDataFrame([
        (5.25, 3.8, "2024-06-09T12:00:00Z", "real_market_data"),
        (25.0, 3.8, "2024-06-09T12:00:00", "fred_api"),
        (5.0, None, "2024-05-01T00:00:00+00:00", "made_up")],
        "fed_funds_rate double, unemployment_rate double, data_timestamp string, data_source string")
    v = vq.validate_economic(snap, as_of).collect()
    assert v[0]["is_valid"] and not v[1]["is_valid"] and "fed_funds_rate_range" in v[1]["errors"]
    assert not v[2]["is_fresh"] and not v[2]["is_authentic"]


def test_registry_upsert_and_best(spark):
    t0 = dt.datetime(2024, 1, 1)
    cur = spark.createDataFrame([("m", "v1", "a", t0), ("m", "v2", "b", t0)],
                                "model_name string, model_version string, note string, updated_at timestamp_ntz")
    upd = spark.createDataFrame([("m", "v2", "c", t0 + dt.timedelta(days=1))],
                                "model_name string, model_version string, note string, updated_at timestamp_ntz")
    out = {r["model_version"]: r["note"] for r in rg.upsert(cur, upd, ["model_name", "model_version"], "updated_at").collect()}
    assert out == {"v1": "a", "v2": "c"}
    long = spark.createDataFrame([("m", "v1", "accuracy", 0.8), ("m", "v2", "accuracy", 0.8),
                                  ("m", "v1", "response_time_ms", 50.0), ("m", "v2", "response_time_ms", 40.0),
                                  ("m", "v3", "accuracy", None)],
                                 "model_name string, model_version string, metric string, value double")
    best = {r["metric"]: r["best_version"] for r in rg.best_per_metric(long).collect()}
    assert best == {"accuracy": "v1", "response_time_ms": "v2"}


def test_metric_display_and_uptime(spark):
    df = spark.createDataFrame([("accuracy", 0.85), ("response_time", 0.25), ("prediction_time", 1.5), ("error_rate", 0.0123),
                                ("cpu_usage", 45.67), ("request_count", 12345.0), ("score", 0.5)], "m string, v double")
    got = [r[0] for r in df.select(tx.format_metric("m", "v")).collect()]
    assert got == ["0.8500 (85.0%)", "250.0ms", "1.50s", "1.23%", "45.7%", "12,345", "0.5000"]
    up = spark.createDataFrame([(90061,), (3720,), (59,), (86400,)], "s long")
    assert [r[0] for r in up.select(tx.format_uptime("s")).collect()] == ["1d 1h 1m", "1h 2m", "0m", "1d 0h 0m"]


def test_drift_status_and_recommendations(spark):
    from lendscope.operators import drift as dr
    df = spark.createDataFrame([(None,), (0.05,), (0.2,), (0.4,), (0.9,)], "s double")
    got = [tuple(r) for r in df.select(dr.drift_status(F.col("s")).alias("t"), dr.recommendations(dr.drift_status(F.col("s")))).collect()]
    assert got == [("insufficient_data", []), ("stable", ["Model performance is stable", "Continue regular monitoring"]),
                   ("minor_drift", []),
                   ("moderate_drift", ["Monitor closely and prepare for retraining", "Analyze prediction accuracy trends"]),
                   ("significant_drift", ["Consider retraining model with recent data",
                                          "Review feature importance and distributions"])]


def test_comparison_request_checks():
    rg.check_comparison_request(["v1", "v2"], ["pd_auc"])
    with pytest.raises(ValueError):
        rg.check_comparison_request(["v1", "v1"], ["pd_auc"])
    with pytest.raises(ValueError):
        rg.check_comparison_request(["v1", "v2"], ["pd_auc", "made_up"])


def test_lookup_flag_and_client_ids(spark):
    from lendscope.operators import rollups as ru
    log = spark.createDataFrame([(1, dt.datetime(2024, 1, 2), 0.2), (1, dt.datetime(2024, 1, 1), 0.4),
                                 (2, dt.datetime(2024, 1, 1), 0.1)], "request_id long, timestamp timestamp_ntz, pd double")
    r = ru.prediction_lookup(log, 1).collect()
    assert len(r) == 1 and r[0]["pd"] == 0.4 and r[0]["status"] == "completed"
    assert [x[0] for x in log.select(ru.critical_flag("pd", 0.15)).collect()] == [True, True, False]
    import hashlib
    ids = spark.createDataFrame([("key123", None, "10.0.0.1"), (None, "1.1.1.1, 2.2.2.2", "10.0.0.1"),
                                 (None, None, None)], "k string, f string, r string")
    got = [x[0] for x in ids.select(jx.short_client_id(F.col("k"), F.col("f"), F.col("r"))).collect()]
    assert got == [hashlib.md5(b"key123").hexdigest()[:16], "ip_1.1.1.1", "ip_unknown"]


def test_materialize_and_drop(spark):
    from lendscope.session import drop_materialized, drop_tables, materialize
    df = materialize(spark.range(10).withColumnRenamed("id", "x"), ["x"])
    assert df.count() == 10
    other = materialize(spark.range(3))
    drop_tables(df, other.select("id"), spark.range(2))
    assert other.count() == 3
    with pytest.raises(Exception):
        df.count()
    assert drop_materialized(spark)


def test_size_for_input(spark):
    from lendscope.session import size_for_input
    before = spark.conf.get("spark.sql.shuffle.partitions")
    s = size_for_input(spark, 100 * (1 << 40), cores=8000)
    assert int(s["spark.sql.shuffle.partitions"]) == 409600
    assert s["spark.sql.files.maxPartitionBytes"] == str(256 * 1024 * 1024)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_result_envelope_and_verdict(spark):
    from lendscope.sources.adapters import credit_applications
    apps = credit_applications(spark, "/root/testdata/sf0.001")
    v = vq.batch_verdict(vq.apply_rules(apps, vq.application_rules()))
    as_of = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    ok = vq.result_envelope(v, "credit", as_of).collect()[0]
    bad = vq.result_envelope(v, "unknown", as_of).collect()[0]
    assert ok["version"] == "1.0.0" and ok["is_valid"] == ok["all_valid"]
    assert bad["is_valid"] is False
    sp = vq.suspicious_patterns(apps, ["loan_term", "loan_amount"], strict=True).collect()
    flags = {r["column"]: r["suspicious"] for r in sp}
    assert flags["loan_term"] is True      # whole numbers only: flagged in strict mode (D-05)


def test_compare_versions_reports_unknown(spark):
    reg = spark.createDataFrame([("v1", "active"), ("v2", "inactive")], "model_version string, status string")
    stats = spark.createDataFrame([("v1", 10)], "model_version string, total_predictions long")
    rows, missing = rg.compare_versions(reg, stats, ["v1", "v2", "v9"])
    got = {r["model_version"]: r["total_predictions"] for r in rows.collect()}
    assert got == {"v1": 10, "v2": None}
    assert [r[0] for r in missing.collect()] == ["v9"]
