"""Stream queries give the same on one file, on many parts and with small Arrow batches."""

import datetime as dt
import os
import shutil
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL

STREAMS = ["stream_api_windows", "stream_hourly_requests", "stream_rate_admission", "stream_request_dedup",
           "stream_drift_check", "stream_scoring_decisions", "stream_alert_evaluations"]


@pytest.fixture(scope="module")
def parts_dir(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("parts")
    for t in ("events", "orders"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").repartition(8).write.parquet(f"{out}/{t}.parquet")
    shutil.copy(f"{SF_SMALL}/customer.parquet", out)
    assert len([f for f in os.listdir(f"{out}/events.parquet") if f.endswith(".parquet")]) == 8
    return str(out)


@pytest.mark.parametrize("name", STREAMS)
def test_same_on_many_parts_and_small_batches(spark, parts_dir, name):
    q = E.queries()[name]
    one = sorted(map(str, q(spark, SF_SMALL).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert sorted(map(str, q(spark, parts_dir).collect())) == one and one
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _requests(spark, path, files):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(7, i, t0 + dt.timedelta(seconds=(i * 37) % 3600)) for i in range(600)]
    rows.sort(key=lambda r: r[2])
    per = -(-len(rows) // files)
    for k in range(files):       # one file after the other, in order of time
        spark.createDataFrame(rows[k * per:(k + 1) * per], "client_id long, request_id long, ts timestamp").coalesce(1).write.mode(
            "append").parquet(str(path))
    return rows


@pytest.mark.parametrize("files", [1, 4])
def test_admission_in_time_order_over_batches_and_epochs(spark, tmp_path, files):
    from lendscope.streaming import jobs as sj
    rows = _requests(spark, tmp_path / "src", files)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        schema = "client_id long, request_id long, ts timestamp"
        stream = sj.event_stream(spark, str(tmp_path / "src"), schema, max_files=1)
        got = {r.request_id: r.allowed for r in sj.sliding_admission(stream, limit=5, window_s=60).collect()}
        table = spark.read.schema(schema).parquet(str(tmp_path / "src"))
        once = {r.request_id: r.allowed for r in sj.sliding_admission(table, limit=5, window_s=60).collect()}
        kept = {r.request_id for r in sj.dedup_requests(
            sj.event_stream(spark, str(tmp_path / "src"), schema, max_files=1).withColumn("h", F.lit("x")), "h", "ts", 300).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    log, want, last, first = [], {}, None, set()
    for _, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        log = [x for x in log if x >= t - dt.timedelta(seconds=60)]
        want[i] = len(log) < 5
        log += [t] if want[i] else []
        if last is None or t - last >= dt.timedelta(seconds=300):
            last = t
            first.add(i)
    assert got == want == once and sum(want.values()) < 600
    assert kept == first


# --- bounded state, late rows, restarts ------------------------------------------------------------

def _parts(spark, path, files, mixed=False):
    """The events in ``files`` files: in order of time, or dealt at random."""
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    if mixed:
        ev.repartition(files).write.parquet(str(path))
        return ev
    rows = ev.orderBy("ts").collect()
    per = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * per:(k + 1) * per], ev.schema).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.02)                   # a file source takes files in order of their times
    return ev


def _windows(s):
    from lendscope.streaming import jobs as sj
    return sj.tumbling_api_metrics(s)


def _api(spark, path, schema, max_files=1):
    from lendscope.streaming import jobs as sj
    return sj.api_stream(sj.event_stream(spark, str(path), schema, max_files=max_files))


def test_windows_leave_the_state(spark, tmp_path):
    from lendscope.streaming import jobs as sj
    ev = _parts(spark, tmp_path / "src", 15)
    got = sj.run_to_end(_api(spark, tmp_path / "src", ev.schema), "ts", _windows, "w", due=sj.window_end("ts", "5 minutes"))
    assert got.late.count() == 0 and got.rows.agg(F.sum("requests")).first()[0] == 1000
    assert got.rows.count() == ev.select(F.window("ts", "5 minutes")).distinct().count()
    per_file = max(r["count"] for r in ev.withColumn("d", F.ntile(15).over(Window.orderBy("ts"))).groupBy("d").count().collect())
    assert max(got.state_rows) <= per_file + 3 and got.state_rows[-1] == 0      # not one row for each window of the month


@pytest.mark.parametrize("window, build", [("5 minutes", "windows"), ("1 hour", "hours"), (None, "keys")])
def test_every_row_is_counted_or_late(spark, tmp_path, window, build):
    from lendscope.streaming import jobs as sj
    from lendscope.streaming import keyed as ky
    ev = _parts(spark, tmp_path / "src", 5, mixed=True)
    api = _api(spark, tmp_path / "src", ev.schema)
    make = {"windows": _windows, "hours": lambda s: sj.hourly_counts(s, "ts", "endpoint"),
            "keys": lambda s: ky.in_event_order(s, ["client_id"], "ts", {"request_id": "bigint"}, lambda k, r: ky.LastAccepted(0),
                                                sj.DECIDED, "request_id", 60)}[build]
    got = sj.run_to_end(api, "ts", make, "late", due=None if window is None else sj.window_end("ts", window), keep=["request_id", "ts"])
    late = {r["request_id"] for r in got.late.collect()}
    assert 0 < len(late) < 1000 and got.late.columns == ["request_id", "ts"]
    if build == "keys":
        assert {r["request_id"] for r in got.rows.collect()} == {r["event_id"] for r in ev.collect()} - late
    else:
        column = "requests" if build == "windows" else "count"
        assert got.rows.agg(F.sum(column)).first()[0] + len(late) == 1000


@pytest.mark.parametrize("files, stop_after", [(1, None), (8, None), (8, 3)])
def test_alerts_on_a_stream_equal_those_of_the_table(spark, tmp_path, files, stop_after):
    """One file, eight files, and eight files with a stop between: the same firings as ``alert_evaluations``."""
    from lendscope.operators import alerts as al
    from lendscope.streaming import jobs as sj
    ev = _parts(spark, tmp_path / "all", files)
    src, base = tmp_path / "src", sj.work_dir(spark, "restart")
    src.mkdir()
    names = sorted((f for f in os.listdir(tmp_path / "all") if f.endswith(".parquet")), key=lambda f: os.path.getmtime(tmp_path / "all" / f))
    for part, close in ([(names[:stop_after], False), (names[stop_after:], True)] if stop_after else [(names, True)]):
        for f in part:
            shutil.copy2(tmp_path / "all" / f, src)
        got = sj.stream_alerts(_api(spark, src, ev.schema), al.rules_table(spark), base=base, close=close)
    fired = [(r["name"], r["ts"], r["failures"]) for r in got.rows.where("fired").collect()]
    want = [(r["name"], r["ts"]) for r in E.queries()["alert_evaluations"](spark, SF_SMALL).collect()]
    assert sorted((n, t) for n, t, _ in fired) == sorted(want) and len(want) > 5 and got.late.count() == 0
    assert all(n == 0 for _, _, n in fired)


def test_rule_machine_takes_ticks_in_order_of_time(spark, tmp_path):
    """Ticks of two rules in files dealt at random within one batch, against a plain replay."""
    from lendscope.streaming import jobs as sj
    from lendscope.streaming import keyed as ky
    t0, schema = dt.datetime(2024, 1, 1), ("name string, ts timestamp, metric_name string, value double, threshold double, "
                                          "severity string, alert_type string, consecutive_failures int, cooldown_period int, violated boolean")
    rows = [(n, t0 + dt.timedelta(minutes=30 * i), "m", float(i), 0.5, "high", "system", need, cool, i % 7 not in (0, 3))
            for n, need, cool in (("a", 2, 3600), ("b", 1, 7200)) for i in range(60)]
    spark.createDataFrame(rows + [("c", None, "m", 1.0, 0.5, "high", "system", 1, 0, True)], schema).repartition(6).write.parquet(
        str(tmp_path / "src"))
    got = sj.run_to_end(spark.readStream.schema(schema).parquet(str(tmp_path / "src")), "ts", ky.rules_on_stream, "m").rows.collect()
    for name, need, cool in (("a", 2, 3600), ("b", 1, 7200)):
        count, last, want = 0, None, []
        for r in (r for r in rows if r[0] == name):
            count = count + 1 if r[9] else 0
            fire = r[9] and count >= need and (last is None or (r[1] - last).total_seconds() > cool)
            if fire:
                count, last = 0, r[1]
            want.append((r[1], count, fire))
        assert sorted((r["ts"], r["failures"], r["fired"]) for r in got if r["name"] == name) == want
    assert {r["name"] for r in got} == {"a", "b"}          # a tick without a time is left out


def test_sketch_quantile_is_exact_for_small_windows(spark):
    from lendscope.streaming import jobs as sj
    d = spark.range(4000).select(F.when(F.col("id") < 3, 0).when(F.col("id") < 40, 1).when(F.col("id") < 1500, 2).otherwise(3).alias("g"),
                                 ((F.col("id") * 7919) % 10007 / 7.0).alias("v"))
    d = d.union(spark.createDataFrame([(4, 1.5), (5, None)], "g int, v double"))
    got = d.groupBy("g").agg(F.percentile("v", 0.95).alias("p"), sj.sketch("v").alias("s")).select("g", "p", sj.sketch_quantile("s", 0.95).alias("q"))
    for r in got.collect():
        if r["g"] == 5:
            assert r["q"] is None
        elif r["g"] == 3:                                   # 2500 values: more than RANKS
            assert abs(r["p"] - r["q"]) < 0.005 * 10007 / 7
        else:
            assert abs(r["p"] - r["q"]) < 1e-9
