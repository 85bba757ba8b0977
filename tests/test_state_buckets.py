"""Keyed state costs the store a few calls a bucket of keys, and gives what the table gives."""

import datetime as dt

from pyspark.sql import functions as F

from lendscope.streaming import jobs as sj
from lendscope.streaming import keyed as ky

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "client_id long, request_id long, ts timestamp"


def _stored(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def test_state_follows_the_buckets_not_the_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ky, "BUCKETS", 4)
    _stored(spark, tmp_path / "src", [(k, k * 10 + i, T0 + dt.timedelta(seconds=i)) for k in range(200) for i in range(3)])
    stream = sj.event_stream(spark, str(tmp_path / "src"), SCHEMA)

    def build(s):
        return ky.in_event_order(s, ["client_id"], "ts", {"request_id": "bigint"}, lambda key, row: ky.SlidingLog(2, 60),
                                 sj.DECIDED, "request_id", 60)

    out = sj.run_to_end(stream, "ts", build, "buckets")
    assert max(out.state_rows) < 100              # 200 keys with their own state would be 400 values and more
    got = out.rows.groupBy("client_id").agg(F.sum(F.col("allowed").cast("int")).alias("n")).collect()
    assert len(got) == 200 and {r["n"] for r in got} == {2}


def test_null_keys_and_long_numbers_stay_as_they_are(spark, tmp_path):
    big = 2 ** 60 + 1
    rows = [(None, None, T0), (None, 5, T0 + dt.timedelta(seconds=1)), (big, big, T0), (big + 1, big + 1, T0), (big, 7, T0)]
    _stored(spark, tmp_path / "src", rows)
    stream = sj.event_stream(spark, str(tmp_path / "src"), SCHEMA)
    got = sj.sliding_admission(stream, limit=1, window_s=60).select("client_id", "request_id", "allowed").collect()
    assert {tuple(r) for r in got} == {(None, None, True), (None, 5, False), (big, 7, True), (big, big, False), (big + 1, big + 1, True)}
