"""Alert channel sink (commit, abort, replayed epochs) and scheduled runs with back-off."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from lendscope.streaming import channels as ch
from lendscope.streaming import schedule as sd

SCHEMA = "alert_id string, channel string, severity string"


def _alerts(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").parquet(str(path))


def _got(spark, path):
    return sorted((r["alert_id"], r["channel"]) for r in ch.delivered(spark, str(path), SCHEMA).collect())


def test_a_replayed_epoch_is_delivered_once(spark, tmp_path):
    src, out, check = tmp_path / "src", tmp_path / "out", tmp_path / "check"
    _alerts(spark, src, [("a", "email", "high"), ("b", "logging", "low")])
    stream = spark.readStream.schema(SCHEMA).parquet(str(src))
    ch.deliver(stream, str(out), str(check))
    _alerts(spark, src, [("c", "email", "high")])
    ch.deliver(stream, str(out), str(check))
    assert _got(spark, out) == [("a", "email"), ("b", "logging"), ("c", "email")]
    files = set(os.listdir(out / "alerts"))
    last = max((f for f in os.listdir(check / "commits") if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):                                 # as if the driver had died before noting the batch
        os.replace(check / "commits" / f, tmp_path / f"lost{f}")
    ch.deliver(stream, str(out), str(check))
    assert _got(spark, out) == [("a", "email"), ("b", "logging"), ("c", "email")]
    assert set(os.listdir(out / "alerts")) == files                  # the repeat's files are gone


def test_commit_and_abort_of_the_writer(tmp_path):
    w = ch.ChannelWriter(str(tmp_path))
    a = w.write(iter([Row(alert_id="x", channel="email"), Row(alert_id="y", channel="email")]))
    b, empty = w.write(iter([Row(alert_id="z", channel="email")])), w.write(iter([]))
    assert (a.alerts, b.alerts, empty.alerts) == (2, 1, 0)
    w.abort([b, None], 0)
    w.commit([a, None, empty], 0)
    again = w.write(iter([Row(alert_id="x", channel="email")]))
    w.commit([again], 0)
    assert os.listdir(tmp_path / "alerts") == [a.file]
    assert json.loads((tmp_path / "epochs" / f"epoch={0:020d}.json").read_text()) == {"epoch": 0, "files": [a.file]}
    assert ch.test_channel(str(tmp_path)) and not ch.test_channel("/proc/no-such-place/x")


def test_a_failing_task_delivers_nothing(spark, tmp_path):
    src = tmp_path / "src"
    _alerts(spark, src, [("a", "email", "high"), ("b", "email", "bad")])
    bad = spark.readStream.schema(SCHEMA).parquet(str(src)).withColumn(
        "severity", F.when(F.col("severity") == "bad", F.raise_error(F.lit("broken row"))).otherwise(F.col("severity")))
    with pytest.raises(Exception, match="broken row"):
        ch.deliver(bad, str(tmp_path / "out"), str(tmp_path / "check"))
    assert not os.path.exists(tmp_path / "out" / "epochs")


def test_three_errors_double_the_wait(spark, tmp_path):
    _alerts(spark, tmp_path / "src", [("a", "email", "high")])
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "src"))
    stop, waits, triggers, calls = threading.Event(), [], [], []

    def body(batch, epoch):
        calls.append(batch.count())
        if len(calls) <= 4:
            raise ValueError("injected")

    def start(interval):
        triggers.append(interval)
        q = (stream.writeStream.queryName("evaluation").foreachBatch(body).option("checkpointLocation", str(tmp_path / "check"))
             .trigger(processingTime=interval).start())
        if len(triggers) > 4:
            threading.Thread(target=ended, args=(q,)).start()
        return q

    def ended(q):
        for _ in range(200):
            if q.lastProgress is not None:
                break
            time.sleep(0.1)
        stop.set()
        q.stop()

    count = sd.keep_running(spark, "evaluation", start, 0.2, stop, waits)
    assert waits == [0.2, 0.2, 0.4, 0.4, 0.2] and triggers == ["0.2 seconds"] * 3 + ["0.4 seconds"] * 2
    assert count.errors == 0 and count.batches >= 1 and calls == [1] * 5
