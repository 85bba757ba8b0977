"""Streaming forms of the monitoring operators.

Sources are file streams (parquet/CSV drop folders, SRC-19); every query has a
checkpoint under the session's ``spark.checkpoint.dir`` so a restarted job
resumes where it stopped (executor or driver loss).  Event time comes from the
data and a 10-minute watermark bounds the state; late rows go to a side table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendscope.session import run_dir
from lendscope.streaming import keyed as ky

WATERMARK = "10 minutes"

# --- fixed values (must equal the reference for equal results) -------------
RATE_LIMITS = {  # path class -> (max requests, window seconds)
    "default": (100, 60),
    "predictions": (50, 60),
    "batch": (10, 300),
}
TIER_QUOTAS = {"free": 100, "standard": 1000, "premium": 10000, "enterprise": 100000}  # per rolling hour
TIER_WINDOW_S = 3600


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one streaming run under this run's part of the shared checkpoint folder."""
    return f"{run_dir(spark)}/streams/{name}-{uuid.uuid4().hex[:8]}"


def event_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """SRC-19: a table (one file or a folder of part files) or drop folder as a stream; new files become micro-batches."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        r = r.option("header", "true")
    # as a pattern, since a plain path must be a folder for a stream while a pattern finds both
    return r.load(f"{path[:-1]}[{path[-1]}]")


def api_stream(events: DataFrame) -> DataFrame:
    """events stream -> API request stream (same formulas as the batch adapter)."""
    return events.select(
        F.col("event_id").alias("request_id"), F.col("event_type").alias("endpoint"),
        F.col("ts").cast("timestamp").alias("ts"),   # watermarks need TIMESTAMP, not TIMESTAMP_NTZ
        F.col("user_id").alias("client_id"), (F.col("value") / F.lit(100.0)).alias("response_time"),
        F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, 500).otherwise(404))
        .otherwise(200).cast("int").alias("status_code"))


# ---- windows with bounded state (ST-01 / ST-02) -------------------------------------------
SKETCH_K = 4096        # a KLL sketch of so many values: exact up to them, about 0.1 % of rank beyond
RANKS = 2048           # ranks that are read from a sketch: windows of up to so many rows have exact quantiles


def sketch(value: str) -> Column:
    """A mergeable quantile sketch; its size does not grow with the rows of a window beyond SKETCH_K."""
    return F.expr(f"kll_sketch_agg_double(cast({value} AS DOUBLE), {SKETCH_K})")


def sketch_quantile(sk: str, p: float) -> Column:
    """Linear quantile from a sketch (NULL for no values).

    A sketch is read at constant ranks only: value i of n lies at rank (i + 0.5) / n, and one of RANKS
    evenly spaced ranks falls on it while n <= RANKS."""
    ranks = ", ".join(f"{(j + 0.5) / RANKS}D" for j in range(RANKS))
    values = F.expr(f"kll_sketch_get_quantile_double({sk}, array({ranks}))")
    n = F.expr(f"kll_sketch_get_n_double({sk})")
    at = F.lit(p) * (n - 1)
    low = F.floor(at)

    def value(i: Column) -> Column:
        return F.element_at(values, (F.floor((i + 0.5) / n * RANKS) + 1).cast("int"))
    return F.when(n > 0, value(low) + (value(F.least(low + 1, n - 1)) - value(low)) * (at - low))


def tumbling_api_metrics(api: DataFrame, window: str = "5 minutes") -> DataFrame:
    """ST-01: event-time windows with count, mean, p95 and error rate; ``api`` has a watermark on ``ts``.

    State is one row a window that is still open: sums and a sketch."""
    g = (api.groupBy(F.window("ts", window).alias("w"))
         .agg(F.count(F.lit(1)).alias("requests"), F.avg("response_time").alias("avg_response_time"),
              sketch("response_time").alias("_sketch"), F.avg((F.col("status_code") >= 400).cast("double")).alias("error_rate")))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    F.window_time("w").alias("window_time"), "requests", "avg_response_time",
                    sketch_quantile("_sketch", 0.95).alias("p95_response_time"), "error_rate")


def hourly_counts(stream: DataFrame, ts: str, key: str | None = None) -> DataFrame:
    """ST-02: tumbling one-hour counts (predictions, alerts, drift events); ``stream`` has a watermark on ``ts``."""
    g = [F.window(ts, "1 hour").alias("w")] + ([F.col(key)] if key else [])
    return (stream.groupBy(*g).agg(F.count(F.lit(1)).alias("count"))
            .select(F.col("w.start").alias("hour"), *([key] if key else []), "count"))


def window_end(ts: str, window: str) -> Column:
    return F.window(ts, window)["end"]


# ---- running a bounded stream to its end ---------------------------------------------------
END_OF_TIME = "9999-01-01 00:00:00"


@dataclass
class Drained:
    """What a run has given so far: result rows, late rows, and the rows of state after each batch."""

    rows: DataFrame
    late: DataFrame
    state_rows: list[int]


def run_to_end(stream: DataFrame, at: str, build: Callable[[DataFrame], DataFrame], name: str, due: Column | None = None,
               keep: list[str] | None = None, delay: str = WATERMARK, base: str | None = None, close: bool = True) -> Drained:
    """Drain everything available through a stateful query in append mode, then close it.

    ``build`` gets the stream with a watermark on ``at`` and returns the result.  Closed windows leave
    the state as the watermark passes them.  ``close`` ends the stream: a closing row with the last
    possible time goes through the same checkpoint, so the watermark passes all that is still open
    and it is emitted; rows after that are late.  Without ``close`` a later run with the same
    ``base`` goes on where this one stopped.

    Spark drops a row whose ``due`` time (default ``at``; the end of its window for windows) the
    watermark of late rows has passed.  Here these rows, with the columns ``keep``, go to a side table
    in the same query, so every row is either in the result or in ``late``.

    Each batch writes its own folder, so a repeated batch gives each row once."""
    spark = stream.sparkSession
    use_rocksdb_state(spark)
    base = base or work_dir(spark, name)
    out, closing = f"{base}/out", f"{base}/closing"
    moment = f"{at} timestamp"
    _write_row(spark, [], moment, closing)
    marks = spark.readStream.schema(moment).parquet(closing)
    marked = stream.unionByName(marks, allowMissingColumns=True).withWatermark(at, delay)
    end = F.lit(END_OF_TIME).cast("timestamp")
    result = build(marked.where(F.col(at) < end))     # names the time, else it would move below the watermark
    kept = F.struct(*(keep or stream.columns))
    none = F.lit(None)
    late_type = marked.select(kept.alias("late")).schema["late"].dataType
    row_type = T.StructType([T.StructField(f.name, f.dataType) for f in result.schema])
    both = result.select(F.struct("*").cast(row_type).alias("row"), none.cast(late_type).alias("late"),
                         none.cast("timestamp").alias("at"), none.cast("timestamp").alias("due")).union(
        marked.select(none.cast(row_type), kept, _plain(F.col(at)), _plain(F.col(at) if due is None else due)))
    states: list[int] = []

    def body(batch: DataFrame, epoch: int) -> None:
        _write_batch(batch, epoch, base, delay, end)

    def run() -> None:
        q = (both.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint")
             .foreachBatch(body).trigger(availableNow=True).start())
        q.awaitTermination()
        states.extend(sum(s.numRowsTotal for s in p.stateOperators) for p in q.recentProgress)

    run()
    if close:
        _write_row(spark, [(END_OF_TIME,)], "t string", closing, F.col("t").cast("timestamp").alias(at))
        run()
    done = spark.read.schema(both.schema).parquet(f"{out}/epoch=*")
    return Drained(done.where("row IS NOT NULL").select("row.*"), done.where("late IS NOT NULL").select("late.*"), states)


def _plain(ts: Column) -> Column:
    """A time without the mark of the watermark (two plain copies of that column break a rule of the optimizer)."""
    return F.timestamp_micros(F.unix_micros(ts))


def _write_row(spark: SparkSession, rows: list, schema: str, path: str, *columns: Column) -> None:
    df = spark.createDataFrame(rows, schema)
    (df.select(*columns) if columns else df).coalesce(1).write.mode("append").parquet(path)


def _write_batch(batch: DataFrame, epoch: int, base: str, delay: str, end: Column) -> None:
    """Result rows and late rows of a batch in one pass; the newest time seen is noted for the batches after it.

    Spark holds a batch's rows against the watermark of the batch before, which comes from the times
    seen before that: of all batches but the last one."""
    spark = batch.sparkSession

    def newest(e: int):
        return spark.read.schema("newest timestamp").parquet(f"{base}/newest/epoch={e}").first()[0] if e >= 0 else None

    seen, passed = Observation(), newest(epoch - 2)
    mark = F.lit(None).cast("timestamp") if passed is None else F.lit(passed) - F.expr(f"INTERVAL {delay}")
    late = F.col("late").isNotNull() & (F.col("at") < end) & (F.col("due") <= F.date_trunc("millisecond", mark))
    (batch.observe(seen, F.max("at").alias("newest"))
     .where(F.col("row").isNotNull() | F.coalesce(late, F.lit(False)))
     .write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}"))
    times = [t for t in (seen.get["newest"], newest(epoch - 1)) if t is not None]
    spark.createDataFrame([(max(times, default=None),)], "newest timestamp").coalesce(1).write.mode("overwrite").parquet(
        f"{base}/newest/epoch={epoch}")


def rule_ticks(api: DataFrame, rules: DataFrame, tick: str = "1 hour") -> DataFrame:
    """Ticks of the request metrics and host samples of a stream with a watermark, matched with alert rules.

    ``window_time`` is the tick's event time, ``window_start`` its beginning."""
    from lendscope.operators import alerts as al
    from lendscope.sources.adapters import host_sample
    w = tumbling_api_metrics(api, tick)
    w = w.withColumns(host_sample(F.col("requests"), F.col("avg_response_time")))
    names = ["requests", "error_rate", "avg_response_time", "p95_response_time", "cpu_percent", "memory_percent"]
    long = w.select("window_time", "window_start", F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric_name"), F.col(c).cast("double").alias("value")) for c in names])).alias("m")).select(
        "window_time", "window_start", "m.*").where("value IS NOT NULL")
    return al.match_rules(long, rules)


def stream_alerts(api: DataFrame, rules: DataFrame, name: str = "alerts", tick: str = "1 hour", **run) -> Drained:
    """ST-04 as a stream: requests -> ticks -> rules -> the machine of each rule, all in Spark's state.

    Every tick is decided once its window has closed, in event-time order; ``ts`` is the tick's beginning."""
    def build(s: DataFrame) -> DataFrame:
        decided = ky.rules_on_stream(rule_ticks(s, rules, tick), "window_time")
        return decided.withColumn("ts", F.window("window_time", tick)["start"]).drop("window_time")

    return run_to_end(api, "ts", build, name, due=window_end("ts", tick), **run)


# ---- keyed state in event-time order: admission (ST-03 / ST-05) and dedup (ST-06) ----
def limits_of(rate_class: str | None, limit: int | None = None, window_s: int | None = None) -> tuple[int, int]:
    """(requests, seconds): tier classes carry an hourly quota, path classes their own window."""
    if rate_class in TIER_QUOTAS:
        return TIER_QUOTAS[rate_class], TIER_WINDOW_S
    n, w = RATE_LIMITS.get(rate_class, RATE_LIMITS["default"])
    return limit or n, window_s or w


DECIDED = "allowed boolean, remaining int, reset_at timestamp"


def _decided(requests: DataFrame, keys: list[str], ts: str, make, forget_s: int, name: str) -> DataFrame:
    fields = {"request_id": "bigint"}
    if not requests.isStreaming:
        return ky.in_event_order_of_table(requests, keys, ts, fields, make, DECIDED, "request_id")
    return run_to_end(requests, ts, lambda s: ky.in_event_order(s, keys, ts, fields, make, DECIDED, "request_id", forget_s), name).rows


def sliding_admission(requests: DataFrame, rate_class: str = "default", limit: int | None = None,
                      window_s: int | None = None, class_col: str | None = None, name: str = "admission") -> DataFrame:
    """ST-03 / ST-05: client_id, rate_class, request_id, ts, allowed, remaining, reset_at of every request.

    State is kept by (client, rate class), D-17, and goes when a client has sent nothing for as long as
    its window.  ``class_col`` names a column holding the class of each request (e.g. a tier from a
    broadcast tier table).  ``requests`` may be a stream or a table."""
    cls = F.col(class_col) if class_col else F.lit(rate_class)
    rows = requests.select("client_id", cls.cast("string").alias("rate_class"), "request_id", "ts")

    def make(key, row):
        return ky.SlidingLog(*limits_of(key[1], limit, window_s))

    longest = max([TIER_WINDOW_S, window_s or 0, *(w for _, w in RATE_LIMITS.values())])
    return _decided(rows, ["client_id", "rate_class"], "ts", make, longest, name)


def dedup_requests(requests: DataFrame, hash_col: str, ts: str, ttl_s: int = 300, id_col: str = "request_id",
                   name: str = "dedup") -> DataFrame:
    """ST-06: request_hash, request_id, ts of the requests that are not a repeat of an accepted one younger than the TTL."""
    rows = requests.select(F.col(hash_col).alias("request_hash"), F.col(id_col).alias("request_id"), F.col(ts).alias("ts"))

    def make(key, row):
        return ky.LastAccepted(ttl_s)

    return _decided(rows, ["request_hash"], "ts", make, ttl_s, name).where("allowed").select("request_hash", "request_id", "ts")


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb_state(spark: SparkSession) -> None:
    """Keyed state (windows, dedup, admission logs) off the JVM heap, so state
    larger than executor memory spills to local disk and checkpoints
    incrementally; only set when the session has not chosen a provider."""
    key = "spark.sql.streaming.stateStore.providerClass"
    current = spark.conf.get(key, None)
    if not current or current.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, ROCKSDB_PROVIDER)


def run_available_now(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain everything available into a parquet table and return it as a batch frame.

    ``complete`` is for aggregates over a fixed set of groups; windows of time go through ``run_to_end``."""
    spark = df.sparkSession
    use_rocksdb_state(spark)
    base = work_dir(spark, name)
    out, ckpt = f"{base}/out", f"{base}/checkpoint"
    if mode == "complete":
        def sink(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(out)
        q = df.writeStream.outputMode("complete").option("checkpointLocation", ckpt) \
            .foreachBatch(sink).trigger(availableNow=True).start()
    else:
        q = df.writeStream.outputMode(mode).format("parquet").option("path", out) \
            .option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


# ---- ST-07: drift per micro-batch against a fixed reference histogram -------
def reference_histogram(reference: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Fit once: the reference range and its bin shares (10 rows + range)."""
    from lendscope.functions.bands import edge_bin
    rng = reference.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    b = reference.crossJoin(F.broadcast(rng)).select(edge_bin(F.col(value), F.col("lo"), F.col("hi"), bins).alias("bin"),
                                                     "lo", "hi")
    c = b.groupBy("bin", "lo", "hi").agg(F.count(F.lit(1)).alias("ref"))
    return c


def daily_drift(stream: DataFrame, ref_hist: DataFrame, value: str, ts: str, bins: int = 10,
                name: str = "drift") -> DataFrame:
    """ST-07: day, batch_rows, psi - the PSI of each day of the stream against ``ref_hist`` (at most ``bins`` + 1 rows).

    Days of event time, so the result does not depend on how rows arrive in files."""
    from lendscope.functions.bands import edge_bin
    rng = ref_hist.select("lo", "hi").distinct()
    binned = stream.crossJoin(F.broadcast(rng)).select(ts, edge_bin(F.col(value), F.col("lo"), F.col("hi"), bins).alias("bin"))
    counts = run_to_end(binned.where("bin IS NOT NULL"), ts, lambda s: s.groupBy(F.window(ts, "1 day").alias("w"), "bin").agg(
        F.count(F.lit(1)).alias("cur")), name, due=window_end(ts, "1 day")).rows.select(F.col("w.start").alias("day"), "bin", "cur")
    total = ref_hist.where("bin IS NOT NULL")
    ref = total.crossJoin(F.broadcast(total.agg(F.sum("ref").alias("tr")))).select("bin", "ref", "tr")
    days = counts.groupBy("day").agg(F.sum("cur").alias("tc"))
    j = days.crossJoin(F.broadcast(ref)).join(counts, ["day", "bin"], "left").fillna(0, ["cur"])
    r = F.greatest(F.col("ref") / F.col("tr"), F.lit(1e-10))
    c = F.greatest(F.col("cur") / F.col("tc"), F.lit(1e-10))
    return j.groupBy("day").agg(F.max("tc").alias("batch_rows"), F.sum((c - r) * F.log(c / r)).alias("psi"))
