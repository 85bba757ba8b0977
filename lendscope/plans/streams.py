"""Streaming queries: drained with ``availableNow`` and returned as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.functions.bands import edge_bin_sql
from lendscope.operators import alerts as al
from lendscope.operators import features as fe
from lendscope.operators import scoring as sc
from lendscope.plans.oracle_views import DECISION_SQL, with_views
from lendscope.plans.registry import register
from lendscope.sources.adapters import EVENTS_SPLIT_TS
from lendscope.sources.tables import Tables, table_path
from lendscope.streaming import jobs as sj


def _events_stream(spark, sf_dir):
    return sj.event_stream(spark, table_path(sf_dir, "events"), Tables(spark, sf_dir).events.schema)


@register("stream_api_windows", ops=("ST-01", "SRC-12", "SRC-19"), sql="""
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS requests,
       round(avg(value / 100.0E0), 6) AS avg_response_time,
       round(quantile_cont(value / 100.0E0, 0.95), 6) AS p95_response_time,
       round(avg(CASE WHEN event_type = 'error' THEN 1.0E0 ELSE 0.0E0 END), 6) AS error_rate
FROM events GROUP BY 1""")
def stream_api_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows in append mode: each leaves the state when it closes, the last ones at the closing flush."""
    api = sj.api_stream(_events_stream(spark, sf_dir))
    out = sj.run_to_end(api, "ts", sj.tumbling_api_metrics, "api_windows", due=sj.window_end("ts", "5 minutes"),
                        keep=["request_id", "ts"]).rows
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "requests",
                      F.round("avg_response_time", 6).alias("avg_response_time"),
                      F.round("p95_response_time", 6).alias("p95_response_time"),
                      F.round("error_rate", 6).alias("error_rate"))


@register("stream_alert_evaluations", ops=("ST-04", "ST-01", "JN-06", "MON-08"), sql=with_views("""
SELECT alert_id, ts, name, severity, alert_type, metric_name, round(value, 8) AS current_value,
       threshold AS threshold_value, 'Alert: ' || name AS title FROM fired""", "fired"))
def stream_alert_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts of ``alert_evaluations`` from the request stream: hourly ticks, then the machine of each rule in keyed state."""
    api = sj.api_stream(_events_stream(spark, sf_dir))
    out = sj.stream_alerts(api, al.rules_table(spark), keep=["request_id", "ts"]).rows
    fired = al.fired_alerts(out.withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    return fired.withColumn("current_value", F.round("current_value", 8))


_CHANNEL_SQL = """(SELECT * FROM (VALUES (0, 'error_rate', 'system', ['logging', 'email']), (1, 'avg_response_time', 'performance', ['logging']),
  (2, 'p95_response_time', 'performance', ['webhook']), (3, 'cpu_percent', 'system', ['logging', 'webhook']),
  (4, 'memory_percent', 'system', ['email']), (5, 'requests', 'availability', ['logging'])) c(i, metric, type, channels))"""


@register("stream_alert_delivery", ops=("UDF-02", "JN-07", "ST-04"), sql=with_views(f"""
SELECT channel, name, count(*) AS deliveries, min(ts) AS first_alert
FROM (SELECT alert_id, name, ts, unnest(list_distinct(list_concat(['logging'], coalesce(arg_min(channels, i), [])))) AS channel
      FROM fired LEFT JOIN {_CHANNEL_SQL} c ON metric_name = metric OR alert_type = type GROUP BY alert_id, name, ts) d
GROUP BY 1, 2""", "fired"))
def stream_alert_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts of the request stream, routed and handed to the channel sink; a second run of the sink adds nothing."""
    from lendscope.streaming import channels as ch
    api = sj.api_stream(_events_stream(spark, sf_dir))
    out = sj.stream_alerts(api, al.rules_table(spark), keep=["request_id", "ts"]).rows
    base = sj.work_dir(spark, "delivery")
    al.fired_alerts(out).write.parquet(f"{base}/alerts")
    routed = al.route(spark.readStream.schema(al.fired_alerts(out).schema).parquet(f"{base}/alerts"), al.rules_table(spark))
    for _ in range(2):
        ch.deliver(routed, f"{base}/channels", f"{base}/checkpoint")
    got = ch.delivered(spark, f"{base}/channels", "alert_id string, name string, ts timestamp, channel string")
    return got.groupBy("channel", "name").agg(F.count(F.lit(1)).alias("deliveries"), F.min("ts").cast("timestamp_ntz").alias("first_alert"))


@register("stream_scoring_decisions", ops=("RSK-09", "RSK-08"), sql=with_views(f"""
SELECT loan_purpose, {DECISION_SQL} AS decision, count(*) AS applications,
       round(sum(expected_loss), 6) AS expected_loss
FROM scored_book GROUP BY 1, 2""", "scored_book"))
def stream_scoring_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders arrive as a stream, are joined to the static customer table,
    scored without any shuffle, and rolled up per purpose and decision."""
    from lendscope.sources import adapters as ad
    t = Tables(spark, sf_dir)
    orders = sj.event_stream(spark, table_path(sf_dir, "orders"), t.orders.schema)
    cust = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    j = orders.join(cust, orders.o_custkey == cust.c_custkey)   # stream-static join
    apps = ad.applications_from_joined(j)
    feats = (apps.withColumn("credit_score_normalized", fe.credit_score_normalized())
             .withColumn("loan_to_income_ratio", fe.loan_to_income_ratio())
             .withColumn("financial_stress_score", fe.financial_stress_score()))
    scored = sc.score_book(sc.scorecard_scores(feats))
    agg = scored.groupBy("loan_purpose", F.col("decision.decision").alias("decision")).agg(
        F.count(F.lit(1)).alias("applications"), F.sum("expected_loss").alias("expected_loss"))
    out = sj.run_available_now(agg, "scoring", mode="complete")
    return out.select("loan_purpose", "decision", "applications", F.round("expected_loss", 6).alias("expected_loss"))


# API-key tiers (fixed values of this library): unknown clients fall to 'free'.
CLIENT_TIERS = [(1, "standard"), (2, "premium"), (3, "enterprise")]


@register("stream_rate_admission", ops=("ST-03", "ST-05", "D-17"), sql="""
WITH tiers(client_id, tier) AS (VALUES (1, 'standard'), (2, 'premium'), (3, 'enterprise')),
req AS (SELECT user_id, coalesce(tier, 'free') AS tier, date_trunc('millisecond', ts) AS t0, ts, event_id
        FROM events LEFT JOIN tiers ON user_id = client_id),
logs AS (SELECT user_id, tier, count(*) AS n, list(ts ORDER BY ts, event_id) AS times,
                CASE tier WHEN 'free' THEN 100 WHEN 'standard' THEN 1000 WHEN 'premium' THEN 10000 ELSE 100000 END AS quota
         FROM req GROUP BY user_id, tier),
done AS (SELECT tier, n, len(list_reduce(list_transform(times, lambda t: [t]),
           lambda acc, x: CASE WHEN len(list_filter(acc, lambda t: t >= x[1] - INTERVAL 1 HOUR)) < quota
                               THEN list_concat(acc, x) ELSE acc END)) AS ok FROM logs)
SELECT tier AS rate_class, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(ok) AS BIGINT) AS allowed FROM done GROUP BY 1""")
def stream_rate_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding-log admission per (client, tier) with keyed state; the tier comes
    from a broadcast lookup table of three rows, unknown clients are 'free'."""
    api = sj.api_stream(_events_stream(spark, sf_dir))
    tiers = spark.createDataFrame(CLIENT_TIERS, "client_id long, tier string")
    api = api.join(F.broadcast(tiers), "client_id", "left").withColumn("tier", F.coalesce("tier", F.lit("free")))
    out = sj.sliding_admission(api, class_col="tier")
    return out.groupBy("rate_class").agg(F.count(F.lit(1)).alias("requests"),
                                         F.sum(F.col("allowed").cast("long")).alias("allowed"))


@register("stream_request_dedup", ops=("ST-06", "SET-06", "FN-04"), sql="""
WITH logs AS (SELECT user_id, event_type, list(ts ORDER BY ts, event_id) AS times FROM events GROUP BY 1, 2),
done AS (SELECT list_reduce(list_transform(times, lambda t: [t]), lambda acc, x:
           CASE WHEN x[1] - acc[-1] >= INTERVAL 300 SECOND THEN list_concat(acc, x) ELSE acc END) AS kept FROM logs)
SELECT CAST(sum(len(kept)) AS BIGINT) AS unique_requests, count(*) AS distinct_hashes FROM done""")
def stream_request_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of an accepted request inside 300 s are suppressed on the stream."""
    ev = _events_stream(spark, sf_dir)
    api = sj.api_stream(ev).withColumn("request_hash", F.md5(F.to_json(F.struct("client_id", "endpoint"))))
    out = sj.dedup_requests(api, "request_hash", "ts", 300)
    return out.agg(F.count(F.lit(1)).alias("unique_requests"),
                   F.count_distinct("request_hash").alias("distinct_hashes"))


@register("stream_drift_check", ops=("ST-07", "DR-05"), sql=f"""
WITH a AS (SELECT ts, value / 100.0E0 AS v, ts < TIMESTAMP '{EVENTS_SPLIT_TS}' AS is_ref FROM events),
fit AS (SELECT min(v) AS lo, max(v) AS hi FROM a WHERE is_ref),
b AS (SELECT is_ref, date_trunc('day', ts)::TIMESTAMP AS day, {edge_bin_sql('v', 'lo', 'hi', 10)} AS bin FROM a, fit),
ref AS (SELECT bin, count(*) AS r, sum(count(*)) OVER () AS tr FROM b WHERE is_ref AND bin IS NOT NULL GROUP BY bin),
cur AS (SELECT day, bin, count(*) AS c FROM b WHERE NOT is_ref AND bin IS NOT NULL GROUP BY ALL),
days AS (SELECT day, CAST(sum(c) AS BIGINT) AS tc FROM cur GROUP BY day),
j AS (SELECT day, tc, greatest(r / tr, 1e-10) AS p, greatest(coalesce(c, 0) / tc, 1e-10) AS q
      FROM days CROSS JOIN ref LEFT JOIN cur USING (day, bin))
SELECT day, tc AS batch_rows, round(sum((q - p) * ln(q / p)), 8) AS psi FROM j GROUP BY day, tc""")
def stream_drift_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response-time PSI of each day of the second half of the month, as a stream, against the
    histogram of the first half (the reference sample)."""
    from lendscope.sources import adapters as ad
    split = F.lit(EVENTS_SPLIT_TS)
    ref = ad.api_metrics(spark, sf_dir).where(F.col("ts") < split.cast("timestamp_ntz"))
    hist = sj.reference_histogram(ref, "response_time")
    api = sj.api_stream(_events_stream(spark, sf_dir)).where(F.col("ts") >= split.cast("timestamp"))
    res = sj.daily_drift(api.select("ts", "response_time"), hist, "response_time", "ts")
    return res.select(F.col("day").cast("timestamp_ntz").alias("day"), "batch_rows", F.round("psi", 8).alias("psi"))


@register("stream_hourly_requests", ops=("ST-02", "SRC-12"), sql="""
SELECT date_trunc('hour', ts) AS hour, event_type AS endpoint, count(*) AS count FROM events GROUP BY 1, 2""")
def stream_hourly_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling one-hour counts per endpoint, all hours of the drain."""
    api = sj.api_stream(_events_stream(spark, sf_dir))
    out = sj.run_to_end(api, "ts", lambda s: sj.hourly_counts(s, "ts", "endpoint"), "hourly",
                        due=sj.window_end("ts", "1 hour"), keep=["request_id", "ts"]).rows
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "endpoint", "count")
