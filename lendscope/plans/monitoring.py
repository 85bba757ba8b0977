"""Monitoring roll-ups, histories, windows and top-k queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.operators import rollups as ru
from lendscope.operators import windows as wn
from lendscope.plans.oracle_views import with_views
from lendscope.plans.registry import register
from lendscope.sources import adapters as ad
from lendscope.sources.tables import Tables

API_AS_OF = "2024-01-31 00:00:00"
BOOK_AS_OF = "2001-09-01 00:00:00"


def _r(c, n=6):
    return F.round(F.col(c), n).alias(c)


@register("api_summary_by_endpoint", ops=("AGG-01", "PRJ-06", "FN-01"), sql=with_views(f"""
SELECT endpoint, count(*) AS total_requests, round(avg(response_time), 6) AS avg_response_time,
       round(quantile_cont(response_time, 0.95), 6) AS p95_response_time,
       round(quantile_cont(response_time, 0.99), 6) AS p99_response_time,
       round(avg(CASE WHEN status_code >= 400 THEN 1.0E0 ELSE 0.0E0 END), 6) AS error_rate,
       round(count(*) / 10080.0E0, 6) AS requests_per_minute
FROM api_metrics
WHERE ts > TIMESTAMP '{API_AS_OF}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{API_AS_OF}'
GROUP BY endpoint""", "api_metrics"))
def api_summary_by_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ru.api_summary(ad.api_metrics(spark, sf_dir), API_AS_OF, minutes=7 * 24 * 60, group_cols=["endpoint"])
    return s.select("endpoint", "total_requests", *[_r(c) for c in (
        "avg_response_time", "p95_response_time", "p99_response_time", "error_rate", "requests_per_minute")])


@register("api_timeseries_5min", ops=("AGG-03", "JN-09", "D-11"), sql=with_views("""
SELECT c.bin, coalesce(a.requests, 0) AS requests, round(a.avg_response_time, 6) AS avg_response_time,
       round(a.p95_response_time, 6) AS p95_response_time, round(a.error_rate, 6) AS error_rate
FROM (SELECT unnest(generate_series(min(bin), max(bin), INTERVAL 5 MINUTE)) AS bin
      FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bin FROM api_metrics) t) c
LEFT JOIN (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bin, count(*) AS requests,
                  avg(response_time) AS avg_response_time,
                  quantile_cont(response_time, 0.95) AS p95_response_time,
                  avg(CASE WHEN status_code >= 400 THEN 1.0E0 ELSE 0.0E0 END) AS error_rate
           FROM api_metrics GROUP BY 1) a ON a.bin = c.bin""", "api_metrics"))
def api_timeseries_5min(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ru.api_timeseries(ad.api_metrics(spark, sf_dir), 300, fill_gaps=True)
    return t.select("bin", "requests", *[_r(c) for c in ("avg_response_time", "p95_response_time", "error_rate")])


_LAST100 = """
SELECT endpoint, response_time * 1000.0E0 AS ms, status_code
FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY ts DESC, request_id) AS rn FROM api_metrics) t
WHERE rn <= 100"""


@register("api_latency_last_100", ops=("AGG-16", "WIN-04", "MON-05"), sql=with_views(f"""
SELECT a.endpoint, a.total_requests, a.error_count, round(a.error_rate, 6) AS error_rate,
       round(s.avg_ms, 6) AS avg_response_time_ms, s.min_ms AS min_response_time_ms, s.max_ms AS max_response_time_ms,
       s.srt[least(CAST(floor(0.95E0 * s.n) AS INTEGER), s.n - 1) + 1] AS p95_response_time_ms,
       s.srt[least(CAST(floor(0.99E0 * s.n) AS INTEGER), s.n - 1) + 1] AS p99_response_time_ms,
       s.slow_requests, s.very_slow_requests
FROM (SELECT endpoint, count(*) AS total_requests,
             CAST(sum(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END) AS BIGINT) AS error_count,
             sum(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END) / count(*) AS error_rate
      FROM api_metrics GROUP BY endpoint) a
JOIN (SELECT endpoint, avg(ms) AS avg_ms, min(ms) AS min_ms, max(ms) AS max_ms, list_sort(list(ms)) AS srt,
             count(*) AS n, CAST(sum(CASE WHEN ms > 1000.0E0 THEN 1 ELSE 0 END) AS BIGINT) AS slow_requests,
             CAST(sum(CASE WHEN ms > 5000.0E0 THEN 1 ELSE 0 END) AS BIGINT) AS very_slow_requests
      FROM ({_LAST100}) l GROUP BY endpoint) s ON a.endpoint = s.endpoint""", "api_metrics"))
def api_latency_last_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ru.latency_stats_last_n(ad.api_metrics(spark, sf_dir), 100, keys=["endpoint"])
    return s.select("endpoint", "total_requests", "error_count", _r("error_rate"), _r("avg_response_time_ms"),
                    "min_response_time_ms", "max_response_time_ms", "p95_response_time_ms",
                    "p99_response_time_ms", "slow_requests", "very_slow_requests")


@register("error_rate_last_100", ops=("AGG-15", "WIN-04"), sql=with_views(f"""
SELECT endpoint, round(avg(CASE WHEN status_code >= 400 THEN 1.0E0 ELSE 0.0E0 END), 6) AS error_rate,
       count(*) AS requests
FROM ({_LAST100}) l GROUP BY endpoint""", "api_metrics"))
def error_rate_last_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ru.error_rate_last_n(ad.api_metrics(spark, sf_dir), 100, keys=["endpoint"])
    return s.select("endpoint", _r("error_rate"), "requests")


@register("prediction_analysis", ops=("AGG-06", "AGG-10", "D-12"), sql=with_views("""
SELECT count(*) AS predictions,
       round(avg(coalesce(try_cast(json_extract_string(prediction_result, '$.probability_of_default') AS DOUBLE), 0.0E0)), 6) AS avg_pd,
       round(avg(coalesce(try_cast(json_extract_string(prediction_result, '$.loss_given_default') AS DOUBLE), 0.0E0)), 6) AS avg_lgd,
       CAST(sum(CASE WHEN pd_score > 0.1E0 THEN 1 ELSE 0 END) AS BIGINT) AS high_risk_predictions,
       round(avg(CASE WHEN pd_score > 0.1E0 THEN 1.0E0 ELSE 0.0E0 END), 6) AS high_risk_rate
FROM prediction_log""", "prediction_log"))
def prediction_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.prediction_log(spark, sf_dir)
    res = F.from_json("prediction_result", "probability_of_default double, loss_given_default double")
    return p.select(res.alias("r"), "pd_score").agg(
        F.count(F.lit(1)).alias("predictions"),
        F.round(F.avg(F.coalesce("r.probability_of_default", F.lit(0.0))), 6).alias("avg_pd"),
        F.round(F.avg(F.coalesce("r.loss_given_default", F.lit(0.0))), 6).alias("avg_lgd"),
        F.sum((F.col("pd_score") > 0.1).cast("long")).alias("high_risk_predictions"),
        F.round(F.avg((F.col("pd_score") > 0.1).cast("double")), 6).alias("high_risk_rate"))


@register("pd_histogram", ops=("AGG-07", "AGG-06"), sql=with_views("""
SELECT b.bin, (b.bin - 1) * 0.1E0 AS bin_start, b.bin * 0.1E0 AS bin_end, coalesce(c.cnt, 0) AS count
FROM (SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS bin) b
LEFT JOIN (SELECT least(CAST(floor((pd_score - 0.0E0) / 0.1E0) AS INTEGER) + 1, 10) AS bin, count(*) AS cnt
           FROM prediction_log WHERE pd_score >= 0.0E0 AND pd_score <= 1.0E0 GROUP BY 1) c ON b.bin = c.bin""",
                                                          "prediction_log"))
def pd_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = ru.fixed_histogram(ad.prediction_log(spark, sf_dir), "pd_score", 10, 0.0, 1.0)
    return h.select("bin", "bin_start", "bin_end", "count")


@register("predictions_daily_gapfilled", ops=("AGG-06", "JN-09", "ST-02"), sql=with_views("""
SELECT c.day, coalesce(a.n, 0) AS predictions
FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day
      FROM (SELECT date_trunc('day', timestamp) AS day FROM prediction_log) t) c
LEFT JOIN (SELECT date_trunc('day', timestamp) AS day, count(*) AS n FROM prediction_log GROUP BY 1) a
  ON a.day = c.day""", "prediction_log"))
def predictions_daily_gapfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.prediction_log(spark, sf_dir)
    d = p.groupBy(F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("day")).agg(
        F.count(F.lit(1)).alias("predictions"))
    return ru.gap_fill(d, "day", 86400, {"predictions": 0}).select("day", "predictions")


@register("per_version_stats", ops=("AGG-11",), sql=with_views(f"""
SELECT model_version, count(*) AS total_predictions, round(avg(response_time_ms), 6) AS avg_response_time_ms,
       min(timestamp) AS period_start, max(timestamp) AS period_end
FROM prediction_log
WHERE timestamp >= TIMESTAMP '{BOOK_AS_OF}' - INTERVAL 3650 DAY
GROUP BY model_version""", "prediction_log"))
def per_version_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.prediction_log(spark, sf_dir).where(ru.within("timestamp", BOOK_AS_OF, 3650 * 86400, strict=False))
    return p.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.round(F.avg("response_time_ms"), 6).alias("avg_response_time_ms"),
        F.min("timestamp").alias("period_start"), F.max("timestamp").alias("period_end"))


@register("rating_distribution", ops=("AGG-13", "RSK-03", "RSK-04"), sql=with_views("""
SELECT risk_rating, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM scored_book GROUP BY risk_rating""", "scored_book"))
def rating_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendscope.plans.book import scored_book
    s = ru.share_by(scored_book(spark, sf_dir, validate=False), "risk_rating")
    return s.select("risk_rating", "count", _r("share"))


@register("portfolio_summary", ops=("AGG-21", "AGG-14", "RSK-10"), sql=with_views("""
SELECT round(sum(loan_amount), 3) AS total_exposure, count(*) AS accounts,
       round(avg(pd_score), 6) AS avg_pd, round(avg(lgd_score), 6) AS avg_lgd,
       round(sum(expected_loss * loan_amount), 2) AS expected_loss_amount,
       round((SELECT sum(e * e) / (sum(e) * sum(e)) FROM (SELECT sum(loan_amount) AS e FROM scored_book GROUP BY loan_purpose) s), 8)
         AS concentration_hhi,
       round(avg(CAST(is_default AS INTEGER)), 6) AS default_rate,
       round(avg(CASE WHEN is_default THEN loss_given_default END), 6) AS avg_lgd_defaulted,
       round(avg(expected_loss), 6) AS el_mean, round(stddev_pop(expected_loss), 6) AS el_std
FROM scored_book""", "scored_book"))
def portfolio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendscope.plans.book import scored_book
    s = scored_book(spark, sf_dir, validate=False)
    p = ru.portfolio_summary(s)
    extra = s.agg(F.avg(F.col("is_default").cast("int")).alias("default_rate"),
                  F.avg(F.when(F.col("is_default"), F.col("loss_given_default"))).alias("avg_lgd_defaulted"),
                  F.avg("expected_loss").alias("el_mean"), F.stddev_pop("expected_loss").alias("el_std"))
    return p.crossJoin(extra).select(_r("total_exposure", 3), "accounts", _r("avg_pd"), _r("avg_lgd"),
                                     _r("expected_loss_amount", 2), _r("concentration_hhi", 8), _r("default_rate"),
                                     _r("avg_lgd_defaulted"), _r("el_mean"), _r("el_std"))


@register("exposure_composition", ops=("AGG-22",), sql=with_views("""
SELECT home_ownership, count(*) AS count, round(sum(loan_amount) / sum(sum(loan_amount)) OVER (), 6) AS share
FROM credit_applications GROUP BY home_ownership""", "credit_applications"))
def exposure_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ru.share_by(ad.credit_applications(spark, sf_dir), "home_ownership", F.col("loan_amount"))
    return s.select("home_ownership", "count", _r("share"))


@register("exposure_rollup", ops=("AGG-22",), sql=with_views("""
SELECT home_ownership, loan_purpose, count(*) AS accounts, round(sum(loan_amount), 3) AS exposure
FROM credit_applications GROUP BY ROLLUP (home_ownership, loan_purpose)""", "credit_applications"))
def exposure_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ad.credit_applications(spark, sf_dir)
    return a.rollup("home_ownership", "loan_purpose").agg(
        F.count(F.lit(1)).alias("accounts"), F.round(F.sum("loan_amount"), 3).alias("exposure"))


@register("model_performance_summary", ops=("AGG-12", "AGG-02"), sql=with_views("""
SELECT 'accuracy' AS metric, round(avg(accuracy), 6) AS avg, round(min(accuracy), 6) AS min,
       round(max(accuracy), 6) AS max, round(stddev_samp(accuracy), 6) AS std FROM model_metrics
UNION ALL
SELECT 'avg_prediction_time', round(avg(avg_prediction_time), 6), round(min(avg_prediction_time), 6),
       round(max(avg_prediction_time), 6), round(stddev_samp(avg_prediction_time), 6) FROM model_metrics
UNION ALL
SELECT 'avg_pd_score', round(avg(avg_pd_score), 6), round(min(avg_pd_score), 6),
       round(max(avg_pd_score), 6), round(stddev_samp(avg_pd_score), 6) FROM model_metrics""", "model_metrics"))
def model_performance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ad.model_metrics(spark, sf_dir)
    s = ru.performance_summary(m, ["accuracy", "avg_prediction_time", "avg_pd_score"])
    return s.select("metric", *[_r(c) for c in ("avg", "min", "max", "std")])


@register("model_summary_last_day", ops=("AGG-02", "PRJ-06"), sql=with_views("""
SELECT CAST(coalesce(sum(prediction_count), 0) AS BIGINT) AS total_predictions,
       round(coalesce(avg(accuracy), 0.0E0), 6) AS avg_accuracy,
       round(coalesce(avg(CASE WHEN avg_prediction_time > 0 THEN avg_prediction_time END), 0.0E0), 6) AS avg_prediction_time,
       round(coalesce(sum(high_risk_predictions), 0) / greatest(coalesce(sum(prediction_count), 0), 1), 6) AS high_risk_rate
FROM model_metrics
WHERE timestamp > (SELECT max(timestamp) FROM model_metrics) - INTERVAL 30 DAY
  AND timestamp <= (SELECT max(timestamp) FROM model_metrics)""", "model_metrics"))
def model_summary_last_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ad.model_metrics(spark, sf_dir)
    as_of = m.agg(F.max("timestamp").alias("as_of"))
    mm = m.crossJoin(F.broadcast(as_of))
    s = ru.model_summary(mm, F.col("as_of"), minutes=30 * 24 * 60)
    return s.select("total_predictions", *[_r(c) for c in ("avg_accuracy", "avg_prediction_time", "high_risk_rate")])


@register("latest_application_per_customer", ops=("AGG-18", "SRT-01"), sql=with_views("""
SELECT customer_id, app_id, application_ts, round(loan_amount, 4) AS loan_amount
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY application_ts DESC, app_id DESC) AS rn
      FROM credit_applications) t WHERE rn = 1""", "credit_applications"))
def latest_application_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ad.credit_applications(spark, sf_dir).select("customer_id", "app_id", "application_ts", "loan_amount")
    l = ru.latest_per_key(a, ["customer_id"], "application_ts", "app_id")
    return l.select("customer_id", "app_id", "application_ts", _r("loan_amount", 4))


@register("latest_system_metric", ops=("AGG-18",), sql=with_views("""
SELECT timestamp, round(cpu_percent, 6) AS cpu_percent, round(memory_percent, 6) AS memory_percent,
       round(disk_percent, 6) AS disk_percent, total_requests
FROM system_metrics ORDER BY timestamp DESC LIMIT 1""", "system_metrics"))
def latest_system_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ad.system_metrics(spark, sf_dir).withColumn("_k", F.lit(1))
    l = ru.latest_per_key(s, ["_k"], "timestamp", "timestamp").drop("_k")
    return l.select("timestamp", _r("cpu_percent"), _r("memory_percent"), _r("disk_percent"), "total_requests")


@register("table_stats", ops=("AGG-09",), sql=with_views("""
SELECT (SELECT count(*) FROM credit_applications) AS applications,
       (SELECT count(*) FROM prediction_log) AS predictions,
       (SELECT max(application_ts) FROM credit_applications) AS latest_application""", "prediction_log"))
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ad.credit_applications(spark, sf_dir).agg(F.count(F.lit(1)).alias("applications"),
                                                  F.max("application_ts").alias("latest_application"))
    p = ad.prediction_log(spark, sf_dir).agg(F.count(F.lit(1)).alias("predictions"))
    return a.crossJoin(p).select("applications", "predictions", "latest_application")


@register("purpose_rating_matrix", ops=("AGG-24",), sql=with_views("""
SELECT loan_purpose, """ + ", ".join(
    f'count(*) FILTER (WHERE risk_rating = {r}) AS "{r}"' for r in range(1, 11)) + """
FROM scored_book GROUP BY loan_purpose""", "scored_book"))
def purpose_rating_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendscope.plans.book import scored_book
    s = scored_book(spark, sf_dir, validate=False)
    counts = s.groupBy("loan_purpose", "risk_rating").agg(F.count(F.lit(1)).alias("n"))
    m = ru.pivot_matrix(counts, "loan_purpose", "risk_rating", "n", list(range(1, 11)))
    return m.select("loan_purpose", *[F.coalesce(F.col(str(r)), F.lit(0)).alias(str(r)) for r in range(1, 11)])


@register("document_facets", ops=("AGG-25",), sql="""
SELECT lang AS value, count(*) AS rows, any_value(lo) AS min, any_value(hi) AS max, any_value(n) AS total_rows
FROM documents, (SELECT min(n_chars) AS lo, max(n_chars) AS hi, count(*) AS n FROM documents) t
WHERE lang IS NOT NULL GROUP BY lang""")
def document_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.facets(Tables(spark, sf_dir).documents, "lang", "n_chars")


@register("document_length_histogram", ops=("AGG-26", "AGG-08"), sql="""
SELECT least(CAST(floor((n_chars - lo) / ((hi - lo) / 20.0E0)) AS INTEGER) + 1, 20) AS bin, count(*) AS count
FROM documents, (SELECT CAST(min(n_chars) AS DOUBLE) AS lo, CAST(max(n_chars) AS DOUBLE) AS hi FROM documents) f
GROUP BY 1""")
def document_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).documents.select(F.col("n_chars").cast("double").alias("n_chars"))
    return ru.range_histogram(d, "n_chars", 20)


@register("daily_requests_change", ops=("WIN-03", "FN-09"), sql=with_views("""
SELECT endpoint, day, requests,
       round(CASE WHEN prev = 0 THEN NULL ELSE (requests - prev) * 100.0E0 / prev END, 6) AS change_pct
FROM (SELECT endpoint, day, requests, lag(requests) OVER (PARTITION BY endpoint ORDER BY day) AS prev
      FROM (SELECT endpoint, date_trunc('day', ts) AS day, count(*) AS requests FROM api_metrics GROUP BY 1, 2) d) t""",
                                                           "api_metrics"))
def daily_requests_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ad.api_metrics(spark, sf_dir)
    d = a.groupBy("endpoint", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(
        F.count(F.lit(1)).alias("requests"))
    c = wn.period_change(d, ["endpoint"], "day", "requests")
    return c.select("endpoint", "day", "requests", _r("change_pct"))


@register("client_sliding_requests", ops=("WIN-06", "PRJ-06"), sql=with_views("""
SELECT request_id, client_id,
       count(*) OVER (PARTITION BY client_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW)
         AS window_count
FROM api_metrics""", "api_metrics"))
def client_sliding_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ad.api_metrics(spark, sf_dir)
    return wn.sliding_count(a, "client_id", "ts", 60).select("request_id", "client_id", "window_count")


@register("model_performance_totals", ops=("AGG-12", "AGG-10"), sql=with_views("""
SELECT model_version, CAST(sum(prediction_count) AS BIGINT) AS total_predictions,
       round(avg(prediction_count), 6) AS mean_predictions, round(avg(avg_prediction_time), 6) AS mean_time_ms,
       round(avg(avg_pd_score), 6) AS mean_pd, round(avg(CASE WHEN avg_pd_score > 0.15E0 THEN 1.0E0 ELSE 0.0E0 END), 6)
         AS high_pd_share
FROM model_metrics GROUP BY model_version""", "model_metrics"))
def model_performance_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per version: total and mean daily predictions, mean time, mean PD and the
    share of days whose mean PD exceeds 0.15."""
    m = ad.model_metrics(spark, sf_dir)
    return m.groupBy("model_version").agg(
        F.sum("prediction_count").cast("long").alias("total_predictions"),
        F.round(F.avg("prediction_count"), 6).alias("mean_predictions"),
        F.round(F.avg("avg_prediction_time"), 6).alias("mean_time_ms"),
        F.round(F.avg("avg_pd_score"), 6).alias("mean_pd"),
        F.round(F.avg((F.col("avg_pd_score") > 0.15).cast("double")), 6).alias("high_pd_share"))


@register("prediction_dashboard", ops=("AGG-06", "JN-09", "FN-02"), sql=with_views("""
WITH p AS (SELECT *, date_trunc('hour', timestamp) AS hour FROM prediction_log
           WHERE timestamp >= TIMESTAMP '1998-07-01 00:00:00' AND timestamp < TIMESTAMP '1998-07-21 00:00:00'),
c AS (SELECT unnest(generate_series(min(hour)::TIMESTAMP, max(hour)::TIMESTAMP, INTERVAL 1 HOUR)) AS hour FROM p)
SELECT c.hour, count(p.request_id) AS predictions,
       round(coalesce(avg(try_cast(json_extract_string(prediction_result, '$.probability_of_default') AS DOUBLE)), 0.0E0), 6) AS avg_pd,
       round(coalesce(avg(CASE WHEN pd_score > 0.1E0 THEN 1.0E0 ELSE 0.0E0 END) FILTER (WHERE p.request_id IS NOT NULL), 0.0E0), 6) AS high_risk_rate
FROM c LEFT JOIN p ON p.hour = c.hour GROUP BY 1""", "prediction_log"))
def prediction_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly prediction counts of twenty days with the hours between filled, scores read through safe JSON access."""
    from lendscope.functions import jsonx as jx
    since, until = (F.lit(t).cast("timestamp_ntz") for t in ("1998-07-01 00:00:00", "1998-07-21 00:00:00"))
    p = ad.prediction_log(spark, sf_dir).where((F.col("timestamp") >= since) & (F.col("timestamp") < until))
    score = F.coalesce(jx.safe_json(F.col("prediction_result"), "probability_of_default double")["probability_of_default"], F.lit(0.0))
    h = p.groupBy(F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour")).agg(
        F.count(F.lit(1)).alias("predictions"), F.round(F.avg(score), 6).alias("avg_pd"),
        F.round(F.avg((score > 0.1).cast("double")), 6).alias("high_risk_rate"))
    return ru.gap_fill(h, "hour", 3600, {"predictions": 0, "avg_pd": 0.0, "high_risk_rate": 0.0}).select(
        "hour", "predictions", "avg_pd", "high_risk_rate")
