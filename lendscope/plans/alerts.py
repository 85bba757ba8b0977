"""Alerting and health queries over hourly evaluation ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.operators import alerts as al
from lendscope.operators import health as hl
from lendscope.operators import rollups as ru
from lendscope.operators import windows as wn
from lendscope.operators.prefix import prefix_sums, value_counts
from lendscope.plans.oracle_views import with_views
from lendscope.plans.registry import register
from lendscope.sources import adapters as ad

METRIC_COLS = ["requests", "error_rate", "avg_response_time", "p95_response_time", "cpu_percent", "memory_percent"]


def _r(c, n=8):
    return F.round(F.col(c), n).alias(c)


def matched(spark, sf_dir, hourly=None):
    """Rules matched with the hourly ticks; ``hourly``: a frame the caller has already."""
    h = hourly if hourly is not None else ad.hourly_metrics(spark, sf_dir)
    return al.match_rules(al.long_metrics(h, "ts", METRIC_COLS), al.rules_table(spark))


@register("rule_violations", ops=("JN-06", "PRJ-12", "UDF-03"), sql=with_views("""
SELECT name, count(*) AS ticks, CAST(sum(CAST(violated AS INTEGER)) AS BIGINT) AS violations
FROM rule_matches GROUP BY name""", "rule_matches"))
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matched(spark, sf_dir)
    return m.groupBy("name").agg(F.count(F.lit(1)).alias("ticks"),
                                 F.sum(F.col("violated").cast("long")).alias("violations"))


@register("rule_violation_runs", ops=("WIN-02",), sql=with_views("""
SELECT name, CAST(max(run_len) AS BIGINT) AS longest_run, CAST(sum(CASE WHEN run_len = 1 THEN 1 ELSE 0 END) AS BIGINT) AS runs
FROM (SELECT name, CASE WHEN violated THEN sum(CAST(violated AS INTEGER)) OVER (PARTITION BY name, grp ORDER BY ts
                                                          ROWS UNBOUNDED PRECEDING) ELSE 0 END AS run_len
      FROM (SELECT *, sum(CASE WHEN violated THEN 0 ELSE 1 END) OVER (PARTITION BY name ORDER BY ts
                                                                     ROWS UNBOUNDED PRECEDING) AS grp
            FROM rule_matches) g) r
GROUP BY name""", "rule_matches"))
def rule_violation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matched(spark, sf_dir)
    r = wn.run_lengths(m, "name", "ts", F.col("violated"), "metric_name", "run_len")
    return r.groupBy("name").agg(F.max("run_len").alias("longest_run"),
                                 F.sum((F.col("run_len") == 1).cast("long")).alias("runs"))


@register("alert_evaluations", ops=("ST-04", "WIN-02", "MON-08", "SRC-14"), sql=with_views("""
SELECT alert_id, ts, name, severity, alert_type, metric_name, round(value, 8) AS current_value,
       threshold AS threshold_value, 'Alert: ' || name AS title FROM fired""", "fired"))
def alert_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fired alerts of the consecutive-failure / cooldown machine."""
    return al.fired_alerts(al.evaluate_rules(matched(spark, sf_dir))).withColumn("current_value", F.round("current_value", 8))


# channels of the default rules, in order of registration
_CHANNELS_SQL = """(SELECT * FROM (VALUES (0, 'error_rate', 'system', ['logging', 'email']), (1, 'avg_response_time', 'performance', ['logging']),
  (2, 'p95_response_time', 'performance', ['webhook']), (3, 'cpu_percent', 'system', ['logging', 'webhook']),
  (4, 'memory_percent', 'system', ['email']), (5, 'requests', 'availability', ['logging'])) c(i, metric, type, channels))"""


@register("alert_routing", ops=("JN-07",), sql=with_views(f"""
SELECT channel, severity, count(*) AS deliveries
FROM (SELECT alert_id, severity, unnest(list_distinct(list_concat(['logging'], coalesce(arg_min(channels, i), [])))) AS channel
      FROM fired LEFT JOIN {_CHANNELS_SQL} c ON metric_name = metric OR alert_type = type GROUP BY alert_id, severity) d
GROUP BY 1, 2""", "fired"))
def alert_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    fired = al.fired_alerts(al.evaluate_rules(matched(spark, sf_dir)))
    return al.route(fired, al.rules_table(spark)).groupBy("channel", "severity").agg(
        F.count(F.lit(1)).alias("deliveries"))


@register("alert_hourly_trend", ops=("AGG-04", "JN-09", "ST-02"), sql=with_views("""
SELECT c.hour, count(alert_id) AS alerts, count(*) FILTER (WHERE severity = 'critical') AS critical,
       count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium,
       count(*) FILTER (WHERE severity = 'low') AS low
FROM (SELECT unnest(generate_series(min(date_trunc('hour', ts))::TIMESTAMP, max(date_trunc('hour', ts))::TIMESTAMP, INTERVAL 1 HOUR)) AS hour FROM fired) c
LEFT JOIN fired f ON date_trunc('hour', f.ts) = c.hour GROUP BY 1""", "fired"))
def alert_hourly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    fired = al.fired_alerts(al.evaluate_rules(matched(spark, sf_dir)))
    h = fired.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.count(F.lit(1)).alias("alerts"),
        *[F.sum((F.col("severity") == s).cast("long")).alias(s) for s in ("critical", "high", "medium", "low")])
    return ru.gap_fill(h, "hour", 3600, {"alerts": 0, "critical": 0, "high": 0, "medium": 0, "low": 0})


_HOURLY_HEALTH_SQL = """
SELECT h.ts, h.error_rate, h.avg_response_time, h.memory_percent AS memory_usage, h.cpu_percent AS cpu_usage,
       coalesce(c.critical_alerts, 0) AS critical_alerts
FROM hourly_metrics h
LEFT JOIN (SELECT ts, count(*) AS critical_alerts FROM rule_matches WHERE violated AND severity = 'critical'
           GROUP BY ts) c ON h.ts = c.ts"""


def hourly_health_inputs(spark, sf_dir):
    h = ad.hourly_metrics(spark, sf_dir)
    crit = matched(spark, sf_dir, h).where(F.col("violated") & (F.col("severity") == "critical")) \
        .groupBy("ts").agg(F.count(F.lit(1)).alias("critical_alerts"))
    return h.join(crit, "ts", "left").select(
        "ts", "error_rate", "avg_response_time", F.col("memory_percent").alias("memory_usage"),
        F.col("cpu_percent").alias("cpu_usage"), F.coalesce("critical_alerts", F.lit(0)).alias("critical_alerts"))


@register("health_by_hour", ops=("MON-01",), sql=with_views(f"""
SELECT ts, greatest(100 - (CASE WHEN error_rate > 0.05E0 THEN 20 ELSE 0 END)
         - (CASE WHEN avg_response_time > 1.0E0 THEN 15 ELSE 0 END) - (CASE WHEN memory_usage > 90.0E0 THEN 25 ELSE 0 END)
         - (CASE WHEN cpu_usage > 80.0E0 THEN 20 ELSE 0 END) - (CASE WHEN critical_alerts > 0 THEN 30 ELSE 0 END), 0) AS health_score,
       array_to_string(list_filter([CASE WHEN error_rate > 0.05E0 THEN printf('High API error rate: %.2f%%', error_rate * 100) END,
                        CASE WHEN avg_response_time > 1.0E0 THEN printf('Slow API response time: %.2fs', avg_response_time) END,
                        CASE WHEN memory_usage > 90.0E0 THEN printf('High memory usage: %.1f%%', memory_usage) END,
                        CASE WHEN cpu_usage > 80.0E0 THEN printf('High CPU usage: %.1f%%', cpu_usage) END,
                        CASE WHEN critical_alerts > 0 THEN printf('Critical alerts active: %d', critical_alerts) END],
                        lambda x: x IS NOT NULL), '; ') AS issues
FROM ({_HOURLY_HEALTH_SQL}) i""", "hourly_metrics", "rule_matches"))
def health_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hl.health_a(hourly_health_inputs(spark, sf_dir))
    return h.select("ts", "health_score", F.array_join("issues", "; ").alias("issues"))


@register("health_status_mix", ops=("MON-01", "MON-02"), sql=with_views(f"""
SELECT status, count(*) AS hours FROM (
  SELECT CASE WHEN s >= 90 THEN 'healthy' WHEN s >= 70 THEN 'warning' ELSE 'critical' END AS status
  FROM (SELECT 100 - (CASE WHEN error_rate > 0.05E0 THEN 20 ELSE 0 END)
           - (CASE WHEN avg_response_time > 1.0E0 THEN 15 ELSE 0 END) - (CASE WHEN memory_usage > 90.0E0 THEN 25 ELSE 0 END)
           - (CASE WHEN cpu_usage > 80.0E0 THEN 20 ELSE 0 END) - (CASE WHEN critical_alerts > 0 THEN 30 ELSE 0 END) AS s
        FROM ({_HOURLY_HEALTH_SQL}) i) x) y GROUP BY status""", "hourly_metrics", "rule_matches"))
def health_status_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hl.health_a(hourly_health_inputs(spark, sf_dir))
    return h.groupBy("status").agg(F.count(F.lit(1)).alias("hours"))


def _comp_sql(v, t, c, lower=True):
    if lower:
        return (f"CASE WHEN {v} <= {t}E0 THEN 100.0E0 WHEN {v} >= {c}E0 THEN 0.0E0 "
                f"ELSE 100.0E0 * ({c}E0 - {v}) / ({c}E0 - {t}E0) END")
    return (f"CASE WHEN {v} >= {t}E0 THEN 100.0E0 WHEN {v} <= {c}E0 THEN 0.0E0 "
            f"ELSE 100.0E0 * ({v} - {c}E0) / ({t}E0 - {c}E0) END")


@register("health_weighted_by_hour", ops=("MON-02",), sql=with_views(f"""
SELECT ts, CAST(trunc(s) AS INTEGER) AS health_score,
       CASE WHEN s >= 90 THEN 'excellent' WHEN s >= 75 THEN 'good' WHEN s >= 60 THEN 'warning' ELSE 'critical' END AS status
FROM (SELECT ts, ({_comp_sql('avg_response_time', 0.1, 1.0)}) * 0.2E0 + ({_comp_sql('error_rate', 0.01, 0.05)}) * 0.25E0
               + ({_comp_sql('cpu_percent', 50.0, 90.0)}) * 0.15E0 + ({_comp_sql('memory_percent', 60.0, 85.0)}) * 0.15E0 AS s
      FROM hourly_metrics) x""", "hourly_metrics"))
def health_weighted_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = ad.hourly_metrics(spark, sf_dir).select(
        "ts", F.col("avg_response_time").alias("api_response_time"), "error_rate",
        F.col("cpu_percent").alias("cpu_usage"), F.col("memory_percent").alias("memory_usage"))
    return hl.health_b(h).select("ts", "health_score", "status")


@register("component_status_by_hour", ops=("MON-03", "MON-04"), sql=with_views("""
SELECT ts, greatest(100 - (CASE WHEN cpu_percent > 80.0E0 THEN 20 ELSE 0 END)
                        - (CASE WHEN memory_percent > 85.0E0 THEN 20 ELSE 0 END)
                        - (CASE WHEN NOT (error_rate < 0.5E0) THEN 30 ELSE 0 END), 0) AS health_score,
       CASE WHEN error_rate < 0.2E0 AND cpu_percent <= 80.0E0 AND memory_percent <= 85.0E0 THEN 'healthy'
            WHEN NOT (error_rate < 0.5E0) THEN 'unhealthy' ELSE 'degraded' END AS overall_status
FROM hourly_metrics""", "hourly_metrics"))
def component_status_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = ad.hourly_metrics(spark, sf_dir)
    scored = hl.health_c(h.withColumnRenamed("cpu_percent", "cpu_usage").withColumnRenamed("memory_percent", "memory_usage"),
                         api_up=F.col("error_rate") < 0.5, tables_present=F.lit(True))
    comps = h.select("ts", F.explode(F.array(
        F.struct(F.lit("api").alias("component"),
                 F.when(F.col("error_rate") < 0.2, "healthy").when(F.col("error_rate") < 0.5, "degraded")
                 .otherwise("unhealthy").alias("status")),
        F.struct(F.lit("host").alias("component"),
                 F.when((F.col("cpu_percent") <= 80) & (F.col("memory_percent") <= 85), "healthy")
                 .otherwise("degraded").alias("status")))).alias("c")).select("ts", "c.*")
    roll = hl.component_rollup(comps, ["ts"])
    return scored.select("ts", "health_score").join(roll, "ts")


@register("request_log_levels", ops=("MON-05", "MON-06"), sql=with_views("""
SELECT request_id,
       CASE WHEN status_code >= 500 THEN 'error' WHEN status_code >= 400 THEN 'warning' ELSE 'info' END AS level,
       status_code BETWEEN 200 AND 399 AS success,
       list_filter([CASE WHEN response_time * 1000.0E0 > 5000.0E0 THEN 'very_slow_request:high'
                         WHEN response_time * 1000.0E0 > 1000.0E0 THEN 'slow_request:medium' END,
                    CASE WHEN n > 10 AND e / n > 0.05E0 THEN 'high_error_rate:high' END], lambda x: x IS NOT NULL) AS alerts
FROM (SELECT *, count(*) OVER (ORDER BY ts) AS n,
             sum(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END) OVER (ORDER BY ts) AS e FROM api_metrics) t""",
                                                       "api_metrics"))
def request_log_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ad.api_metrics(spark, sf_dir).withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    # running totals through the bucketed prefix sums (no global window); ties share a value
    vc = value_counts(a, "_t", (), {"err": (F.col("status_code") >= 400).cast("long")})
    ps = prefix_sums(vc, "_t", (), ("cnt", "err")).select(
        "_t", (F.col("below_cnt") + F.col("cnt")).alias("_n"), (F.col("below_err") + F.col("err")).alias("_e"))
    j = a.join(ps, "_t")
    return j.select("request_id", hl.log_level(F.col("status_code")).alias("level"),
                    F.col("status_code").between(200, 399).alias("success"),
                    hl.request_alerts(F.col("response_time") * 1000.0, F.col("_e") / F.col("_n"), F.col("_n"))
                    .alias("alerts"))


DASH_AS_OF = "2024-01-31 00:00:00"


@register("dashboard_summary", ops=("AGG-17", "AGG-01", "AGG-18", "MON-01"), sql=with_views(f"""
SELECT a.total_requests, round(a.avg_response_time, 6) AS avg_response_time, round(a.error_rate, 6) AS error_rate,
       round(s.cpu_percent, 6) AS cpu_usage, round(s.memory_percent, 6) AS memory_usage,
       c.critical_alerts, c.active_alerts
FROM (SELECT count(*) AS total_requests, avg(response_time) AS avg_response_time,
             avg(CASE WHEN status_code >= 400 THEN 1.0E0 ELSE 0.0E0 END) AS error_rate
      FROM api_metrics WHERE ts > TIMESTAMP '{DASH_AS_OF}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{DASH_AS_OF}') a,
     (SELECT cpu_percent, memory_percent FROM system_metrics ORDER BY timestamp DESC LIMIT 1) s,
     (SELECT CAST(sum(CASE WHEN violated AND severity = 'critical' THEN 1 ELSE 0 END) AS BIGINT) AS critical_alerts,
             CAST(sum(CASE WHEN violated THEN 1 ELSE 0 END) AS BIGINT) AS active_alerts
      FROM rule_matches WHERE ts > TIMESTAMP '{DASH_AS_OF}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{DASH_AS_OF}') c""",
                                                             "api_metrics", "system_metrics", "rule_matches"))
def dashboard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary row: API window, latest host sample, violations of the last day."""
    api = ad.api_metrics(spark, sf_dir).where(ru.within("ts", DASH_AS_OF, 7 * 86400))
    a = api.agg(F.count(F.lit(1)).alias("total_requests"), F.avg("response_time").alias("avg_response_time"),
                F.avg((F.col("status_code") >= 400).cast("double")).alias("error_rate"))
    sysm = ad.system_metrics(spark, sf_dir).withColumn("_k", F.lit(1))
    s = ru.latest_per_key(sysm, ["_k"], "timestamp", "timestamp").select("cpu_percent", "memory_percent")
    m = matched(spark, sf_dir, ad.hourly_metrics(spark, sf_dir, F.expr(f"TIMESTAMP_NTZ '{DASH_AS_OF}' - INTERVAL 25 HOURS"),
                                                 F.expr(f"TIMESTAMP_NTZ '{DASH_AS_OF}' + INTERVAL 1 HOUR"))).where(
        ru.within("ts", DASH_AS_OF, 86400))
    c = m.agg(F.sum((F.col("violated") & (F.col("severity") == "critical")).cast("long")).alias("critical_alerts"),
              F.sum(F.col("violated").cast("long")).alias("active_alerts"))
    return a.crossJoin(s).crossJoin(c).select(
        "total_requests", _r("avg_response_time", 6), _r("error_rate", 6),
        F.round("cpu_percent", 6).alias("cpu_usage"), F.round("memory_percent", 6).alias("memory_usage"),
        "critical_alerts", "active_alerts")


def _status_events(spark: SparkSession, sf_dir: str):
    """Matched ticks, fired alerts and their status events: opened, acknowledged, resolved."""
    m = matched(spark, sf_dir)
    ev = al.evaluate_rules(m)
    fired = al.fired_alerts(ev)
    # first passing tick after each firing: one ordered pass over the rule's
    # tick series (no pairing of alerts with all later ticks)
    from pyspark.sql import Window
    ticks = m.select("name", "ts", (~F.col("violated")).alias("_pass"))
    # newest first, so that the frame only grows
    nxt = Window.partitionBy("name").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, -1)
    ticks = ticks.withColumn("resolved_at", F.min(F.when(F.col("_pass"), F.col("ts"))).over(nxt))
    res = fired.join(ticks.select("name", "ts", "resolved_at"), ["name", "ts"], "left").select("alert_id", "resolved_at")
    opened = fired.select("alert_id", F.lit("active").alias("status"), F.lit("system").alias("actor"),
                          F.lit(None).cast("timestamp_ntz").alias("suppressed_until"),
                          F.col("ts").alias("event_ts"), F.lit(0).alias("seq"))
    acked = fired.where(F.col("severity") == "critical").select(
        "alert_id", F.lit("acknowledged").alias("status"), F.lit("on_call").alias("actor"),
        F.lit(None).cast("timestamp_ntz").alias("suppressed_until"),
        (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("event_ts"), F.lit(1).alias("seq"))
    resolved = res.where(F.col("resolved_at").isNotNull()).select(
        "alert_id", F.lit("resolved").alias("status"), F.lit("system").alias("actor"),
        F.lit(None).cast("timestamp_ntz").alias("suppressed_until"), F.col("resolved_at").alias("event_ts"),
        F.lit(2).alias("seq"))
    events = opened.unionByName(acked).unionByName(resolved)
    return m, fired, events


@register("alert_lifecycle", ops=("MON-07", "MON-08", "SRC-14"), sql=with_views("""
SELECT CASE WHEN resolved_at IS NOT NULL AND resolved_at >= acked_at THEN 'resolved'
            WHEN acked_at IS NOT NULL AND acked_at <= newest THEN 'acknowledged'
            WHEN resolved_at IS NOT NULL THEN 'resolved' ELSE 'active' END AS status, count(*) AS alerts
FROM (SELECT f.alert_id, CASE WHEN f.severity = 'critical' THEN f.ts + INTERVAL 1 HOUR END AS acked_at,
             (SELECT min(m.ts) FROM rule_matches m WHERE m.name = f.name AND m.ts > f.ts AND NOT m.violated) AS resolved_at,
             (SELECT max(ts) FROM rule_matches) AS newest FROM fired f) x
GROUP BY 1""", "fired"))
def alert_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-sourced alert status: every fired alert opens as active, is
    acknowledged one tick later when its severity is critical, and is resolved
    at the first later tick where its rule passes; status as of the last tick."""
    m, _, events = _status_events(spark, sf_dir)
    as_of = m.agg(F.max("ts").alias("_asof"))
    events = events.crossJoin(F.broadcast(as_of)).where(F.col("event_ts") <= F.col("_asof")).drop("_asof")
    lc = al.lifecycle(events, F.lit(None).cast("timestamp_ntz"))
    return lc.groupBy("status").agg(F.count(F.lit(1)).alias("alerts"))


LIFECYCLE_AS_OF = ["2024-01-08 12:00:00", "2024-01-16 06:45:00", "2024-01-31 00:00:00"]


@register("alert_status_as_of", ops=("MON-07", "MON-08"), sql=with_views("""
SELECT as_of, status, count(*) AS alerts, count(*) FILTER (WHERE status <> 'resolved') AS active
FROM (SELECT as_of, alert_id, CASE WHEN s.status = 'suppressed' AND s.until <= as_of THEN 'active' ELSE s.status END AS status
      FROM (SELECT as_of, alert_id, arg_max({'status': status, 'until': until}, (moment, seq)) AS s
            FROM (SELECT alert_id, 'active' AS status, CAST(NULL AS TIMESTAMP) AS until, ts AS moment, 0 AS seq FROM fired
                  UNION ALL SELECT alert_id, 'acknowledged', NULL, ts + INTERVAL 1 HOUR, 1 FROM fired WHERE severity = 'critical'
                  UNION ALL SELECT alert_id, 'suppressed', ts + INTERVAL 300 MINUTE, ts + INTERVAL 30 MINUTE, 1 FROM fired WHERE severity <> 'critical'
                  UNION ALL SELECT alert_id, 'resolved', NULL, r, 2 FROM (
                    SELECT f.alert_id, (SELECT min(m.ts) FROM rule_matches m WHERE m.name = f.name AND m.ts > f.ts AND NOT m.violated) AS r
                    FROM fired f) x WHERE r IS NOT NULL) e,
                 (VALUES (TIMESTAMP '2024-01-08 12:00:00'), (TIMESTAMP '2024-01-16 06:45:00'), (TIMESTAMP '2024-01-31 00:00:00')) a(as_of)
            WHERE moment <= as_of GROUP BY as_of, alert_id) l) c
GROUP BY 1, 2""", "fired"))
def alert_status_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counts at three times: critical alerts are acknowledged after an hour, others are suppressed from half
    an hour to five hours after firing and active again when that expires, all are resolved when their rule passes."""
    _, fired, events = _status_events(spark, sf_dir)
    suppressed = fired.where("severity <> 'critical'").select(
        "alert_id", F.lit("suppressed").alias("status"), F.lit("on_call").alias("actor"),
        (F.col("ts") + F.expr("INTERVAL 300 MINUTES")).alias("suppressed_until"),
        (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("event_ts"), F.lit(1).alias("seq"))
    held = al.status_as_of(al.status_intervals(events.unionByName(suppressed)), LIFECYCLE_AS_OF)
    return held.groupBy("as_of", "status").agg(F.count(F.lit(1)).alias("alerts"), F.count_if("is_active").alias("active"))


TEXT_RULES = {"busy_and_failing": "error_rate > 0.05 AND requests >= 10",
              "heavy_tail": "p95_response_time > 1.8 * avg_response_time OR p95_response_time >= 9",
              "loaded_host": "cpu_percent BETWEEN 60 AND 80 OR coalesce(memory_percent, 0) > 145"}


@register("rule_predicates", ops=("UDF-03", "PRJ-12"), sql=with_views("""
SELECT name, count(*) AS ticks, count(*) FILTER (WHERE v) AS violations, min(ts) FILTER (WHERE v) AS first_violation
FROM (SELECT ts, 'busy_and_failing' AS name, error_rate > 0.05E0 AND requests >= 10 AS v FROM hourly_metrics
      UNION ALL SELECT ts, 'heavy_tail', p95_response_time > 1.8E0 * avg_response_time OR p95_response_time >= 9 FROM hourly_metrics
      UNION ALL SELECT ts, 'loaded_host', cpu_percent BETWEEN 60 AND 80 OR coalesce(memory_percent, 0) > 145 FROM hourly_metrics) r
GROUP BY name""", "hourly_metrics"))
def rule_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules whose condition is text over all metrics of a tick, checked against the allow-list before they run."""
    v = al.match_predicates(ad.hourly_metrics(spark, sf_dir), "ts", TEXT_RULES)
    return v.groupBy("name").agg(F.count(F.lit(1)).alias("ticks"), F.count_if("violated").alias("violations"),
                                 F.min(F.when(F.col("violated"), F.col("ts"))).alias("first_violation"))


_LOWER = [("Api Response Time", "avg_response_time", 0.1, 1.0), ("Error Rate", "error_rate", 0.01, 0.05), ("Cpu Usage", "cpu_percent", 50.0, 90.0),
          ("Memory Usage", "memory_percent", 60.0, 85.0)]
_ISSUES_B = ", ".join(f"CASE WHEN {c} >= {bad}E0 THEN printf('{t} is critical (%.2f)', {c}) WHEN {c} >= {aim}E0 THEN printf('{t} is above target (%.2f)', {c}) END"
                      for t, c, aim, bad in _LOWER)


@register("health_components_by_hour", ops=("MON-02", "MON-03"), sql=with_views(f"""
SELECT ts, CAST(trunc(s) AS INTEGER) AS weighted_score, CASE WHEN s >= 90 THEN 'excellent' WHEN s >= 75 THEN 'good' WHEN s >= 60 THEN 'warning' ELSE 'critical' END AS weighted_status,
       array_to_string(list_filter([{_ISSUES_B}, CASE WHEN accuracy <= 0.7E0 THEN printf('Model Accuracy is critical (%.2f)', accuracy)
         WHEN accuracy <= 0.85E0 THEN printf('Model Accuracy is below target (%.2f)', accuracy) END], lambda x: x IS NOT NULL), '; ') AS weighted_issues,
       greatest(c, 0) AS host_score, CASE WHEN c >= 90 THEN 'healthy' WHEN c >= 70 THEN 'warning' ELSE 'critical' END AS host_status,
       array_to_string(list_filter([CASE WHEN cpu_percent > 80.0E0 THEN printf('High CPU usage: %.1f%%', cpu_percent) END,
         CASE WHEN memory_percent > 85.0E0 THEN printf('High memory usage: %.1f%%', memory_percent) END,
         CASE WHEN NOT (error_rate < 0.5E0) THEN 'API server not running' END], lambda x: x IS NOT NULL), '; ') AS host_issues
FROM (SELECT *, ({_comp_sql('avg_response_time', 0.1, 1.0)}) * 0.2E0 + ({_comp_sql('error_rate', 0.01, 0.05)}) * 0.25E0
               + ({_comp_sql('cpu_percent', 50.0, 90.0)}) * 0.15E0 + ({_comp_sql('memory_percent', 60.0, 85.0)}) * 0.15E0
               + ({_comp_sql('accuracy', 0.85, 0.7, False)}) * 0.25E0 AS s,
             100 - (CASE WHEN cpu_percent > 80.0E0 THEN 20 ELSE 0 END) - (CASE WHEN memory_percent > 85.0E0 THEN 20 ELSE 0 END)
                 - (CASE WHEN NOT (error_rate < 0.5E0) THEN 30 ELSE 0 END) AS c
      FROM (SELECT *, 1.0E0 - error_rate AS accuracy FROM hourly_metrics) h) x""", "hourly_metrics"))
def health_components_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted score with all five components (the share of requests without an error stands for accuracy) and host
    score, each with its issues and status."""
    h = ad.hourly_metrics(spark, sf_dir).select(
        "ts", F.col("avg_response_time").alias("api_response_time"), "error_rate", F.col("cpu_percent").alias("cpu_usage"),
        F.col("memory_percent").alias("memory_usage"), (F.lit(1.0) - F.col("error_rate")).alias("model_accuracy"))
    b = hl.health_b(h).select(*h.columns, F.col("health_score").alias("weighted_score"), F.col("status").alias("weighted_status"),
                              F.array_join("issues", "; ").alias("weighted_issues"))
    c = hl.health_c(b, api_up=F.col("error_rate") < 0.5, tables_present=F.lit(True))
    return c.select("ts", "weighted_score", "weighted_status", "weighted_issues", F.col("health_score").alias("host_score"),
                    F.col("status").alias("host_status"), F.array_join("issues", "; ").alias("host_issues"))


_DRIFT_ROWS_SQL = f"""
WITH base AS (SELECT avg(avg_response_time) AS r, avg(cpu_percent) AS c, avg(error_rate) AS e FROM hourly_metrics WHERE ts < TIMESTAMP '{ad.EVENTS_SPLIT_TS}'),
rows AS (SELECT ts, u.drift_type, u.score FROM (
  SELECT ts, unnest([{{'drift_type': 'feature_drift_response_time', 'score': (avg_response_time - r) / r}}, {{'drift_type': 'feature_drift_cpu', 'score': (cpu_percent - c) / c}},
                     {{'drift_type': 'performance_drift', 'score': (error_rate - e) / e}}]) AS u
  FROM hourly_metrics, base WHERE ts >= TIMESTAMP '{ad.EVENTS_SPLIT_TS}') x)"""


def _hourly_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drift result for each hour and metric: the change against the first half of the month (DR-08)."""
    from lendscope.operators import drift as dr
    h = ad.hourly_metrics(spark, sf_dir)
    split = F.lit(ad.EVENTS_SPLIT_TS).cast("timestamp_ntz")
    names = {"feature_drift_response_time": "avg_response_time", "feature_drift_cpu": "cpu_percent", "performance_drift": "error_rate"}
    base = h.where(F.col("ts") < split).agg(*[F.avg(c).alias(f"base_{c}") for c in names.values()])
    j = h.where(F.col("ts") >= split).crossJoin(F.broadcast(base))                     # one row
    each = [F.struct(F.lit(t).alias("drift_type"), dr.performance_drift(F.col(f"base_{c}"), F.col(c)).alias("d")) for t, c in names.items()]
    return j.select(F.col("ts").alias("timestamp"), F.explode(F.array(*each)).alias("r")).select(
        "timestamp", F.lit("credit_risk_model").alias("model_name"), F.lit("v1").alias("model_version"), "r.drift_type",
        "r.d.drift_detected", F.col("r.d.relative_change").alias("drift_score"), F.lit(dr.PERFORMANCE_TOLERANCE).alias("threshold_value"))


def _drift_store(spark: SparkSession, sf_dir: str):
    import uuid
    from lendscope.session import run_dir
    from lendscope.sources.stores import DriftStore
    store = DriftStore(spark, f"{run_dir(spark)}/hourly-drift-{uuid.uuid4().hex[:8]}")
    store.write(_hourly_drift(spark, sf_dir), "hourly")
    return store


@register("drift_dashboard", ops=("AGG-05", "DR-12", "SRC-13", "SRT-03"), sql=with_views(_DRIFT_ROWS_SQL + """,
last AS (SELECT * FROM rows WHERE ts >= TIMESTAMP '2024-01-29 12:00:00' AND ts < TIMESTAMP '2024-01-30 12:00:00')
SELECT 'total' AS section, CAST(NULL AS TIMESTAMP) AS timestamp, CAST(NULL AS VARCHAR) AS drift_type, CAST(count(*) AS DOUBLE) AS value FROM last
UNION ALL SELECT 'feature', NULL, NULL, CAST(count(*) AS DOUBLE) FROM last WHERE drift_type LIKE '%feature_drift%'
UNION ALL SELECT 'performance', NULL, NULL, CAST(count(*) AS DOUBLE) FROM last WHERE drift_type = 'performance_drift'
UNION ALL SELECT 'trend', date_trunc('hour', ts)::TIMESTAMP, drift_type, CAST(count(*) AS DOUBLE) FROM last GROUP BY ALL
UNION ALL SELECT 'recent', ts, drift_type, round(score, 8) FROM (SELECT * FROM last ORDER BY ts DESC, drift_type LIMIT 10) r""", "hourly_metrics"))
def drift_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift results of the store's last 24 hours: totals, counts by hour and type, the newest ten."""
    from lendscope.operators import drift as dr
    history = _drift_store(spark, sf_dir).history("2024-01-29 12:00:00", until="2024-01-30 12:00:00")
    return dr.drift_sections(history).withColumn("value", F.round("value", 8))


@register("dashboard_overview", ops=("AGG-17", "AGG-01", "AGG-02", "AGG-18", "MON-01", "MON-07"), sql=with_views(_DRIFT_ROWS_SQL + f""",
api AS (SELECT count(*) AS n, avg(response_time) AS rt, avg(CASE WHEN status_code >= 400 THEN 1.0E0 ELSE 0.0E0 END) AS er
        FROM api_metrics WHERE ts > TIMESTAMP '{DASH_AS_OF}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{DASH_AS_OF}'),
model AS (SELECT CAST(coalesce(sum(prediction_count), 0) AS BIGINT) AS n, avg(accuracy) AS acc, avg(avg_prediction_time) AS t,
                 sum(high_risk_predictions) / sum(prediction_count) AS high
          FROM model_metrics WHERE timestamp > TIMESTAMP '1998-07-01 00:00:00' AND timestamp <= TIMESTAMP '1998-07-31 00:00:00'),
host AS (SELECT * FROM system_metrics ORDER BY timestamp DESC LIMIT 1),
open AS (SELECT f.severity FROM fired f WHERE f.ts <= TIMESTAMP '{DASH_AS_OF}' AND NOT EXISTS (
           SELECT 1 FROM rule_matches m WHERE m.name = f.name AND m.ts > f.ts AND NOT m.violated AND m.ts <= TIMESTAMP '{DASH_AS_OF}')),
dr AS (SELECT count(*) FILTER (WHERE drift_type LIKE '%feature_drift%') AS features,
              coalesce(bool_or(drift_type = 'performance_drift' AND abs(score) > 0.05E0), false) AS performance
       FROM rows WHERE ts >= TIMESTAMP '{DASH_AS_OF}' - INTERVAL 24 HOUR AND ts < TIMESTAMP '{DASH_AS_OF}')
SELECT api.n AS total_requests, round(coalesce(rt, 0.0E0), 6) AS avg_response_time, round(coalesce(er, 0.0E0), 6) AS error_rate,
       round(api.n / 1440.0E0, 6) AS requests_per_minute, model.n AS total_predictions, round(coalesce(acc, 0.0E0), 6) AS avg_accuracy,
       round(coalesce(high, 0.0E0), 6) AS high_risk_rate, round(coalesce(t, 0.0E0), 6) AS avg_prediction_time,
       round(cpu_percent, 6) AS cpu_usage, round(memory_percent, 6) AS memory_usage, round(disk_percent, 6) AS disk_usage,
       (SELECT count(*) FROM open) AS active_alerts, (SELECT count(*) FROM open WHERE severity = 'critical') AS critical_alerts,
       features AS feature_drift_count, performance AS performance_drift_detected
FROM api, model, host, dr""", "api_metrics", "model_metrics", "system_metrics", "fired"))
def dashboard_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole summary row: request window, model window, newest host sample, alerts that are open, drift of the last day."""
    api = ru.api_summary(ad.api_metrics(spark, sf_dir), DASH_AS_OF, minutes=1440).select(
        "total_requests", "avg_response_time", "error_rate", "requests_per_minute")
    model = ru.model_summary(ad.model_metrics(spark, sf_dir), "1998-07-31 00:00:00", minutes=30 * 1440)
    host = ru.latest_per_key(ad.system_metrics(spark, sf_dir).withColumn("_k", F.lit(1)), ["_k"], "timestamp", "timestamp").select(
        F.col("cpu_percent").alias("cpu_usage"), F.col("memory_percent").alias("memory_usage"), F.col("disk_percent").alias("disk_usage"))
    _, fired, events = _status_events(spark, sf_dir)
    held = al.status_as_of(al.status_intervals(events), [DASH_AS_OF]).where("is_active").join(fired.select("alert_id", "severity"), "alert_id")
    alerts = held.agg(F.count(F.lit(1)).alias("active_alerts"), F.count_if(F.col("severity") == "critical").alias("critical_alerts"))
    history = _drift_store(spark, sf_dir).history("2024-01-30 00:00:00", until=DASH_AS_OF)
    drift = history.agg(F.count_if(F.col("drift_type").contains("feature_drift")).alias("feature_drift_count"),
                        F.coalesce(F.bool_or((F.col("drift_type") == "performance_drift") & F.col("drift_detected")), F.lit(False))
                        .alias("performance_drift_detected"))
    row = api.crossJoin(model).crossJoin(host).crossJoin(alerts).crossJoin(drift)          # one row each
    return row.select("total_requests", *[_r(c, 6) for c in ("avg_response_time", "error_rate", "requests_per_minute")], "total_predictions",
                      *[_r(c, 6) for c in ("avg_accuracy", "high_risk_rate", "avg_prediction_time", "cpu_usage", "memory_usage", "disk_usage")],
                      "active_alerts", "critical_alerts", "feature_drift_count", "performance_drift_detected")


@register("health_with_drift_by_hour", ops=("MON-01", "DR-08"), sql=with_views(f"""
WITH base AS (SELECT avg(error_rate) AS e FROM hourly_metrics WHERE ts < TIMESTAMP '{ad.EVENTS_SPLIT_TS}'),
x AS (SELECT ts, error_rate > 0.05E0 AS a, avg_response_time > 1.0E0 AS b, memory_usage > 90.0E0 AS c, cpu_usage > 80.0E0 AS d, critical_alerts > 0 AS f,
             abs(error_rate - e) > 0.05E0 * e AS g FROM ({_HOURLY_HEALTH_SQL}) h, base WHERE ts >= TIMESTAMP '{ad.EVENTS_SPLIT_TS}'),
s AS (SELECT *, 100 - 20 * a::INT - 15 * b::INT - 25 * c::INT - 20 * d::INT - 30 * f::INT - 25 * g::INT AS score FROM x)
SELECT ts, greatest(score, 0) AS health_score, CASE WHEN score >= 90 THEN 'healthy' WHEN score >= 70 THEN 'warning' ELSE 'critical' END AS status,
       a::INT + b::INT + c::INT + d::INT + f::INT + g::INT AS issues, g AS drift FROM s""", "hourly_metrics", "rule_matches"))
def health_with_drift_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health with the drift deduction: hours of the second half of the month against the error rate of the first."""
    h = hourly_health_inputs(spark, sf_dir)
    found = _hourly_drift(spark, sf_dir).where("drift_type = 'performance_drift'").select(F.col("timestamp").alias("ts"), "drift_detected")
    out = hl.health_a(h.join(found, "ts"), drift_col="drift_detected")
    return out.select("ts", "health_score", "status", F.size("issues").alias("issues"), F.col("drift_detected").alias("drift"))
