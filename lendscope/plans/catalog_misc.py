"""Registry, paging, formatting, freshness, de-duplication and economic-context queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.functions import jsonx as jx
from lendscope.functions import text as tx
from lendscope.operators import features as fe
from lendscope.operators import registry as rg
from lendscope.operators import scoring as sc
from lendscope.plans.oracle_views import with_views
from lendscope.plans.registry import register
from lendscope.session import materialize
from lendscope.sources import adapters as ad
from lendscope.sources.tables import Tables

API_AS_OF = "2024-01-31 00:00:00"


def _r(c, n=8):
    return F.round(F.col(c), n).alias(c)


def registry_from_log(spark, sf_dir) -> DataFrame:
    """One registry row per model version, metrics computed from its predictions."""
    p = ad.prediction_log(spark, sf_dir)
    m = p.groupBy("model_name", "model_version").agg(
        F.round(F.avg(((F.col("pd_score") > 0.5) == F.col("is_default")).cast("double")), 8).alias("accuracy"),
        F.round(F.avg("expected_loss"), 8).alias("expected_loss_mean"),
        F.round(F.avg("response_time_ms"), 8).alias("response_time_ms"),
        F.min("timestamp").alias("created_at"), F.max("timestamp").alias("updated_at"))
    return m.select("model_name", "model_version", F.lit("scorecard").alias("model_type"),
                    F.lit("inactive").alias("status"),
                    F.to_json(F.create_map(F.lit("accuracy"), "accuracy", F.lit("expected_loss_mean"),
                                           "expected_loss_mean", F.lit("response_time_ms"), "response_time_ms"))
                    .alias("performance_metrics"), "created_at", "updated_at")


_VERSION_METRICS_SQL = """
SELECT model_version, round(avg(CAST((pd_score > 0.5E0) = is_default AS DOUBLE)), 8) AS accuracy,
       round(avg(expected_loss), 8) AS expected_loss_mean, round(avg(response_time_ms), 8) AS response_time_ms,
       min(timestamp) AS created_at
FROM prediction_log GROUP BY model_version"""


@register("model_comparison", ops=("MV-15", "SRT-07", "D-13"), sql=with_views(f"""
SELECT metric, arg_min(model_version, (-s, model_version)) AS best_version
FROM (SELECT model_version, 'accuracy' AS metric, accuracy AS s FROM ({_VERSION_METRICS_SQL}) v
      UNION ALL SELECT model_version, 'expected_loss_mean', -expected_loss_mean FROM ({_VERSION_METRICS_SQL}) v
      UNION ALL SELECT model_version, 'response_time_ms', -response_time_ms FROM ({_VERSION_METRICS_SQL}) v) x
GROUP BY metric""", "prediction_log"))
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = registry_from_log(spark, sf_dir)
    return rg.best_per_metric(rg.metrics_long(reg))


@register("registry_activation", ops=("ML-12", "ML-13", "ML-14", "SRC-14", "SRC-15", "SRC-17", "PRJ-09"),
          sql=with_views(f"""
SELECT model_version, CASE WHEN model_version = 'v1' THEN 'active' ELSE 'inactive' END AS status,
       CASE WHEN model_version = 'v1' THEN 'production' ELSE 'development' END AS stage,
       'continue_current' AS action, 'v1' AS recommended_version
FROM ({_VERSION_METRICS_SQL}) v WHERE model_version <> 'v0'""", "prediction_log"))
def registry_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = rg.ensure_column(registry_from_log(spark, sf_dir), "stage", "development")
    reg = rg.activate(reg, "credit_risk_model", "v1", F.col("updated_at"))
    reg = rg.promote(reg, "credit_risk_model", "v1")
    # a re-registration of v2 arrives later and replaces the old row (keyed upsert) ...
    upd = reg.where("model_version = 'v2'").withColumn("updated_at", F.col("updated_at") + F.expr("INTERVAL 1 DAY"))
    reg = rg.upsert(reg, upd, ["model_name", "model_version"], "updated_at")
    # ... and v0 is retired (keyed delete)
    reg = rg.delete_keys(reg, reg.where("model_version = 'v0'"), ["model_name", "model_version"])
    rec = rg.recommendation(reg).select(F.col("action"), F.col("model_version").alias("recommended_version"))
    return reg.where(F.col("status").isin("active", "inactive", "archived")).select(
        "model_version", "status", "stage").crossJoin(rec)


@register("credit_page", ops=("SRT-02", "SRC-07", "PRJ-01", "PRJ-11"), sql=with_views("""
SELECT app_id, customer_id, round(loan_amount, 4) AS loan_amount, loan_term, credit_score, loan_purpose,
       count(*) OVER () = 50 AS has_more
FROM (SELECT * FROM credit_applications WHERE loan_purpose = 'CAR' AND home_ownership = 'OWN'
      ORDER BY app_id LIMIT 50 OFFSET 20) p""", "credit_applications"))
def credit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 2 (offset 20, limit 50) of a filtered listing; the page size is the feature."""
    a = ad.credit_applications(spark, sf_dir)
    filters = {"loan_purpose": "CAR", "home_ownership": "OWN", "unknown_column": "x"}
    for k, v in filters.items():   # only known columns filter (the reference ignores the rest)
        if k in a.columns:
            a = a.where(F.col(k) == v)
    page = a.orderBy("app_id").offset(20).limit(50).select(
        "app_id", "customer_id", _r("loan_amount", 4), "loan_term", "credit_score", "loan_purpose")
    n = page.agg(F.count(F.lit(1)).alias("_n"))
    return page.crossJoin(n).withColumn("has_more", F.col("_n") == 50).drop("_n")


@register("newest_predictions", ops=("SRT-03", "SRT-01", "PRJ-15", "RSK-07", "FN-28"), sql=with_views("""
SELECT request_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS ts_display,
       printf('%.4f', round(pd_score, 4)) AS pd_display,
       CASE WHEN pd_score IS NULL THEN 'Unknown' WHEN pd_score < 0.05E0 THEN 'Low' WHEN pd_score < 0.15E0 THEN 'Medium'
            WHEN pd_score < 0.30E0 THEN 'High' ELSE 'Critical' END AS risk_level,
       strftime(timestamp, '%Y%m%d_%H%M%S') AS version_stamp
FROM prediction_log ORDER BY timestamp DESC, request_id DESC LIMIT 10""", "prediction_log"))
def newest_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.prediction_log(spark, sf_dir).orderBy(F.col("timestamp").desc(), F.col("request_id").desc()).limit(10)
    return p.select("request_id", tx.ts_display("timestamp").alias("ts_display"),
                    tx.score_display(F.round("pd_score", 4)).alias("pd_display"),
                    sc.display_risk_level(F.col("pd_score")).alias("risk_level"),
                    tx.version_stamp("timestamp").alias("version_stamp"))


@register("endpoint_freshness", ops=("PRJ-13", "PRJ-14", "PRJ-06"), sql=with_views(f"""
SELECT endpoint, max(ts) AS latest,
       round((epoch(TIMESTAMP '{API_AS_OF}') - epoch(max(ts))) / 3600.0E0, 6) AS age_hours,
       CASE WHEN max(ts) IS NULL THEN 'no_data'
            WHEN (epoch(TIMESTAMP '{API_AS_OF}') - epoch(max(ts))) / 3600.0E0 > 24 THEN 'stale'
            WHEN (epoch(TIMESTAMP '{API_AS_OF}') - epoch(max(ts))) / 3600.0E0 > 6 THEN 'aging' ELSE 'fresh' END AS status,
       max(ts) >= TIMESTAMP '{API_AS_OF}' - INTERVAL 24 HOUR AS is_fresh
FROM api_metrics GROUP BY endpoint""", "api_metrics"))
def endpoint_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ad.api_metrics(spark, sf_dir)
    as_of = F.lit(API_AS_OF).cast("timestamp_ntz")
    g = a.groupBy("endpoint").agg(F.max("ts").alias("latest"))
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("latest").cast("timestamp"))) / F.lit(3.6e9)
    status = (F.when(F.col("latest").isNull(), "no_data").when(age > 24, "stale").when(age > 6, "aging")
              .otherwise("fresh"))
    return g.select("endpoint", "latest", F.round(age, 6).alias("age_hours"), status.alias("status"),
                    (F.col("latest") >= as_of - F.expr("INTERVAL 24 HOURS")).alias("is_fresh"))


@register("request_dedup", ops=("SET-06", "FN-04", "ST-06"), sql=with_views("""
SELECT CAST(sum(n) AS BIGINT) AS total_requests, count(*) AS unique_requests, CAST(sum(len(kept)) AS BIGINT) AS accepted_requests
FROM (SELECT n, list_reduce(times, lambda acc, x:
               CASE WHEN x[1] - acc[-1] >= INTERVAL 300 SECOND THEN list_concat(acc, x) ELSE acc END) AS kept
      FROM (SELECT count(*) AS n, list([CAST(application_ts AS TIMESTAMP)] ORDER BY application_ts) AS times FROM credit_applications
            GROUP BY customer_id, loan_term, credit_score, home_ownership, loan_purpose) g) f""", "credit_applications"))
def request_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, distinct requests, and those that are no repeat of an accepted one younger than 300 s."""
    from lendscope.streaming import jobs as sj
    a = ad.credit_applications(spark, sf_dir)
    cols = ["customer_id", "loan_term", "credit_score", "home_ownership", "loan_purpose"]
    h = a.select(jx.canonical_hash(a, cols).alias("request_hash"), F.col("app_id").cast("long").alias("request_id"),
                 F.col("application_ts").cast("timestamp").alias("ts"))
    kept = sj.dedup_requests(h, "request_hash", "ts", 300).agg(F.count(F.lit(1)).alias("accepted_requests"))
    hashes = h.groupBy("request_hash").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("total_requests"), F.count(F.lit(1)).alias("unique_requests"))
    return hashes.crossJoin(kept)


# Scenarios of the stress report (fixed values of this library): name, change of the expected loss.
SCENARIOS = [("baseline", 0.0), ("adverse", 0.35), ("severe", 0.8)]


@register("stress_scenarios", ops=("RSK-11",), sql=with_views("""
SELECT scenario, loss_impact, accounts, round(base_el * (1.0E0 + loss_impact), 4) AS scenario_el,
       round(base_amount * (1.0E0 + loss_impact) / 1e6, 4) AS scenario_el_millions
FROM (VALUES ('baseline', 0.0E0), ('adverse', 0.35E0), ('severe', 0.8E0)) s(scenario, loss_impact),
     (SELECT sum(expected_loss) AS base_el, sum(expected_loss * loan_amount) AS base_amount, count(*) AS accounts FROM scored_book) b""",
                                                            "scored_book"))
def stress_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected loss of the whole book under each scenario."""
    from lendscope.plans.book import scored_book
    table = spark.createDataFrame(SCENARIOS, "scenario string, loss_impact double")
    out = sc.stress_scenarios(scored_book(spark, sf_dir, validate=False), table)
    return out.select("scenario", "loss_impact", "accounts", F.round("scenario_el", 4).alias("scenario_el"),
                      F.round(F.col("scenario_el_amount") / 1e6, 4).alias("scenario_el_millions"))


@register("prediction_lookup", ops=("PRJ-08",), sql=with_views("""
SELECT app_id AS request_id, 'v' || (app_id % 3) AS model_version, round(pd_score, 8) AS pd_score, risk_rating,
       true AS success, 'completed' AS status
FROM scored_book WHERE app_id = (SELECT max(o_orderkey) FROM orders)""", "scored_book"))
def prediction_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookup of one prediction (the newest order's)."""
    from lendscope.operators import rollups as ru
    from lendscope.sources.tables import Tables
    newest = Tables(spark, sf_dir).orders.agg(F.max("o_orderkey")).first()[0]
    hit = ru.prediction_lookup(ad.prediction_log(spark, sf_dir), newest)
    return hit.select("request_id", "model_version", _r("pd_score"), "risk_rating", "success", "status")


@register("metric_display", ops=("FN-10", "FN-13", "FN-19", "FN-21"), sql=with_views("""
SELECT endpoint, CASE WHEN avg_rt < 1 THEN printf('%.1fms', avg_rt * 1000) ELSE printf('%.2fs', avg_rt) END AS response_time,
       printf('%.2f%%', err * 100) AS error_rate, printf('%.4f (%.1f%%)', 1 - err, (1 - err) * 100) AS accuracy,
       format('{:,}', n) AS request_count,
       CASE WHEN busy >= 86400 THEN (busy // 86400) || 'd ' || (busy % 86400 // 3600) || 'h ' || (busy % 3600 // 60) || 'm'
            WHEN busy >= 3600 THEN (busy // 3600) || 'h ' || (busy % 3600 // 60) || 'm' ELSE (busy // 60) || 'm' END AS busy_time,
       CASE WHEN size < 1024 THEN printf('%.1f B', size) WHEN size < 1048576 THEN printf('%.1f KB', size / 1024)
            ELSE printf('%.1f MB', size / 1048576) END AS payload,
       CASE WHEN size >= 1e6 THEN printf('%.1fM', size / 1e6) WHEN size >= 1e3 THEN printf('%.1fK', size / 1e3)
            ELSE printf('%.1f', size) END AS payload_count
FROM (SELECT endpoint, avg(response_time) AS avg_rt, avg(CASE WHEN status_code >= 400 THEN 1.0E0 ELSE 0.0E0 END) AS err,
             count(*) AS n, CAST(floor(sum(response_time)) AS BIGINT) AS busy, CAST(sum(strlen(metadata)) AS DOUBLE) AS size
      FROM api_metrics GROUP BY 1) a""", "api_metrics"))
def metric_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display forms of each endpoint's metrics."""
    a = ad.api_metrics(spark, sf_dir).groupBy("endpoint").agg(
        F.avg("response_time").alias("rt"), F.avg((F.col("status_code") >= 400).cast("double")).alias("err"),
        F.count(F.lit(1)).alias("n"), F.floor(F.sum("response_time")).cast("long").alias("busy"),
        F.sum(F.octet_length("metadata")).cast("double").alias("size"))
    return a.select("endpoint", tx.format_metric(F.lit("response_time"), F.col("rt")).alias("response_time"),
                    tx.format_metric(F.lit("error_rate"), F.col("err")).alias("error_rate"),
                    tx.format_metric(F.lit("accuracy"), 1 - F.col("err")).alias("accuracy"),
                    tx.format_metric(F.lit("request_count"), F.col("n")).alias("request_count"),
                    tx.format_uptime("busy").alias("busy_time"), tx.file_size_human("size").alias("payload"),
                    tx.format_large_number("size").alias("payload_count"))


# Economic snapshots: fixed publication table (values of this library, one row per date).
ECONOMIC_SNAPSHOTS = [
    ("1995-01-01 00:00:00", 5.5, 5.6, 7.8), ("1996-06-01 00:00:00", 5.25, 5.3, 6.9),
    ("1998-01-01 00:00:00", 5.5, 4.6, 5.6), ("1999-07-01 00:00:00", 5.0, 4.3, 6.0),
    ("2001-01-01 00:00:00", 6.0, 4.2, 5.2),
]
_ECO_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"(TIMESTAMP '{d}', {a}E0, {b}E0, {c}E0)" for d, a, b, c in ECONOMIC_SNAPSHOTS) + \
    ") AS e(eff_from, fed_funds_rate, unemployment_rate, avg_interest_rate)"


def economic_snapshots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(d, a, b, c) for d, a, b, c in ECONOMIC_SNAPSHOTS],
        "eff_from string, fed_funds_rate double, unemployment_rate double, avg_interest_rate double"
    ).withColumn("eff_from", F.col("eff_from").cast("timestamp_ntz"))


@register("economic_context_asof", ops=("JN-02", "FE-17", "FE-18", "FE-19"), sql=with_views(f"""
SELECT loan_purpose, count(*) AS applications,
       round(avg(least(unemployment_rate / 15.0E0, 1.0E0) / 2 + least(fed_funds_rate / 10.0E0, 1.0E0) / 2), 8)
         AS avg_economic_stress_index,
       round(avg(unemployment_rate / 10.0E0 + greatest(0.0E0, fed_funds_rate - 3.0E0) / 10.0E0), 8) AS avg_macro_stress,
       CAST(sum(CASE WHEN fed_funds_rate > 3.0E0 THEN 1 ELSE 0 END) AS BIGINT) AS high_rate_environment
FROM credit_applications a ASOF LEFT JOIN ({_ECO_SQL}) e ON a.application_ts >= e.eff_from
GROUP BY loan_purpose""", "credit_applications"))
def economic_context_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    eco = fe.economic_features(fe.economic_environment(
        economic_snapshots(spark).withColumn("fed_funds_rate_raw", F.col("fed_funds_rate"))))
    eco = eco.select("eff_from", "economic_stress_index", "interest_rate_environment",
                     fe.macro_stress_index("unemployment_rate", "fed_funds_rate_raw").alias("macro_stress"))
    j = fe.attach_economics_asof(ad.credit_applications(spark, sf_dir), eco)
    return j.groupBy("loan_purpose").agg(
        F.count(F.lit(1)).alias("applications"),
        F.round(F.avg("eco_economic_stress_index"), 8).alias("avg_economic_stress_index"),
        F.round(F.avg("eco_macro_stress"), 8).alias("avg_macro_stress"),
        F.sum((F.col("eco_interest_rate_environment") == "high").cast("long")).alias("high_rate_environment"))


_SCALED = ["loan_amount", "interest_rate", "income", "debt_to_income", "credit_score", "employment_length", "loan_term"]


@register("scaler_fit", ops=("FE-21", "VAL-11", "PRJ-04", "FE-24"), sql=with_views("\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) = 0 THEN 1.0E0 "
    f"ELSE stddev_pop({c}) END, 6) AS std, round(quantile_cont({c}, 0.5), 6) AS median FROM credit_applications"
    for c in _SCALED), "credit_applications"))
def scaler_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ad.credit_applications(spark, sf_dir)
    cols = [c for c in fe.numeric_feature_columns(a) if c in _SCALED]
    s = fe.fit_scaler(a, cols)
    m = fe.fit_medians(materialize(a, cols), cols, every=True)
    return s.join(m, "feature").select("feature", _r("mean", 6), _r("std", 6), _r("median", 6))


@register("training_frame", ops=("FE-22", "FE-23", "FE-24", "PRJ-05", "JN-01", "VAL-11", "FE-21"))
def training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled, imputed model inputs for the whole book (rows-only check)."""
    snap = economic_snapshots(spark).orderBy(F.col("eff_from").desc()).limit(1).drop("eff_from")
    frame, names, _ = fe.prepare_training_frame(ad.credit_applications(spark, sf_dir), snap)
    return frame


@register("display_formatting", ops=("FN-08", "FN-09", "FN-10", "FN-13", "FN-15", "FN-20", "FN-11"), sql=with_views("""
SELECT app_id,
       '$' || format('{:,.2f}', floor(loan_amount * 100.0E0 + 0.5E0) / 100.0E0) AS amount_display,
       printf('%.2f', round(interest_rate * 100.0E0, 2)) || '%' AS rate_display,
       CASE WHEN abs(income) >= 1e9 THEN printf('%.1f', round(income / 1e9, 1)) || 'B'
            WHEN abs(income) >= 1e6 THEN printf('%.1f', round(income / 1e6, 1)) || 'M'
            WHEN abs(income) >= 1e3 THEN printf('%.1f', round(income / 1e3, 1)) || 'K'
            ELSE printf('%.1f', round(income, 1)) END AS income_display,
       CASE WHEN length(customer_id) <= 3 THEN customer_id ELSE substr(customer_id, 1, 0) || '...' END AS customer_short,
       CASE WHEN employment_length * 3600 < 60 THEN CAST(employment_length * 3600 AS VARCHAR) || 's'
            WHEN employment_length * 3600 < 3600 THEN CAST(employment_length * 60 AS VARCHAR) || 'm'
            WHEN employment_length * 3600 < 86400 THEN CAST(employment_length AS VARCHAR) || 'h'
            ELSE CAST(employment_length // 24 AS VARCHAR) || 'd' ||
                 CASE WHEN employment_length % 24 <> 0 THEN ' ' || CAST(employment_length % 24 AS VARCHAR) || 'h' ELSE '' END
       END AS tenure_display,
       array_to_string(list_transform(string_split(lower(loan_purpose), '_'),
                                      lambda w: upper(w[1]) || w[2:]), ' ') AS purpose_title
FROM credit_applications""", "credit_applications"))
def display_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ad.credit_applications(spark, sf_dir)
    return a.select(
        "app_id", tx.format_currency(F.floor(F.col("loan_amount") * 100.0 + 0.5) / 100.0).alias("amount_display"),
        tx.format_percentage(F.round(F.col("interest_rate") * 100.0, 2) / 100.0).alias("rate_display"),
        F.when(F.abs("income") >= 1e9, F.concat(F.format_string("%.1f", F.round(F.col("income") / 1e9, 1)), F.lit("B")))
        .when(F.abs("income") >= 1e6, F.concat(F.format_string("%.1f", F.round(F.col("income") / 1e6, 1)), F.lit("M")))
        .when(F.abs("income") >= 1e3, F.concat(F.format_string("%.1f", F.round(F.col("income") / 1e3, 1)), F.lit("K")))
        .otherwise(F.format_string("%.1f", F.round("income", 1))).alias("income_display"),
        tx.truncate_string("customer_id", 3).alias("customer_short"),
        tx.format_duration(F.col("employment_length") * 3600).alias("tenure_display"),
        tx.title_case_metric(F.lower("loan_purpose")).alias("purpose_title"))


@register("batch_scoring_summary", ops=("AGG-19", "RSK-08", "VAL-02", "D-04"), sql=with_views("""
SELECT count(*) AS total, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS successful,
       CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS failed,
       sum(CASE WHEN ok THEN 0 ELSE 1 END) = 0 AS success,
       round(sum(CASE WHEN ok THEN expected_loss ELSE 0 END), 6) AS expected_loss
FROM (SELECT *, (loan_amount > 0 AND loan_amount <= 1000000.0E0 AND loan_term BETWEEN 12 AND 360
                 AND interest_rate BETWEEN 0.01E0 AND 0.40E0 AND income BETWEEN 1000.0E0 AND 10000000.0E0
                 AND debt_to_income BETWEEN 0.0E0 AND 0.8E0 AND credit_score BETWEEN 300 AND 850
                 AND employment_length BETWEEN 0 AND 50 AND length(customer_id) BETWEEN 1 AND 100
                 AND home_ownership IN ('RENT','OWN','MORTGAGE','OTHER')
                 AND lower(loan_purpose) IN ('debt_consolidation','credit_card','home_improvement','major_purchase',
                                             'medical','small_business','vacation','wedding','other')) AS ok
      FROM scored_book) s""", "scored_book"))
def batch_scoring_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole book through the API-edge rules: failed rows are kept as error rows,
    the batch is not aborted; successful rows carry their scores."""
    from lendscope.operators import quality as vq
    from lendscope.plans.book import scored_book
    s = scored_book(spark, sf_dir, validate=False).withColumn("loan_purpose", F.lower("loan_purpose"))
    v = vq.apply_rules(s, vq.api_request_rules(), upper_enums=False)
    ok = F.col("is_valid")
    return v.agg(F.count(F.lit(1)).alias("total"), F.sum(ok.cast("long")).alias("successful"),
                 F.sum((~ok).cast("long")).alias("failed"),
                 (F.sum((~ok).cast("long")) == 0).alias("success"),
                 F.round(F.sum(F.when(ok, F.col("expected_loss")).otherwise(F.lit(0.0))), 6).alias("expected_loss"))


@register("page_url_checks", ops=("VAL-10", "FN-11", "FN-12", "FN-13", "FN-20"), sql="""
SELECT page_id, regexp_full_match(url, '^https?://[^\\s/$.?#].[^\\s]*$') AS is_url,
       regexp_full_match(url, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$') AS is_email,
       CASE WHEN length(url) <= 30 THEN url ELSE substr(url, 1, 27) || '...' END AS url_short,
       trim(translate(url, '<>:"/\\|?*', '_________'), ' .') AS file_name,
       CASE WHEN length(html) < 1024 THEN printf('%.1f', length(html) * 1.0E0) || ' B'
            WHEN length(html) < 1048576 THEN printf('%.1f', round(length(html) / 1024.0E0, 1)) || ' KB'
            ELSE printf('%.1f', round(length(html) / 1048576.0E0, 1)) || ' MB' END AS html_size
FROM pages""")
def page_url_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendscope.operators import quality as vq
    from lendscope.sources.tables import Tables
    p = Tables(spark, sf_dir).pages
    flags = vq.pattern_flags("url")
    n = F.length("html").cast("double")
    size = (F.when(n < 1024, F.concat(F.format_string("%.1f", n), F.lit(" B")))
            .when(n < 1048576, F.concat(F.format_string("%.1f", F.round(n / 1024.0, 1)), F.lit(" KB")))
            .otherwise(F.concat(F.format_string("%.1f", F.round(n / 1048576.0, 1)), F.lit(" MB"))))
    return p.select("page_id", flags["is_url"].alias("is_url"), flags["is_email"].alias("is_email"),
                    tx.truncate_string("url", 30).alias("url_short"), tx.clean_filename("url").alias("file_name"),
                    size.alias("html_size"))


@register("ingestion_cycle_summary", ops=("AGG-20", "VAL-03", "D-02"), sql=with_views("""
WITH b AS (SELECT date_trunc('year', application_ts) AS batch, count(*) AS records,
                  CAST(sum(CASE WHEN loan_amount BETWEEN 1000.0E0 AND 10000000.0E0 THEN 1 ELSE 0 END) AS BIGINT) AS valid
           FROM credit_applications GROUP BY 1),
     log AS (SELECT batch, 'credit' AS data_type, 'orders' AS source,
                    CASE WHEN valid = records THEN 'success' WHEN valid > 0 THEN 'partial' ELSE 'error' END AS status,
                    valid AS record_count FROM b)
SELECT data_type, source, arg_max(status, batch) AS latest_status, CAST(sum(record_count) AS BIGINT) AS records,
       CAST(sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS BIGINT) AS clean_batches, count(*) AS batches
FROM log GROUP BY 1, 2""", "credit_applications"))
def ingestion_cycle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each application year is one ingestion batch: rows are validated, the
    good ones counted as saved, one log row per batch; then the cycle summary."""
    from lendscope.operators import quality as vq
    a = ad.credit_applications(spark, sf_dir).withColumn(
        "batch", F.date_trunc("year", "application_ts").cast("timestamp_ntz"))
    rules = [r for r in vq.application_rules() if r.name == "loan_amount_range"]
    v = vq.apply_rules(a, rules)
    b = v.groupBy("batch").agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("is_valid").cast("long")).alias("valid"))
    log = b.select("batch", F.lit("credit").alias("data_type"), F.lit("orders").alias("source"),
                   F.when(F.col("valid") == F.col("records"), "success").when(F.col("valid") > 0, "partial")
                   .otherwise("error").alias("status"), F.col("valid").alias("record_count"))
    return log.groupBy("data_type", "source").agg(
        F.max_by("status", "batch").alias("latest_status"), F.sum("record_count").cast("long").alias("records"),
        F.sum((F.col("status") == "success").cast("long")).alias("clean_batches"),
        F.count(F.lit(1)).alias("batches"))


_PORT_METRICS = ["total_exposure", "avg_pd", "avg_lgd", "default_rate", "el_mean"]


@register("portfolio_metric_table", ops=("PRJ-17", "FN-20", "PRJ-15"), sql=with_views("""
SELECT array_to_string(list_transform(string_split(metric, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS "Metric",
       printf('%.4f', floor(value * 10000.0E0 + 0.5E0) / 10000.0E0) AS "Value"
FROM (SELECT sum(loan_amount) AS total_exposure, avg(pd_score) AS avg_pd, avg(lgd_score) AS avg_lgd,
             avg(CAST(is_default AS INTEGER)) AS default_rate, avg(expected_loss) AS el_mean FROM scored_book)
UNPIVOT (value FOR metric IN (total_exposure, avg_pd, avg_lgd, default_rate, el_mean))""", "scored_book"))
def portfolio_metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendscope.plans.book import scored_book
    s = scored_book(spark, sf_dir, validate=False)
    one = s.agg(F.sum("loan_amount").alias("total_exposure"), F.avg("pd_score").alias("avg_pd"),
                F.avg("lgd_score").alias("avg_lgd"), F.avg(F.col("is_default").cast("int")).alias("default_rate"),
                F.avg("expected_loss").alias("el_mean"))
    long = one.unpivot([], _PORT_METRICS, "metric", "value")
    return long.select(tx.title_case_metric("metric").alias("Metric"),
                       F.format_string("%.4f", F.floor(F.col("value") * 10000.0 + 0.5) / 10000.0).alias("Value"))


@register("outlier_counts", ops=("FE-25",), sql=with_views("\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CAST(sum(CASE WHEN abs({c} - m) > 3.0E0 * s THEN 1 ELSE 0 END) AS BIGINT) AS outliers "
    f"FROM credit_applications, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM credit_applications) f"
    for c in _SCALED), "credit_applications"))
def outlier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-sigma rule per numeric column (fit row broadcast, one pass)."""
    a = ad.credit_applications(spark, sf_dir)
    fit = fe.fit_scaler(a, _SCALED)   # population mean / std per feature (std 0 -> 1)
    raw = a.agg(*[F.stddev_pop(c).alias(c) for c in _SCALED])
    wide = fit.groupBy().pivot("feature", _SCALED).agg(F.first("mean"))
    j = a.crossJoin(F.broadcast(wide.select([F.col(c).alias(f"_m_{c}") for c in _SCALED]))) \
        .crossJoin(F.broadcast(raw.select([F.col(c).alias(f"_s_{c}") for c in _SCALED])))
    counts = j.agg(*[F.sum(fe.outlier_flag(c, F.col(f"_m_{c}"), F.col(f"_s_{c}")).cast("long")).alias(c)
                     for c in _SCALED])
    return counts.unpivot([], _SCALED, "feature", "outliers")


@register("customer_prediction_history", ops=("WIN-05", "PRJ-08", "SRT-01"), sql=with_views("""
SELECT customer_id, request_id, CAST(rn AS INTEGER) AS rn, round(pd_score, 8) AS pd_score
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY timestamp DESC, request_id) AS rn
      FROM prediction_log) t WHERE rn <= 3""", "prediction_log"))
def customer_prediction_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest three predictions of every customer (salted top-N)."""
    from lendscope.operators.windows import top_n_per_key
    p = ad.prediction_log(spark, sf_dir)
    h = top_n_per_key(p, ["customer_id"], [F.col("timestamp").desc()], 3, tie_cols=["request_id"])
    return h.select("customer_id", "request_id", "rn", F.round("pd_score", 8).alias("pd_score"))


@register("registry_sql_listing", ops=("SRC-18", "SRT-01", "PRJ-18"), sql=with_views(f"""
SELECT model_version, status, round(accuracy, 8) AS accuracy FROM ({_VERSION_METRICS_SQL}) v
ORDER BY created_at DESC, model_version""".replace("SELECT model_version, round(avg", "SELECT model_version, 'inactive' AS status, round(avg"), "prediction_log"))
def registry_sql_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry read back through ``spark.sql`` on a temp view, newest first."""
    registry_from_log(spark, sf_dir).createOrReplaceTempView("model_registry")
    return spark.sql("""
        SELECT model_version, status,
               round(CAST(from_json(performance_metrics, 'map<string,double>')['accuracy'] AS DOUBLE), 8) AS accuracy
        FROM model_registry ORDER BY created_at DESC, model_version""")


@register("category_set_changes", ops=("SET-02", "SET-03", "SET-01", "JN-03"), sql=with_views("""
SELECT feature, category, change FROM (
  SELECT feature, category, 'new_in_current' AS change FROM
    (SELECT DISTINCT feature, category FROM drift_samples WHERE sample = 'current' AND category IS NOT NULL
     EXCEPT SELECT DISTINCT feature, category FROM drift_samples WHERE sample = 'reference' AND category IS NOT NULL) a
  UNION ALL
  SELECT feature, category, 'missing_in_current' FROM
    (SELECT DISTINCT feature, category FROM drift_samples WHERE sample = 'reference' AND category IS NOT NULL
     EXCEPT SELECT DISTINCT feature, category FROM drift_samples WHERE sample = 'current' AND category IS NOT NULL) b
  UNION ALL
  SELECT feature, category, 'shared' FROM
    (SELECT DISTINCT feature, category FROM drift_samples WHERE sample = 'reference' AND category IS NOT NULL
     INTERSECT SELECT DISTINCT feature, category FROM drift_samples WHERE sample = 'current' AND category IS NOT NULL) c) t""",
                                                            "drift_samples"))
def category_set_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category sets of the two samples: differences both ways and the overlap."""
    long = ad.drift_samples(spark, sf_dir).where(F.col("category").isNotNull())
    ref = long.where(F.col("sample") == "reference").select("feature", "category").distinct()
    cur = long.where(F.col("sample") == "current").select("feature", "category").distinct()
    new = cur.join(ref, ["feature", "category"], "left_anti").withColumn("change", F.lit("new_in_current"))
    gone = ref.subtract(cur).withColumn("change", F.lit("missing_in_current"))
    both = ref.intersect(cur).withColumn("change", F.lit("shared"))
    return new.unionByName(gone).unionByName(both)


@register("multi_source_applications", ops=("SET-04", "SET-05", "D-22"), sql=with_views("""
WITH a AS (SELECT customer_id, loan_amount, 'orders' AS source FROM credit_applications
           WHERE application_ts >= TIMESTAMP '2010-01-01 00:00:00'),
     b AS (SELECT customer_id, loan_amount, 'orders_all' AS source FROM credit_applications),
     chosen AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a)),
     prospects AS (SELECT CAST(c_custkey AS VARCHAR) AS customer_id, CAST(NULL AS DOUBLE) AS loan_amount,
                          'customers' AS source FROM customer
                   WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))
SELECT source, count(*) AS records, count(loan_amount) AS with_amount
FROM (SELECT * FROM chosen UNION ALL SELECT * FROM prospects) u GROUP BY source""", "credit_applications"))
def multi_source_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallback source (first non-empty) plus prospects from a second mapping
    with fewer columns, appended by name."""
    from lendscope.sources.tables import Tables
    apps = ad.credit_applications(spark, sf_dir)
    a = apps.where(F.col("application_ts") >= F.lit("2010-01-01 00:00:00").cast("timestamp_ntz")) \
        .select("customer_id", "loan_amount", F.lit("orders").alias("source"))
    b = apps.select("customer_id", "loan_amount", F.lit("orders_all").alias("source"))
    a_empty = a.limit(1).groupBy().count().withColumnRenamed("count", "_a")   # 0 or 1, no full scan
    chosen = a.unionByName(b.crossJoin(F.broadcast(a_empty)).where(F.col("_a") == 0).drop("_a"))
    t = Tables(spark, sf_dir)
    prospects = t.customer.join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti") \
        .select(F.col("c_custkey").cast("string").alias("customer_id"), F.lit("customers").alias("source"))
    u = chosen.unionByName(prospects, allowMissingColumns=True)
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.count("loan_amount").alias("with_amount"))


_RECORD_SQL = """
WITH m AS (SELECT model_version, count(*) AS n, avg(CAST((pd_score > 0.5E0) = is_default AS DOUBLE)) AS accuracy, avg(pd_score) AS mean_pd,
                  avg(CAST(is_default AS DOUBLE)) AS default_rate, avg(expected_loss) AS el, avg(response_time_ms) AS ms,
                  max(timestamp) AS last_evaluated FROM prediction_log GROUP BY 1)"""


@register("model_performance_record", ops=("PRJ-19", "JN-08", "MV-15", "AGG-11"), sql=with_views(_RECORD_SQL + """
SELECT position, a.model_version, last_evaluated, round(accuracy, 8) AS accuracy,
       CASE WHEN a.model_version = 'v2' THEN NULL ELSE round(mean_pd - default_rate, 8) END AS calibration_gap,
       round(el, 8) AS expected_loss_mean, CASE WHEN n IS NULL THEN NULL ELSE 0 END AS validation_results,
       n AS total_predictions, round(ms, 6) AS avg_response_time_ms,
       CASE WHEN n IS NULL THEN 'Model version ' || a.model_version || ' not found' END AS error
FROM (VALUES (0, 'v2'), (1, 'v9'), (2, 'v1')) a(position, model_version) LEFT JOIN m ON m.model_version = a.model_version""",
                                                                                                 "prediction_log"))
def model_performance_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requested versions side by side: v2 has no calibration section, v9 is unknown, nobody has validation results."""
    p = ad.prediction_log(spark, sf_dir)
    m = p.groupBy("model_name", "model_version").agg(
        F.avg(((F.col("pd_score") > 0.5) == F.col("is_default")).cast("double")).alias("accuracy"), F.avg("pd_score").alias("mean_pd"),
        F.avg(F.col("is_default").cast("double")).alias("default_rate"), F.avg("expected_loss").alias("el"),
        F.avg("response_time_ms").alias("avg_response_time_ms"), F.count(F.lit(1)).alias("total_predictions"),
        F.max("timestamp").alias("updated_at"))
    m = materialize(m)                                    # one row a version, read by registry and statistics
    gap = F.when(F.col("model_version") != "v2", F.struct((F.col("mean_pd") - F.col("default_rate")).alias("gap")))
    reg = m.select("model_name", "model_version", F.lit("inactive").alias("status"), "updated_at", F.to_json(F.struct(
        F.struct("accuracy").alias("accuracy_metrics"), gap.alias("calibration_metrics"),
        F.struct(F.col("el").alias("expected_loss_mean")).alias("business_metrics"))).alias("performance_metrics"))
    rec = rg.performance_record(reg, m.select("model_version", "total_predictions", "avg_response_time_ms"), ["v2", "v9", "v1", "v2"])
    return rec.select(
        "position", "model_version", "last_evaluated", F.round(F.col("accuracy_metrics")["accuracy"], 8).alias("accuracy"),
        F.round(F.col("calibration_metrics")["gap"], 8).alias("calibration_gap"),
        F.round(F.col("business_metrics")["expected_loss_mean"], 8).alias("expected_loss_mean"),
        F.when(F.col("validation_results").isNotNull(), F.size("validation_results")).alias("validation_results"),
        "total_predictions", F.round("avg_response_time_ms", 6).alias("avg_response_time_ms"), "error")


@register("model_performance_history", ops=("PRJ-07", "SRC-12"), sql=with_views("""
SELECT model_name, model_version, metric_name, round(metric_value, 8) AS metric_value, timestamp
FROM (SELECT * FROM model_metrics WHERE timestamp >= (TIMESTAMP '1998-08-02 00:00:00' - INTERVAL 90 DAY) AND timestamp <= TIMESTAMP '1998-08-02 00:00:00')
     UNPIVOT (metric_value FOR metric_name IN (accuracy, avg_prediction_time, avg_pd_score))""", "model_metrics"))
def model_performance_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 90 days of a model's metrics as rows of name and value."""
    h = rg.performance_history(ad.model_metrics(spark, sf_dir), ["accuracy", "avg_prediction_time", "avg_pd_score"],
                               "credit_risk_model", "1998-08-02 00:00:00", 90)
    return h.withColumns({"metric_value": F.round("metric_value", 8), "timestamp": F.col("timestamp").cast("timestamp_ntz")})


@register("active_model", ops=("PRJ-18", "AGG-18", "ML-12"), sql=with_views(f"""
SELECT 'credit_risk_model' AS model_name, model_version, 'scorecard' AS model_type, true AS is_loaded, 9 AS feature_count,
       round(accuracy, 8) AS accuracy, 3 AS metrics, created_at
FROM ({_VERSION_METRICS_SQL}) v WHERE model_version = 'v1'""", "prediction_log"))
def active_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = rg.activate(registry_from_log(spark, sf_dir), "credit_risk_model", "v1", F.col("updated_at"))
    info = rg.active_model_info(reg, "credit_risk_model", ad.CONTINUOUS_FEATURES + ad.CATEGORICAL_FEATURES)
    return info.select("model_name", "model_version", "model_type", "is_loaded", "feature_count",
                       F.round(F.col("metrics")["accuracy"], 8).alias("accuracy"), F.size("metrics").alias("metrics"), "created_at")


_PATCH = '{"k": 7, "source": {"host": {"name": "a", "zone": {"id": 3, "tags": ["x", "y"]}}, "kind": "api"}}'
_BASE = '{"source": {"host": {"zone": {"id": 1, "label": "old"}, "cpu": 4}, "kind": {"was": "object"}}}'


@register("metadata_deep_merge", ops=("FN-18", "FN-03"), sql=f"""
WITH b AS (SELECT event_id, props, json_merge_patch(props, CASE WHEN event_id % 3 = 0 THEN '{_BASE}' ELSE '{{}}' END) AS base FROM events),
m AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_merge_patch(base, '{_PATCH}') ELSE base END AS j FROM b)
SELECT event_id, CAST(json_extract(j, '$.k') AS BIGINT) AS k, json_extract_string(j, '$.source.kind') AS kind,
       json_extract_string(j, '$.source.host.name') AS host, CAST(json_extract(j, '$.source.host.cpu') AS BIGINT) AS cpu,
       CAST(json_extract(j, '$.source.host.zone.id') AS BIGINT) AS zone, json_extract_string(j, '$.source.host.zone.label') AS label,
       CAST(coalesce(json_array_length(j, '$.source.host.zone.tags'), 0) AS INTEGER) AS tags
FROM m WHERE json_extract_string(j, '$.source.kind') IS NOT NULL""")
def metadata_deep_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request metadata of four levels merged with a base and a patch; arrays and texts are replaced, objects merged."""
    e = Tables(spark, sf_dir).events
    base = F.to_json(jx.deep_merge(F.col("props"), F.when(F.col("event_id") % 3 == 0, F.lit(_BASE))))
    v = e.select("event_id", jx.deep_merge(base, F.when(F.col("event_id") % 2 == 0, F.lit(_PATCH))).alias("j"))

    def get(path: str, kind: str):
        return F.try_variant_get("j", f"$.{path}", kind)

    kind = get("source.kind", "variant")
    return v.where(kind.isNotNull()).select(
        "event_id", get("k", "bigint").alias("k"), F.coalesce(get("source.kind", "string"), F.to_json(kind)).alias("kind"),
        get("source.host.name", "string").alias("host"), get("source.host.cpu", "bigint").alias("cpu"),
        get("source.host.zone.id", "bigint").alias("zone"), get("source.host.zone.label", "string").alias("label"),
        F.coalesce(F.size(get("source.host.zone.tags", "array<string>")), F.lit(0)).alias("tags"))


@register("credit_filter", ops=("PRJ-11", "SRC-07"), sql=with_views("""
SELECT app_id, loan_purpose, home_ownership, credit_score, round(loan_amount, 4) AS loan_amount FROM credit_applications
WHERE loan_purpose IN ('CAR', 'MEDICAL') AND home_ownership = 'RENT' AND credit_score BETWEEN 600 AND 700""", "credit_applications"))
def credit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters by a list of values, by a value and by a closed range."""
    a = ad.credit_applications(spark, sf_dir)
    keep = rg.filters({"loan_purpose": ["CAR", "MEDICAL"], "home_ownership": "RENT", "credit_score": (600, 700)})
    return a.where(keep).select("app_id", "loan_purpose", "home_ownership", "credit_score", _r("loan_amount", 4))


@register("application_profile_text", ops=("FN-26", "FN-27"), sql=with_views("""
SELECT app_id, 'BORROWER PROFILE:' || chr(10) || '- Borrower ID: ' || customer_id || chr(10) || '- Loan Amount: $' || format('{:,}', CAST(floor(loan_amount) AS BIGINT))
  || chr(10) || '- Credit Score: ' || credit_score || chr(10) || '- Debt-to-Income Ratio: ' || printf('%.2f', debt_to_income * 100) || '%' || chr(10) || '- Industry: N/A'
  || chr(10) || chr(10) || 'MODEL PREDICTIONS:' || chr(10) || '- Probability of Default (PD): ' || printf('%.2f', pd_score * 100) || '%' || chr(10) || '- Risk Rating: ' || risk_rating
  || CASE app_id % 3 WHEN 0 THEN chr(10) || chr(10) || 'AUDIENCE FOCUS: Emphasize business implications, practical applications, and strategic insights.'
                     WHEN 1 THEN chr(10) || chr(10) || 'AUDIENCE FOCUS: Provide high-level strategic perspective with actionable recommendations.' ELSE '' END AS text
FROM scored_book""", "scored_book"))
def application_profile_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile and prediction text of each application, with the focus of its audience (one is unknown)."""
    from lendscope.plans.book import scored_book
    s = scored_book(spark, sf_dir, validate=False)
    who = F.element_at(F.array(F.lit("business"), F.lit("executive"), F.lit("nobody")), (F.col("app_id") % 3 + 1).cast("int"))
    profile = tx.profile_text("BORROWER PROFILE", [
        ("Borrower ID", F.col("customer_id"), "text"), ("Loan Amount", F.floor("loan_amount"), "currency"),
        ("Credit Score", F.col("credit_score"), "text"), ("Debt-to-Income Ratio", F.col("debt_to_income"), "percent"),
        ("Industry", F.lit(None).cast("string"), "text")])
    scores = tx.profile_text("MODEL PREDICTIONS", [("Probability of Default (PD)", F.col("pd_score"), "percent"),
                                                   ("Risk Rating", F.col("risk_rating"), "text")])
    return s.select("app_id", tx.for_audience(F.concat(profile, F.lit("\n\n"), scores), who).alias("text"))
