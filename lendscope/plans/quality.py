"""Validation, quality and feature-engineering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.operators import features as fe
from lendscope.operators import quality as vq
from lendscope.plans.oracle_views import with_views
from lendscope.plans.registry import register
from lendscope.sources.adapters import credit_applications

_RULES_SQL = """[
 CASE WHEN customer_id IS NULL THEN 'customer_id_required' END,
 CASE WHEN loan_amount IS NULL OR NOT (loan_amount BETWEEN 1000.0E0 AND 10000000.0E0) THEN 'loan_amount_range' END,
 CASE WHEN loan_term IS NULL OR loan_term NOT IN (12, 24, 36, 48, 60, 84, 120, 180, 240, 360) THEN 'loan_term_value' END,
 CASE WHEN interest_rate IS NULL OR NOT (interest_rate BETWEEN 0.01E0 AND 0.50E0) THEN 'interest_rate_range' END,
 CASE WHEN income IS NULL OR NOT (income BETWEEN 10000.0E0 AND 10000000.0E0) THEN 'income_range' END,
 CASE WHEN debt_to_income IS NULL OR NOT (debt_to_income BETWEEN 0.0E0 AND 2.0E0) THEN 'debt_to_income_range' END,
 CASE WHEN credit_score IS NULL OR NOT (credit_score BETWEEN 300 AND 850) THEN 'credit_score_range' END,
 CASE WHEN employment_length IS NULL OR NOT (employment_length BETWEEN 0 AND 50) THEN 'employment_length_range' END,
 CASE WHEN home_ownership IS NULL OR upper(home_ownership) NOT IN ('RENT','OWN','MORTGAGE','OTHER') THEN 'home_ownership_value' END,
 CASE WHEN loan_purpose IS NULL OR upper(loan_purpose) NOT IN ('DEBT_CONSOLIDATION','CREDIT_CARD','HOME_IMPROVEMENT',
      'MAJOR_PURCHASE','MEDICAL','VACATION','WEDDING','MOVING','HOUSE','CAR','OTHER') THEN 'loan_purpose_value' END]"""

_API_RULES_SQL = """[
 CASE WHEN customer_id IS NULL OR NOT (length(customer_id) BETWEEN 1 AND 100) THEN 'customer_id_length' END,
 CASE WHEN loan_amount IS NULL OR NOT (loan_amount > 0 AND loan_amount <= 1000000.0E0) THEN 'loan_amount_range' END,
 CASE WHEN loan_term IS NULL OR NOT (loan_term BETWEEN 12 AND 360) THEN 'loan_term_range' END,
 CASE WHEN interest_rate IS NULL OR NOT (interest_rate BETWEEN 0.01E0 AND 0.40E0) THEN 'interest_rate_range' END,
 CASE WHEN income IS NULL OR NOT (income BETWEEN 1000.0E0 AND 10000000.0E0) THEN 'income_range' END,
 CASE WHEN debt_to_income IS NULL OR NOT (debt_to_income BETWEEN 0.0E0 AND 0.8E0) THEN 'debt_to_income_range' END,
 CASE WHEN credit_score IS NULL OR NOT (credit_score BETWEEN 300 AND 850) THEN 'credit_score_range' END,
 CASE WHEN employment_length IS NULL OR NOT (employment_length BETWEEN 0 AND 50) THEN 'employment_length_range' END,
 CASE WHEN home_ownership IS NULL OR home_ownership NOT IN ('RENT','OWN','MORTGAGE','OTHER') THEN 'home_ownership_value' END,
 CASE WHEN loan_purpose IS NULL OR loan_purpose NOT IN ('debt_consolidation','credit_card','home_improvement',
      'major_purchase','medical','small_business','vacation','wedding','other') THEN 'loan_purpose_value' END]"""


@register("validation_rule_failures", ops=("VAL-01", "VAL-03"), sql=with_views(f"""
SELECT rule, count(*) AS failures
FROM (SELECT unnest(list_filter({_RULES_SQL}, lambda x: x IS NOT NULL)) AS rule FROM credit_applications) t
GROUP BY rule""", "credit_applications"))
def validation_rule_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vq.apply_rules(credit_applications(spark, sf_dir), vq.application_rules())
    return vq.rule_failure_counts(v)


@register("validation_verdict", ops=("VAL-03",), sql=with_views(f"""
SELECT total_records, valid_records, total_records - valid_records AS invalid_records,
       round(valid_records / total_records, 6) AS completeness, total_records > 0 AS non_empty,
       valid_records / total_records >= 0.95E0 AS meets_completeness,
       total_records > 0 AND total_records = valid_records AS all_valid
FROM (SELECT count(*) AS total_records,
             CAST(sum(CASE WHEN len(list_filter({_RULES_SQL}, lambda x: x IS NOT NULL)) = 0 THEN 1 ELSE 0 END) AS BIGINT)
               AS valid_records
      FROM credit_applications) t""", "credit_applications"))
def validation_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vq.apply_rules(credit_applications(spark, sf_dir), vq.application_rules())
    out = vq.batch_verdict(v)
    return out.withColumn("completeness", F.round("completeness", 6))


@register("api_rule_failures", ops=("VAL-02",), sql=with_views(f"""
SELECT rule, count(*) AS failures
FROM (SELECT unnest(list_filter({_API_RULES_SQL}, lambda x: x IS NOT NULL)) AS rule FROM credit_applications) t
GROUP BY rule""", "credit_applications"))
def api_rule_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = credit_applications(spark, sf_dir)
    v = vq.apply_rules(apps, vq.api_request_rules(), upper_enums=False)
    return vq.rule_failure_counts(v)


_NUMERIC = ["app_id", "loan_amount", "loan_term", "interest_rate", "income", "debt_to_income",
            "credit_score", "employment_length", "loss_given_default"]


def _suspicious_sql() -> str:
    parts = []
    for c in _NUMERIC:
        frac = c in ("loan_amount", "interest_rate", "income", "debt_to_income", "loss_given_default")
        parts.append(f"""SELECT '{c}' AS "column", count({c}) AS non_null,
       round(stddev_samp({c}), 4) AS std,
       round(avg(CASE WHEN {c} IS NOT NULL THEN CAST(CAST({c} AS DOUBLE) = round(CAST({c} AS DOUBLE), 0) AS DOUBLE) END), 6) AS whole_share,
       coalesce(count(*) >= 10 AND count({c}) > 5 AND (stddev_samp({c}) = 0
         OR avg(CASE WHEN {c} IS NOT NULL THEN CAST(CAST({c} AS DOUBLE) = round(CAST({c} AS DOUBLE), 0) AS DOUBLE) END) > 0.9E0), false) AS suspicious,
       {'true' if frac else 'false'} AS gating
FROM credit_applications""")
    return with_views("\nUNION ALL\n".join(parts), "credit_applications")


@register("suspicious_patterns", ops=("VAL-06",), sql=_suspicious_sql())
def suspicious_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = credit_applications(spark, sf_dir)
    out = vq.suspicious_patterns(apps, _NUMERIC)
    return out.select("column", "non_null", F.round("std", 4).alias("std"),
                      F.round("whole_share", 6).alias("whole_share"), "suspicious", "gating")


_FEATURE_OUT = ["income_to_loan_ratio", "loan_to_income_ratio", "credit_score_normalized",
                "loan_term_risk", "interest_rate_percentile", "ownership_stability",
                "purpose_risk_score", "financial_stress_score", "monthly_payment", "payment_to_income_ratio"]
_FEATURE_TEXT = ["income_quartile", "credit_score_band", "dti_risk_category", "employment_stability",
                 "high_dti_flag", "short_term_loan", "high_interest_rate", "long_employment"]


@register("credit_features", ops=("FE-01", "FE-02", "FE-03", "FE-04", "FE-05", "FE-06", "FE-07", "FE-08",
                                  "FE-09", "FE-10", "FE-11", "FE-12", "FE-13", "FE-14", "FE-15", "FE-16",
                                  "WIN-01", "FN-22", "FN-23", "JN-04", "VAL-08", "UDF-04"),
          sql=with_views("SELECT app_id, " + ", ".join(_FEATURE_TEXT) + ", "
                         + ", ".join(f"round({c}, 6) AS {c}" for c in _FEATURE_OUT[:-1])
                         + ", round(monthly_payment * 12.0E0 / (income + 1e-6), 6) AS payment_to_income_ratio"
                         + " FROM features", "features"))
def credit_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every engineered credit feature for every application."""
    f = fe.engineer_credit_features(credit_applications(spark, sf_dir))
    return f.select("app_id", *_FEATURE_TEXT, *[F.round(c, 6).alias(c) for c in _FEATURE_OUT])


@register("income_quartile_mix", ops=("FE-03", "AGG-13"), sql=with_views("""
SELECT income_quartile, count(*) AS applications,
       round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM features GROUP BY income_quartile""", "features"))
def income_quartile_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = credit_applications(spark, sf_dir)
    f = apps.crossJoin(F.broadcast(fe.fit_income_quartiles(apps))).select(fe.income_quartile().alias("income_quartile"))
    g = f.groupBy("income_quartile").agg(F.count(F.lit(1)).alias("applications"))
    tot = g.agg(F.sum("applications").alias("_n"))
    return g.crossJoin(tot).select("income_quartile", "applications",
                                   F.round(F.col("applications") / F.col("_n"), 6).alias("share"))


@register("out_of_time_features", ops=("FE-03", "FE-10", "FE-23", "D-08", "JN-02"), sql=with_views("""
WITH ref AS (SELECT * FROM credit_applications WHERE application_ts < TIMESTAMP '1998-04-15 00:00:00'),
     cur AS (SELECT * FROM credit_applications WHERE application_ts >= TIMESTAMP '1998-04-15 00:00:00'),
     f0 AS (SELECT interest_rate AS v, count(*) AS cnt FROM ref GROUP BY 1),
     fit AS (SELECT v, cnt, sum(cnt) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) - cnt AS below,
                    sum(cnt) OVER () AS n FROM f0),
     e AS (SELECT quantile_cont(income, [0.0, 0.25, 0.5, 0.75, 1.0]) AS edges FROM ref)
SELECT c.app_id,
       round(CASE WHEN f.v IS NULL THEN 0.0E0 WHEN f.v = c.interest_rate THEN (f.below + (f.cnt + 1) / 2.0E0) / f.n
                  ELSE (f.below + f.cnt) / f.n END, 8) AS interest_rate_percentile,
       CASE WHEN c.income IS NULL THEN NULL
            WHEN len(list_distinct(e.edges)) = 5 THEN
              CASE WHEN c.income <= e.edges[2] THEN 'Q1' WHEN c.income <= e.edges[3] THEN 'Q2'
                   WHEN c.income <= e.edges[4] THEN 'Q3' ELSE 'Q4' END
            ELSE CASE WHEN c.income < 40000.0E0 THEN 'Q1' WHEN c.income < 60000.0E0 THEN 'Q2'
                      WHEN c.income < 90000.0E0 THEN 'Q3' ELSE 'Q4' END END AS income_quartile
FROM cur c ASOF LEFT JOIN fit f ON c.interest_rate >= f.v, e""", "credit_applications"))
def out_of_time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits (income quartile edges, rate ranks) from the reference period, applied
    to later applications: the scoring transform reuses the training fit (D-08)."""
    from lendscope.sources.adapters import DRIFT_SPLIT_TS
    apps = credit_applications(spark, sf_dir)
    split = F.lit(DRIFT_SPLIT_TS).cast("timestamp_ntz")
    ref, cur = apps.where(F.col("application_ts") < split), apps.where(F.col("application_ts") >= split)
    f = fe.engineer_credit_features(cur, income_fit=fe.fit_income_quartiles(ref), rate_fit=fe.fit_rate_ranks(ref))
    return f.select("app_id", F.round("interest_rate_percentile", 8).alias("interest_rate_percentile"), "income_quartile")


_BATCH_COLUMNS = ["app_id", "customer_id", "loan_amount", "loan_term", "loan_purpose", "home_ownership", "application_ts"]


@register("ingestion_roundtrip", ops=("SRC-08", "SRC-11", "VAL-01", "VAL-03"), sql=with_views(f"""
SELECT strftime(application_ts, '%Y') AS batch, CASE WHEN bad = 0 THEN 'success' WHEN good > 0 THEN 'partial' ELSE 'error' END AS status,
       good AS records, bad AS rejected, attempts, round(exposure, 2) AS exposure, failures
FROM (SELECT max(application_ts) AS application_ts, count(*) FILTER (WHERE ok) AS good, count(*) FILTER (WHERE NOT ok) AS bad,
             1 AS attempts, sum(loan_amount) FILTER (WHERE ok) AS exposure, CAST(coalesce(sum(len(e)), 0) AS BIGINT) AS failures
      FROM (SELECT *, len(e) = 0 AS ok FROM (SELECT *, list_filter({_RULES_SQL}, lambda x: x IS NOT NULL) AS e FROM credit_applications) r) v
      GROUP BY strftime(application_ts, '%Y')) b""", "credit_applications"))
def ingestion_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each application year is a batch of the store.  An attempt that dies before its commit, the append and a
    repeated append: each row is read back once, with the log row and the quarantine of its batch."""
    import uuid
    from lendscope.session import run_dir
    from lendscope.sources.stores import BatchStore
    apps = credit_applications(spark, sf_dir)
    store = BatchStore(spark, f"{run_dir(spark)}/applications-{uuid.uuid4().hex[:8]}", apps.select(*_BATCH_COLUMNS).schema)
    batch = F.date_format("application_ts", "yyyy")
    store.stage(apps, batch)                                        # killed: never committed
    store.append(apps, batch, "credit", "orders")
    store.append(apps, batch, "credit", "orders")                   # repeated
    good = store.rows().groupBy("batch").agg(F.sum("loan_amount").alias("exposure"))
    bad = store.quarantine().groupBy("batch").agg(F.sum(F.size("errors")).cast("long").alias("failures"))
    log = store.log().groupBy("batch").agg(F.max("status").alias("status"), F.sum("record_count").alias("records"),
                                           F.sum("rejected_count").alias("rejected"), F.count(F.lit(1)).cast("int").alias("attempts"))
    return log.join(good, "batch", "left").join(bad, "batch", "left").select(
        "batch", "status", "records", "rejected", "attempts", F.round("exposure", 2).alias("exposure"),
        F.coalesce("failures", F.lit(0)).alias("failures"))
