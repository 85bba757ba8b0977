"""Application-book queries: validate -> features -> score -> aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.operators import features as fe
from lendscope.operators import quality as vq
from lendscope.operators import scoring as sc
from lendscope.plans.oracle_views import DECISION_SQL, VALID_APP_SQL, with_views
from lendscope.plans.registry import register
from lendscope.sources.adapters import credit_applications


def scored_book(spark: SparkSession, sf_dir: str, validate: bool = True) -> DataFrame:
    """Whole book scored with the scorecard PD; one narrow pass, no shuffle."""
    apps = credit_applications(spark, sf_dir)
    if validate:
        apps = vq.apply_rules(apps, vq.application_rules())
    feats = (apps.withColumn("credit_score_normalized", fe.credit_score_normalized())
             .withColumn("loan_to_income_ratio", fe.loan_to_income_ratio())
             .withColumn("financial_stress_score", fe.financial_stress_score()))
    return sc.score_book(sc.scorecard_scores(feats))


@register("book_by_purpose", ops=("SRC-07", "VAL-01", "VAL-03", "FE-02", "FE-05", "FE-14",
                                  "RSK-01", "RSK-02", "RSK-03", "RSK-04", "RSK-05", "RSK-06", "RSK-10",
                                  "AGG-21", "FN-24"),
          sql=with_views(f"""
SELECT loan_purpose,
       count(*) AS applications,
       CAST(sum(CASE WHEN NOT {VALID_APP_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS quarantined,
       round(sum(CASE WHEN {VALID_APP_SQL} THEN loan_amount END), 3) AS exposure,
       round(avg(CASE WHEN {VALID_APP_SQL} THEN pd_score END), 6) AS avg_pd,
       round(avg(CASE WHEN {VALID_APP_SQL} THEN lgd_score END), 6) AS avg_lgd,
       round(sum(CASE WHEN {VALID_APP_SQL} THEN expected_loss END), 4) AS expected_loss,
       round(sum(CASE WHEN {VALID_APP_SQL} THEN expected_loss * loan_amount END), 2) AS expected_loss_amount,
       round(avg(CASE WHEN {VALID_APP_SQL} THEN risk_rating END), 6) AS avg_rating,
       CAST(sum(CASE WHEN {VALID_APP_SQL} AND {DECISION_SQL} = 'APPROVE' THEN 1 ELSE 0 END) AS BIGINT) AS approve,
       CAST(sum(CASE WHEN {VALID_APP_SQL} AND {DECISION_SQL} = 'APPROVE_WITH_CONDITIONS' THEN 1 ELSE 0 END) AS BIGINT) AS approve_with_conditions,
       CAST(sum(CASE WHEN {VALID_APP_SQL} AND {DECISION_SQL} = 'MANUAL_REVIEW' THEN 1 ELSE 0 END) AS BIGINT) AS manual_review,
       CAST(sum(CASE WHEN {VALID_APP_SQL} AND {DECISION_SQL} = 'DECLINE' THEN 1 ELSE 0 END) AS BIGINT) AS decline,
       round(avg(CASE WHEN {VALID_APP_SQL} THEN CAST(is_default AS INTEGER) END), 6) AS default_rate
FROM scored_book GROUP BY loan_purpose""", "scored_book"))
def book_by_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: expected loss, rating mix and decisions of the book by purpose."""
    s = scored_book(spark, sf_dir)
    v = F.col("is_valid")
    dec = F.col("decision.decision")

    def n_dec(d):
        return F.sum(F.when(v & (dec == d), 1).otherwise(0)).cast("long").alias(d.lower())

    return s.groupBy("loan_purpose").agg(
        F.count(F.lit(1)).alias("applications"),
        F.sum(F.when(~v, 1).otherwise(0)).cast("long").alias("quarantined"),
        F.round(F.sum(F.when(v, F.col("loan_amount"))), 3).alias("exposure"),
        F.round(F.avg(F.when(v, F.col("pd_score"))), 6).alias("avg_pd"),
        F.round(F.avg(F.when(v, F.col("lgd_score"))), 6).alias("avg_lgd"),
        F.round(F.sum(F.when(v, F.col("expected_loss"))), 4).alias("expected_loss"),
        F.round(F.sum(F.when(v, sc.expected_loss_amount(F.col("expected_loss"), F.col("loan_amount")))), 2)
        .alias("expected_loss_amount"),
        F.round(F.avg(F.when(v, F.col("risk_rating"))), 6).alias("avg_rating"),
        n_dec("APPROVE"), n_dec("APPROVE_WITH_CONDITIONS"), n_dec("MANUAL_REVIEW"), n_dec("DECLINE"),
        F.round(F.avg(F.when(v, F.col("is_default").cast("int"))), 6).alias("default_rate"),
    )
