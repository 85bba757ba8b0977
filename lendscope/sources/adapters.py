"""Adapter views: the credit-risk domain tables derived from the driver tables.

Every formula here has a twin in ``lendscope.plans.oracle`` (DuckDB SQL) and the
two must stay value-identical.  Literals are doubles (``0.05E0`` in SQL) so both
engines use the same arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.functions.bands import clip, lookup
from lendscope.sources.tables import Tables

# --- fixed values of the adapter (not from the reference; chosen for the fixtures)
LOAN_TERMS = [12, 24, 36, 48, 60, 84, 120, 180, 240, 360]
SEGMENT_TO_OWNERSHIP = {"BUILDING": "OWN", "HOUSEHOLD": "MORTGAGE",
                        "AUTOMOBILE": "RENT", "MACHINERY": "OTHER"}
PRIORITY_TO_PURPOSE = {"1": "MEDICAL", "2": "DEBT_CONSOLIDATION", "3": "CAR",
                       "4": "OTHER", "5": "VACATION"}
DRIFT_SPLIT_TS = "1998-04-15 00:00:00"
EVENTS_SPLIT_TS = "2024-01-16 00:00:00"
CONTINUOUS_FEATURES = ["loan_amount", "interest_rate", "income", "debt_to_income",
                       "credit_score", "employment_length", "loan_term"]
CATEGORICAL_FEATURES = ["home_ownership", "loan_purpose"]


def stress_expr(dti, score, loan_amount, income):
    """FE-14 on raw columns (also drives the synthetic default flag)."""
    score_norm = (score - F.lit(300)) / F.lit(550.0)
    lti = loan_amount / (income + F.lit(1e-6))
    return dti * F.lit(0.4) + (F.lit(1.0) - score_norm) * F.lit(0.3) + clip(lti, 0, 2) * F.lit(0.3)


def credit_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders JOIN customer -> one loan application per order."""
    t = Tables(spark, sf_dir)
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    # Big-to-big equi-join on the customer key: sort-merge by default; AQE turns it
    # into a broadcast join only when the customer side is measured small.
    return applications_from_joined(o.join(c, o.o_custkey == c.c_custkey, "inner"))


def applications_from_joined(j: DataFrame) -> DataFrame:
    """Application columns from an orders x customer row (batch or stream)."""
    k = F.col("o_orderkey")
    ck = F.col("o_custkey")
    apps = j.select(
        k.alias("app_id"),
        ck.cast("string").alias("customer_id"),
        (F.col("o_totalprice") / F.lit(10.0)).alias("loan_amount"),
        lookup(k % 10, dict(enumerate(LOAN_TERMS))).cast("int").alias("loan_term"),
        (F.lit(0.05) + (k % 31) / F.lit(100.0)).alias("interest_rate"),
        (F.lit(30000.0) + (F.col("c_acctbal") + F.lit(1000.0)) * F.lit(12.0)).alias("income"),
        (((k * 7) % 97) / F.lit(100.0)).alias("debt_to_income"),
        (F.lit(300) + (ck * 37 + k * 11) % 551).cast("int").alias("credit_score"),
        (ck % 40).cast("int").alias("employment_length"),
        lookup(F.col("c_mktsegment"), SEGMENT_TO_OWNERSHIP, "RENT").alias("home_ownership"),
        lookup(F.substring("o_orderpriority", 1, 1), PRIORITY_TO_PURPOSE, "OTHER").alias("loan_purpose"),
        F.col("o_orderdate").alias("application_ts"),
    )
    stress = stress_expr(F.col("debt_to_income"), F.col("credit_score"),
                         F.col("loan_amount"), F.col("income"))
    noise = ((F.col("app_id") * 7919) % 1000) / F.lit(1000.0) * F.lit(0.4)
    apps = apps.withColumn("is_default", (stress + noise) > F.lit(0.80))
    return apps.withColumn(
        "loss_given_default",
        F.when(F.col("is_default"), F.lit(0.2) + ((F.col("app_id") * 31) % 60) / F.lit(100.0))
        .otherwise(F.lit(0.0)))


def api_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> API request log (response_time in seconds)."""
    e = Tables(spark, sf_dir).events
    return e.select(
        F.col("event_id").alias("request_id"),
        F.col("event_type").alias("endpoint"),
        F.col("ts"),
        F.col("user_id").alias("client_id"),
        (F.col("value") / F.lit(100.0)).alias("response_time"),
        F.when(F.col("event_type") == "error",
               F.when(F.col("event_id") % 2 == 0, F.lit(500)).otherwise(F.lit(404)))
        .otherwise(F.lit(200)).cast("int").alias("status_code"),
        F.col("props").alias("metadata"),
    )


def host_sample(requests: Column, avg_response_time: Column) -> dict[str, Column]:
    """Load of the host in an hour, from its requests (formulas are fixed values)."""
    return {"cpu_percent": F.lit(20.0) + requests * F.lit(3.0), "memory_percent": F.lit(40.0) + avg_response_time * F.lit(20.0)}


def system_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly host samples derived from the request log (formulas are fixed values)."""
    a = api_metrics(spark, sf_dir)
    h = a.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp")).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.avg((F.col("status_code") >= 400).cast("double")).alias("error_rate"),
        F.avg("response_time").alias("avg_response_time"))
    return h.select(
        "timestamp",
        *[c.alias(n) for n, c in host_sample(F.col("total_requests"), F.col("avg_response_time")).items()],
        (F.lit(50.0) + F.hour("timestamp") * F.lit(1.5)).alias("disk_percent"),
        F.col("total_requests").cast("long").alias("total_requests"),
        "error_rate", "avg_response_time")


def drift_samples(spark: SparkSession, sf_dir: str, apps: DataFrame | None = None) -> DataFrame:
    """Long form (feature, sample, value, category) of the application book.

    ``reference`` = applications before ``DRIFT_SPLIT_TS``, ``current`` = after.
    """
    apps = apps if apps is not None else credit_applications(spark, sf_dir)
    sample = F.when(F.col("application_ts") < F.lit(DRIFT_SPLIT_TS).cast("timestamp_ntz"),
                    F.lit("reference")).otherwise(F.lit("current"))
    base = apps.select(sample.alias("sample"), *CONTINUOUS_FEATURES, *CATEGORICAL_FEATURES)
    cont = base.select("sample", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
        for f in CONTINUOUS_FEATURES])).alias("kv"))
    cont = cont.select(F.col("kv.feature").alias("feature"), "sample",
                       F.col("kv.value").alias("value"), F.lit(None).cast("string").alias("category"))
    cat = base.select("sample", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("category"))
        for f in CATEGORICAL_FEATURES])).alias("kv"))
    cat = cat.select(F.col("kv.feature").alias("feature"), "sample",
                     F.lit(None).cast("double").alias("value"), F.col("kv.category").alias("category"))
    return cont.unionByName(cat)


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored book as a prediction log (typed scores + JSON payloads, D-12)."""
    from lendscope.plans.book import scored_book
    s = scored_book(spark, sf_dir, validate=False)
    return s.select(
        F.col("app_id").alias("request_id"), "customer_id",
        F.lit("credit_risk_model").alias("model_name"),
        F.concat(F.lit("v"), (F.col("app_id") % 3).cast("string")).alias("model_version"),
        "pd_score", "lgd_score", "expected_loss", "risk_rating", "is_default", "loan_amount",
        F.to_json(F.struct("loan_amount", "income", "credit_score", "debt_to_income", "loan_purpose",
                           "customer_id")).alias("input_features"),
        F.to_json(F.struct(F.col("pd_score").alias("probability_of_default"),
                           F.col("lgd_score").alias("loss_given_default"),
                           "expected_loss", "risk_rating")).alias("prediction_result"),
        (F.lit(5.0) + ((F.col("app_id") * 13) % 200).cast("double")).alias("response_time_ms"),
        F.col("application_ts").alias("timestamp"),
    )


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily model metrics per version, rolled up from the prediction log."""
    p = prediction_log(spark, sf_dir)
    return p.groupBy("model_name", "model_version", F.date_trunc("day", "timestamp").alias("timestamp")).agg(
        F.count(F.lit(1)).alias("prediction_count"),
        F.avg(((F.col("pd_score") > 0.5) == F.col("is_default")).cast("double")).alias("accuracy"),
        F.avg("response_time_ms").alias("avg_prediction_time"),
        F.avg("pd_score").alias("avg_pd_score"),
        F.avg("lgd_score").alias("avg_lgd_score"),
        F.sum((F.col("pd_score") > 0.1).cast("long")).alias("high_risk_predictions"))


def hourly_metrics(spark: SparkSession, sf_dir: str, since=None, until=None) -> DataFrame:
    """Hourly evaluation ticks: API roll-up joined with the host samples.

    ``since`` / ``until`` (whole hours) bound the requests that are read."""
    from lendscope.operators.rollups import quantile_columns
    a = api_metrics(spark, sf_dir)
    if since is not None:
        a = a.where((F.col("ts") >= since) & (F.col("ts") < until))
    a = a.withColumn("timestamp", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    agg = a.groupBy("timestamp").agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg((F.col("status_code") >= 400).cast("double")).alias("error_rate"),
        F.avg("response_time").alias("avg_response_time"))
    p95 = quantile_columns(a, "response_time", [0.95], ["timestamp"], ["p95_response_time"])
    s = system_metrics(spark, sf_dir).select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
                                             "cpu_percent", "memory_percent")
    out = agg.join(p95, "timestamp").join(s, "timestamp").withColumnRenamed("timestamp", "ts")
    # one row per hour, read by several consumers (rules, health, dashboard): materialise once
    from lendscope.session import cut_lineage
    return cut_lineage(out)
