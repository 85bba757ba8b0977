"""Landed-file readers (SRC-01 .. SRC-06) with explicit schemas (no inference).

HTTP fetching is out of scope; these read what a fetcher lands in storage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lendscope.functions.bands import lookup

OBSERVATIONS_SCHEMA = "series_id string, observations array<struct<date:string, value:string>>"
TREASURY_SCHEMA = "data array<struct<record_date:string, avg_interest_rate_amt:string, security_desc:string>>"

# --- fixed values (must equal the reference for equal results) -------------
GERMAN_COLUMNS = ["checking_status", "duration", "credit_history", "purpose", "credit_amount",
                  "savings_status", "employment", "installment_commitment", "personal_status", "other_parties",
                  "residence_since", "property_magnitude", "age", "other_payment_plans", "housing",
                  "existing_credits", "job", "num_dependents", "own_telephone", "foreign_worker", "class"]
GERMAN_SCORE = {"A30": 500, "A31": 550, "A32": 650, "A33": 700, "A34": 750}
GERMAN_EMPLOYMENT = {"A71": 0, "A72": 1, "A73": 4, "A74": 7, "A75": 10}
GERMAN_HOUSING = {"A151": "RENT", "A152": "OWN", "A153": "MORTGAGE"}
GERMAN_PURPOSE = {"A40": "new_car", "A41": "used_car", "A42": "furniture", "A43": "radio_tv", "A44": "appliances",
                  "A45": "repairs", "A46": "education", "A47": "vacation", "A48": "retraining", "A49": "business",
                  "A410": "other"}
CARD_EMPLOYMENT = {"1": 10, "2": 7, "3": 5, "4": 3, "5": 1, "6": 1}   # by education level


def economic_series(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """SRC-01: observations -> (series_id, date, value); non-numeric -> NULL; newest first per series."""
    raw = spark.read.schema(OBSERVATIONS_SCHEMA).json(path)
    obs = raw.select("series_id", F.explode("observations").alias("o")).select(
        "series_id", F.to_date("o.date").alias("date"), F.col("o.value").try_cast("double").alias("value"))
    w = Window.partitionBy("series_id").orderBy(F.col("date").desc())
    return obs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def latest_value(series: DataFrame, series_id: str | None = None) -> DataFrame:
    """SRC-03 / AGG-18: newest value per series (``max_by``)."""
    s = series.where(F.col("series_id") == series_id) if series_id else series
    return s.groupBy("series_id").agg(F.max_by("value", "date").alias("value"), F.max("date").alias("date"))


def treasury_rates(spark: SparkSession, path: str, since: str = "2024-01-01") -> DataFrame:
    """SRC-02: newest record on/after ``since`` -> (date, avg_interest_rate, security_type)."""
    raw = spark.read.schema(TREASURY_SCHEMA).json(path)
    d = raw.select(F.explode("data").alias("r")).select(
        F.to_date("r.record_date").alias("date"), F.col("r.avg_interest_rate_amt").try_cast("double")
        .alias("avg_interest_rate"), F.col("r.security_desc").alias("security_type"))
    d = d.where(F.col("date") >= F.lit(since).cast("date"))
    return d.agg(F.max_by(F.struct("date", "avg_interest_rate", "security_type"), "date").alias("r")).select("r.*")


def paired_series(series: DataFrame, ids=("DRSFRMACBS", "MORTGAGE30US"), last: int = 12) -> DataFrame:
    """SRC-06: newest ``last`` values of both series, only when both are present."""
    s = series.where(F.col("series_id").isin(list(ids)))
    w = Window.partitionBy("series_id").orderBy(F.col("date").desc())
    s = s.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= last).drop("_rn")
    present = s.agg(F.count_distinct("series_id").alias("_k"))
    return s.crossJoin(present).where(F.col("_k") == len(ids)).drop("_k")


def with_row_index(df: DataFrame, name: str) -> DataFrame:
    """Adds the 0-based place of a row in the order in which files are read, without gaps.

    Rows are numbered within their partition and shifted by the counts of the partitions before;
    the counts are one row a partition, hence the broadcast."""
    own = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    counts = own.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return own.join(F.broadcast(start), "_part").withColumn(
        name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_n", "_start")


def german_credit(spark: SparkSession, path: str) -> DataFrame:
    """SRC-04 + PRJ-02: space-separated file -> application schema; malformed rows are left out.

    ``customer_id`` is GER_ and the row's place in the file plus 1000 (malformed rows count)."""
    ints = ("duration", "credit_amount", "installment_commitment", "residence_since", "age", "existing_credits",
            "num_dependents", "class")
    schema = ", ".join(f"{c} {'int' if c in ints else 'string'}" for c in GERMAN_COLUMNS) + ", _bad string"
    raw = with_row_index(spark.read.csv(path, sep=" ", header=False, schema=schema, mode="PERMISSIVE",
                                        columnNameOfCorruptRecord="_bad"), "_row").where(F.col("_bad").isNull())
    score = lookup(F.col("credit_history"), GERMAN_SCORE, 650)
    default = F.col("class") == 2
    return raw.select(
        F.concat(F.lit("GER_"), (F.col("_row") + 1000).cast("string")).alias("customer_id"),
        F.col("credit_amount").cast("double").alias("loan_amount"),
        F.col("duration").alias("loan_term"),
        (F.lit(0.08) + (F.lit(750) - score) / F.lit(10000.0)).alias("interest_rate"),
        (F.try_divide(F.col("credit_amount").cast("double"), F.col("duration")) * F.lit(36.0)).alias("income"),
        (F.col("installment_commitment") / F.lit(10.0)).alias("debt_to_income"),
        score.cast("int").alias("credit_score"),
        lookup(F.col("employment"), GERMAN_EMPLOYMENT, 5).cast("int").alias("employment_length"),
        lookup(F.col("housing"), GERMAN_HOUSING, "RENT").alias("home_ownership"),
        lookup(F.col("purpose"), GERMAN_PURPOSE, "other").alias("loan_purpose"),
        default.alias("is_default"),
        F.when(default, F.lit(0.45)).otherwise(F.lit(0.0)).alias("loss_given_default")).where(F.col("income").isNotNull())


def credit_card_defaults(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05 + PRJ-03: whole card file -> application schema.

    Delinquencies count the columns PAY_0 to PAY_5 that the file has; the reference's random
    application date is left out.  An empty cell takes the column's default; a row with a cell that is
    no number, or without a whole ID, is left out."""
    raw = spark.read.csv(path, header=True, inferSchema=False)

    readable = F.col("ID").try_cast("double").isNotNull()
    for c in ["EDUCATION", "LIMIT_BAL", "BILL_AMT1", "default payment next month", *(f"PAY_{k}" for k in range(6))]:
        if c in raw.columns:
            readable &= F.col(c).isNull() | F.col(c).try_cast("double").isNotNull()
    raw = raw.where(readable)

    def num(c: str, missing: float) -> Column:
        return F.coalesce(F.col(c).try_cast("double"), F.lit(missing)) if c in raw.columns else F.lit(missing)

    p0, limit_bal, bill = num("PAY_0", 0.0), num("LIMIT_BAL", 50000.0), num("BILL_AMT1", 10000.0)
    label = "default payment next month"
    default = F.coalesce(F.col(label).try_cast("double").cast("int") == 1, F.lit(False)) if label in raw.columns else F.lit(False)
    late = F.lit(0)
    for k in range(6):
        late = late + (num(f"PAY_{k}", 0.0) > 0).cast("int")
    education = F.coalesce(F.col("EDUCATION").try_cast("double").cast("int").cast("string"), F.lit("3")) if "EDUCATION" in raw.columns else F.lit("3")
    return raw.select(
        F.concat(F.lit("CC_"), F.col("ID").try_cast("double").cast("long").cast("string")).alias("customer_id"), bill.alias("loan_amount"),
        F.lit(36).alias("loan_term"), (F.lit(0.15) + p0 * F.lit(0.02)).alias("interest_rate"),
        (limit_bal * 2).alias("income"), (F.lit(0.3) + p0 * F.lit(0.1)).alias("debt_to_income"),
        (F.lit(750) - p0.cast("int") * 50).alias("credit_score"),
        lookup(education, CARD_EMPLOYMENT, 5).cast("int").alias("employment_length"),
        F.lit("RENT").alias("home_ownership"), F.lit("credit_card").alias("loan_purpose"),
        F.lit(5).alias("number_of_accounts"), late.alias("delinquencies_past_2_years"),
        F.when(num("LIMIT_BAL", 0.0) > 0, num("BILL_AMT1", 0.0) / num("LIMIT_BAL", 1.0)).otherwise(F.lit(0.5))
        .alias("revolving_utilization"),
        F.when(p0 > 0, F.lit(1.0)).otherwise(F.lit(24.0)).alias("months_since_last_delinquency"),
        F.lit("Verified").alias("verification_status"),
        default.alias("is_default"), F.when(default, F.lit(0.65)).otherwise(F.lit(0.0)).alias("loss_given_default"))


def assemble_economic_factors(series: DataFrame, mapping: dict | None = None) -> DataFrame:
    """FE-20: latest value of each indicator series pivoted into one snapshot row;
    the row is kept only when more than two fields are present."""
    mapping = mapping or {"FEDFUNDS": "fed_funds_rate", "UNRATE": "unemployment_rate",
                          "TREASURY_AVG": "avg_interest_rate"}
    latest = latest_value(series.where(F.col("series_id").isin(list(mapping))))
    named = latest.select(lookup(F.col("series_id"), mapping).alias("name"), "value", "date")
    wide = named.groupBy().pivot("name", list(mapping.values())).agg(F.first("value"))
    present = F.size(F.array_compact(F.array(*[F.col(c) for c in mapping.values()])))
    # data_timestamp and data_source count as fields, as in the snapshot record
    return wide.withColumn("_n", present + F.lit(2)).where(F.col("_n") > 2).drop("_n")
