"""Validation and data quality (VAL-01 .. VAL-11).

Rules are data: ``(name, column, predicate)``.  A row's ``errors`` array lists
every failed rule in one projection, so validating a table is one scan; the
verdict and per-rule counts are aggregates over that column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values (must equal the reference for equal results) -------------
VALID_TERMS = [12, 24, 36, 48, 60, 84, 120, 180, 240, 360]
VALID_OWNERSHIP = ["RENT", "OWN", "MORTGAGE", "OTHER"]
VALID_PURPOSES = ["DEBT_CONSOLIDATION", "CREDIT_CARD", "HOME_IMPROVEMENT",
                  "MAJOR_PURCHASE", "MEDICAL", "VACATION", "WEDDING",
                  "MOVING", "HOUSE", "CAR", "OTHER"]
API_PURPOSES = ["debt_consolidation", "credit_card", "home_improvement", "major_purchase",
                "medical", "small_business", "vacation", "wedding", "other"]
ECONOMIC_SOURCES = ["real_market_data", "fred_api", "treasury_api", "tavily_search"]
AUTHENTIC_SOURCES = ["real_market_data", "fred_api", "treasury_api",
                     "tavily_search", "bls_api", "government_api"]
ECONOMIC_COLUMNS = ["fed_funds_rate", "unemployment_rate", "data_timestamp", "data_source",
                    # D-03: columns the provider itself emits are allowed
                    "fed_rate_date", "date", "avg_interest_rate", "security_type", "credit_spreads"]
COMPLETENESS_THRESHOLD = 0.95
FRESHNESS_HOURS = 24
SCHEMA_MAX_AGE_DAYS = 7
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL_PATTERN = r"^https?://[^\s/$.?#].[^\s]*$"


@dataclass(frozen=True)
class Rule:
    name: str
    column: str
    predicate: Column          # must be TRUE for a valid value
    required: bool = True      # NULL counts as a failure when required


def _between(c: str, lo, hi) -> Column:
    return (F.col(c) >= F.lit(lo)) & (F.col(c) <= F.lit(hi))


def application_rules() -> list[Rule]:
    """VAL-01: the stored-application rule set."""
    return [
        Rule("customer_id_required", "customer_id", F.col("customer_id").isNotNull()),
        Rule("loan_amount_range", "loan_amount", _between("loan_amount", 1000.0, 10000000.0)),
        Rule("loan_term_value", "loan_term", F.col("loan_term").isin(VALID_TERMS)),
        Rule("interest_rate_range", "interest_rate", _between("interest_rate", 0.01, 0.50)),
        Rule("income_range", "income", _between("income", 10000.0, 10000000.0)),
        Rule("debt_to_income_range", "debt_to_income", _between("debt_to_income", 0.0, 2.0)),
        Rule("credit_score_range", "credit_score", _between("credit_score", 300, 850)),
        Rule("employment_length_range", "employment_length", _between("employment_length", 0, 50)),
        Rule("home_ownership_value", "home_ownership", F.upper("home_ownership").isin(VALID_OWNERSHIP)),
        Rule("loan_purpose_value", "loan_purpose", F.upper("loan_purpose").isin(VALID_PURPOSES)),
        Rule("previous_defaults_range", "previous_defaults", _between("previous_defaults", 0, 10), False),
        Rule("open_credit_lines_range", "open_credit_lines", _between("open_credit_lines", 0, 50), False),
        Rule("total_credit_lines_range", "total_credit_lines", _between("total_credit_lines", 0, 100), False),
    ]


def api_request_rules() -> list[Rule]:
    """VAL-02: the stricter API-edge rule set (case-sensitive enums)."""
    return [
        Rule("customer_id_length", "customer_id", F.length("customer_id").between(1, 100)),
        Rule("loan_amount_range", "loan_amount", (F.col("loan_amount") > 0) & (F.col("loan_amount") <= 1000000.0)),
        Rule("loan_term_range", "loan_term", _between("loan_term", 12, 360)),
        Rule("interest_rate_range", "interest_rate", _between("interest_rate", 0.01, 0.40)),
        Rule("income_range", "income", _between("income", 1000.0, 10000000.0)),
        Rule("debt_to_income_range", "debt_to_income", _between("debt_to_income", 0.0, 0.8)),
        Rule("credit_score_range", "credit_score", _between("credit_score", 300, 850)),
        Rule("employment_length_range", "employment_length", _between("employment_length", 0, 50)),
        Rule("home_ownership_value", "home_ownership", F.col("home_ownership").isin(VALID_OWNERSHIP)),
        Rule("loan_purpose_value", "loan_purpose", F.col("loan_purpose").isin(API_PURPOSES)),
        Rule("annual_income_range", "annual_income", _between("annual_income", 1000.0, 10000000.0), False),
        Rule("previous_defaults_range", "previous_defaults", _between("previous_defaults", 0, 10), False),
        Rule("open_credit_lines_range", "open_credit_lines", _between("open_credit_lines", 0, 50), False),
        Rule("total_credit_lines_range", "total_credit_lines", _between("total_credit_lines", 0, 100), False),
        Rule("revolving_balance_range", "revolving_credit_balance", F.col("revolving_credit_balance") >= 0, False),
        Rule("revolving_limit_range", "revolving_credit_limit", F.col("revolving_credit_limit") >= 0, False),
    ]


def errors_column(df: DataFrame, rules: Sequence[Rule]) -> Column:
    """Array of failed rule names (absent optional columns are skipped)."""
    have = set(df.columns)
    items = []
    for r in rules:
        if r.column not in have:
            if r.required:
                items.append(F.lit(f"{r.column}_missing"))
            continue
        ok = r.predicate
        failed = (F.when(F.col(r.column).isNull(), F.lit(r.required))
                  .otherwise(F.coalesce(~ok, F.lit(True))))
        items.append(F.when(failed, F.lit(r.name)))
    return F.array_compact(F.array(*items)) if items else F.array().cast("array<string>")


def apply_rules(df: DataFrame, rules: Sequence[Rule], upper_enums: bool = True) -> DataFrame:
    """Attach ``errors`` and ``is_valid``; enum columns are upper-cased as the validator does."""
    out = df.withColumn("errors", errors_column(df, rules))
    out = out.withColumn("is_valid", F.size("errors") == 0)
    if upper_enums:
        for c in ("home_ownership", "loan_purpose"):
            if c in df.columns:
                out = out.withColumn(c, F.when(F.col("is_valid"), F.upper(c)).otherwise(F.col(c)))
    return out


def split_valid(df: DataFrame, rules: Sequence[Rule] | None = None):
    """SRC-08/VAL-03: (good, quarantine) from one validated projection."""
    v = apply_rules(df, rules or application_rules())
    return v.where("is_valid").drop("errors", "is_valid"), v.where(~F.col("is_valid"))


def batch_verdict(validated: DataFrame) -> DataFrame:
    """VAL-03 verdict as one row (D-06: both all_valid and meets_completeness)."""
    v = validated.agg(F.count(F.lit(1)).alias("total_records"),
                      F.sum(F.col("is_valid").cast("long")).alias("valid_records"))
    ratio = F.try_divide(F.col("valid_records").cast("double"), F.col("total_records").cast("double"))
    return v.select(
        "total_records", F.coalesce("valid_records", F.lit(0)).cast("long").alias("valid_records"),
        (F.col("total_records") - F.coalesce("valid_records", F.lit(0))).cast("long").alias("invalid_records"),
        ratio.alias("completeness"),
        (F.col("total_records") > 0).alias("non_empty"),
        (F.coalesce(ratio, F.lit(0.0)) >= F.lit(COMPLETENESS_THRESHOLD)).alias("meets_completeness"),
        ((F.col("total_records") > 0) & (F.col("total_records") == F.col("valid_records"))).alias("all_valid"))


def rule_failure_counts(validated: DataFrame) -> DataFrame:
    """VAL-03: failures per rule (explode of the errors array)."""
    return (validated.select(F.explode("errors").alias("rule"))
            .groupBy("rule").agg(F.count(F.lit(1)).alias("failures")))


def suspicious_patterns(df: DataFrame, cols: Sequence[str] | None = None, strict: bool = False) -> DataFrame:
    """VAL-06: per numeric column: count, sample std, share of whole numbers, flag.

    Applies only when the table has >= 10 rows and the column > 5 non-null values.
    D-05: by default only fractional (floating) columns gate; ``strict`` flags
    integer columns too, as the reference does.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols or [n for n, t in fields.items() if isinstance(t, T.NumericType)])
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n_{c}"), F.stddev_samp(x).alias(f"s_{c}"),
                 F.avg(F.when(x.isNotNull(), (x == F.round(x, 0)).cast("double"))).alias(f"w_{c}")]
    one = df.agg(*aggs)
    rows = []
    for c in cols:
        frac = isinstance(fields.get(c), (T.DoubleType, T.FloatType, T.DecimalType))
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("non_null"),
                             F.col(f"s_{c}").alias("std"), F.col(f"w_{c}").alias("whole_share"),
                             F.lit(frac or strict).alias("gating")))
    long = one.select("_rows", F.explode(F.array(*rows)).alias("r")).select("_rows", "r.*")
    applies = (F.col("_rows") >= 10) & (F.col("non_null") > 5)
    flag = applies & ((F.col("std") == 0) | (F.col("whole_share") > 0.9))
    return long.select("column", "non_null", "std", "whole_share",
                       F.coalesce(flag, F.lit(False)).alias("suspicious"), "gating")


def economic_rules(as_of: Column) -> list[Rule]:
    """VAL-04 rules on an economic snapshot table."""
    ts = parse_iso_timestamp(F.col("data_timestamp"))
    return [
        Rule("fed_funds_rate_range", "fed_funds_rate", _between("fed_funds_rate", 0.0, 20.0), False),
        Rule("unemployment_rate_range", "unemployment_rate", _between("unemployment_rate", 0.0, 30.0), False),
        Rule("data_timestamp_valid", "data_timestamp", ts.isNotNull()),
        Rule("data_timestamp_age", "data_timestamp",
             ts >= as_of - F.expr(f"INTERVAL {SCHEMA_MAX_AGE_DAYS} DAYS")),
        Rule("data_source_value", "data_source", F.col("data_source").isin(ECONOMIC_SOURCES)),
    ]


def validate_economic(snap: DataFrame, as_of: Column) -> DataFrame:
    """VAL-04/05: rule errors + freshness + completeness + authenticity per snapshot row."""
    unknown = [c for c in snap.columns if c not in ECONOMIC_COLUMNS]
    out = snap.withColumn("errors", errors_column(snap, economic_rules(as_of)))
    if unknown:
        out = out.withColumn("errors", F.concat("errors", F.array(*[F.lit(f"unknown_column:{c}") for c in unknown])))
    ts = parse_iso_timestamp(F.col("data_timestamp"))
    fresh = F.coalesce(ts >= as_of - F.expr(f"INTERVAL {FRESHNESS_HOURS} HOURS"), F.lit(False))
    ind = [F.col(c) for c in ("fed_funds_rate", "unemployment_rate", "avg_interest_rate") if c in snap.columns]
    complete = (F.col("data_timestamp").isNotNull() & F.col("data_source").isNotNull()
                & (F.size(F.array_compact(F.array(*ind))) >= 1 if ind else F.lit(False)))
    auth = F.coalesce(F.col("data_source").isin(AUTHENTIC_SOURCES), F.lit(False))
    out = (out.withColumn("is_fresh", fresh).withColumn("is_complete", complete)
           .withColumn("is_authentic", auth))
    return out.withColumn("is_valid", (F.size("errors") == 0) & fresh & complete & auth)


def parse_iso_timestamp(s: Column) -> Column:
    """FN-25: ISO-8601 with ``Z``, an offset or naive (naive = UTC, D-23)."""
    return F.coalesce(
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd")),
    )


def result_envelope(verdict: DataFrame, data_type: str, as_of: Column) -> DataFrame:
    """VAL-07: is_valid + data_type + timestamp + version; unknown type -> invalid."""
    known = data_type in ("credit", "economic")
    return verdict.select(
        (F.col("all_valid") & F.lit(known)).alias("is_valid"), F.lit(data_type).alias("data_type"),
        as_of.alias("timestamp"), F.lit("1.0.0").alias("version"), "*")


def pattern_flags(col: str) -> Column:
    """VAL-10: e-mail and URL predicates as a struct."""
    return F.struct(F.col(col).rlike(EMAIL_PATTERN).alias("is_email"),
                    F.col(col).rlike(URL_PATTERN).alias("is_url"))
