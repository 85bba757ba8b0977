"""Feature engineering (FE-01 .. FE-25) as column expressions over whole tables.

Data-dependent features (income quartile edges, rate percentile, medians,
mean/std) are computed as small *fit* tables (one row, or one row per
feature) that are broadcast back; a stored fit can be passed in at scoring
time so training and scoring share the same fit (D-08).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendscope.functions.bands import clip, cut, lookup
from lendscope.operators.prefix import asof_rank, average_rank_table, exact_quantiles
from lendscope.session import cut_lineage, materialize

# --- fixed values (must equal the reference for equal results) -------------
CREDIT_SCORE_EDGES = [0, 580, 670, 740, 800, 850]
CREDIT_SCORE_LABELS = ["Poor", "Fair", "Good", "Very Good", "Excellent"]
DTI_EDGES = [0, 0.2, 0.36, 0.5, 1.0, float("inf")]
DTI_LABELS = ["Low", "Moderate", "High", "Very High", "Extreme"]
OWNERSHIP_STABILITY = {"OWN": 2.0, "MORTGAGE": 1.0, "RENT": 0.0, "OTHER": 0.0}
PURPOSE_RISK = {
    "DEBT_CONSOLIDATION": 0.12,
    "HOME_IMPROVEMENT": 0.08,
    "MAJOR_PURCHASE": 0.10,
    "CAR": 0.09,
    "WEDDING": 0.15,
    "VACATION": 0.18,
    "MEDICAL": 0.11,
    "CREDIT_CARD": 0.16,
    "OTHER": 0.14,
}
PURPOSE_RISK_DEFAULT = 0.14
INCOME_FIXED_BANDS = [(40000.0, "Q1"), (60000.0, "Q2"), (90000.0, "Q3")]  # else Q4
HIGH_DTI = 0.43
HIGH_RATE = 0.15
EPS = 1e-6
REQUIRED_COLUMNS = ["loan_amount", "income", "credit_score", "debt_to_income"]
NON_FEATURE_COLUMNS = ["id", "app_id", "customer_id", "created_at", "updated_at",
                       "loss_given_default", "default_probability", "target", "label"]


def check_required(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> None:
    """VAL-08: schema-level check (no job)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


# ---- single-column features ------------------------------------------------
def income_to_loan_ratio(income="income", loan="loan_amount") -> Column:       # FE-01
    return F.col(income) / (F.col(loan) + F.lit(EPS))


def loan_to_income_ratio(loan="loan_amount", income="income") -> Column:       # FE-02
    return F.col(loan) / (F.col(income) + F.lit(EPS))


def credit_score_band(score="credit_score") -> Column:                          # FE-04
    return cut(F.col(score), CREDIT_SCORE_EDGES, CREDIT_SCORE_LABELS)


def credit_score_normalized(score="credit_score") -> Column:                    # FE-05
    return (F.col(score) - F.lit(300)) / F.lit(550.0)


def dti_risk_category(dti="debt_to_income") -> Column:                          # FE-06
    return cut(F.col(dti), DTI_EDGES, DTI_LABELS)


def monthly_payment(loan="loan_amount", rate="interest_rate", term="loan_term") -> Column:  # FE-15
    r = F.col(rate) / F.lit(12.0)
    growth = F.pow(F.lit(1.0) + r, F.col(term))
    # rate = 0 gives 0/0: NULL (the reference yields NaN)
    return F.try_divide(F.col(loan) * (r * growth), growth - F.lit(1.0))


def financial_stress_score(dti="debt_to_income", score_norm="credit_score_normalized",
                           lti="loan_to_income_ratio") -> Column:               # FE-14
    return (F.col(dti) * F.lit(0.4) + (F.lit(1.0) - F.col(score_norm)) * F.lit(0.3)
            + clip(F.col(lti), 0, 2) * F.lit(0.3))


# ---- fits -------------------------------------------------------------------
def fit_income_quartiles(df: DataFrame, col: str = "income") -> DataFrame:
    """FE-03 fit: one row, ``income_edges`` = exact quantiles 0, .25, .5, .75, 1."""
    q = exact_quantiles(df, col, [0.0, 0.25, 0.5, 0.75, 1.0])
    return q.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "q"))),
                             lambda s: s["q"]).alias("income_edges"))


def income_quartile(col: str = "income", edges: str = "income_edges") -> Column:
    """FE-03: qcut(4) on the fitted edges, fixed bands when the edges collapse."""
    x = F.col(col)
    e = F.col(edges)
    distinct = F.size(F.array_distinct(e)) == F.lit(5)
    q = (F.when(x.isNull(), F.lit(None).cast("string"))
         .when(x <= F.element_at(e, 2), F.lit("Q1"))
         .when(x <= F.element_at(e, 3), F.lit("Q2"))
         .when(x <= F.element_at(e, 4), F.lit("Q3"))
         .otherwise(F.lit("Q4")))
    fixed = F.when(x.isNull(), F.lit(None).cast("string"))
    for bound, lab in INCOME_FIXED_BANDS:
        fixed = fixed.when(x < F.lit(bound), F.lit(lab))
    fixed = fixed.otherwise(F.lit("Q4"))
    return F.when(distinct, q).otherwise(fixed)


def fit_rate_ranks(df: DataFrame) -> DataFrame:
    """FE-10 fit: distinct training rates with their average-tie percentile."""
    return average_rank_table(materialize(df, ["interest_rate"]), "interest_rate")


def engineer_credit_features(df: DataFrame, income_fit: DataFrame | None = None,
                             with_rate_percentile: bool = True, rate_fit: DataFrame | None = None) -> DataFrame:
    """FE-01 .. FE-16 on a whole application table (one pass + two small fits)."""
    check_required(df)
    cols = set(df.columns)
    # the data-dependent fits computed here read one narrow checkpoint of the input
    need_rate = "interest_rate" in cols and with_rate_percentile and rate_fit is None
    narrow = None
    if income_fit is None or need_rate:
        narrow = materialize(df, ["income"] + (["interest_rate"] if need_rate else []))
    fit = income_fit if income_fit is not None else fit_income_quartiles(narrow)
    out = df.crossJoin(F.broadcast(fit))  # one-row fit table
    out = out.withColumn("income_to_loan_ratio", income_to_loan_ratio())
    out = out.withColumn("loan_to_income_ratio", loan_to_income_ratio())
    out = out.withColumn("income_quartile", income_quartile()).drop("income_edges")
    out = out.withColumn("credit_score_band", credit_score_band())
    out = out.withColumn("credit_score_normalized", credit_score_normalized())
    out = out.withColumn("dti_risk_category", dti_risk_category())
    out = out.withColumn("high_dti_flag", (F.col("debt_to_income") > F.lit(HIGH_DTI)).cast("int"))
    if "loan_term" in cols:
        out = out.withColumn("loan_term_risk", F.col("loan_term") / F.lit(360.0))
        out = out.withColumn("short_term_loan", (F.col("loan_term") <= 36).cast("int"))
    if "interest_rate" in cols:
        out = out.withColumn("high_interest_rate", (F.col("interest_rate") > F.lit(HIGH_RATE)).cast("int"))
        if with_rate_percentile and rate_fit is not None:
            out = asof_rank(out, "interest_rate", "interest_rate_percentile", rate_fit)   # D-08
        elif with_rate_percentile:
            # one row a distinct rate; stored, so that its size decides between broadcast and shuffle
            ranks = cut_lineage(average_rank_table(narrow, "interest_rate").select(
                "interest_rate", F.col("pct_rank").alias("interest_rate_percentile")))
            out = out.join(ranks, "interest_rate", "left")
    if "employment_length" in cols:
        el = F.col("employment_length")
        out = out.withColumn("employment_stability",
                             F.when(el >= 2, "Stable").when(el >= 1, "Moderate").otherwise("New"))
        out = out.withColumn("long_employment", (el >= 5).cast("int"))
    if "home_ownership" in cols:
        out = out.withColumn("ownership_stability",
                             lookup(F.col("home_ownership"), OWNERSHIP_STABILITY, 0.0))
    if "loan_purpose" in cols:
        # D-07: keys are upper case; the loaders emit lower case, so look up on upper()
        out = out.withColumn("purpose_risk_score",
                             lookup(F.upper(F.col("loan_purpose")), PURPOSE_RISK, PURPOSE_RISK_DEFAULT))
    out = out.withColumn("financial_stress_score", financial_stress_score())
    if "loan_term" in cols and "interest_rate" in cols:
        out = out.withColumn("monthly_payment", monthly_payment())
        out = out.withColumn("payment_to_income_ratio",
                             F.col("monthly_payment") * F.lit(12.0) / (F.col("income") + F.lit(EPS)))
    return out


# ---- economic features (FE-17 .. FE-20) ------------------------------------
def economic_features(snapshot: DataFrame) -> DataFrame:
    """FE-17 on a snapshot table (fed_funds_rate, unemployment_rate, avg_interest_rate).

    Works on any number of snapshot rows (one per effective date).
    """
    fed = F.col("fed_funds_rate").cast("double")
    un = F.col("unemployment_rate").cast("double")
    avg = F.col("avg_interest_rate").cast("double")
    # least() skips NULLs, so a missing input must stay missing explicitly
    fed_n = F.when(fed.isNotNull(), F.least(fed / F.lit(10.0), F.lit(1.0)))
    un_n = F.when(un.isNotNull(), F.least(un / F.lit(15.0), F.lit(1.0)))
    comps = F.array_compact(F.array(un_n, fed_n))
    stress = F.when(F.size(comps) > 0,
                    F.aggregate(comps, F.lit(0.0), lambda a, x: a + x) / F.size(comps))
    keep = [c for c in snapshot.columns if c not in ("fed_funds_rate", "unemployment_rate", "avg_interest_rate")]
    return snapshot.select(
        *keep,
        fed.alias("fed_rate"), (fed > 3.0).cast("int").alias("fed_rate_high"), fed_n.alias("fed_rate_normalized"),
        un.alias("unemployment_rate"), (un > 6.0).cast("int").alias("unemployment_high"),
        un_n.alias("unemployment_normalized"),
        avg.alias("avg_interest_rate"), (avg > 4.0).cast("int").alias("high_rate_environment"),
        stress.alias("economic_stress_index"),
        F.when(stress.isNotNull(), (stress > 0.5).cast("int")).alias("high_economic_stress"),
    )


def economic_environment(snapshot: DataFrame) -> DataFrame:
    """FE-18: labelled environment features."""
    fed = F.col("fed_funds_rate").cast("double")
    un = F.col("unemployment_rate").cast("double")
    return snapshot.select(
        "*",
        F.when(fed.isNotNull(), F.when(fed > 3.0, "high").otherwise("low")).alias("interest_rate_environment"),
        fed.alias("base_risk_free_rate"),
        F.when(un.isNotNull(), F.when(un > 6.0, "high").otherwise("normal")).alias("economic_stress_indicator"),
        (un / 10.0).alias("macro_risk_factor"))


def macro_stress_index(unemployment="unemployment_rate", fed="fed_funds_rate", gdp="gdp_growth") -> Column:
    """FE-19: u/10 + max(0, fed-3)/10 with defaults fed 5.0 (gdp 2.0 is carried only)."""
    f = F.coalesce(F.col(fed).cast("double"), F.lit(5.0))
    return F.col(unemployment) / 10.0 + F.greatest(F.lit(0.0), f - 3.0) / 10.0


def attach_economics(apps: DataFrame, eco: DataFrame, prefix: str = "eco_") -> DataFrame:
    """JN-01: every economic feature becomes an ``eco_*`` column; of several snapshots the newest (``eff_from``) counts."""
    row = F.struct(*eco.columns)
    newest = eco.agg((F.max_by(row, "eff_from") if "eff_from" in eco.columns else F.max(row)).alias("e"))
    renamed = newest.select(*[F.col(f"e.{c}").alias(prefix + c) for c in eco.columns])
    return apps.crossJoin(F.broadcast(renamed))      # one row


def attach_economics_asof(apps: DataFrame, eco: DataFrame, ts_col: str = "application_ts",
                          eff_col: str = "eff_from", prefix: str = "eco_") -> DataFrame:
    """JN-02: latest snapshot with ``eff_from <= ts`` for each application.

    Each snapshot gets one row for every day on which it holds, and applications meet it by day;
    the last snapshot holds for all later days.  So the join is an equi-join whose right side is one
    row a day of the snapshots' span (more on days of a change), never a nested loop.
    """
    from pyspark.sql import Window
    w = Window.orderBy(eff_col)     # the snapshot table: one row a publication
    iv = eco.withColumn("_eff_to", F.lead(eff_col).over(w)).withColumn("_last", F.max(F.to_date(eff_col)).over(w.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)))
    until = F.coalesce(F.to_date("_eff_to"), F.col("_last"))
    days = iv.withColumn("_day", F.explode(F.sequence(F.to_date(eff_col), F.greatest(until, F.to_date(eff_col)))))
    renamed = days.select([F.col(c).alias(prefix + c) for c in eco.columns] + ["_eff_to", "_day"])
    last = eco.agg(F.max(F.to_date(eff_col)).alias("_last"))      # one row
    day = F.least(F.to_date(ts_col), F.col("_last"))
    cond = (F.col("_app_day") == F.col("_day")) & (F.col(ts_col) >= F.col(prefix + eff_col)) & (
        F.col("_eff_to").isNull() | (F.col(ts_col) < F.col("_eff_to")))
    return (apps.crossJoin(F.broadcast(last)).withColumn("_app_day", day).drop("_last").join(renamed, cond, "left")
            .drop("_eff_to", "_day", "_app_day"))


# ---- model-input preparation (PRJ-04/05, VAL-11, FE-21..24) ----------------
def numeric_feature_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """PRJ-04: numeric columns minus non-feature names (booleans are not numeric)."""
    drop = set(NON_FEATURE_COLUMNS) | set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in drop]


def align_features(df: DataFrame, feature_names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """PRJ-05: frozen feature order, missing -> 0.0, extras dropped."""
    have = set(df.columns)
    return df.select(*keep, *[(F.col(f).cast("double") if f in have else F.lit(0.0)).alias(f)
                              for f in feature_names])


def fit_medians(df: DataFrame, cols: Sequence[str], every: bool = False) -> DataFrame:
    """VAL-11 fit: (feature, median), with an exact median for each column that has missing values to fill.

    One aggregate counts the missing values; columns without any get no median (NULL) unless
    ``every`` asks for it."""
    if every or not cols:
        gaps = list(cols)
    else:
        counts = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols]).first()
        gaps = [c for c in cols if counts[c]]
    out = df.sparkSession.createDataFrame([(c, None) for c in cols if c not in gaps], "feature string, median double")
    for c in gaps:
        q = exact_quantiles(df.select(F.col(c).cast("double").alias("v")), "v", [0.5])
        out = out.unionByName(q.select(F.lit(c).alias("feature"), F.col("q").alias("median")))
    return out


def impute(df: DataFrame, medians: DataFrame, cols: Sequence[str]) -> DataFrame:
    """VAL-11: NULL -> fitted median; all-null column (no median) -> 0.0."""
    wide = medians.groupBy().pivot("feature", list(cols)).agg(F.first("median"))
    wide = wide.select([F.col(c).alias(f"_med_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(wide))
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}"), F.lit(0.0)))
    return out.drop(*[f"_med_{c}" for c in cols])


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """FE-21 fit: one row per feature with population mean and std (std 0 -> 1)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c)).alias(f"m_{c}"), F.stddev_pop(F.col(c)).alias(f"s_{c}")]
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"),
                 F.when((F.col(f"s_{c}") == 0) | F.col(f"s_{c}").isNull(), F.lit(1.0))
                 .otherwise(F.col(f"s_{c}")).alias("std")) for c in cols])).alias("kv")).select("kv.*")


def standardize(df: DataFrame, fit: DataFrame | None, cols: Sequence[str]) -> DataFrame:
    """FE-21 transform; identity without a fit."""
    if fit is None:
        return df
    wide = fit.groupBy().pivot("feature", list(cols)).agg(F.first(F.struct("mean", "std")))
    wide = wide.select([F.col(c).alias(f"_z_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(wide))
    for c in cols:
        out = out.withColumn(c, (F.col(c) - F.col(f"_z_{c}.mean")) / F.col(f"_z_{c}.std"))
    return out.drop(*[f"_z_{c}" for c in cols])


def outlier_flag(col: str, mean: Column, std: Column, k: float = 3.0) -> Column:
    """FE-25: |x - mean| > k * std (configured 3 sigma; opt-in)."""
    return F.abs(F.col(col) - mean) > F.lit(k) * std


def prepare_training_frame(apps: DataFrame, eco: DataFrame | None = None,
                           target: str = "is_default", lgd_default: float = 0.4,
                           fits: Mapping[str, DataFrame] | None = None):
    """FE-22/23/24: features + eco constants + target, numeric-only, imputed, scaled.

    Returns ``(frame, feature_names, fits)``; ``frame`` keeps ``app_id``,
    ``y_default`` and ``y_lgd`` next to the scaled features.  Passing the
    returned ``fits`` back reproduces the training transform at scoring time.
    """
    fits = dict(fits or {})
    training = "income" not in fits or fits.get("income") is None
    if training:   # fit on this table; scoring passes the stored fits back (D-08)
        fits["income"] = cut_lineage(fit_income_quartiles(apps))
        fits["rate"] = cut_lineage(fit_rate_ranks(apps))
    feats = engineer_credit_features(apps, income_fit=fits["income"], rate_fit=None if training else fits.get("rate"))
    if eco is not None:
        feats = attach_economics(feats, economic_features(eco))
    y = [F.coalesce(F.col(target).cast("int"), F.lit(0)).alias("y_default")] if target in feats.columns else []
    if "loss_given_default" in feats.columns:
        y.append(F.coalesce(F.col("loss_given_default"), F.lit(lgd_default)).alias("y_lgd"))
    names = fits.get("feature_names") or numeric_feature_columns(feats.drop(target) if target in feats.columns else feats)
    keep = (["app_id"] if "app_id" in feats.columns else []) + ["y_default", "y_lgd"][:len(y)]
    base = align_features(feats.select("*", *y), names, keep=keep)
    # materialise once: the fits below and the transform all read this frame
    base = cut_lineage(base)
    med = fits.get("medians")
    if med is None:
        med = fit_medians(base, names)
    base = impute(base, med, names)
    sc = fits.get("scaler")
    if sc is None:
        sc = fit_scaler(base, names)
    base = standardize(base, sc, names)
    return base, list(names), {"income": fits["income"], "rate": fits.get("rate"), "medians": med,
                               "scaler": sc, "feature_names": list(names)}
