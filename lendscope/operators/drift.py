"""Drift detection (DR-01 .. DR-16) as one grouped job over long-form samples.

Input is long form ``(feature, sample, value, category)`` with ``sample`` in
{reference, current}: every feature is tested in the same scan / shuffle, not
in a Python loop over features.  Feature cardinality is bounded (it is a
schema property), which is what lets per-feature fits be broadcast: a join that
shuffles by feature would leave all rows of a feature to one task, and so would
every aggregate after it whose keys begin with the feature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendscope.functions.bands import bin_edges, bin_of
from lendscope.operators.prefix import prefix_sums
from lendscope.operators.tails import chi2_pvalue, ks_pvalue
from lendscope.session import materialize

# --- fixed values (must equal the reference for equal results) -------------
MIN_SAMPLE_SIZE = 100
SIGNIFICANCE = 0.05
CONTINUOUS_DISTINCT = 20
PSI_BINS = 10
PSI_FLOOR = 1e-10
PERFORMANCE_TOLERANCE = 0.05
RECOMMENDATIONS = {
    "stable": ["Model performance is stable", "Continue regular monitoring"],
    "moderate_drift": ["Monitor closely and prepare for retraining", "Analyze prediction accuracy trends"],
    "significant_drift": ["Consider retraining model with recent data", "Review feature importance and distributions"],
}


def _is_ref() -> Column:
    return F.col("sample") == F.lit("reference")


def _is_cur() -> Column:
    return F.col("sample") == F.lit("current")


def value_table(long: DataFrame) -> DataFrame:
    """feature, value, category, ref, cur: how often each sample holds each distinct value.

    Partial aggregation folds repeated values before the shuffle; every test below is computed from
    this table, so the exploded samples are scanned once and never written."""
    present = F.col("category").isNotNull() | F.col("value").isNotNull()
    return long.where(present).groupBy("feature", "value", "category").agg(
        F.sum(_is_ref().cast("long")).alias("ref"), F.sum(_is_cur().cast("long")).alias("cur"))


def _counted(df: DataFrame) -> DataFrame:
    return df if "ref" in df.columns else value_table(df)


def sample_profile(values: DataFrame, float_features: Sequence[str] = ()) -> DataFrame:
    """DR-01/02: sizes, distinct reference values and the test each feature gets (samples or a value table)."""
    prof = _counted(values).groupBy("feature").agg(
        F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur"),
        F.sum((F.col("ref") > 0).cast("long")).alias("distinct_ref"),
        F.max(F.col("category").isNotNull()).alias("_is_cat"))
    continuous = (~F.col("_is_cat")) & ((F.col("distinct_ref") > CONTINUOUS_DISTINCT)
                                        | F.col("feature").isin(list(float_features) or [""]))
    test = (F.when((F.col("n_ref") < MIN_SAMPLE_SIZE) | (F.col("n_cur") < MIN_SAMPLE_SIZE), F.lit("insufficient_data"))
            .when(continuous, F.lit("ks_test")).otherwise(F.lit("chi_square")))
    return prof.select("feature", "n_ref", "n_cur", "distinct_ref", continuous.alias("continuous"), test.alias("test"))


def per_feature(table: DataFrame) -> DataFrame:
    """A table of one row a feature, sent to the rows it is joined to."""
    return F.broadcast(table)


def _edges(fit: DataFrame, bins: int) -> DataFrame:
    """feature, edges: the bin edges of each feature's range, computed once a feature."""
    return per_feature(fit.select("feature", bin_edges("lo", "hi", bins).alias("edges")))


def ks_statistics(values: DataFrame) -> DataFrame:
    """DR-03: D = max |F_ref - F_cur| per feature, plus means and population stds."""
    vc = _counted(values).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    ps = prefix_sums(vc, "value", ["feature"], ("ref", "cur"))
    f1 = (F.col("below_ref") + F.col("ref")) / F.col("total_ref")
    f2 = (F.col("below_cur") + F.col("cur")) / F.col("total_cur")

    def mean(c):
        return F.try_divide(F.sum(F.col("value") * F.col(c)), F.sum(c))

    # one row a feature, read twice
    out = materialize(ps.groupBy("feature").agg(F.max(F.abs(f1 - f2)).alias("ks_statistic"),
                                                mean("ref").alias("reference_mean"), mean("cur").alias("current_mean")))
    # deviations around the means, in a second pass over the counts
    dev = vc.join(per_feature(out.select("feature", "reference_mean", "current_mean")), "feature").groupBy("feature").agg(
        F.sqrt(F.try_divide(F.sum(F.pow(F.col("value") - F.col("reference_mean"), 2) * F.col("ref")), F.sum("ref")))
        .alias("reference_std"),
        F.sqrt(F.try_divide(F.sum(F.pow(F.col("value") - F.col("current_mean"), 2) * F.col("cur")), F.sum("cur")))
        .alias("current_std"))
    return out.join(dev, "feature")


def category_counts(values: DataFrame) -> DataFrame:
    """JN-03 / SET-01: aligned frequency table over the union of categories."""
    key = F.coalesce(F.col("category"), F.col("value").cast("string"))
    return _counted(values).where(key.isNotNull()).groupBy("feature", key.alias("cat")).agg(
        F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))


def chi_square(values: DataFrame) -> DataFrame:
    """DR-04: chi-square statistic of current counts against reference shares."""
    cc = category_counts(values)
    tot = cc.groupBy("feature").agg(F.sum("ref").alias("_tr"), F.sum("cur").alias("_tc"),
                                    F.count(F.lit(1)).alias("_k"))
    j = cc.join(per_feature(tot), "feature")
    exp = F.greatest(F.col("ref") / F.col("_tr") * F.col("_tc"), F.lit(PSI_FLOOR))
    return j.groupBy("feature").agg(
        F.sum(F.pow(F.col("cur") - exp, 2) / exp).alias("chi2_statistic"),
        (F.first("_k") - 1).cast("long").alias("degrees_of_freedom"))


def _psi_from_counts(counts: DataFrame, key: str) -> DataFrame:
    tot = counts.groupBy("feature").agg(F.sum("ref").alias("_tr"), F.sum("cur").alias("_tc"))
    j = counts.join(per_feature(tot), "feature")
    r = F.greatest(F.try_divide(F.col("ref").cast("double"), F.col("_tr").cast("double")), F.lit(PSI_FLOOR))
    c = F.greatest(F.try_divide(F.col("cur").cast("double"), F.col("_tc").cast("double")), F.lit(PSI_FLOOR))
    term = (c - r) * F.log(c / r)
    return j.groupBy("feature").agg(
        F.when(F.min("_tc") > 0, F.sum(term)).alias("psi"))  # all current outside range -> NULL


def psi_continuous(values: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """DR-05: equal-width bins of the reference range; current outside is ignored."""
    x = _counted(values).where(F.col("value").isNotNull())
    fit = x.where("ref > 0").groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    b = x.join(_edges(fit, bins), "feature").select("feature", bin_of("value", "edges").alias("bin"), "ref", "cur")
    counts = b.where(F.col("bin").isNotNull()).groupBy("feature", "bin").agg(
        F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    return _psi_from_counts(counts, "bin")


def psi_categorical(values: DataFrame) -> DataFrame:
    """DR-06: PSI over the union of categories."""
    return _psi_from_counts(category_counts(values), "cat")


def psi_severity(psi: Column) -> Column:                                  # DR-07
    return F.when(psi < 0.1, "no_significant_change").when(psi < 0.2, "moderate_change") \
        .otherwise("significant_change")


def drift_status(score: Column) -> Column:                                # DR-13
    return (F.when(score.isNull(), "insufficient_data").when(score < 0.1, "stable")
            .when(score < 0.3, "minor_drift").when(score < 0.5, "moderate_drift").otherwise("significant_drift"))


def recommendations(status: Column) -> Column:                            # DR-14
    expr = None
    for k, v in RECOMMENDATIONS.items():
        arr = F.array(*[F.lit(s) for s in v]) if v else F.array().cast("array<string>")
        expr = F.when(status == k, arr) if expr is None else expr.when(status == k, arr)
    return expr.otherwise(F.array().cast("array<string>"))


def feature_drift(long: DataFrame, float_features: Sequence[str] = (), with_p_values: bool = True) -> DataFrame:
    """DR-01..07/09: one row per feature with the routed test, its statistic, PSI."""
    values = materialize(value_table(long))
    prof = materialize(sample_profile(values, float_features))      # one row a feature
    numeric = prof.where("continuous").select("feature")
    numeric = per_feature(numeric)
    cont, cat = values.join(numeric, "feature", "left_semi"), values.join(numeric, "feature", "left_anti")
    ks, chi = ks_statistics(cont), chi_square(cat)
    psi = psi_continuous(cont).unionByName(psi_categorical(cat))
    out = prof.join(ks, "feature", "left").join(chi, "feature", "left").join(psi, "feature", "left")
    stat = (F.when(F.col("test") == "ks_test", F.col("ks_statistic"))
            .when(F.col("test") == "chi_square", F.col("chi2_statistic")).otherwise(F.lit(0.0)))
    out = out.withColumn("test_statistic", stat).withColumn("psi_severity", psi_severity(F.col("psi")))
    if with_p_values:
        p = (F.when(F.col("test") == "ks_test", ks_pvalue(F.col("ks_statistic"), F.col("n_ref"), F.col("n_cur")))
             .when(F.col("test") == "chi_square", chi2_pvalue(F.col("chi2_statistic"),
                                                              F.col("degrees_of_freedom").cast("double"))))
        out = out.withColumn("p_value", p).withColumn(
            "drift_detected", F.coalesce(F.col("p_value") < SIGNIFICANCE, F.lit(False)))
    return out.withColumn("drift_type", F.concat(F.lit("feature_drift_"), F.col("feature")))


def performance_drift(ref_metric: Column, cur_metric: Column) -> Column:
    """DR-08: struct(drift_detected, relative_change) with a 5 % tolerance."""
    diff = F.abs(ref_metric - cur_metric)
    rel = F.when(ref_metric == 0, F.lit(0.0)).otherwise((cur_metric - ref_metric) / ref_metric)
    return F.struct((diff > F.lit(PERFORMANCE_TOLERANCE) * ref_metric).alias("drift_detected"),
                    rel.alias("relative_change"))


def drift_alert_line(report: DataFrame, score: str = "psi", threshold: float = 0.2, k: int = 3) -> DataFrame:
    """DR-16 / SRT-05: ALERT flag + top-k drifting features (a top-k report)."""
    top = report.where(F.col(score).isNotNull()).orderBy(F.col(score).desc(), "feature").limit(k)
    top_arr = top.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("_s"), "feature"))),
                                  lambda s: s["feature"]).alias("top_features"))
    mx = report.agg(F.max(score).alias("max_score"))
    return mx.crossJoin(top_arr).withColumn(
        "status", F.when(F.col("max_score") > threshold, "ALERT").otherwise("OK"))


def psi_history(long: DataFrame, period_col: str, bins: int = PSI_BINS,
                float_features: Sequence[str] | None = None) -> DataFrame:
    """DR-09/12 over time: PSI of every (feature, period) of the current sample
    against the fixed reference sample.

    Two passes over the samples: the reference range of each feature, then one aggregate over (feature,
    period, bin) with a count for each sample.  That table is stored and everything else comes from it,
    so the reference is never replicated per period.  Continuous features use the reference
    equal-width bins, categorical ones their categories.  Given ``float_features``, a number that is not
    among them and has few distinct reference values goes by its values (the routing of ``sample_profile``);
    else every number is continuous.
    """
    x = long.withColumn("_key", F.when(F.col("category").isNotNull(), F.col("category")))
    by_value = F.lit(False)
    if float_features is not None:
        other = ~F.col("feature").isin([*float_features])
        by_value = F.first(other) & (F.count_distinct(F.when(other, F.col("value"))) <= CONTINUOUS_DISTINCT)
    fit = x.where(_is_ref() & F.col("value").isNotNull()).groupBy("feature").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), by_value.alias("_by_value"))
    edges = per_feature(fit.select("feature", "_by_value", bin_edges("lo", "hi", bins).alias("edges")))
    number = F.when(F.col("_by_value"), F.col("value").cast("string")).otherwise(bin_of("value", "edges").cast("string"))
    binned = x.join(edges, "feature", "left").withColumn("_bin", F.coalesce(F.col("_key"), number))
    counts = materialize(binned.where(F.col("_bin").isNotNull()).groupBy("feature", period_col, "_bin").agg(
        F.count_if(_is_ref()).alias("ref"), F.count_if(_is_cur()).alias("cur")))
    rc = counts.where("ref > 0").groupBy("feature", "_bin").agg(F.sum("ref").alias("ref"))
    rt = rc.groupBy("feature").agg(F.sum("ref").alias("_tr"))
    cc = counts.where("cur > 0").drop("ref")
    ct = cc.groupBy("feature", period_col).agg(F.sum("cur").alias("_tc"))
    # every (feature, period) sees every reference bin plus its own current bins
    periods = ct.select("feature", period_col)
    grid = rc.join(periods, "feature").select("feature", period_col, "_bin", "ref")
    j = grid.join(cc, ["feature", period_col, "_bin"], "full_outer").fillna({"ref": 0, "cur": 0})
    j = j.join(per_feature(rt), "feature").join(ct, ["feature", period_col])
    r = F.greatest(F.col("ref") / F.col("_tr"), F.lit(PSI_FLOOR))
    c = F.greatest(F.col("cur") / F.col("_tc"), F.lit(PSI_FLOOR))
    out = j.groupBy("feature", period_col).agg(F.sum((c - r) * F.log(c / r)).alias("drift_score"))
    return out.select("feature", period_col, F.concat(F.lit("feature_drift_"), F.col("feature")).alias("drift_type"),
                      "drift_score", (F.col("drift_score") > F.lit(0.2)).alias("drift_detected"))


def drift_sections(history: DataFrame, newest: int = 10) -> DataFrame:
    """AGG-05: section, timestamp, drift_type, value of a drift history.

    ``total``, ``feature`` and ``performance`` count results; ``trend`` counts them by hour and type (hours
    without results are left out); ``recent`` are the ``newest`` results with their score (a top-k report)."""
    kind = F.col("drift_type")
    counts = history.agg(F.count(F.lit(1)).alias("total"), F.count_if(kind.contains("feature_drift")).alias("feature"),
                         F.count_if(kind == "performance_drift").alias("performance"))
    none = F.lit(None)
    totals = counts.select(F.explode(F.create_map(*[x for c in counts.columns for x in (F.lit(c), F.col(c).cast("double"))])).alias(
        "section", "value")).select("section", none.cast("timestamp_ntz").alias("timestamp"), none.cast("string").alias("drift_type"), "value")
    trend = history.groupBy(F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("timestamp"), "drift_type").agg(
        F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("trend").alias("section"), "timestamp", "drift_type", "value")
    recent = history.orderBy(F.desc("timestamp"), "drift_type").limit(newest).select(
        F.lit("recent").alias("section"), "timestamp", "drift_type", F.col("drift_score").alias("value"))
    return totals.unionByName(trend).unionByName(recent)


def wasserstein(values: DataFrame) -> DataFrame:
    """Wasserstein-1 distance per feature: the area between the two distribution functions.

    Prefix sums give both functions at every distinct value; each difference holds until the next value,
    which for the last value of a range bucket is the first value of the next bucket."""
    vc = _counted(values).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    ps = prefix_sums(vc, "value", ["feature"], ("ref", "cur"), keep_bucket=True)
    first = ps.groupBy("feature", "_bucket").agg(F.min("value").alias("_first"))
    following = first.select("feature", "_bucket", F.lead("_first").over(Window.partitionBy("feature").orderBy("_bucket")).alias("_next"))
    inside = F.lead("value").over(Window.partitionBy("feature", "_bucket").orderBy("value"))
    gap = F.abs(F.try_divide(F.col("below_ref") + F.col("ref"), F.col("total_ref"))
                - F.try_divide(F.col("below_cur") + F.col("cur"), F.col("total_cur")))
    x = ps.withColumn("_inside", inside).join(following, ["feature", "_bucket"])
    return x.groupBy("feature").agg(F.sum(gap * (F.coalesce("_inside", "_next", "value") - F.col("value"))).alias("wasserstein"))


# ---- UDF-01: plug-in drift detectors ------------------------------------------
#: name -> (function from samples or a value table to one row per feature, its column of the score)
DETECTORS = {
    "ks_test": (ks_statistics, "ks_statistic"),
    "chi_square": (chi_square, "chi2_statistic"),
    "psi_continuous": (psi_continuous, "psi"),
    "psi_categorical": (psi_categorical, "psi"),
    "wasserstein": (wasserstein, "wasserstein"),
}


def register_detector(name: str, fn, score: str) -> None:
    """Add a detector: ``fn`` gets samples (or their value table) and returns one row per feature with the column ``score``."""
    DETECTORS[name] = (fn, score)


def run_detector(name: str, long: DataFrame) -> DataFrame:
    """feature, detector, drift_score of a registered detector."""
    if name not in DETECTORS:
        raise ValueError(f"unknown detector {name}; known: {', '.join(sorted(DETECTORS))}")
    fn, score = DETECTORS[name]
    return fn(long).select("feature", F.lit(name).alias("detector"), F.col(score).cast("double").alias("drift_score"))


def run_detectors(names: Sequence[str], long: DataFrame) -> DataFrame:
    """Several detectors over one stored value table, in one plan."""
    values = materialize(value_table(long))
    out = run_detector(names[0], values)
    for name in names[1:]:
        out = out.unionByName(run_detector(name, values))
    return out
