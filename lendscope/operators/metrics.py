"""Model validation statistics (MV-01 .. MV-16) on whole scored tables.

Rank-based statistics (AUC, ROC, KS) use ``prefix.prefix_sums`` over the
distinct scores, so the cumulative counts never need a global window.
Every function accepts ``group_cols`` (model, version, segment...) of bounded
cardinality.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.operators.prefix import exact_quantiles, prefix_sums, value_counts
from lendscope.session import materialize

# --- fixed values: default validation gates --------------------------------
DEFAULT_GATES = {"min_auc": 0.75, "max_lgd_rmse": 0.25, "max_calibration_error": 0.05,
                 "min_business_rules_pass_rate": 0.95}


def _score_counts(df: DataFrame, score: str, label: str, group_cols: Sequence[str]) -> DataFrame:
    y = F.col(label).cast("int")
    df = materialize(df.where(F.col(label).isNotNull()), [*group_cols, score, label])
    vc = value_counts(df, score, group_cols,
                      {"pos": (y == 1).cast("long"), "neg": (y == 0).cast("long")})
    return prefix_sums(vc, score, group_cols, ("cnt", "pos", "neg"))


def auc(df: DataFrame, score: str, label: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """MV-01/02: tie-aware ROC AUC (Mann-Whitney on average ranks) and Gini.

    NULL when one class is absent.
    """
    g = list(group_cols)
    ps = _score_counts(df, score, label, g)
    avg_rank = F.col("below_cnt") + (F.col("cnt") + F.lit(1)) / F.lit(2.0)
    agg = ps.groupBy(*g).agg(F.sum(F.col("pos") * avg_rank).alias("_rsum"),
                             F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    n1, n0 = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    a = F.try_divide(F.col("_rsum") - n1 * (n1 + F.lit(1.0)) / F.lit(2.0), n1 * n0)
    a = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), a)
    return agg.select(*g, a.alias("auc"), (F.lit(2.0) * a - F.lit(1.0)).alias("gini"),
                      F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"))


def roc_points(df: DataFrame, score: str, label: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """MV-03: one ROC point per distinct score (threshold = score, predict ``>=``)."""
    g = list(group_cols)
    ps = _score_counts(df, score, label, g)
    tp = F.col("total_pos") - F.col("below_pos")
    fp = F.col("total_neg") - F.col("below_neg")
    return ps.select(*g, F.col(score).cast("double").alias("threshold"),
                     tp.cast("long").alias("tp"), fp.cast("long").alias("fp"),
                     F.try_divide(tp.cast("double"), F.col("total_pos").cast("double")).alias("tpr"),
                     F.try_divide(fp.cast("double"), F.col("total_neg").cast("double")).alias("fpr"),
                     F.col("total_pos").cast("long").alias("n_pos"), F.col("total_neg").cast("long").alias("n_neg"))


def youden(roc: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """MV-04 / MV-16: first arg-max of tpr - fpr (highest threshold on ties); KS = max."""
    j = F.col("tpr") - F.col("fpr")
    return roc.groupBy(*group_cols).agg(
        F.max_by("threshold", F.struct(j, F.col("threshold"))).alias("optimal_threshold"),
        F.max(j).alias("ks_statistic"))


def confusion(df: DataFrame, score: str, label: str, threshold: Column, strict: bool = False,
              group_cols: Sequence[str] = ()) -> DataFrame:
    """MV-05/06/07: confusion counts and class-1 precision/recall/F1 at a threshold.

    ``strict`` predicts ``score > t`` (MV-07), else ``score >= t`` (MV-05).
    """
    pred = (F.col(score) > threshold) if strict else (F.col(score) >= threshold)
    y = F.col(label).cast("int") == 1
    agg = df.groupBy(*group_cols).agg(
        F.sum((pred & y).cast("long")).alias("tp"), F.sum((pred & ~y).cast("long")).alias("fp"),
        F.sum((~pred & ~y).cast("long")).alias("tn"), F.sum((~pred & y).cast("long")).alias("fn"))
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    precision = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * precision * recall, precision + recall), F.lit(0.0))
    acc = F.try_divide(tp + tn, tp + fp + tn + fn)
    return agg.select("*", acc.alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
                      f1.alias("f1_score"))


def lgd_metrics(df: DataFrame, pred: str, actual: str, default_flag: str, max_rmse: float = 0.25,
                group_cols: Sequence[str] = ()) -> DataFrame:
    """MV-08: RMSE, MAE, R^2 and out-of-range count on defaulted rows only."""
    d = df.where(F.col(default_flag).cast("int") == 1)
    e = F.col(pred) - F.col(actual)
    agg = d.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("defaulted_samples"), F.avg(e * e).alias("_mse"), F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("_sse"), F.var_pop(actual).alias("_var"),
        F.sum(((F.col(pred) < 0) | (F.col(pred) > 1)).cast("long")).alias("out_of_range_predictions"))
    rmse = F.sqrt("_mse")
    r2 = F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_var") * F.col("defaulted_samples"))
    return agg.select(*group_cols, "defaulted_samples", rmse.alias("rmse"), "mae", r2.alias("r2"),
                      "out_of_range_predictions",
                      ((rmse <= max_rmse) & (F.col("out_of_range_predictions") == 0)).alias("pass"))


def quantile_edges(df: DataFrame, score: str, n_bins: int = 10, group_cols: Sequence[str] = ()) -> DataFrame:
    """Exact quantile edges at 0, 1/n, ..., 1 as one array per group."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    q = exact_quantiles(df, score, probs, group_cols)
    return q.groupBy(*group_cols).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p", "q"))), lambda s: s["q"]).alias("edges"))


def calibration(df: DataFrame, score: str, label: str, n_bins: int = 10, max_error: float = 0.05,
                group_cols: Sequence[str] = ()):
    """MV-09/10: (error row, calibration table).

    Error: bin = count of *inner* edges strictly below p; mean |observed - mean p|
    over non-empty bins.  Table: bin = count of edges <= p (left-closed), with
    the maximum clamped into the last bin (D-10).
    """
    g = list(group_cols)
    df = materialize(df, [*g, score, label])
    edges = quantile_edges(df, score, n_bins, g)
    j = df.join(edges, g) if g else df.crossJoin(F.broadcast(edges))
    p = F.col(score)
    inner = F.slice("edges", 2, n_bins - 1)
    err_bin = F.size(F.filter(inner, lambda e: e < p))
    tab_bin = F.least(F.size(F.filter("edges", lambda e: e <= p)), F.lit(n_bins))
    y = F.col(label).cast("double")
    per = j.groupBy(*g, err_bin.alias("bin")).agg(F.avg(y).alias("obs"), F.avg(p).alias("exp"))
    err = per.groupBy(*g).agg(F.avg(F.abs(F.col("obs") - F.col("exp"))).alias("calibration_error"))
    err = err.withColumn("pass", F.col("calibration_error") <= max_error)
    table = j.groupBy(*g, tab_bin.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg(y).alias("observed_rate"), F.avg(p).alias("expected_rate"))
    table = table.withColumn("difference", F.col("observed_rate") - F.col("expected_rate"))
    return err, table


def business_rules(scored: DataFrame, pd_col: str = "pd_score", rating: str = "risk_rating",
                   el: str = "expected_loss", min_pass_rate: float = 0.95) -> DataFrame:
    """MV-11: four portfolio rules as one row (checks, violations, pass rate)."""
    cols = set(scored.columns)
    aggs = [F.min(el).alias("_el_min"), F.max(el).alias("_el_max")]
    if "credit_score_normalized" in cols:
        aggs.append(F.avg(F.when(F.col("credit_score_normalized") > 0.8, F.col(pd_col))).alias("_pd_hi_score"))
    if "debt_to_income" in cols:
        hi = F.col("debt_to_income") > 0.5
        aggs += [F.avg(F.when(hi, F.col(pd_col))).alias("_pd_hi_dti"),
                 F.avg(F.when(~hi | F.col("debt_to_income").isNull(), F.col(pd_col))).alias("_pd_lo_dti")]
    one = scored.agg(*aggs)
    # mean PD per rating: at most 10 rows
    by_rating = scored.groupBy(rating).agg(F.avg(pd_col).alias("_m"))
    mono = by_rating.agg(F.sort_array(F.collect_list(F.struct(rating, "_m"))).alias("_s")).select(
        F.aggregate(F.sequence(F.lit(2), F.greatest(F.size("_s"), F.lit(2))),
                    F.lit(True),
                    lambda acc, i: acc & F.coalesce(
                        F.element_at("_s", i)["_m"] >= F.element_at("_s", i - 1)["_m"], F.lit(True))
                    ).alias("_monotonic"))
    j = one.crossJoin(mono)
    # the four texts are fixed values (must equal the reference)
    v = [F.when(~F.col("_monotonic"), F.lit("Risk ratings not monotonic with PD")),
         F.when((F.col("_el_max") > 1.0) | (F.col("_el_min") < 0), F.format_string("Expected loss out of range: [%.3f, %.3f]", "_el_min", "_el_max"))]
    checks = F.lit(2)
    if "credit_score_normalized" in cols:
        checks = checks + 1
        v.insert(0, F.when(F.col("_pd_hi_score") > 0.1, F.format_string("High credit score avg PD too high: %.2f%%", F.col("_pd_hi_score") * 100)))
    if "debt_to_income" in cols:
        checks = checks + 1
        v.append(F.when(F.col("_pd_hi_dti").isNotNull() & (F.col("_pd_hi_dti") <= F.col("_pd_lo_dti")),
                        F.lit("High DTI not showing higher risk")))
    viol = F.array_compact(F.array(*v))
    rate = (checks - F.size(viol)).cast("double") / checks.cast("double")
    return j.select(checks.alias("total_rules_checked"), viol.alias("violations"),
                    F.size(viol).alias("violation_count"), rate.alias("pass_rate"),
                    (rate >= min_pass_rate).alias("pass"))


def stability_stats(df: DataFrame, pd_col: str = "pd_score", group_cols: Sequence[str] = ()) -> DataFrame:
    """MV-12: mean, population std, min, max, zeros, ones, inf and NaN counts."""
    x = F.col(pd_col)
    return df.groupBy(*group_cols).agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.sum((x == 0).cast("long")).alias("zeros"), F.sum((x == 1).cast("long")).alias("ones"),
        F.sum((F.abs(x) == F.lit(float("inf"))).cast("long")).alias("inf_values"),
        F.sum(F.isnan(x).cast("long")).alias("nan_values"))


def perturbation_sensitivity(df: DataFrame, id_col: str, numeric_cols: Sequence[str], score_fn,
                             noise: float = 0.01, seed: int = 42) -> DataFrame:
    """MV-13: score all rows before and after 1 % multiplicative Gaussian noise; mean / max |dPD|.

    The noise is a function of the row's id (Box-Muller on two hashes), so a retried task draws the
    same, and both scores are taken in one pass without a join."""
    def normal(i: int) -> Column:
        u = [(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed), F.lit(2 * i + k)), F.lit(1 << 52)) + F.lit(0.5))
             / F.lit(float(1 << 52)) for k in (0, 1)]
        return F.sqrt(F.lit(-2.0) * F.log(u[0])) * F.cos(F.lit(2 * math.pi) * u[1])

    base = score_fn(df).withColumn("_p0", F.col("pd_score")).select(*df.columns, "_p0")
    noisy = base.withColumns({c: F.col(c) * (F.lit(1.0) + F.lit(noise) * normal(i)) for i, c in enumerate(numeric_cols)})
    d = score_fn(noisy).select(F.abs(F.col("_p0") - F.col("pd_score")).alias("d"))
    return d.agg(F.avg("d").alias("mean_absolute_change"), F.max("d").alias("max_absolute_change"),
                 (F.max("d") < 0.1).alias("stable"))


def overall_verdict(pd_auc: DataFrame, lgd: DataFrame, calib: DataFrame, rules: DataFrame,
                    gates: dict | None = None) -> DataFrame:
    """MV-14: AND of PD, LGD, calibration and business-rule gates (one row)."""
    g = {**DEFAULT_GATES, **(gates or {})}
    a = pd_auc.select(F.col("auc"), (F.coalesce(F.col("auc"), F.lit(0.0)) >= g["min_auc"]).alias("pd_pass"))
    l_ = lgd.select(F.col("rmse").alias("lgd_rmse"), F.col("pass").alias("lgd_pass"))
    l_ = l_.unionByName(l_.sparkSession.createDataFrame([(None, True)], "lgd_rmse double, lgd_pass boolean")) \
        .agg(F.max("lgd_rmse").alias("lgd_rmse"), F.min(F.col("lgd_pass").cast("int")).cast("boolean").alias("lgd_pass"))
    c = calib.select("calibration_error", (F.col("calibration_error") <= g["max_calibration_error"])
                     .alias("calibration_pass"))
    r = rules.select(F.col("pass_rate").alias("business_rules_pass_rate"),
                     (F.col("pass_rate") >= g["min_business_rules_pass_rate"]).alias("business_rules_pass"))
    out = a.crossJoin(l_).crossJoin(c).crossJoin(r)
    return out.withColumn("overall_pass", F.col("pd_pass") & F.col("lgd_pass") & F.col("calibration_pass")
                          & F.col("business_rules_pass"))
