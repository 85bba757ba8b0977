"""Model validation queries over the whole scored book."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.operators import metrics as mv
from lendscope.plans.book import scored_book
from lendscope.plans.oracle_views import with_views
from lendscope.plans.registry import register
from lendscope.sources.tables import Tables


def _r(c, n=8):
    return F.round(F.col(c), n).alias(c)


_AUC_SQL = """
SELECT {g_sel} round((sum(CASE WHEN y = 1 THEN ar END) - n1 * (n1 + 1) / 2.0E0) / nullif(n1 * n0, 0), 8) AS auc,
       round(2.0E0 * ((sum(CASE WHEN y = 1 THEN ar END) - n1 * (n1 + 1) / 2.0E0) / nullif(n1 * n0, 0)) - 1.0E0, 8) AS gini,
       CAST(n1 AS BIGINT) AS n_pos, CAST(n0 AS BIGINT) AS n_neg
FROM (SELECT {g_sel} y, rank() OVER (PARTITION BY {g_part} ORDER BY s)
             + (count(*) OVER (PARTITION BY {g_part}, s) - 1) / 2.0E0 AS ar,
             sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {g_part}) AS n1,
             sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {g_part}) AS n0
      FROM ({src}) x) r
GROUP BY {g_grp} n1, n0"""


def auc_sql(src: str, group: str | None = None) -> str:
    return _AUC_SQL.format(g_sel=f"{group}," if group else "", g_part=group or "1",
                           g_grp=f"{group}," if group else "", src=src)


_BOOK_SRC = "SELECT CAST(is_default AS INTEGER) AS y, pd_score AS s, loan_purpose FROM scored_book"


@register("pd_auc", ops=("MV-01", "MV-02", "WIN-01"), sql=with_views(auc_sql(_BOOK_SRC), "scored_book"))
def pd_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = mv.auc(scored_book(spark, sf_dir, validate=False), "pd_score", "is_default")
    return a.select(_r("auc"), _r("gini"), "n_pos", "n_neg")


@register("pd_auc_by_purpose", ops=("MV-01", "MV-02"),
          sql=with_views(auc_sql(_BOOK_SRC, "loan_purpose"), "scored_book"))
def pd_auc_by_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = mv.auc(scored_book(spark, sf_dir, validate=False), "pd_score", "is_default", ["loan_purpose"])
    return a.select("loan_purpose", _r("auc"), _r("gini"), "n_pos", "n_neg")


@register("document_quality_auc", ops=("MV-01", "JN-05"), sql=auc_sql(
    "SELECT l.quality AS y, CAST(d.n_chars AS DOUBLE) AS s, d.lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "lang"))
def document_quality_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    j = t.documents.select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars")).join(
        t.labels.select("doc_id", "quality"), "doc_id")
    a = mv.auc(j, "n_chars", "quality", ["lang"])
    return a.select("lang", _r("auc"), _r("gini"), "n_pos", "n_neg")


_ROC_RAW = """
SELECT s, tp, fp, n1, n0
FROM (SELECT s, sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp,
             sum(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp,
             sum(pos) OVER () AS n1, sum(neg) OVER () AS n0
      FROM (SELECT pd_score AS s, sum(CAST(is_default AS INTEGER)) AS pos,
                   sum(1 - CAST(is_default AS INTEGER)) AS neg FROM scored_book GROUP BY pd_score) v) c"""

_ROC_SQL = f"""
SELECT round(s, 12) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       round(tp / n1, 8) AS tpr, round(fp / n0, 8) AS fpr
FROM ({_ROC_RAW}) r"""


@register("roc_curve", ops=("MV-03", "WIN-07"), sql=with_views(_ROC_SQL, "scored_book"))
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = mv.roc_points(scored_book(spark, sf_dir, validate=False), "pd_score", "is_default")
    return r.select(_r("threshold", 12), "tp", "fp", _r("tpr"), _r("fpr"))


@register("optimal_threshold_confusion", ops=("MV-04", "MV-05", "MV-06", "MV-16"), sql=with_views(f"""
SELECT round(t.threshold, 12) AS optimal_threshold, round(t.j, 8) AS ks_statistic,
       CAST(sum(CASE WHEN pd_score >= t.threshold AND is_default THEN 1 ELSE 0 END) AS BIGINT) AS tp,
       CAST(sum(CASE WHEN pd_score >= t.threshold AND NOT is_default THEN 1 ELSE 0 END) AS BIGINT) AS fp,
       CAST(sum(CASE WHEN pd_score < t.threshold AND NOT is_default THEN 1 ELSE 0 END) AS BIGINT) AS tn,
       CAST(sum(CASE WHEN pd_score < t.threshold AND is_default THEN 1 ELSE 0 END) AS BIGINT) AS fn
FROM scored_book, (SELECT s AS threshold, tp / n1 - fp / n0 AS j FROM ({_ROC_RAW}) r ORDER BY tp / n1 - fp / n0 DESC, s DESC LIMIT 1) t
GROUP BY t.threshold, t.j""", "scored_book"))
def optimal_threshold_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_book(spark, sf_dir, validate=False)
    y = mv.youden(mv.roc_points(s, "pd_score", "is_default"))
    c = mv.confusion(s.crossJoin(F.broadcast(y)), "pd_score", "is_default", F.col("optimal_threshold"),
                     group_cols=["optimal_threshold", "ks_statistic"])
    return c.select(_r("optimal_threshold", 12), _r("ks_statistic"), "tp", "fp", "tn", "fn")


@register("classification_at_half", ops=("MV-07", "MV-06"), sql=with_views("""
SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 8) AS accuracy,
       round(coalesce(tp / nullif(tp + fp, 0), 0.0E0), 8) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0.0E0), 8) AS recall
FROM (SELECT CAST(sum(CASE WHEN pd_score > 0.5E0 AND is_default THEN 1 ELSE 0 END) AS BIGINT) AS tp,
             CAST(sum(CASE WHEN pd_score > 0.5E0 AND NOT is_default THEN 1 ELSE 0 END) AS BIGINT) AS fp,
             CAST(sum(CASE WHEN pd_score <= 0.5E0 AND NOT is_default THEN 1 ELSE 0 END) AS BIGINT) AS tn,
             CAST(sum(CASE WHEN pd_score <= 0.5E0 AND is_default THEN 1 ELSE 0 END) AS BIGINT) AS fn
      FROM scored_book) c""", "scored_book"))
def classification_at_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = mv.confusion(scored_book(spark, sf_dir, validate=False), "pd_score", "is_default", F.lit(0.5), strict=True)
    return c.select("tp", "fp", "tn", "fn", _r("accuracy"), _r("precision"), _r("recall"))


@register("lgd_validation", ops=("MV-08",), sql=with_views("""
SELECT count(*) AS defaulted_samples, round(sqrt(avg((lgd_score - loss_given_default) ^ 2)), 8) AS rmse,
       round(avg(abs(lgd_score - loss_given_default)), 8) AS mae,
       round(1 - sum((lgd_score - loss_given_default) ^ 2) / (var_pop(loss_given_default) * count(*)), 8) AS r2,
       CAST(sum(CASE WHEN lgd_score < 0 OR lgd_score > 1 THEN 1 ELSE 0 END) AS BIGINT) AS out_of_range_predictions
FROM scored_book WHERE is_default""", "scored_book"))
def lgd_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mv.lgd_metrics(scored_book(spark, sf_dir, validate=False), "lgd_score", "loss_given_default", "is_default")
    return m.select("defaulted_samples", _r("rmse"), _r("mae"), _r("r2"), "out_of_range_predictions")


_EDGES = "(SELECT quantile_cont(pd_score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS edges FROM scored_book)"


_CALIBRATION_SQL = f"""
SELECT round(avg(abs(obs - exp)), 8) AS calibration_error
FROM (SELECT len(list_filter(e.edges[2:10], lambda x: x < pd_score)) AS bin,
             avg(CAST(is_default AS DOUBLE)) AS obs, avg(pd_score) AS exp
      FROM scored_book, {_EDGES} e GROUP BY 1) b"""


@register("calibration_error", ops=("MV-09",), sql=with_views(_CALIBRATION_SQL, "scored_book"))
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    err, _ = mv.calibration(scored_book(spark, sf_dir, validate=False), "pd_score", "is_default")
    return err.select(_r("calibration_error"))


@register("calibration_table", ops=("MV-10", "D-10"), sql=with_views(f"""
SELECT CAST(least(len(list_filter(e.edges, lambda x: x <= pd_score)), 10) AS INTEGER) AS bin, count(*) AS count,
       round(avg(CAST(is_default AS DOUBLE)), 8) AS observed_rate, round(avg(pd_score), 8) AS expected_rate,
       round(avg(CAST(is_default AS DOUBLE)) - avg(pd_score), 8) AS difference
FROM scored_book, {_EDGES} e GROUP BY 1""", "scored_book"))
def calibration_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, t = mv.calibration(scored_book(spark, sf_dir, validate=False), "pd_score", "is_default")
    return t.select("bin", "count", _r("observed_rate"), _r("expected_rate"), _r("difference"))


_RULES_SQL = """
WITH a AS (SELECT min(expected_loss) AS el_min, max(expected_loss) AS el_max,
                  avg(CASE WHEN (credit_score - 300) / 550.0E0 > 0.8E0 THEN pd_score END) AS pd_hi_score,
                  avg(CASE WHEN debt_to_income > 0.5E0 THEN pd_score END) AS pd_hi_dti,
                  avg(CASE WHEN NOT (debt_to_income > 0.5E0) OR debt_to_income IS NULL THEN pd_score END) AS pd_lo_dti
           FROM scored_book),
     m AS (SELECT bool_and(coalesce(mm >= prev, true)) AS mono
           FROM (SELECT mm, lag(mm) OVER (ORDER BY risk_rating) AS prev
                 FROM (SELECT risk_rating, avg(pd_score) AS mm FROM scored_book GROUP BY 1) r) x),
     v AS (SELECT list_filter([CASE WHEN pd_hi_score > 0.1E0 THEN printf('High credit score avg PD too high: %.2f%%', pd_hi_score * 100) END,
                               CASE WHEN NOT mono THEN 'Risk ratings not monotonic with PD' END,
                               CASE WHEN el_max > 1.0E0 OR el_min < 0 THEN printf('Expected loss out of range: [%.3f, %.3f]', el_min, el_max) END,
                               CASE WHEN pd_hi_dti IS NOT NULL AND pd_hi_dti <= pd_lo_dti THEN 'High DTI not showing higher risk' END],
                              lambda x: x IS NOT NULL) AS violations FROM a, m)
SELECT 4 AS total_rules_checked, violations, CAST(len(violations) AS INTEGER) AS violation_count,
       round((4 - len(violations)) / 4.0E0, 8) AS pass_rate, (4 - len(violations)) / 4.0E0 >= 0.95E0 AS pass
FROM v"""


@register("business_rules", ops=("MV-11",), sql=with_views(_RULES_SQL, "scored_book"))
def business_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_book(spark, sf_dir, validate=False)
    b = mv.business_rules(s)
    return b.select("total_rules_checked", "violations", "violation_count", _r("pass_rate"), "pass")


@register("pd_stability", ops=("MV-12",), sql=with_views("""
SELECT round(avg(pd_score), 8) AS mean, round(stddev_pop(pd_score), 8) AS std, min(pd_score) AS min,
       max(pd_score) AS max, CAST(sum(CASE WHEN pd_score = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros,
       CAST(sum(CASE WHEN pd_score = 1 THEN 1 ELSE 0 END) AS BIGINT) AS ones,
       CAST(sum(CASE WHEN isinf(pd_score) THEN 1 ELSE 0 END) AS BIGINT) AS inf_values,
       CAST(sum(CASE WHEN isnan(pd_score) THEN 1 ELSE 0 END) AS BIGINT) AS nan_values
FROM scored_book""", "scored_book"))
def pd_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = mv.stability_stats(scored_book(spark, sf_dir, validate=False))
    return s.select(_r("mean"), _r("std"), "min", "max", "zeros", "ones", "inf_values", "nan_values")


@register("perturbation_sensitivity", ops=("MV-13",))
def perturbation_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random noise: no SQL twin (rows-only check)."""
    from lendscope.operators import features as fe
    from lendscope.operators import scoring as sc
    from lendscope.sources.adapters import credit_applications

    def score(df):
        f = (df.withColumn("credit_score_normalized", fe.credit_score_normalized())
             .withColumn("loan_to_income_ratio", fe.loan_to_income_ratio())
             .withColumn("financial_stress_score", fe.financial_stress_score()))
        return sc.scorecard_scores(f)

    apps = credit_applications(spark, sf_dir).withColumn("credit_score", F.col("credit_score").cast("double"))
    return mv.perturbation_sensitivity(apps, "app_id", ["loan_amount", "income", "debt_to_income", "credit_score"],
                                       score)


@register("model_validation_verdict", ops=("MV-14", "MV-15"), sql=with_views(f"""
SELECT auc, auc >= 0.75E0 AS pd_pass, lgd_rmse, lgd_rmse <= 0.25E0 AND outside = 0 AS lgd_pass, calibration_error,
       calibration_error <= 0.05E0 AS calibration_pass, pass_rate AS business_rules_pass_rate, pass_rate >= 0.95E0 AS business_rules_pass,
       auc >= 0.75E0 AND lgd_rmse <= 0.25E0 AND outside = 0 AND calibration_error <= 0.05E0 AND pass_rate >= 0.95E0 AS overall_pass
FROM ({auc_sql(_BOOK_SRC)}) a,
     (SELECT round(sqrt(avg((lgd_score - loss_given_default) ^ 2)), 8) AS lgd_rmse,
             sum(CASE WHEN lgd_score < 0 OR lgd_score > 1 THEN 1 ELSE 0 END) AS outside FROM scored_book WHERE is_default) l,
     ({_CALIBRATION_SQL}) c, (SELECT pass_rate FROM ({_RULES_SQL}) q) r""", "scored_book"))
def model_validation_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_book(spark, sf_dir, validate=False)
    a = mv.auc(s, "pd_score", "is_default")
    lg = mv.lgd_metrics(s, "lgd_score", "loss_given_default", "is_default")
    err, _ = mv.calibration(s, "pd_score", "is_default")
    br = mv.business_rules(s)
    v = mv.overall_verdict(a, lg, err, br)
    return v.withColumns({c: F.round(c, 8) for c in ("auc", "lgd_rmse", "calibration_error", "business_rules_pass_rate")})
