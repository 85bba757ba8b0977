"""Drift queries: all features of the book in one job, prediction and performance drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.functions.bands import edge_bin_sql
from lendscope.operators import drift as dr
from lendscope.operators import metrics as mv
from lendscope.plans.book import scored_book
from lendscope.plans.oracle_views import CAT_KEY, with_views
from lendscope.plans.registry import register
from lendscope.sources import adapters as ad

FLOAT_FEATURES = ["loan_amount", "interest_rate", "income", "debt_to_income"]


def _r(c, n=8):
    return F.round(F.col(c), n).alias(c)


def drift_sql(src: str, float_features: list[str]) -> str:
    """DuckDB twin of ``operators.drift.feature_drift`` (statistics, no p-values)."""
    floats = ", ".join(f"'{f}'" for f in float_features) or "''"
    eb = edge_bin_sql("value", "lo", "hi", 10)
    return f"""
WITH L AS ({src}),
prof AS (SELECT feature,
                CAST(sum(CASE WHEN sample = 'reference' THEN 1 ELSE 0 END) AS BIGINT) AS n_ref,
                CAST(sum(CASE WHEN sample = 'current' THEN 1 ELSE 0 END) AS BIGINT) AS n_cur,
                count(DISTINCT CASE WHEN sample = 'reference' THEN {CAT_KEY} END) AS distinct_ref,
                bool_or(category IS NOT NULL) AS is_cat
         FROM L WHERE {CAT_KEY} IS NOT NULL GROUP BY feature),
prof2 AS (SELECT *, (NOT is_cat) AND (distinct_ref > 20 OR feature IN ({floats})) AS continuous,
                 CASE WHEN n_ref < 100 OR n_cur < 100 THEN 'insufficient_data'
                      WHEN (NOT is_cat) AND (distinct_ref > 20 OR feature IN ({floats})) THEN 'ks_test'
                      ELSE 'chi_square' END AS test FROM prof),
cv AS (SELECT l.feature, value, sum(CASE WHEN sample = 'reference' THEN 1 ELSE 0 END) AS r,
              sum(CASE WHEN sample = 'current' THEN 1 ELSE 0 END) AS c
       FROM L l JOIN prof2 p ON l.feature = p.feature AND p.continuous
       WHERE value IS NOT NULL GROUP BY 1, 2),
ks AS (SELECT feature, max(abs(f1 - f2)) AS ks_statistic
       FROM (SELECT feature, sum(r) OVER w / sum(r) OVER (PARTITION BY feature) AS f1,
                    sum(c) OVER w / sum(c) OVER (PARTITION BY feature) AS f2
             FROM cv WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)) x
       GROUP BY feature),
cc AS (SELECT l.feature, {CAT_KEY} AS cat, sum(CASE WHEN sample = 'reference' THEN 1 ELSE 0 END) AS ref,
              sum(CASE WHEN sample = 'current' THEN 1 ELSE 0 END) AS cur
       FROM L l JOIN prof2 p ON l.feature = p.feature AND NOT p.continuous
       WHERE {CAT_KEY} IS NOT NULL GROUP BY 1, 2),
cct AS (SELECT cc.*, sum(ref) OVER (PARTITION BY feature) AS tr, sum(cur) OVER (PARTITION BY feature) AS tc,
               count(*) OVER (PARTITION BY feature) AS k FROM cc),
chi AS (SELECT feature, sum((cur - greatest(ref / tr * tc, 1e-10)) ^ 2 / greatest(ref / tr * tc, 1e-10)) AS chi2_statistic,
               CAST(max(k) - 1 AS BIGINT) AS degrees_of_freedom FROM cct GROUP BY feature),
fit AS (SELECT l.feature, min(value) AS lo, max(value) AS hi FROM L l JOIN prof2 p ON l.feature = p.feature AND p.continuous
        WHERE sample = 'reference' AND value IS NOT NULL GROUP BY 1),
bc AS (SELECT feature, bin, sum(CASE WHEN sample = 'reference' THEN 1 ELSE 0 END) AS ref,
              sum(CASE WHEN sample = 'current' THEN 1 ELSE 0 END) AS cur
       FROM (SELECT l.feature, sample, {eb} AS bin FROM L l JOIN fit f ON l.feature = f.feature
             WHERE value IS NOT NULL) b WHERE bin IS NOT NULL GROUP BY 1, 2),
counts AS (SELECT feature, ref, cur FROM bc UNION ALL SELECT feature, ref, cur FROM cc),
psi AS (SELECT feature, CASE WHEN min(tc) > 0 THEN sum((c - r) * ln(c / r)) END AS psi
        FROM (SELECT feature, tc, greatest(ref / tr, 1e-10) AS r,
                     greatest(CASE WHEN tc = 0 THEN NULL ELSE cur / tc END, 1e-10) AS c
              FROM (SELECT *, sum(ref) OVER (PARTITION BY feature) AS tr, sum(cur) OVER (PARTITION BY feature) AS tc
                    FROM counts) t) u GROUP BY feature)
SELECT p.feature, p.n_ref, p.n_cur, p.test,
       round(CASE WHEN p.test = 'ks_test' THEN ks.ks_statistic WHEN p.test = 'chi_square' THEN chi.chi2_statistic
                  ELSE 0.0E0 END, 8) AS test_statistic,
       round(psi.psi, 8) AS psi,
       CASE WHEN psi.psi < 0.1E0 THEN 'no_significant_change' WHEN psi.psi < 0.2E0 THEN 'moderate_change'
            ELSE 'significant_change' END AS psi_severity,
       CASE WHEN psi.psi IS NULL THEN 'insufficient_data' WHEN psi.psi < 0.1E0 THEN 'stable'
            WHEN psi.psi < 0.3E0 THEN 'minor_drift' WHEN psi.psi < 0.5E0 THEN 'moderate_drift' ELSE 'significant_drift' END AS status
FROM prof2 p LEFT JOIN ks ON p.feature = ks.feature LEFT JOIN chi ON p.feature = chi.feature
LEFT JOIN psi ON p.feature = psi.feature"""


def _stats_select(rep: DataFrame) -> DataFrame:
    return rep.select("feature", "n_ref", "n_cur", "test", _r("test_statistic"), _r("psi"), "psi_severity",
                      dr.drift_status(F.col("psi")).alias("status"))


@register("feature_drift_statistics", ops=("DR-01", "DR-02", "DR-03", "DR-04", "DR-05", "DR-06", "DR-07",
                                           "DR-09", "DR-13", "JN-03", "SET-01", "WIN-08"),
          sql=with_views(drift_sql("SELECT * FROM drift_samples", FLOAT_FEATURES), "drift_samples"))
def feature_drift_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rep = dr.feature_drift(ad.drift_samples(spark, sf_dir), FLOAT_FEATURES, with_p_values=False)
    return _stats_select(rep)


@register("feature_drift_report", ops=("DR-03", "DR-04", "DR-09", "DR-14"))
def feature_drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With p-values (Kolmogorov / chi-square tails): rows-only check."""
    rep = dr.feature_drift(ad.drift_samples(spark, sf_dir), FLOAT_FEATURES, with_p_values=True)
    st = dr.drift_status(F.col("psi"))
    return rep.select("feature", "drift_type", "test", _r("test_statistic"), _r("p_value"), "drift_detected",
                      _r("psi"), st.alias("status"), dr.recommendations(st).alias("recommendations"),
                      _r("reference_mean", 6), _r("current_mean", 6), _r("reference_std", 6), _r("current_std", 6))


@register("feature_drift_moments", ops=("DR-03", "DR-09", "DR-14"), sql=with_views(f"""
SELECT f.feature, 'feature_drift_' || f.feature AS drift_type, f.test, f.psi, f.status,
       CASE f.status WHEN 'stable' THEN ['Model performance is stable', 'Continue regular monitoring']
            WHEN 'moderate_drift' THEN ['Monitor closely and prepare for retraining', 'Analyze prediction accuracy trends']
            WHEN 'significant_drift' THEN ['Consider retraining model with recent data', 'Review feature importance and distributions']
            ELSE CAST([] AS VARCHAR[]) END AS recommendations,
       CASE WHEN f.test = 'ks_test' THEN m.rm END AS reference_mean, CASE WHEN f.test = 'ks_test' THEN m.cm END AS current_mean,
       CASE WHEN f.test = 'ks_test' THEN m.rs END AS reference_std, CASE WHEN f.test = 'ks_test' THEN m.cs END AS current_std
FROM ({drift_sql('SELECT * FROM drift_samples', FLOAT_FEATURES)}) f
JOIN (SELECT feature, round(avg(value) FILTER (WHERE sample = 'reference'), 6) AS rm,
             round(avg(value) FILTER (WHERE sample = 'current'), 6) AS cm,
             round(stddev_pop(value) FILTER (WHERE sample = 'reference'), 6) AS rs,
             round(stddev_pop(value) FILTER (WHERE sample = 'current'), 6) AS cs
      FROM drift_samples GROUP BY feature) m USING (feature)""", "drift_samples"))
def feature_drift_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drift report without p-values."""
    rep = dr.feature_drift(ad.drift_samples(spark, sf_dir), FLOAT_FEATURES, with_p_values=False)
    st = dr.drift_status(F.col("psi"))
    return rep.select("feature", "drift_type", "test", _r("psi"), st.alias("status"),
                      dr.recommendations(st).alias("recommendations"), _r("reference_mean", 6),
                      _r("current_mean", 6), _r("reference_std", 6), _r("current_std", 6))


_PRED_SRC = ("SELECT 'pd_score' AS feature, CASE WHEN application_ts < TIMESTAMP '1998-04-15 00:00:00' "
             "THEN 'reference' ELSE 'current' END AS sample, pd_score AS value, CAST(NULL AS VARCHAR) AS category "
             "FROM scored_book")


def _pred_long(spark, sf_dir):
    s = scored_book(spark, sf_dir, validate=False)
    return s.select(F.lit("pd_score").alias("feature"),
                    F.when(F.col("application_ts") < F.lit(ad.DRIFT_SPLIT_TS).cast("timestamp_ntz"), "reference")
                    .otherwise("current").alias("sample"),
                    F.col("pd_score").alias("value"), F.lit(None).cast("string").alias("category"))


@register("prediction_drift", ops=("DR-10", "DR-03", "DR-05"),
          sql=with_views(drift_sql(_PRED_SRC, ["pd_score"]), "scored_book"))
def prediction_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rep = dr.feature_drift(_pred_long(spark, sf_dir), ["pd_score"], with_p_values=False)
    return _stats_select(rep)


_EVENT_SRC = ("SELECT event_type AS feature, CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'reference' "
              "ELSE 'current' END AS sample, value, CAST(NULL AS VARCHAR) AS category FROM events")


@register("event_value_drift", ops=("DR-01", "DR-03", "DR-05", "DR-09"), sql=drift_sql(_EVENT_SRC, []))
def event_value_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendscope.sources.tables import Tables
    e = Tables(spark, sf_dir).events
    long = e.select(F.col("event_type").alias("feature"),
                    F.when(F.col("ts") < F.lit(ad.EVENTS_SPLIT_TS).cast("timestamp_ntz"), "reference")
                    .otherwise("current").alias("sample"), "value", F.lit(None).cast("string").alias("category"))
    return _stats_select(dr.feature_drift(long, [], with_p_values=False))


@register("performance_drift", ops=("DR-08", "DR-11", "MV-07"), sql=with_views("""
SELECT round(r.acc, 8) AS reference_accuracy, round(c.acc, 8) AS current_accuracy,
       abs(r.acc - c.acc) > 0.05E0 * r.acc AS drift_detected,
       round(CASE WHEN r.acc = 0 THEN 0.0E0 ELSE (c.acc - r.acc) / r.acc END, 8) AS relative_change
FROM (SELECT avg(CAST((pd_score > 0.5E0) = is_default AS DOUBLE)) AS acc FROM scored_book
      WHERE application_ts < TIMESTAMP '1998-04-15 00:00:00') r,
     (SELECT avg(CAST((pd_score > 0.5E0) = is_default AS DOUBLE)) AS acc FROM scored_book
      WHERE application_ts >= TIMESTAMP '1998-04-15 00:00:00') c""", "scored_book"))
def performance_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_book(spark, sf_dir, validate=False)
    ref = F.col("application_ts") < F.lit(ad.DRIFT_SPLIT_TS).cast("timestamp_ntz")
    s = s.withColumn("sample", F.when(ref, "reference").otherwise("current"))
    c = mv.confusion(s, "pd_score", "is_default", F.lit(0.5), strict=True, group_cols=["sample"])
    w = c.groupBy().pivot("sample", ["reference", "current"]).agg(F.first("accuracy"))
    w = w.select(F.col("reference").alias("reference_accuracy"), F.col("current").alias("current_accuracy"))
    pdr = dr.performance_drift(F.col("reference_accuracy"), F.col("current_accuracy"))
    return w.select(_r("reference_accuracy"), _r("current_accuracy"), pdr["drift_detected"].alias("drift_detected"),
                    F.round(pdr["relative_change"], 8).alias("relative_change"))


@register("drift_overview", ops=("DR-15", "DR-13"), sql=with_views(f"""
SELECT round(avg(psi), 8) AS overall_drift_score, round(max(psi), 8) AS max_feature_psi,
       (SELECT round(psi, 8) FROM ({drift_sql(_PRED_SRC, ['pd_score'])}) p) AS prediction_psi
FROM ({drift_sql('SELECT * FROM drift_samples', FLOAT_FEATURES)}) f""", "drift_samples", "scored_book"))
def drift_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = dr.feature_drift(ad.drift_samples(spark, sf_dir), FLOAT_FEATURES, with_p_values=False)
    p = dr.feature_drift(_pred_long(spark, sf_dir), ["pd_score"], with_p_values=False)
    a = f.agg(F.round(F.avg(F.round("psi", 8)), 8).alias("overall_drift_score"),
              F.round(F.max("psi"), 8).alias("max_feature_psi"))
    return a.crossJoin(p.select(F.round("psi", 8).alias("prediction_psi")))


@register("drift_alert_top3", ops=("DR-16", "SRT-05"), sql=with_views(f"""
SELECT round(max(psi), 8) AS max_score, list(feature ORDER BY psi DESC, feature)[1:3] AS top_features,
       CASE WHEN max(psi) > 0.2E0 THEN 'ALERT' ELSE 'OK' END AS status
FROM ({drift_sql('SELECT * FROM drift_samples', FLOAT_FEATURES)}) f WHERE psi IS NOT NULL""", "drift_samples"))
def drift_alert_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = dr.feature_drift(ad.drift_samples(spark, sf_dir), FLOAT_FEATURES, with_p_values=False)
    return dr.drift_alert_line(f, "psi", 0.2, 3).select(_r("max_score"), "top_features", "status")


def monthly_psi(spark: SparkSession, sf_dir: str, numbers: list[str] = FLOAT_FEATURES) -> DataFrame:
    """PSI of every month for the features ``numbers`` and all categorical ones."""
    apps = ad.credit_applications(spark, sf_dir).withColumn(
        "month", F.date_trunc("month", "application_ts").cast("timestamp_ntz"))
    sample = F.when(F.col("application_ts") < F.lit(ad.DRIFT_SPLIT_TS).cast("timestamp_ntz"), "reference") \
        .otherwise("current")
    base = apps.select(sample.alias("sample"), "month", *numbers, *ad.CATEGORICAL_FEATURES)
    cont = base.select("sample", "month", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                 F.lit(None).cast("string").alias("category")) for f in numbers] + [
        F.struct(F.lit(f).alias("feature"), F.lit(None).cast("double").alias("value"),
                 F.col(f).alias("category")) for f in ad.CATEGORICAL_FEATURES])).alias("kv")).select(
        "sample", "month", "kv.*")
    return dr.psi_history(cont, "month", float_features=FLOAT_FEATURES)


def _hist_src(numbers: list[str]) -> str:
    return " UNION ALL ".join(
        [f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS category, "
         f"date_trunc('month', application_ts) AS month, application_ts < TIMESTAMP '1998-04-15 00:00:00' AS is_ref "
         f"FROM credit_applications" for f in numbers]
        + [f"SELECT '{f}', CAST(NULL AS DOUBLE), {f}, date_trunc('month', application_ts), "
           f"application_ts < TIMESTAMP '1998-04-15 00:00:00' FROM credit_applications" for f in ad.CATEGORICAL_FEATURES])


# counts and PSI of the binned rows B
_HIST_PSI = """rc AS (SELECT feature, bin, count(*) AS ref FROM B WHERE is_ref AND bin IS NOT NULL GROUP BY 1, 2),
rt AS (SELECT feature, sum(ref) AS tr FROM rc GROUP BY 1),
cc AS (SELECT feature, month, bin, count(*) AS cur FROM B WHERE NOT is_ref AND bin IS NOT NULL GROUP BY 1, 2, 3),
ct AS (SELECT feature, month, sum(cur) AS tc FROM cc GROUP BY 1, 2),
grid AS (SELECT rc.feature, ct.month, rc.bin, rc.ref FROM rc JOIN ct ON rc.feature = ct.feature),
j AS (SELECT coalesce(g.feature, c.feature) AS feature, coalesce(g.month, c.month) AS month,
             coalesce(g.ref, 0) AS ref, coalesce(c.cur, 0) AS cur
      FROM grid g FULL OUTER JOIN cc c ON g.feature = c.feature AND g.month = c.month AND g.bin = c.bin),
psi AS (SELECT j.feature, j.month,
               sum((greatest(cur / tc, 1e-10) - greatest(ref / tr, 1e-10)) * ln(greatest(cur / tc, 1e-10) / greatest(ref / tr, 1e-10))) AS drift_score
        FROM j JOIN rt ON j.feature = rt.feature JOIN ct ON j.feature = ct.feature AND j.month = ct.month
        GROUP BY 1, 2)
"""

_HIST_SQL = f"""
WITH L AS ({_hist_src(FLOAT_FEATURES)}),
fit AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM L WHERE is_ref AND value IS NOT NULL GROUP BY 1),
B AS (SELECT L.feature, month, is_ref,
             coalesce(category, CAST({edge_bin_sql('value', 'lo', 'hi', 10)} AS VARCHAR)) AS bin
      FROM L LEFT JOIN fit ON L.feature = fit.feature),
""" + _HIST_PSI

# all numbers: those with few distinct reference values go by their values, as in drift_sql
_HIST_ALL_SQL = f"""
WITH L AS ({_hist_src(ad.CONTINUOUS_FEATURES)}),
fit AS (SELECT feature, min(value) AS lo, max(value) AS hi,
               count(DISTINCT value) > 20 OR feature IN ({", ".join(f"'{f}'" for f in FLOAT_FEATURES)}) AS continuous
        FROM L WHERE is_ref AND value IS NOT NULL GROUP BY feature),
B AS (SELECT L.feature, month, is_ref,
             coalesce(category, CASE WHEN continuous THEN CAST({edge_bin_sql('value', 'lo', 'hi', 10)} AS VARCHAR)
                                     WHEN NOT continuous THEN CAST(value AS VARCHAR) END) AS bin
      FROM L LEFT JOIN fit ON L.feature = fit.feature),
""" + _HIST_PSI


@register("drift_history", ops=("DR-09", "PRJ-10"), sql=with_views(_HIST_ALL_SQL + """
SELECT feature, month, 'feature_drift_' || feature AS drift_type, round(drift_score, 8) AS drift_score,
       drift_score > 0.2E0 AS drift_detected
FROM psi WHERE month >= TIMESTAMP '2000-01-01 00:00:00'""", "credit_applications"))
def drift_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly PSI of every feature since 2000 (history filter on the drift table)."""
    h = monthly_psi(spark, sf_dir, ad.CONTINUOUS_FEATURES)
    h = h.where(F.col("drift_type").contains("feature_drift") & (F.col("month") >= F.lit("2000-01-01 00:00:00")
                                                                 .cast("timestamp_ntz")))
    return h.select("feature", "month", "drift_type", F.round("drift_score", 8).alias("drift_score"), "drift_detected")


@register("drift_analysis", ops=("DR-12",), sql=with_views(_HIST_SQL + """
SELECT CAST(year(month) AS INTEGER) AS year, 'feature_drift_' || feature AS drift_type, count(*) AS detections,
       CAST(sum(CASE WHEN drift_score > 0.2E0 THEN 1 ELSE 0 END) AS BIGINT) AS drifted
FROM psi GROUP BY 1, 2""", "credit_applications"))
def drift_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of drift rows per year x drift type (no gap filling)."""
    h = monthly_psi(spark, sf_dir)
    return h.groupBy(F.year("month").alias("year"), "drift_type").agg(
        F.count(F.lit(1)).alias("detections"), F.sum(F.col("drift_detected").cast("long")).alias("drifted"))


@register("drift_detectors", ops=("UDF-01", "DR-03", "DR-05"), sql=with_views("""
WITH v AS (SELECT feature, value, sum(CAST(sample = 'reference' AS INT)) AS r, sum(CAST(sample = 'current' AS INT)) AS c
           FROM drift_samples WHERE value IS NOT NULL GROUP BY 1, 2),
f AS (SELECT feature, value, abs(sum(r) OVER w / sum(r) OVER (PARTITION BY feature) - sum(c) OVER w / sum(c) OVER (PARTITION BY feature)) AS gap,
             lead(value) OVER (PARTITION BY feature ORDER BY value) AS next
      FROM v WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING))
SELECT feature, 'wasserstein' AS detector, round(sum(gap * (coalesce(next, value) - value)), 6) AS drift_score FROM f GROUP BY 1
UNION ALL SELECT feature, 'ks_test', round(max(gap), 6) FROM f GROUP BY 1""", "drift_samples"))
def drift_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detectors picked by name from the registry, one of them the Wasserstein distance, over one value table."""
    out = dr.run_detectors(["wasserstein", "ks_test"], ad.drift_samples(spark, sf_dir).where("value IS NOT NULL"))
    return out.withColumn("drift_score", F.round("drift_score", 6))


_MODEL = "credit_risk_model"


@register("drift_store_history", ops=("SRC-13", "DR-12", "PRJ-10", "DR-09"), sql=with_views(_HIST_SQL + f""",
bounds AS (SELECT min(application_ts) AS rs, max(application_ts) AS re FROM credit_applications WHERE application_ts < TIMESTAMP '1998-04-15 00:00:00'),
months AS (SELECT date_trunc('month', application_ts) AS month, min(application_ts) AS ds, max(application_ts) AS de
           FROM credit_applications WHERE application_ts >= TIMESTAMP '1998-04-15 00:00:00' GROUP BY 1)
SELECT psi.month AS timestamp, '{_MODEL}' AS model_name, 'v1' AS model_version, 'feature_drift_' || feature AS drift_type,
       drift_score > 0.2E0 AS drift_detected, round(drift_score, 8) AS drift_score, 0.2E0 AS threshold_value,
       rs AS reference_start, re AS reference_end, ds AS detection_start, de AS detection_end
FROM psi JOIN months ON psi.month = months.month, bounds WHERE psi.month >= TIMESTAMP '2000-01-01 00:00:00'""",
                                                             "credit_applications"))
def drift_store_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly drift results with the periods of both samples go into the store, the last ones twice; history since 2000."""
    from lendscope.session import cut_lineage, run_dir
    from lendscope.sources.stores import DriftStore, with_periods
    apps = ad.credit_applications(spark, sf_dir).select(
        F.col("application_ts").alias("ts"), F.date_trunc("month", "application_ts").cast("timestamp_ntz").alias("month"),
        F.when(F.col("application_ts") < F.lit(ad.DRIFT_SPLIT_TS).cast("timestamp_ntz"), "reference").otherwise("current").alias("sample"))
    found = cut_lineage(with_periods(monthly_psi(spark, sf_dir), apps, "ts", "sample", ["month"]).select(
        F.col("month").alias("timestamp"), F.lit(_MODEL).alias("model_name"), F.lit("v1").alias("model_version"), "drift_type",
        "drift_detected", "drift_score", F.lit(0.2).alias("threshold_value"), "reference_start", "reference_end",
        "detection_start", "detection_end"))
    import uuid
    store = DriftStore(spark, f"{run_dir(spark)}/drift-store-{uuid.uuid4().hex[:8]}")
    store.write(found, "feature")
    store.write(found.where(F.col("timestamp") >= F.lit("2001-01-01").cast("timestamp_ntz")), "feature")     # a repeated check
    h = store.history("2000-01-01 00:00:00", model_name=_MODEL, drift_type="feature_drift")
    return h.select("timestamp", "model_name", "model_version", "drift_type", "drift_detected", F.round("drift_score", 8).alias("drift_score"),
                    "threshold_value", "reference_start", "reference_end", "detection_start", "detection_end")
