"""Model registry tables: keyed upsert/delete, activation, promotion, comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REGISTRY_SCHEMA = ("model_name string, model_version string, model_type string, status string, "
                   "performance_metrics string, created_at timestamp_ntz, updated_at timestamp_ntz")
# metric -> True when higher is better (D-13)
METRIC_DIRECTION = {"pd_auc": True, "accuracy": True, "precision": True, "recall": True, "f1_score": True,
                    "lgd_rmse": False, "brier_score": False, "response_time_ms": False,
                    "expected_loss_mean": False}


def upsert(current: DataFrame, updates: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """SRC-14: last write per key wins.

    ``max_by`` over (order, arrival side) is a partial aggregate, so a key with
    many versions is combined map-side instead of being sorted in one task;
    on equal order values the update wins.
    """
    u = current.withColumn("_side", F.lit(0)).unionByName(
        updates.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in u.columns if c != "_side"]
    latest = u.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(F.col(order_col), F.col("_side"))).alias("_r"))
    return latest.select(*[F.col(f"_r.{c}").alias(c) for c in cols])


def delete_keys(current: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SRC-15: keyed delete as a left anti join."""
    return current.join(keys_df.select(*keys), list(keys), "left_anti")


def ensure_column(df: DataFrame, name: str, default) -> DataFrame:
    """SRC-17: additive migration; existing column -> NULLs get the default."""
    if name not in df.columns:
        return df.withColumn(name, F.lit(default))
    return df.withColumn(name, F.coalesce(F.col(name), F.lit(default)))


def activate(registry: DataFrame, model_name: str, version: str, as_of: Column) -> DataFrame:
    """ML-12: chosen version active, other versions of the model inactive."""
    same = F.col("model_name") == model_name
    status = F.when(same & (F.col("model_version") == version), "active").when(same, "inactive").otherwise(F.col("status"))
    return registry.withColumn("updated_at", F.when(same, as_of).otherwise(F.col("updated_at"))) \
        .withColumn("status", status)


def promote(registry: DataFrame, model_name: str, version: str, stage: str = "production") -> DataFrame:
    """ML-13: stage of one version."""
    hit = (F.col("model_name") == model_name) & (F.col("model_version") == version)
    return registry.withColumn("stage", F.when(hit, F.lit(stage)).otherwise(F.col("stage")))


def metrics_long(registry: DataFrame) -> DataFrame:
    """PRJ-18/19: JSON metrics -> (model_version, metric, value)."""
    m = F.from_json("performance_metrics", "map<string,double>")
    return registry.select("model_name", "model_version", F.explode(m).alias("metric", "value"))


def best_per_metric(long: DataFrame) -> DataFrame:
    """SRT-07: best version per metric (max, or min for lower-is-better, D-13);
    NULL values skipped; ties go to the first version in name order."""
    hi = F.col("metric").isin([k for k, v in METRIC_DIRECTION.items() if v]) | \
        ~F.col("metric").isin(list(METRIC_DIRECTION))
    signed = F.when(hi, F.col("value")).otherwise(-F.col("value"))
    x = long.where(F.col("value").isNotNull()).withColumn("_s", signed)
    return x.groupBy("metric").agg(
        F.min_by("model_version", F.struct(-F.col("_s"), F.col("model_version"))).alias("best_version"))


def recommendation(registry: DataFrame) -> DataFrame:
    """ML-14: continue with the first active version, else activate the newest."""
    return registry.agg(
        F.min(F.when(F.col("status") == "active", F.col("model_version"))).alias("_active"),
        F.max_by("model_version", F.struct("created_at", "model_version")).alias("_newest")).select(
        F.when(F.col("_active").isNotNull(), F.lit("continue_current")).otherwise(F.lit("activate_latest"))
        .alias("action"), F.coalesce("_active", "_newest").alias("model_version"))


# --- fixed values (must equal the reference for equal results) -------------
COMPARISON_METRICS = ["pd_auc", "lgd_rmse", "expected_loss_mean", "accuracy", "precision", "recall",
                      "f1_score", "brier_score", "response_time_ms"]


def check_comparison_request(versions, metrics) -> None:
    """VAL-09: 2..5 distinct versions; metric names from the known set (SET-03)."""
    distinct = list(dict.fromkeys(versions))
    if not 2 <= len(distinct) <= 5:
        raise ValueError("between 2 and 5 distinct model versions are required")
    invalid = sorted(set(metrics) - set(COMPARISON_METRICS))
    if invalid:
        raise ValueError(f"Invalid metrics: {invalid}")


def compare_versions(registry: DataFrame, stats: DataFrame, versions) -> tuple[DataFrame, DataFrame]:
    """JN-08 / MV-15: side-by-side rows for the requested versions (registry left
    join prediction stats) and the requested versions the registry lacks."""
    spark = registry.sparkSession
    req = spark.createDataFrame([(v,) for v in dict.fromkeys(versions)], "model_version string")
    rows = req.join(registry, "model_version", "inner").join(stats, "model_version", "left")
    missing = req.join(registry.select("model_version"), "model_version", "left_anti")
    return rows, missing


# --- fixed values (must equal the reference for equal results) -------------
SECTIONS = ["accuracy_metrics", "calibration_metrics", "business_metrics", "validation_results"]


def sections(metrics_json: Column) -> list[Column]:
    """PRJ-19: the four sections of a version's metrics JSON as maps; a missing section, or a missing or malformed JSON, is empty."""
    parsed = F.from_json(metrics_json, ", ".join(f"{s} map<string,double>" for s in SECTIONS))
    empty = F.create_map().cast("map<string,double>")
    return [F.coalesce(parsed[s], empty).alias(s) for s in SECTIONS]


def performance_record(registry: DataFrame, stats: DataFrame, versions: Sequence[str]) -> DataFrame:
    """PRJ-19 / JN-08: one row for each requested version, side by side; an unknown version has only its error.

    ``stats``: the prediction statistics of each version (AGG-11).  The requested versions are a short list
    of names, so the registry and the statistics are read with a filter and never shuffled whole."""
    names = list(dict.fromkeys(versions))
    asked = registry.sparkSession.createDataFrame([(i, v) for i, v in enumerate(names)], "position int, model_version string")
    known = registry.where(F.col("model_version").isin(names)).select(
        "model_version", "status", F.col("updated_at").alias("last_evaluated"), *sections(F.col("performance_metrics")))
    found = asked.join(F.broadcast(known), "model_version").join(
        stats.where(F.col("model_version").isin(names)), "model_version", "left").withColumn("error", F.lit(None).cast("string"))
    unknown = asked.join(known, "model_version", "left_anti").withColumn(
        "error", F.format_string("Model version %s not found", "model_version"))
    return found.unionByName(unknown, allowMissingColumns=True)


def active_model_info(registry: DataFrame, model_name: str, feature_names: Sequence[str]) -> DataFrame:
    """PRJ-18: the newest active version of a model with its feature count and its parsed metrics."""
    act = registry.where((F.col("model_name") == model_name) & (F.col("status") == "active"))
    row = act.agg(F.max_by(F.struct("model_version", "model_type", "performance_metrics", "created_at"),
                           F.struct("updated_at", "model_version")).alias("r")).where("r IS NOT NULL")
    return row.select(F.lit(model_name).alias("model_name"), "r.model_version", "r.model_type", F.lit(True).alias("is_loaded"),
                      F.lit(len(feature_names)).alias("feature_count"),
                      F.from_json("r.performance_metrics", "map<string,double>").alias("metrics"), "r.created_at")


def performance_history(metrics: DataFrame, names: Sequence[str], model_name: str, as_of: str, days: int = 30) -> DataFrame:
    """PRJ-07: model_name, model_version, metric_name, metric_value, timestamp of a model's last ``days`` days."""
    t, now = F.col("timestamp"), F.lit(as_of).cast("timestamp_ntz")
    rows = metrics.where((F.col("model_name") == model_name) & (t >= now - F.make_dt_interval(F.lit(days))) & (t <= now))
    pairs = F.array(*[F.struct(F.lit(n).alias("metric_name"), F.col(n).cast("double").alias("metric_value")) for n in names])
    return rows.select("model_name", "model_version", "timestamp", F.explode(pairs).alias("m")).select(
        "model_name", "model_version", "m.*", "timestamp").where(F.col("metric_value").isNotNull())


def filters(wanted: dict) -> Column:
    """PRJ-11: a list is IN, a pair a closed range (an open end is None), anything else equality; all must hold."""
    keep = F.lit(True)
    for name, v in wanted.items():
        if isinstance(v, tuple):
            low, high = v
            keep &= (F.lit(True) if low is None else F.col(name) >= low) & (F.lit(True) if high is None else F.col(name) <= high)
        else:
            keep &= F.col(name).isin(v) if isinstance(v, list) else F.col(name) == v
    return keep
