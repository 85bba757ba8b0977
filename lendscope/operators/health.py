"""Health scores and status roll-ups (MON-01 .. MON-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values (must equal the reference for equal results) -------------
HEALTH_A_DEDUCTIONS = [  # (column, factor of the shown value, threshold, points, issue)
    ("error_rate", 100.0, 0.05, 20, "High API error rate: %.2f%%"),
    ("avg_response_time", 1.0, 1.0, 15, "Slow API response time: %.2fs"),
    ("memory_usage", 1.0, 90.0, 25, "High memory usage: %.1f%%"),
    ("cpu_usage", 1.0, 80.0, 20, "High CPU usage: %.1f%%"),
    ("critical_alerts", 1, 0, 30, "Critical alerts active: %d"),
]
HEALTH_A_DRIFT_POINTS = 25
HEALTH_B_COMPONENTS = {
    "api_response_time": {"weight": 0.2, "target": 0.1, "critical": 1.0, "lower_is_better": True},
    "error_rate": {"weight": 0.25, "target": 0.01, "critical": 0.05, "lower_is_better": True},
    "cpu_usage": {"weight": 0.15, "target": 50, "critical": 90, "lower_is_better": True},
    "memory_usage": {"weight": 0.15, "target": 60, "critical": 85, "lower_is_better": True},
    "model_accuracy": {"weight": 0.25, "target": 0.85, "critical": 0.70, "lower_is_better": False},
}
HEALTH_C_DEDUCTIONS = [("cpu_usage", 80.0, 20, "High CPU usage"), ("memory_usage", 85.0, 20, "High memory usage")]
SLOW_MS, VERY_SLOW_MS, MEMORY_DELTA_MB = 1000.0, 5000.0, 500.0


def health_a(df: DataFrame, drift_col: str | None = None) -> DataFrame:
    """MON-01: 100 minus deductions; healthy >= 90, warning >= 70, else critical."""
    score = F.lit(100)
    issues = []
    for col, factor, thr, pts, text in HEALTH_A_DEDUCTIONS:
        hit = F.coalesce(F.col(col) > F.lit(thr), F.lit(False))
        score = score - F.when(hit, F.lit(pts)).otherwise(F.lit(0))
        shown = F.col(col) * F.lit(factor) if "f" in text else F.col(col).cast("long")
        issues.append(F.when(hit, F.format_string(text, shown)))
    if drift_col:
        hit = F.coalesce(F.col(drift_col), F.lit(False))
        score = score - F.when(hit, F.lit(HEALTH_A_DRIFT_POINTS)).otherwise(F.lit(0))
        issues.append(F.when(hit, F.lit("Performance drift detected")))
    status = F.when(score >= 90, "healthy").when(score >= 70, "warning").otherwise("critical")
    return df.select("*", F.greatest(score, F.lit(0)).alias("health_score"), status.alias("status"),
                     F.array_compact(F.array(*issues)).alias("issues"))


def _component(value: Column, cfg: dict) -> Column:
    t, c = float(cfg["target"]), float(cfg["critical"])
    if cfg["lower_is_better"]:
        return (F.when(value <= t, F.lit(100.0)).when(value >= c, F.lit(0.0))
                .otherwise(F.lit(100.0) * (F.lit(c) - value) / F.lit(c - t)))
    return (F.when(value >= t, F.lit(100.0)).when(value <= c, F.lit(0.0))
            .otherwise(F.lit(100.0) * (value - F.lit(c)) / F.lit(t - c)))


def health_b(df: DataFrame) -> DataFrame:
    """MON-02: weighted component scores, ``int`` of the sum, and an issue for each metric at or past its target; present metrics only."""
    total = F.lit(0.0)
    comps, issues = [], []
    for name, cfg in HEALTH_B_COMPONENTS.items():
        if name not in df.columns:
            continue
        s = F.when(F.col(name).isNotNull(), _component(F.col(name), cfg))
        comps.append(s.alias(f"{name}_score"))
        title, lower, v = name.replace("_", " ").title(), cfg["lower_is_better"], F.col(name)
        shown = F.bround(v.cast("double"), 2)          # ties go to the even digit
        bad = v >= cfg["critical"] if lower else v <= cfg["critical"]
        off = v >= cfg["target"] if lower else v <= cfg["target"]
        issues.append(F.when(bad, F.format_string(f"{title} is critical (%.2f)", shown))
                      .when(off, F.format_string(f"{title} is {'above' if lower else 'below'} target (%.2f)", shown)))
        total = total + F.coalesce(s, F.lit(0.0)) * F.lit(cfg["weight"])
    status = (F.when(total >= 90, "excellent").when(total >= 75, "good").when(total >= 60, "warning")
              .otherwise("critical"))
    return df.select("*", *comps, total.cast("int").alias("health_score"), status.alias("status"),
                     (F.array_compact(F.array(*issues)) if issues else F.array().cast("array<string>")).alias("issues"))


def health_c(df: DataFrame, api_up: Column, tables_present: Column) -> DataFrame:
    """MON-03: cpu > 80 -20, memory > 85 -20, API down -30, tables missing -25, with the issues and the status band."""
    score, issues = F.lit(100), []
    for col, thr, pts, text in HEALTH_C_DEDUCTIONS:
        hit = F.coalesce(F.col(col) > thr, F.lit(False))
        score = score - F.when(hit, F.lit(pts)).otherwise(F.lit(0))
        issues.append(F.when(hit, F.format_string(f"{text}: %.1f%%", F.col(col).cast("double"))))
    for up, pts, text in ((api_up, 30, "API server not running"), (tables_present, 25, "Database not initialized")):
        score = score - F.when(~up, F.lit(pts)).otherwise(F.lit(0))
        issues.append(F.when(~up, F.lit(text)))
    status = F.when(score >= 90, "healthy").when(score >= 70, "warning").otherwise("critical")
    return df.select("*", F.greatest(score, F.lit(0)).alias("health_score"), status.alias("status"),
                     F.array_compact(F.array(*issues)).alias("issues"))


def component_rollup(components: DataFrame, group_cols=(), status: str = "status") -> DataFrame:
    """MON-04: all healthy -> healthy; any unhealthy -> unhealthy; else degraded."""
    return components.groupBy(*group_cols).agg(
        F.when(F.bool_and(F.col(status) == "healthy"), "healthy")
        .when(F.bool_or(F.col(status) == "unhealthy"), "unhealthy").otherwise("degraded").alias("overall_status"))


def log_level(status_code: Column) -> Column:                      # MON-06
    return F.when(status_code >= 500, "error").when(status_code >= 400, "warning").otherwise("info")


def request_alerts(ms: Column, running_error_rate: Column, running_requests: Column,
                   memory_delta_mb: Column | None = None) -> Column:
    """MON-05: per-request performance alert labels."""
    items = [F.when(ms > VERY_SLOW_MS, F.lit("very_slow_request:high"))
             .when(ms > SLOW_MS, F.lit("slow_request:medium")),
             F.when((running_requests > 10) & (running_error_rate > 0.05), F.lit("high_error_rate:high"))]
    if memory_delta_mb is not None:
        items.append(F.when(memory_delta_mb > MEMORY_DELTA_MB, F.lit("high_memory_usage:medium")))
    return F.array_compact(F.array(*items))
