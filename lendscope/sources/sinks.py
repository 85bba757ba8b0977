"""Sinks: partitioned appends and reports (SRC-09, SRC-10, SRC-20).  Batches with quarantine and log, and drift
results, are kept by ``stores``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_predictions(scored: DataFrame, path: str) -> None:
    """SRC-09: structs JSON-encoded, partitioned by date."""
    out = scored.withColumn("prediction_result", F.to_json(F.struct("pd_score", "lgd_score", "expected_loss",
                                                                    "risk_rating", "decision"))) \
        .withColumn("date", F.to_date("timestamp"))
    out.write.mode("append").partitionBy("date").parquet(path)


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """SRC-10: one JSON document per snapshot date."""
    snapshot.withColumn("snapshot_date", F.to_date("data_timestamp")).write.mode("append") \
        .partitionBy("snapshot_date").json(path)


def validation_report_rows(verdict: DataFrame) -> DataFrame:
    """SRC-20: validation summary as (section, metric, value, verdict) rows."""
    cols = [c for c in verdict.columns if c != "overall_pass"]
    return verdict.select(F.explode(F.array(*[
        F.struct(F.lit("validation").alias("section"), F.lit(c).alias("metric"),
                 F.col(c).cast("string").alias("value"),
                 F.when(F.col("overall_pass"), "PASS").otherwise("FAIL").alias("verdict")) for c in cols]))
        .alias("r")).select("r.*")
