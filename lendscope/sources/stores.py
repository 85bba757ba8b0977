"""Stores that are appended to in steps: application batches with quarantine and log, and drift results.

Folders on storage that driver and executors share; every step may be repeated after a lost executor
or driver without doubling rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendscope.operators import quality as vq

LOG_SCHEMA = ("timestamp timestamp, batch string, attempt string, data_type string, source string, status string, "
              "record_count long, rejected_count long, error_message string, details string")


class BatchStore:
    """SRC-08 / SRC-11: validated appends with quarantine, committed by the ingestion log.

    1. *Stage*: one pass validates the rows and writes them, good and bad, to
       ``data/batch=.../attempt=.../is_valid=...``.  Nothing refers to them yet.
    2. *Commit*: one log row for each batch is written.  A batch counts only once its row is there.

    Readers take, for each batch, the rows of its first committed attempt.  So a killed attempt leaves
    nothing to be seen, a repeated batch adds nothing, and two attempts that both commit count once.
    A failed attempt logs its error and the batch can be tried again."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.columns = [f.name for f in self.schema.fields]
        full = T.StructType([*[T.StructField(f.name, f.dataType) for f in self.schema.fields],
                             T.StructField("errors", T.ArrayType(T.StringType())), T.StructField("batch", T.StringType()),
                             T.StructField("attempt", T.StringType()), T.StructField("is_valid", T.BooleanType())])
        self.full = full
        spark.createDataFrame([], full).coalesce(1).write.mode("append").parquet(f"{self.path}/data")
        spark.createDataFrame([], LOG_SCHEMA).coalesce(1).write.mode("append").json(f"{self.path}/log")

    # a letter before the value, so that no partition folder reads as a number
    @staticmethod
    def _folder(c: Column) -> Column:
        return F.concat(F.lit("_"), c.cast("string"))

    def _all(self) -> DataFrame:
        rows = self.spark.read.schema(self.full).parquet(f"{self.path}/data")
        return rows.withColumns({c: F.substr(c, F.lit(2)) for c in ("batch", "attempt")})

    def log(self, limit: int | None = None) -> DataFrame:
        """SRC-11: one row for each batch and attempt, newest first; ``limit`` for the report of the newest."""
        rows = self.spark.read.schema(LOG_SCHEMA).json(f"{self.path}/log")
        return rows.orderBy(F.desc("timestamp"), F.desc("batch"), "attempt").limit(limit) if limit else rows

    def committed(self) -> DataFrame:
        """batch, attempt: the attempt that counts for each batch."""
        return self.log().where("status <> 'failed'").groupBy("batch").agg(
            F.min_by("attempt", F.struct("timestamp", "attempt")).alias("attempt"))

    def rows(self, valid: bool = True) -> DataFrame:
        """The committed rows: valid ones, or the quarantine with ``errors``; with their batch."""
        chosen = self._all().where(F.col("is_valid") == valid).join(self.committed(), ["batch", "attempt"], "left_semi")
        return chosen.drop("attempt", "is_valid") if not valid else chosen.drop("attempt", "is_valid", "errors")

    def quarantine(self) -> DataFrame:
        return self.rows(valid=False)

    def stage(self, df: DataFrame, batch: Column, rules: Sequence[vq.Rule] | None = None) -> str:
        """Validate and write the rows of batches that are not committed; the attempt's name."""
        attempt = uuid.uuid4().hex
        v = vq.apply_rules(df.withColumn("batch", batch.cast("string")), rules or vq.application_rules())
        new = v.join(self.committed(), "batch", "left_anti")
        new.select(*self.columns, "errors", self._folder(F.col("batch")).alias("batch"),
                   self._folder(F.lit(attempt)).alias("attempt"), "is_valid").write.mode("append").partitionBy(
            "batch", "attempt", "is_valid").parquet(f"{self.path}/data")
        return attempt

    def commit(self, attempt: str, data_type: str, source: str) -> None:
        """Log the staged batches of an attempt: success, partial (some rows rejected) or error (all rejected)."""
        counts = self._all().where(F.col("attempt") == attempt).groupBy("batch", "attempt").agg(
            F.count_if("is_valid").alias("record_count"), F.count_if(~F.col("is_valid")).alias("rejected_count"))
        status = (F.when(F.col("rejected_count") == 0, "success").when(F.col("record_count") > 0, "partial").otherwise("error"))
        self._log(counts.select("*", status.alias("status"), F.when(F.col("rejected_count") > 0, F.format_string(
            "%d rows in quarantine", "rejected_count")).alias("error_message")), data_type, source)

    def _log(self, rows: DataFrame, data_type: str, source: str) -> None:
        details = F.to_json(F.struct("batch", "attempt", "record_count", "rejected_count"))
        rows.select(F.current_timestamp().alias("timestamp"), "batch", "attempt", F.lit(data_type).alias("data_type"),
                    F.lit(source).alias("source"), "status", "record_count", "rejected_count", "error_message",
                    details.alias("details")).coalesce(1).write.mode("append").json(f"{self.path}/log")   # one file: all or nothing

    def append(self, df: DataFrame, batch: Column, data_type: str = "credit", source: str = "file",
               rules: Sequence[vq.Rule] | None = None) -> None:
        """Stage and commit; an error is logged and raised."""
        try:
            self.commit(self.stage(df, batch, rules), data_type, source)
        except Exception as e:
            message = f"{type(e).__name__}: {e}"[:500]
            self._log(self.spark.createDataFrame([(None, uuid.uuid4().hex, 0, 0, "failed", message)],
                                                 "batch string, attempt string, record_count long, rejected_count long, status string, "
                                                 "error_message string"), data_type, source)
            raise

    def summary(self) -> DataFrame:
        """AGG-20: latest status, records, batches and failed attempts of each source."""
        counted = self.log().join(self.committed().withColumn("counts", F.lit(True)), ["batch", "attempt"], "left")
        return counted.groupBy("data_type", "source").agg(
            F.max_by("status", F.struct("timestamp", "batch", "attempt")).alias("latest_status"),
            F.coalesce(F.sum(F.when(F.col("counts"), F.col("record_count"))), F.lit(0)).alias("records"),
            F.coalesce(F.sum(F.when(F.col("counts"), F.col("rejected_count"))), F.lit(0)).alias("rejected"),
            F.count_if("counts").alias("batches"), F.count_if(F.col("status") == "failed").alias("failures"))


class DriftStore:
    """SRC-13 / DR-12: drift results by day, model and kind of drift.

    A check writes the partitions of its own days, models and kinds and replaces what an earlier run of
    the same check wrote there, so a repeated check leaves each result once.  History reads prune by
    day and model before any row is read."""

    SCHEMA = ("timestamp timestamp_ntz, model_version string, drift_type string, drift_detected boolean, drift_score double, "
              "p_value double, threshold_value double, test_statistic double, reference_start timestamp_ntz, "
              "reference_end timestamp_ntz, detection_start timestamp_ntz, detection_end timestamp_ntz, metadata string, "
              "day date, model_name string, kind string")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.schema = T._parse_datatype_string(self.SCHEMA)
        spark.createDataFrame([], self.schema).coalesce(1).write.mode("append").parquet(path)

    def write(self, results: DataFrame, kind: str) -> None:
        """``results``: columns of SCHEMA (absent ones are null) without day and kind."""
        rows = results.withColumns({"day": F.to_date("timestamp"), "kind": F.lit(kind)})
        columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]
        rows.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "day", "model_name", "kind").parquet(self.path)

    def history(self, since: str, until: str | None = None, model_name: str | None = None, drift_type: str | None = None) -> DataFrame:
        """Results from ``since`` on (to ``until``, exclusive), newest first when ordered by the caller."""
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        keep = (F.col("day") >= F.to_date(F.lit(since))) & (F.col("timestamp") >= F.lit(since).cast("timestamp_ntz"))
        if until is not None:
            keep &= (F.col("day") <= F.to_date(F.lit(until))) & (F.col("timestamp") < F.lit(until).cast("timestamp_ntz"))
        if model_name is not None:
            keep &= F.col("model_name") == model_name
        if drift_type is not None:
            keep &= F.col("drift_type").contains(drift_type)
        return rows.where(keep)


def with_periods(results: DataFrame, samples: DataFrame, ts: str, sample: str, by: Sequence[str] = ()) -> DataFrame:
    """Bounds of the reference sample (of all rows) and of the current sample (of each ``by``)."""
    reference = samples.where(F.col(sample) == "reference").agg(F.min(ts).alias("reference_start"), F.max(ts).alias("reference_end"))
    current = samples.where(F.col(sample) == "current").groupBy(*by).agg(F.min(ts).alias("detection_start"), F.max(ts).alias("detection_end"))
    joined = results.join(current, list(by), "left") if by else results.crossJoin(F.broadcast(current))
    return joined.crossJoin(F.broadcast(reference))       # one row
