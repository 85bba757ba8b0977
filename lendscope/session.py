"""Session helpers.

Library code never creates its own session; it takes the caller's.  ``get_spark``
exists for tests, the bench and the command line only.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every operator assumes: UTC wall clock, ANSI arithmetic, AQE on.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # whole texts go to Python workers: several copies of a batch are in memory at once
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "lendscope") -> SparkSession:
    """Build (or reuse) a session for tests / bench / CLI use."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LENDSCOPE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    for k, v in SESSION_DEFAULTS.items():
        spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the cluster.

    Read from ``spark.checkpoint.dir``.  A scratch folder is made and registered
    only in a local session that names none (tests, the bench); on a cluster a
    missing setting is an error, because executors do not share local folders.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    try:
        sc = spark.sparkContext          # not available on Spark Connect
    except Exception as e:
        raise RuntimeError("spark.checkpoint.dir is not set for this session") from e
    current = sc.getCheckpointDir()
    if current:
        return current
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    d = tempfile.mkdtemp(prefix="lendscope-ckpt-", dir="/tmp")
    sc.setCheckpointDir(d)
    return d


# Folder of the tables this driver process writes; jobs that share the checkpoint folder have their own.
_RUN = f"run-{os.getpid()}-{uuid.uuid4().hex[:12]}"


def run_dir(spark: SparkSession) -> str:
    """This run's own sub-folder of the shared checkpoint folder."""
    return "/".join([checkpoint_dir(spark).rstrip("/"), "lendscope-tables", _RUN])


def cut_lineage(df, spark: SparkSession | None = None):
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and
    read it back: the lineage is cut, the data survives executor loss, and later
    passes get columnar, vectorised reads with column pruning and pushdown
    (much cheaper than re-reading serialised RDD checkpoint blocks)."""
    spark = spark or df.sparkSession
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lendscope_path = path
    return out


def materialize(df, columns=None):
    """Multi-pass operators (global order statistics, fits) read their input
    several times; a reliable checkpoint of the narrow projection they need
    replaces repeated evaluation of the upstream plan (joins, scans)."""
    if getattr(df, "_lendscope_materialized", False):
        return df.select(*columns) if columns else df
    narrow = df.select(*columns) if columns else df
    out = cut_lineage(narrow)
    out._lendscope_materialized = True
    return out


def _delete(spark: SparkSession, folder: str) -> bool:
    """Uses the Hadoop file system of the folder, so it works for any shared storage."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(path) and fs.delete(path, True))


def drop_materialized(spark: SparkSession) -> bool:
    """Remove the tables that this run wrote (never those of other runs).

    Call it when the results are written; they must not be read after this.
    """
    return _delete(spark, run_dir(spark))


def drop_tables(*tables) -> None:
    """Remove tables of ``cut_lineage`` / ``materialize`` that nothing reads any more.

    Only for steps of an operator whose own result is stored already; a frame that is not one of these
    tables itself (a selection of one, say) is left alone.  Spark removes the shuffle files of finished
    steps when the driver collects its garbage, which a driver with little to do may not do for long, so
    that is asked for here."""
    for t in tables:
        path = getattr(t, "_lendscope_path", None)
        if path:
            _delete(t.sparkSession, path)
    if tables:
        empty_exchanges(tables[0].sparkSession)


def empty_exchanges(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps whose results are stored."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def size_for_input(spark: SparkSession, input_bytes: int, target_partition_bytes: int = 256 * 1024 * 1024,
                   cores: int | None = None) -> dict:
    """Size scan splits and shuffle partitions from the input volume.

    Shuffle partitions ~ input / 256 MB (never below 2x the cores, so every core
    has work), scan splits of at most 256 MB and never fewer than the cores, and
    AQE's advisory size equal to the target so coalescing and skew splitting aim
    at partitions that fit comfortably in an executor's memory.  At 100 TB this
    gives ~400 000 shuffle partitions before AQE coalesces what is small.
    Returns the settings applied.
    """
    try:
        cores = cores or spark.sparkContext.defaultParallelism
    except Exception:
        cores = cores or 8
    shuffle = max(2 * cores, int(input_bytes // target_partition_bytes))
    split = max(1 << 20, min(target_partition_bytes, input_bytes // max(1, 2 * cores)))
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    return settings
