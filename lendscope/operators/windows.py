"""Window operators (WIN-02 .. WIN-06) that stay partitioned.

A window partitioned by a hot key runs in one task, so "newest N per key" is
computed in two stages: top-N inside (key, salt) sub-groups, then top-N over
at most ``salt x N`` survivors per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SALT = 64


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  tie_cols: Sequence[str] = (), salt: int | None = None, rank_col: str = "rn") -> DataFrame:
    """WIN-04/05, SRT-03/05/06: first ``n`` rows per key under ``order`` (+ unique tie-break).

    Stage 1 splits every key into ``salt`` sub-groups by a hash of the tie-break
    columns, so a key holding a third of all rows is spread over ``salt`` tasks;
    the row_number filter also lets Spark cut each group before the shuffle.
    Stage 2 ranks at most ``salt * n`` rows per key, whatever the cluster's size.
    With no keys, stage 2 is a single window over ``salt * n`` rows.
    """
    salt = salt or DEFAULT_SALT
    ordering = list(order) + [F.col(c) for c in tie_cols]
    # deterministic salt (a retried task must put every row in the same sub-group)
    hash_src = [F.col(c) for c in tie_cols] or [F.col(c) for c in df.columns]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*hash_src), F.lit(salt)))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*ordering)
    stage1 = salted.withColumn("_rn1", F.row_number().over(w1)).where(F.col("_rn1") <= n)
    w2 = Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(0)])).orderBy(*ordering)
    return (stage1.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= n)
            .drop("_salt", "_rn1"))


def period_change(df: DataFrame, keys: Sequence[str], period: str, value: str,
                  out: str = "change_pct") -> DataFrame:
    """WIN-03: (cur - prev) / prev * 100 per key ordered by period; prev = 0 -> NULL + 'New'."""
    w = Window.partitionBy(*keys).orderBy(period)
    prev = F.lag(value).over(w)
    return (df.withColumn("_prev", prev)
            .withColumn(out, F.try_divide((F.col(value) - F.col("_prev")) * F.lit(100.0), F.col("_prev")))
            .withColumn(out + "_label",
                        F.when(F.col("_prev").isNull(), F.lit(None))
                        .when(F.col("_prev") == 0, F.lit("New"))
                        .otherwise(F.format_string("%+.1f%%", F.col(out))))
            .drop("_prev"))


def sliding_count(df: DataFrame, key: str, ts: str, window_seconds: int, out: str = "window_count",
                  chunk_seconds: int | None = None) -> DataFrame:
    """WIN-06: requests of the same key with ``now - W <= t <= now`` (RANGE frame).

    Time is cut into chunks of ``C >= W`` seconds; every row is also copied into
    the next chunk as context, so all rows of a frame lie in (key, chunk).  The
    window is partitioned by (key, chunk): a hot key is spread over its chunks
    and each task holds at most two chunks of one key.
    """
    c = max(chunk_seconds or 3600, window_seconds)
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    base = df.withColumn("_t", t).withColumn("_chunk", F.floor(F.col("_t") / F.lit(c * 1_000_000)))
    both = base.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False)))) \
        .withColumn("_chunk", F.when(F.col("_own"), F.col("_chunk")).otherwise(F.col("_chunk") + 1))
    w = Window.partitionBy(key, "_chunk").orderBy("_t").rangeBetween(-window_seconds * 1_000_000, 0)
    counted = both.withColumn(out, F.count(F.lit(1)).over(w))
    return counted.where("_own").drop("_t", "_chunk", "_own")


def run_lengths(df: DataFrame, key: str, ts: str, violated: Column, tie: str,
                out: str = "consecutive_failures") -> DataFrame:
    """WIN-02 (pure form): length of the current run of violations per key.

    Reset-after-fire and cooldown need the state machine in
    ``lendscope.operators.alerts``; this is the windowed count without feedback.
    """
    w = Window.partitionBy(key).orderBy(ts, tie)
    run_id = F.sum(F.when(violated, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    tmp = df.withColumn("_viol", violated).withColumn("_run", run_id)
    w2 = Window.partitionBy(key, "_run").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    return (tmp.withColumn(out, F.when(F.col("_viol"), F.sum(F.col("_viol").cast("int")).over(w2))
                           .otherwise(F.lit(0)))
            .drop("_viol", "_run"))
