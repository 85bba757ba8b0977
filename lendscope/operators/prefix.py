"""Global order statistics without an un-partitioned window.

Average-tie ranks, empirical CDFs, exact quantiles, the Mann-Whitney AUC and
the two-sample KS statistic all need *cumulative* counts over a global order.
A window with an empty PARTITION BY would pull every row into one task, so the
work is split in three steps:

1. ``value_counts``: one row per distinct (group, value) with summed measures
   (map-side combined, so a value held by a third of all rows is one row).
2. Range buckets: ``repartitionByRange`` over (group, value) — Spark samples
   the bounds and places every distinct value by binary search — and the
   partition id is the bucket; ids increase with the value, so any bounds give
   the same exact answer (they only balance work).
3. A window partitioned by (group, bucket) adds the running sum inside the
   bucket; per-bucket totals (one row per (group, bucket)) give each bucket's
   offset.

Explicit broadcasts are used only for tables whose size is fixed (at most
``nb`` bucket offsets, the probability list); tables that grow with the number
of groups are joined by key and AQE decides at run time, from their measured
size, whether to broadcast them or shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKETS = 64
MIN_BUCKETS = 8
BUCKET_ROWS = 200_000     # distinct values a bucket: the sort and the windows of a task hold a few buckets, however many rows there are


def _n_buckets(df: DataFrame, n_buckets: int | None) -> int:
    if n_buckets:
        return n_buckets
    try:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover - conf always present
        parts = DEFAULT_BUCKETS
    return max(MIN_BUCKETS, parts)


def value_counts(df: DataFrame, value: str, group_cols: Sequence[str] = (),
                 measures: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per distinct non-null (group, value): ``cnt`` plus summed measures."""
    aggs = [F.count(F.lit(1)).alias("cnt")]
    for name, c in (measures or {}).items():
        aggs.append(F.sum(c).alias(name))
    return df.where(F.col(value).isNotNull()).groupBy(*group_cols, value).agg(*aggs)


def prefix_sums(vc: DataFrame, value: str, group_cols: Sequence[str] = (),
                measures: Sequence[str] = ("cnt",), n_buckets: int | None = None,
                keep_bucket: bool = False) -> DataFrame:
    """Add ``below_<m>`` = sum of measure ``m`` over values strictly below.

    ``vc`` must hold one row per (group, value) (see ``value_counts``).
    Also adds ``total_<m>`` = group total of the measure.

    Buckets are range partitions of (group, value).  The per-(group, bucket)
    offsets are joined by key and AQE decides; without groups they are at most
    ``nb`` rows and broadcast.
    """
    g = list(group_cols)
    from lendscope.session import cut_lineage
    # stored first, since the sampled bounds and the exchange read it once each
    vc = cut_lineage(vc)
    nb = n_buckets or max(_n_buckets(vc, None), -(-vc.count() // BUCKET_ROWS))
    # Range partitions over (group, value): Spark samples the bounds and places
    # each row by binary search (O(log nb) per row for any nb, so nb can follow
    # the cluster size); partition ids increase with (group, value), which is
    # all the running sums need.  Nothing proportional to the groups is broadcast.
    b = vc.repartitionByRange(nb, *[F.col(c) for c in g], F.col(value)) \
        .withColumn("_bucket", F.spark_partition_id())
    # The sampled bounds belong to one evaluation: every later use (running sums,
    # totals, position lookups) must see the same bucket ids, also after a task
    # retry, so the bucketed distinct values are written once.
    b = cut_lineage(b)

    # One exchange by (group, bucket): running sums inside the bucket and the
    # bucket totals come from the same window pass; the totals table (at most
    # groups x nb rows) is read back through the reused exchange.
    wrun = Window.partitionBy(*g, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(*g, "_bucket")
    # as many tasks as buckets: joined into larger ones, they would sort and hold many buckets at once
    w = b.repartition(nb, *g, "_bucket").select("*", *[F.coalesce(F.sum(m).over(wrun), F.lit(0)).alias(f"_in_{m}") for m in measures],
                 *[F.sum(m).over(wall).alias(f"_bt_{m}") for m in measures])
    tot = w.groupBy(*g, "_bucket").agg(*[F.first(f"_bt_{m}").alias(f"_bt_{m}") for m in measures])
    gpart = [F.col(c) for c in g] or [F.lit(0)]
    wb = Window.partitionBy(*gpart).orderBy("_bucket")
    off = tot.select(
        *g, "_bucket",
        *[F.coalesce(F.sum(f"_bt_{m}").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
          .alias(f"_off_{m}") for m in measures],
        *[F.sum(f"_bt_{m}").over(Window.partitionBy(*gpart)).alias(f"total_{m}") for m in measures],
    )
    off_side = F.broadcast(off) if not g else off   # no groups: at most nb rows
    out = w.drop(*[f"_bt_{m}" for m in measures]).join(off_side, [*g, "_bucket"])
    for m in measures:
        out = out.withColumn(f"below_{m}", F.col(f"_off_{m}") + F.col(f"_in_{m}"))
    out = out.drop(*[f"_off_{m}" for m in measures], *[f"_in_{m}" for m in measures])
    return out if keep_bucket else out.drop("_bucket")


def average_rank_table(df: DataFrame, value: str, group_cols: Sequence[str] = (),
                       n_buckets: int | None = None) -> DataFrame:
    """(group, value, cnt, avg_rank, pct_rank) with pandas ``rank(pct=True)`` ties."""
    vc = value_counts(df, value, group_cols)
    ps = prefix_sums(vc, value, group_cols, ("cnt",), n_buckets)
    avg_rank = F.col("below_cnt") + (F.col("cnt") + F.lit(1)) / F.lit(2.0)
    return ps.select(*group_cols, value, "cnt", avg_rank.alias("avg_rank"),
                     (avg_rank / F.col("total_cnt")).alias("pct_rank"), "below_cnt", "total_cnt")


def with_percentile_rank(df: DataFrame, value: str, out_col: str,
                         group_cols: Sequence[str] = ()) -> DataFrame:
    """WIN-01 / FE-10: attach the average-tie percentile rank of ``value``.

    The rank table has one row per distinct value; joining it back is an
    equi-join on the value (AQE splits a hot value on the large side).
    """
    table = average_rank_table(df, value, group_cols).select(
        *group_cols, value, F.col("pct_rank").alias(out_col))
    return df.join(table, [*group_cols, value], "left")


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    group_cols: Sequence[str] = (), n_buckets: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (= ``percentile`` / ``quantile_cont``).

    Returns one row per (group, p) with column ``q``.  The two order positions
    each quantile needs are first located in a (group, bucket) range table and
    then read with an equi-join on (group, bucket), so no task ever holds more
    than one bucket of distinct values, hot groups included.
    """
    g = list(group_cols)
    from lendscope.session import materialize   # multi-pass: read the narrow input once
    vc = value_counts(materialize(df, [*g, value]), value, g)
    ps = prefix_sums(vc, value, g, ("cnt",), n_buckets, keep_bucket=True)
    spark = df.sparkSession
    probs_df = spark.createDataFrame([(float(p),) for p in probs], "p double")
    ranges = ps.groupBy(*g, "_bucket").agg(F.min("below_cnt").alias("_lo"),
                                           F.max(F.col("below_cnt") + F.col("cnt")).alias("_hi"),
                                           F.max("total_cnt").alias("n"))
    totals = ranges.groupBy(*g).agg(F.max("n").alias("n"))
    pos = (F.col("n") - 1) * F.col("p")
    targets = (totals.crossJoin(F.broadcast(probs_df))
               .select(*g, "p", F.floor(pos).cast("long").alias("lo_i"),
                       F.ceil(pos).cast("long").alias("hi_i"),
                       (pos - F.floor(pos)).alias("frac")))
    want = (targets.select(*g, "p", F.col("lo_i").alias("i"), F.lit("lo").alias("side"))
            .unionByName(targets.select(*g, "p", F.col("hi_i").alias("i"), F.lit("hi").alias("side"))))
    rng = ranges.select(*[F.col(c).alias(f"_w_{c}") for c in g], "_bucket", "_lo", "_hi")
    cond = (F.col("_lo") <= F.col("i")) & (F.col("i") < F.col("_hi"))
    for c in g:
        cond = cond & (F.col(c) == F.col(f"_w_{c}"))
    rng_side = F.broadcast(rng) if not g else rng
    located = want.join(rng_side, cond).select(*g, "p", "i", "side", "_bucket")
    loc = located.select(*[F.col(c).alias(f"_w_{c}") for c in g], "p", "i", "side",
                         F.col("_bucket").alias("_wb"))
    cond2 = (F.col("_bucket") == F.col("_wb")) & (F.col("below_cnt") <= F.col("i")) & \
        (F.col("i") < F.col("below_cnt") + F.col("cnt"))
    for c in g:
        cond2 = cond2 & (F.col(c) == F.col(f"_w_{c}"))
    loc_side = F.broadcast(loc) if not g else loc
    hit = ps.join(loc_side, cond2).select(*g, "p", "side", F.col(value).cast("double").alias("v"))
    pv = hit.groupBy(*g, "p").agg(
        F.max(F.when(F.col("side") == "lo", F.col("v"))).alias("v_lo"),
        F.max(F.when(F.col("side") == "hi", F.col("v"))).alias("v_hi"))
    out = pv.join(targets.select(*g, "p", "frac"), [*g, "p"])
    return out.select(*g, "p", (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("frac")).alias("q"))


def quantile_row(df: DataFrame, value: str, probs: Sequence[float],
                 group_cols: Sequence[str] = (), name: str = "edges") -> DataFrame:
    """Exact quantiles folded into one array column per group (probs order)."""
    q = exact_quantiles(df, value, probs, group_cols)
    return q.groupBy(*group_cols).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p", "q"))), lambda s: s["q"]).alias(name))


def asof_rank(df: DataFrame, value: str, out_col: str, fit: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """Place ``value`` in a *stored* distribution (D-08: scoring uses the training fit).

    ``fit`` is an ``average_rank_table`` of the training data.  A value found in
    the fit gets its training percentile rank; any other value gets the share of
    training values below it.  Both sides are cut by one set of split points
    from the fit; inside a bucket an ordered window carries the last fitted
    value forward, and buckets without an earlier fitted value take the share
    of all lower buckets.  Scoring values are de-duplicated first, so a hot value
    is one row, and the result is joined back on the value.
    """
    nb = _n_buckets(fit, n_buckets)
    f = fit.select(F.col(value).cast("double").alias("_v"), "pct_rank",
                   ((F.col("below_cnt") + F.col("cnt")) / F.col("total_cnt")).alias("_le"))
    xs = df.select(F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull()).distinct()
    u = (f.select("_v", F.lit(1).alias("_fit"), F.struct("_v", "pct_rank", "_le").alias("_f"))
         .unionByName(xs.select("_v", F.lit(0).alias("_fit"),
                                F.lit(None).cast("struct<_v:double,pct_rank:double,_le:double>").alias("_f"))))
    # one range partitioning for fitted and scoring values: ids increase with the value
    u = u.repartitionByRange(nb, "_v").withColumn("_b", F.spark_partition_id())
    from lendscope.session import cut_lineage
    u = cut_lineage(u)   # fixed bucket ids for both uses below
    # share of training values at or below the last fitted value of every lower bucket
    # (a table of at most nb rows)
    per_b = u.groupBy("_b").agg(F.max_by(F.when(F.col("_fit") == 1, F.col("_f._le")),
                                         F.when(F.col("_fit") == 1, F.col("_v"))).alias("_last_le"))
    prev = per_b.select("_b", F.coalesce(F.max("_last_le").over(
        Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        .alias("_prev_le"))
    w = Window.partitionBy("_b").orderBy(F.col("_v"), F.col("_fit").desc()).rowsBetween(Window.unboundedPreceding, 0)
    carried = u.withColumn("_lf", F.last("_f", ignorenulls=True).over(w)).where(F.col("_fit") == 0)
    carried = carried.join(F.broadcast(prev), "_b", "left")
    pct = (F.when(F.col("_lf").isNull(), F.coalesce(F.col("_prev_le"), F.lit(0.0)))
           .when(F.col("_lf._v") == F.col("_v"), F.col("_lf.pct_rank"))
           .otherwise(F.col("_lf._le")))
    table = carried.select(F.col("_v").alias("_key"), pct.alias(out_col))
    return df.join(table, F.col(value).cast("double") == F.col("_key"), "left").drop("_key")
