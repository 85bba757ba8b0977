"""Monitoring and portfolio roll-ups (AGG-01 .. AGG-26).

All measures of one table share one ``agg`` (one scan, partial aggregation
before the shuffle).  Exact percentiles go through ``prefix.exact_quantiles``
so no single task holds a whole group's values; ``accuracy=`` switches to the
bounded ``percentile_approx`` sketch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.functions.bands import equal_width_bin
from lendscope.operators.prefix import exact_quantiles
from lendscope.operators.windows import top_n_per_key


def as_ts(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("timestamp_ntz")


def within(ts: str, as_of, seconds: int, strict: bool = True) -> Column:
    """PRJ-06: rows inside the look-back window ending at ``as_of``."""
    lo = as_ts(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    cond = (F.col(ts) > lo) if strict else (F.col(ts) >= lo)
    return cond & (F.col(ts) <= as_ts(as_of))


def quantile_columns(df: DataFrame, value: str, probs: Sequence[float], group_cols: Sequence[str],
                     names: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """Wide (group, name_1, name_2, ...) table of linear-interpolated quantiles."""
    g = list(group_cols)
    if accuracy:
        agg = df.groupBy(*g).agg(F.percentile_approx(value, list(probs), accuracy).alias("_q"))
        return agg.select(*g, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    q = exact_quantiles(df, value, probs, g)
    return q.groupBy(*g).agg(*[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(n)
                              for p, n in zip(probs, names)])


def api_summary(api: DataFrame, as_of, minutes: int = 5, group_cols: Sequence[str] = (),
                accuracy: int | None = None) -> DataFrame:
    """AGG-01: count, mean, p95, p99, error rate, requests/min over the last ``minutes``."""
    recent = api.where(within("ts", as_of, minutes * 60))
    g = list(group_cols)
    base = recent.groupBy(*g).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.avg("response_time").alias("avg_response_time"),
        F.avg((F.col("status_code") >= 400).cast("double")).alias("error_rate"))
    q = quantile_columns(recent, "response_time", [0.95, 0.99], g,
                         ["p95_response_time", "p99_response_time"], accuracy)
    out = base.join(q, g, "left") if g else base.crossJoin(q)
    return out.select(*g, "total_requests",
                      F.coalesce("avg_response_time", F.lit(0.0)).alias("avg_response_time"),
                      F.coalesce("p95_response_time", F.lit(0.0)).alias("p95_response_time"),
                      F.coalesce("p99_response_time", F.lit(0.0)).alias("p99_response_time"),
                      F.coalesce("error_rate", F.lit(0.0)).alias("error_rate"),
                      (F.col("total_requests") / F.lit(float(minutes))).alias("requests_per_minute"))


def model_summary(metrics: DataFrame, as_of, minutes: int = 60) -> DataFrame:
    """AGG-02 over a model-metrics table (prediction_count, accuracy, avg_prediction_time,
    high_risk_predictions)."""
    recent = metrics.where(within("timestamp", as_of, minutes * 60))
    return recent.agg(
        F.coalesce(F.sum("prediction_count"), F.lit(0)).cast("long").alias("total_predictions"),
        F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("avg_accuracy"),
        F.coalesce(F.avg(F.when(F.col("avg_prediction_time") > 0, F.col("avg_prediction_time"))), F.lit(0.0))
        .alias("avg_prediction_time"),
        (F.coalesce(F.sum("high_risk_predictions"), F.lit(0))
         / F.greatest(F.coalesce(F.sum("prediction_count"), F.lit(0)), F.lit(1))).cast("double")
        .alias("high_risk_rate"))


CALENDAR = 10_000        # bins of one piece of a calendar


def gap_fill(binned: DataFrame, bin_col: str, step_seconds: int, fill: dict | None = None,
             group_cols: Sequence[str] = ()) -> DataFrame:
    """JN-09: calendar of every bin between the first and last one, left-joined.

    The calendar comes from the (min, max) row in pieces of CALENDAR bins that are dealt out to tasks
    before they are unfolded, so a wrong date far away makes many small rows and no large one.
    """
    g = list(group_cols)
    bounds = binned.groupBy(*g).agg(F.min(bin_col).alias("_lo"), F.max(bin_col).alias("_hi"))

    def seconds(n: int) -> Column:
        return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n))

    pieces = bounds.select(*g, "_hi", F.explode(F.sequence("_lo", "_hi", seconds(step_seconds * CALENDAR))).alias("_from"))
    last = F.least(F.col("_from") + seconds(step_seconds * (CALENDAR - 1)), "_hi")
    cal = pieces.repartition(*g, "_from").select(*g, F.explode(F.sequence("_from", last, seconds(step_seconds))).alias(bin_col))
    out = cal.join(binned, [*g, bin_col], "left")
    return out.fillna(fill) if fill else out


def api_timeseries(api: DataFrame, bin_seconds: int = 300, fill_gaps: bool = True) -> DataFrame:
    """AGG-03 / ST-01 batch twin: mean & p95 response, error rate and count per bin."""
    b = api.withColumn("bin", F.timestamp_seconds(
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(bin_seconds * 1_000_000)) * bin_seconds)
        .cast("timestamp_ntz"))
    agg = b.groupBy("bin").agg(F.count(F.lit(1)).alias("requests"),
                               F.avg("response_time").alias("avg_response_time"),
                               F.avg((F.col("status_code") >= 400).cast("double")).alias("error_rate"))
    # one group per time bin: the group count grows with the time span
    p95 = quantile_columns(b, "response_time", [0.95], ["bin"], ["p95_response_time"])
    out = agg.join(p95, "bin", "left")
    if fill_gaps:
        out = gap_fill(out, "bin", bin_seconds, {"requests": 0})
    return out


def fixed_histogram(df: DataFrame, value: str, bins: int = 10, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """AGG-07: equal bins on [lo, hi], last bin closed, out-of-range dropped, all bins emitted."""
    b = df.select(equal_width_bin(F.col(value), lo, hi, bins).alias("bin")).where("bin IS NOT NULL")
    counts = b.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    allb = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    width = (hi - lo) / bins
    return (allb.join(counts, "bin", "left").fillna({"count": 0})
            .select("bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("bin_start"),
                    (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_end"), "count"))


def range_histogram(df: DataFrame, value: str, bins: int = 20, fit: DataFrame | None = None,
                    group_cols: Sequence[str] = ()) -> DataFrame:
    """AGG-08 / AGG-26: ``bins`` equal-width bins over the (fitted) min..max range."""
    g = list(group_cols)
    fit = fit if fit is not None else df.groupBy(*g).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    j = df.join(fit, g) if g else df.crossJoin(F.broadcast(fit))
    b = j.select(*g, equal_width_bin(F.col(value), F.col("lo"), F.col("hi"), bins).alias("bin"))
    return b.where("bin IS NOT NULL").groupBy(*g, "bin").agg(F.count(F.lit(1)).alias("count"))


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """AGG-18: newest row per key via ``max_by(struct, (ts, tie))`` (partial aggregation)."""
    cols = [c for c in df.columns]
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(F.col(ts), F.col(tie))).alias("_r"))
    return packed.select(*[F.col(f"_r.{c}").alias(c) for c in cols])


def nearest_rank(sorted_values: Column, n: Column, p: float) -> Column:
    """AGG-16 percentile: ``sorted[min(int(p/100*n), n-1)]`` (0-based)."""
    idx = F.least(F.floor(F.lit(p / 100.0) * n).cast("int"), (n - 1).cast("int"))
    return F.element_at(sorted_values, idx + 1)


def latency_stats_last_n(api: DataFrame, n: int = 100, keys: Sequence[str] = (),
                         slow_ms: float = 1000.0, very_slow_ms: float = 5000.0) -> DataFrame:
    """AGG-16: stats over the newest ``n`` requests per key; error rate over all requests."""
    g = list(keys)
    ms = F.col("response_time") * F.lit(1000.0)
    last = top_n_per_key(api.withColumn("ms", ms), g, [F.col("ts").desc()], n, tie_cols=["request_id"])
    # bounded group: at most n values per key
    stats = last.groupBy(*g).agg(
        F.avg("ms").alias("avg_response_time_ms"), F.min("ms").alias("min_response_time_ms"),
        F.max("ms").alias("max_response_time_ms"), F.array_sort(F.collect_list("ms")).alias("_s"),
        F.count(F.lit(1)).alias("_n"),
        F.sum((F.col("ms") > slow_ms).cast("long")).alias("slow_requests"),
        F.sum((F.col("ms") > very_slow_ms).cast("long")).alias("very_slow_requests"))
    stats = stats.select(*g, "avg_response_time_ms", "min_response_time_ms", "max_response_time_ms",
                         nearest_rank(F.col("_s"), F.col("_n"), 95).alias("p95_response_time_ms"),
                         nearest_rank(F.col("_s"), F.col("_n"), 99).alias("p99_response_time_ms"),
                         "slow_requests", "very_slow_requests")
    allr = api.groupBy(*g).agg(F.count(F.lit(1)).alias("total_requests"),
                               F.sum((F.col("status_code") >= 400).cast("long")).alias("error_count"))
    allr = allr.withColumn("error_rate", F.coalesce(F.try_divide(F.col("error_count").cast("double"),
                                                                 F.col("total_requests").cast("double")), F.lit(0.0)))
    return allr.join(stats, g) if g else allr.crossJoin(stats)


def error_rate_last_n(api: DataFrame, n: int = 100, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-15: error share of the newest ``n`` requests (0 when none)."""
    last = top_n_per_key(api, list(keys), [F.col("ts").desc()], n, tie_cols=["request_id"])
    return last.groupBy(*keys).agg(
        F.coalesce(F.avg((F.col("status_code") >= 400).cast("double")), F.lit(0.0)).alias("error_rate"),
        F.count(F.lit(1)).alias("requests"))


def performance_summary(metrics: DataFrame, value_cols: Sequence[str]) -> DataFrame:
    """AGG-12: avg/min/max/sample std per metric in one pass, long output."""
    aggs = []
    for c in value_cols:
        aggs += [F.avg(c).alias(f"{c}__avg"), F.min(c).alias(f"{c}__min"),
                 F.max(c).alias(f"{c}__max"), F.stddev_samp(c).alias(f"{c}__std")]
    one = metrics.agg(*aggs)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(f"{c}__avg").alias("avg"), F.col(f"{c}__min").alias("min"),
                 F.col(f"{c}__max").alias("max"), F.col(f"{c}__std").alias("std")) for c in value_cols]))
        .alias("m")).select("m.*")


def share_by(df: DataFrame, key: str | Sequence[str], weight: Column | None = None, out: str = "share") -> DataFrame:
    """AGG-13 / AGG-22: normalised counts (or weighted shares) per key."""
    keys = [key] if isinstance(key, str) else list(key)
    w = weight if weight is not None else F.lit(1)
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.sum(w).alias("_w"))
    tot = g.agg(F.sum("_w").alias("_t"))
    return g.crossJoin(tot).select(*keys, "count", (F.col("_w") / F.col("_t")).alias(out))


def portfolio_summary(scored: DataFrame, segment: str = "loan_purpose") -> DataFrame:
    """AGG-21: exposure, accounts, mean PD/LGD, expected loss, HHI concentration by segment."""
    seg = scored.groupBy(segment).agg(F.sum("loan_amount").alias("_e"))
    hhi = seg.agg((F.sum(F.col("_e") * F.col("_e")) / F.pow(F.sum("_e"), 2)).alias("concentration_hhi"))
    tot = scored.agg(F.sum("loan_amount").alias("total_exposure"), F.count(F.lit(1)).alias("accounts"),
                     F.avg("pd_score").alias("avg_pd"), F.avg("lgd_score").alias("avg_lgd"),
                     F.sum(F.col("expected_loss") * F.col("loan_amount")).alias("expected_loss_amount"))
    return tot.crossJoin(hhi)


def pivot_matrix(df: DataFrame, index: str, columns: str, values: str, column_values: Sequence | None = None) -> DataFrame:
    """AGG-24: index x columns -> first value (pass ``column_values`` to skip the distinct job)."""
    return df.groupBy(index).pivot(columns, list(column_values) if column_values else None).agg(F.first(values))


def facets(df: DataFrame, text_col: str, num_col: str) -> DataFrame:
    """AGG-25: one row for each distinct text value with its row count, and the numeric range over all rows."""
    values = df.where(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    rng = df.agg(F.min(num_col).alias("min"), F.max(num_col).alias("max"), F.count(F.lit(1)).alias("total_rows"))
    return values.crossJoin(F.broadcast(rng))      # one row


def prediction_lookup(log: DataFrame, request_id) -> DataFrame:
    """PRJ-08: first log row of one request (status 'completed', success true)."""
    hit = log.where(F.col("request_id") == F.lit(request_id)).orderBy("timestamp").limit(1)
    return hit.select("*", F.lit(True).alias("success"), F.lit("completed").alias("status"))


def critical_flag(col: str, threshold: float) -> Column:
    """PRJ-16: rows whose value exceeds the threshold."""
    return F.coalesce(F.col(col) > F.lit(threshold), F.lit(False))
