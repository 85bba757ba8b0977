"""What must not grow with the rows: tasks that take a whole feature, buckets that take ever more values."""

from __future__ import annotations

import contextlib
import random

import pytest
from pyspark.sql import functions as F

from lendscope.functions import bands
from lendscope.operators import drift as dr
from lendscope.operators import prefix


@contextlib.contextmanager
def conf(spark, **settings):
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def samples(spark, n=400):
    rnd = random.Random(5)
    rows = [(f, rnd.choice(["reference", "current"]), rnd.gauss(0, 1), None) for f in ("a", "b") for _ in range(n)]
    rows += [("c", rnd.choice(["reference", "current"]), None, rnd.choice("xyz")) for _ in range(n)]
    rows += [("a", "reference", None, None), ("b", "current", float("nan"), None)]
    return spark.createDataFrame(rows, "feature string, sample string, value double, category string")


@pytest.mark.parametrize("statistic", [dr.psi_continuous, dr.psi_categorical, dr.chi_square])
def test_rows_are_not_shuffled_by_feature_alone(spark, statistic):
    values = dr.value_table(samples(spark))
    with conf(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        plan = statistic(values)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_bins_between_ready_edges_are_the_same(spark):
    rnd = random.Random(6)
    rows = [(rnd.uniform(-1, 11), 0.0, 10.0) for _ in range(300)] + [(x, 0.0, 0.7) for x in (0.0, 0.07, 0.21, 0.35, 0.7, 0.71)]
    rows += [(1.0, 1.0, 1.0), (None, 0.0, 1.0), (float("nan"), 0.0, 1.0), (0.5, None, None), (float("inf"), 0.0, 1.0)]
    df = spark.createDataFrame(rows, "x double, lo double, hi double")
    got = df.select(bands.bin_of("x", bands.bin_edges("lo", "hi", 10)).alias("g"), bands.edge_bin("x", "lo", "hi", 10).alias("w"))
    assert got.where(~F.col("g").eqNullSafe(F.col("w"))).count() == 0


def test_buckets_follow_the_values(spark, monkeypatch):
    monkeypatch.setattr(prefix, "BUCKET_ROWS", 20)
    df = spark.range(1000).select((F.col("id") * 7 % 500).alias("v"))
    out = prefix.prefix_sums(prefix.value_counts(df, "v"), "v", keep_bucket=True)
    assert out.select("_bucket").distinct().count() >= 20
    assert out.where("below_cnt <> 2 * v OR total_cnt <> 1000").count() == 0
