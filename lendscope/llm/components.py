"""Connected components of a stored edge table by min-label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import drop_tables, join_hot, materialize


def components(edges: DataFrame) -> DataFrame:
    """v, label for every vertex of ``edges`` (a, b; longs): label is the smallest vertex it reaches.

    Large-star / small-star rounds over the edge table: each round replaces edges by stars around
    local minima, with one aggregate and one join on the vertex (AQE splits the partitions of a
    hub).  Nothing but a count of changed rows reaches the driver; the rounds grow with the
    logarithm of the largest component.
    """
    pairs = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # large star: every neighbour above a vertex is tied to the smallest vertex around it
        both = pairs.union(pairs.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = join_hot(both.where("v > u"), low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every vertex and its smaller neighbours are tied to the smallest of them
        large = materialize(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_hot(large, least, ["u"]).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        small = materialize(small.where("u <> v").distinct())
        done = small.exceptAll(pairs).isEmpty() and pairs.exceptAll(small).isEmpty()
        drop_tables(pairs, large)
        pairs = small
        if done:
            break
    return pairs.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("label")).union(
        pairs.select("v", F.col("v").alias("label")).distinct())
