"""Exact deduplication with a two-pass Bloom filter.

Pass 1 counts rows per filter position and keeps, as a bitmap, the positions hit at least twice.
Pass 2 tests every row: if one of its positions was hit once only, no other row has its text and
the row passes straight through; only the possibly repeated rows shuffle, to be grouped by the
SHA-256 of their normalised text.  A false positive costs a shuffled row, never a wrong result.

The bitmap is one scalar of at most MAX_BITS / 8 bytes whatever the input; beyond about
MAX_BITS / 8 rows it gets full and more unique rows shuffle (40 narrow bytes each, never texts).

Nulls: a null text is the empty text.  A null doc_id sorts below every id.  Rows that repeat
doc_id and text are the same document: all of them carry ``kept``.  An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import ascii_lower, join_hot, materialize, next_pow2

MIN_BITS, MAX_BITS = 1 << 16, 1 << 25
BITS_PER_ROW = 8
HASHES = 2


def positions(sha: Column, bits: int) -> list[Column]:
    """Filter positions from disjoint 48-bit pieces of the hash."""
    return [F.conv(F.substring(sha, 1 + 12 * i, 12), 16, 10).cast("long") % bits for i in range(HASHES)]


def twice_hit(hashed: DataFrame, bits: int) -> DataFrame:
    """One row: the bitmap of positions hit at least twice, as an array of bits / 64 longs."""
    hits = (hashed.select(F.explode(F.array_distinct(F.array(*positions(F.col("sha"), bits)))).alias("p"))
            .groupBy("p").agg(F.count("*").alias("n")).where("n >= 2"))
    longs = hits.groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    every = longs.sparkSession.range(bits // 64).join(longs, F.col("id") == F.col("w"), "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0)).alias("b")))),
                                 lambda x: x["b"]).alias("bitmap"))


def maybe_repeated(sha: Column, bitmap: Column, bits: int) -> Column:
    out = F.lit(True)
    for p in positions(sha, bits):
        word = F.get(bitmap, F.shiftright(p, 6).cast("int"))
        out = out & (F.getbit(word, (p % 64).cast("int")) == 1)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; the largest id of equal texts stays."""
    hashed = materialize(docs.select(
        F.col(id_col).alias("id"),
        F.sha2(F.encode(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), "UTF-8"), 256).alias("sha")))
    bits = min(MAX_BITS, max(MIN_BITS, next_pow2(BITS_PER_ROW * hashed.count())))
    flagged = hashed.withColumn("maybe", maybe_repeated(F.col("sha"), twice_hit(hashed, bits).scalar(), bits))

    alone = flagged.where(~F.col("maybe")).select(
        F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    rows = flagged.where("maybe").select("id", "sha")
    groups = rows.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    pairs = join_hot(rows, groups, ["sha"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(pairs)
