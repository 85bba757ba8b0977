"""Expressions shared by the operators of this package."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.session import drop_tables, empty_exchanges, materialize
from lendscope.sources.tables import table_path

# Words are runs of digits, letters and non-ASCII characters (fixed by the result contracts).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"                    # of a text whose A-Z are lower-cased
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same words before lower-casing
# What stands between words: splitting there gives the same words as matching them, about four times faster.
GAP = WORD.replace("^", "")
GAP_ANY_CASE = WORD_ANY_CASE.replace("^", "")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` is the fast form; it is the same thing on pure ASCII."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def words(c: Column) -> Column:
    """Lower-cased words of a text in order (empty for null)."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), GAP), "")


def n_words(c: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(c, F.lit("")), GAP_ANY_CASE), "")).cast("long")


def text_key(c: Column) -> Column:
    """With doc_id, names a document: rows that repeat both are the same document."""
    return F.xxhash64(F.coalesce(c, F.lit("")))


def next_pow2(n: int) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, n))))


def join_hot(rows: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a table that is aggregated by ``on``.

    One more key than that (a bit, which hardly adds to the rows) makes both sides plain exchanges,
    and AQE can split the partition of a hot key."""
    bit = F.pmod(F.hash(on[0]), F.lit(2))
    return rows.withColumn("__bit", bit).join(other.withColumn("__bit", bit), ["__bit", *on], how).drop("__bit")


BROADCAST_ROWS = 200_000


def sized(df: DataFrame) -> DataFrame:
    """A stored narrow table with a broadcast hint if it has at most BROADCAST_ROWS rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


__all__ = ["WORD", "WORD_ANY_CASE", "ascii_lower", "drop_tables", "empty_exchanges", "join_hot", "materialize", "n_words", "next_pow2", "read", "same", "sized",
           "text_key", "words"]
