"""Line deduplication within one edit, by a deletion-neighbourhood join.

A line (trimmed of blanks; empty ones are left alone) goes when an earlier line - smaller doc_id, or
the same document and a smaller line number - is equal, or both have MIN_CHARS characters or more
and their edit distance is 1.  Lines are judged on the input, not on what is left.

Two lines within one edit have a common deletion variant: the shorter line itself and the longer one
without a character, or both without the character at one place.  Variants are joined by hash.
As each line has as many variants as characters, they are emitted in two steps that lose nothing:
first the line without one of BLOCKS blocks (an edit lies in one of them), then, only for lines
that meet another one there, the variants that delete a character of that block.  Every class of
equal variants is reduced to its earliest line by an aggregate, so a line repeated or varied in a
third of all documents makes no pairs; each line is verified against that earliest line.

Defined results: null and empty texts have no lines to remove; doc_id names one text, and rows that
repeat it with the same text are the same document; rows without doc_id come after all others, in order of their
text's hash; an empty table gives an empty result; only the named columns are used.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import drop_tables, join_hot, materialize, sized, text_key
from lendscope.llm.nptext import BASE, mix, powers

MIN_CHARS = 16
BLOCKS = 4
NO_ID = 1 << 62
_K = mix(np.arange(1, 5, dtype=np.uint64)) | np.uint64(1)
_BLOCK = np.arange(BLOCKS, dtype=np.uint64) * _K[3]


class Lines:
    """Hashes of pieces of many lines."""

    def __init__(self, lines: list[str]):
        cp = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.size = np.array([len(x) for x in lines], np.int64)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.sum = np.zeros(len(cp) + 1, np.uint64)
        up, self.down = powers(len(cp) + 1)
        np.cumsum(mix(cp * BASE) * up[:-1], out=self.sum[1:])

    def piece(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.sum[j] - self.sum[i]) * self.down[i]


def block(size, b):
    return b * size // BLOCKS, (b + 1) * size // BLOCKS


def block_keys(lines: list[str]) -> np.ndarray:
    """lines x (2 BLOCKS): each line without a block, as a line of its own size and as the longer one of a pair."""
    x = Lines(lines)
    out = []
    for longer in (0, 1):
        size = x.size - longer
        for b in range(BLOCKS):
            lo, hi = block(size, b)
            head, tail = x.piece(x.start, x.start + lo), x.piece(x.end - (size - hi), x.end)
            out.append(mix(head * _K[0] + tail * _K[1] + size.astype(np.uint64) * _K[2] + _BLOCK[b]))
    return np.stack(out, 1).view(np.int64)


def variants(line: str, slot: int) -> tuple[list[int], np.ndarray]:
    """(kinds, keys) of the variants of a line in one of its block places.

    Kind 0: without the character at a place, the place being part of the key; 1: the longer line
    without a character; 2: the line itself, as the shorter one."""
    x = Lines([line])
    longer, b = divmod(slot, BLOCKS)
    size = len(line) - longer
    lo, hi = block(size, b)
    at = np.arange(lo, hi + longer)
    n = np.full(len(at), len(line))
    head, tail = x.piece(np.zeros_like(at), at), x.piece(at + 1, n)
    one = head + tail * powers(len(line) + 1)[0][at]         # the hash of head and tail put together
    if longer:
        return [1] * len(at), mix(one * _K[0] + np.uint64(size)).view(np.int64)
    same = mix(x.piece(np.array([0]), np.array([len(line)])) * _K[0] + np.uint64(size))
    return [0] * len(at) + [2], np.concatenate(
        [mix(one * _K[1] + at.astype(np.uint64) * _K[2] + np.uint64(size)), same]).view(np.int64)


def _vertex(id_col: Column, key: Column) -> Column:
    return F.coalesce(id_col.cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(key, 2))


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """v, line (number), s (trimmed text) of the lines that are not blank."""
    rows = docs.select(_vertex(F.col(id_col), text_key(F.col(text_col))).alias("v"),
                       F.posexplode(F.split(text_col, "\n")).alias("line", "s"))
    return rows.select("v", "line", F.trim("s").alias("s")).where("s <> ''")


KEYS = [f"k{i}" for i in range(2 * BLOCKS)]


def _add_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keys = block_keys(list(b["s"])) if len(b) else np.zeros((0, 2 * BLOCKS), np.int64)
        yield b.drop(columns="s").assign(**dict(zip(KEYS, keys.T)))


def _add_variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        parts, size = [], 0
        for v, line, s, slots in zip(b["v"], b["line"], b["s"], b["slots"]):
            for slot in slots:
                kinds, keys = variants(s, int(slot))
                parts.append((keys, np.array(kinds, np.int32), np.full(len(keys), v), np.full(len(keys), line, np.int32)))
                size += len(keys)
            if size >= 50_000:
                yield pd.DataFrame(dict(zip(("key", "kind", "v", "line"), map(np.concatenate, zip(*parts)))))
                parts, size = [], 0
        if parts:
            yield pd.DataFrame(dict(zip(("key", "kind", "v", "line"), map(np.concatenate, zip(*parts)))))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """v, line, near: the lines that go; near tells those with an earlier line at one edit from those with an equal one."""
    lines = split_lines(docs, id_col, text_col).select(
        "v", "line", F.length("s").alias("n"), F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(1), "s").alias("h2"), "s")
    keyed = lines.mapInPandas(_add_keys, "v long, line int, n int, h1 long, h2 long, " + ", ".join(f"{k} long" for k in KEYS))
    # one row a distinct line before any key is sent; equal lines have equal keys
    firsts = materialize(keyed.groupBy("h1", "h2").agg(
        F.min(F.struct("v", "line")).alias("g"), F.count("*").alias("times"), F.max("n").alias("n"),
        *[F.max(k).alias(k) for k in KEYS]))
    again = firsts.where("times > 1").select("h1", "h2", "g")
    exact = materialize(join_hot(lines.select("h1", "h2", "v", "line"), again, ["h1", "h2"]).where(
        F.struct("v", "line") != F.col("g")).select("v", "line", F.lit(False).alias("near")))

    # Lines that meet another one without a block.  Keys of different blocks never meet, so the blocks
    # go one after the other: the shuffle files of one are gone before the next writes its own.
    met = []
    for b in range(BLOCKS):
        of_block = firsts.where(F.col("n") >= MIN_CHARS).select(F.col("g.v").alias("v"), F.col("g.line").alias("line"), F.explode(
            F.array(*[F.struct(F.lit(i).alias("slot"), F.col(KEYS[i]).alias("key")) for i in (b, b + BLOCKS)])).alias("x"))
        of_block = of_block.select("v", "line", "x.slot", "x.key")
        meets = materialize(of_block.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
        met.append(materialize(of_block.join(meets, "key").select("v", "line", "slot")))
        drop_tables(meets)
    live = materialize(functools.reduce(DataFrame.union, met).groupBy("v", "line").agg(F.collect_set("slot").alias("slots")))
    drop_tables(firsts, *met)

    has_any = sized(materialize(live.select("v").distinct()))
    texts = materialize(split_lines(docs, id_col, text_col).join(has_any, "v", "left_semi").join(live, ["v", "line"])
                        .dropDuplicates(["v", "line"]))
    var = materialize(texts.mapInPandas(_add_variants, "key long, kind int, v long, line int"))

    me = F.struct("v", "line")
    placed = var.where("kind = 0")
    alike = placed.groupBy("key").agg(F.min(me).alias("g"), F.count("*").alias("c")).where("c > 1").drop("c")
    pairs = join_hot(placed, alike, ["key"]).where(me != F.col("g"))
    ends = var.where("kind > 0").groupBy("key").agg(
        F.min(F.when(F.col("kind") == 2, me)).alias("short"), F.min(F.when(F.col("kind") == 1, me)).alias("long")
    ).where("short is not null and long is not null")
    tied = join_hot(var.where("kind > 0"), ends, ["key"]).withColumn(
        "g", F.when(F.col("kind") == 2, F.col("long")).otherwise(F.col("short"))).where(F.col("g") < me)
    pairs = pairs.select("v", "line", "g").union(tied.select("v", "line", "g")).select(
        "v", "line", F.col("g.v").alias("gv"), F.col("g.line").alias("gline")).distinct()

    own = texts.select("v", "line", "s")
    near = materialize(pairs.join(own, ["v", "line"]).join(own.toDF("gv", "gline", "gs"), ["gv", "gline"]).where(
        F.levenshtein("s", "gs", 1) == 1).select("v", "line", F.lit(True).alias("near")).distinct())
    drop_tables(live, texts, var)
    return exact.union(near)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_lines, n_equal, n_near, text: what is left of each text, and how many lines went for which reason."""
    gone = materialize(repeats(docs, id_col, text_col).groupBy("v").agg(
        F.collect_set(F.when(~F.col("near"), F.col("line"))).alias("equal"),
        F.collect_set(F.when(F.col("near"), F.col("line"))).alias("close")))
    rows = docs.select(F.col(id_col).alias("id"), _vertex(F.col(id_col), text_key(F.col(text_col))).alias("v"),
                       F.col(text_col).alias("text"))
    n_lines = F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    # only texts that lose lines meet their list; they are split after that, as a text is smaller than its lines
    ids = sized(materialize(gone.select("v")))
    left = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.array_union("equal", "close"), i))
    cut = rows.join(ids, "v", "left_semi").join(gone, "v").select(
        "id", n_lines.alias("n_lines"), F.size("equal").cast("long").alias("n_equal"),
        F.size("close").cast("long").alias("n_near"), F.array_join(left, "\n").alias("text"))
    whole = rows.join(ids, "v", "left_anti").select(
        "id", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_equal"), F.lit(0).cast("long").alias("n_near"), "text")
    return cut.union(whole)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_lines, n_equal, n_near, kept_sha256."""
    return clean(docs, id_col, text_col).select(
        F.col("id").alias(id_col), "n_lines", "n_equal", "n_near",
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
