"""Benchmark decontamination by a prefix-filtered set join.

A window is ``width`` consecutive words of a benchmark item (a shorter item is one window).  The
words of a window are ordered by their rarity in the corpus and its PREFIX rarest ones are joined
with the documents' words; as a window must be contained whole, a document place that can hold it
must have all of them, each at its own distance from the window's start (positional bound), and
must leave room for the whole window (length bound).  What is left is verified word by word on
the document's text.

Shuffles: candidate places and, for the verification, the texts of documents that have any.  The
word tables of the benchmark are broadcast only below BROADCAST_ROWS rows and shuffle otherwise.

Defined results: null and empty texts have no words; an item without words has no window; equal
windows of several items count for each; rows that repeat doc_id and text get equal results; empty
tables give no hits or no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lendscope.llm.common import materialize, n_words, same, text_key, words

WIDTH = 13
PREFIX = 3
BROADCAST_ROWS = 200_000


def sized(df: DataFrame) -> DataFrame:
    """Broadcast hint for a stored table of checked size; beyond it the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def windows(benchmark: DataFrame, width: int, item_col: str, text_col: str) -> DataFrame:
    """window, len, ws, items: the distinct windows and the items that have them."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws")).where(
        F.size("ws") > 0)
    size = F.least(F.size("ws"), F.lit(width))
    cut = items.select("item", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("ws") - size), lambda i: F.slice("ws", i + 1, size))).alias("ws"))
    return cut.groupBy("ws").agg(F.collect_set("item").alias("items")).select(
        F.xxhash64("ws").alias("window"), F.size("ws").alias("len"), "ws", "items")


def doc_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ws = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"),
                     words(F.col(text_col)).alias("ws"))
    return ws.select("id", "key", F.size("ws").alias("total"), F.posexplode("ws").alias("pos", "w"))


def prefixes(wins: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """w, window, len, off, bit, need: each window's rarest words in the corpus, at one place each."""
    placed = wins.select("window", "len", F.posexplode("ws").alias("off", "w"))
    vocab = materialize(placed.select("w").distinct())
    df = doc_words(docs, id_col, text_col).join(sized(vocab), "w").groupBy("w").agg(F.count("*").alias("n"))
    df = materialize(df)                   # read twice below
    rarest = Window.partitionBy("window").orderBy("n", "w", "off")
    # words that the corpus does not have rule their window out, so an inner join is enough:
    # such a window keeps fewer words than it has and is dropped
    known = placed.join(df, "w")
    whole = known.groupBy("window").agg(F.count("*").alias("c"))
    return (known.join(whole, "window").where("c = len").withColumn("r", F.row_number().over(rarest))
            .where(F.col("r") <= PREFIX)
            .select("w", "window", "len", "off", F.expr("shiftleft(1, r - 1)").alias("bit"),
                    F.least("len", F.lit(PREFIX)).alias("need")))


def candidates(docs: DataFrame, wins: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key, start, window, len: places where all prefix words of a window stand as in the window."""
    pre = materialize(prefixes(wins, docs, id_col, text_col))
    at = doc_words(docs, id_col, text_col).join(sized(pre), "w").where(
        (F.col("pos") >= F.col("off")) & (F.col("pos") - F.col("off") + F.col("len") <= F.col("total")))
    # bits, not a count: rows that repeat id and text bring each prefix word once a row
    return (at.groupBy("id", "key", (F.col("pos") - F.col("off")).alias("start"), "window")
            .agg(F.bit_or("bit").alias("bits"), F.max("need").alias("need"), F.max("len").alias("len"))
            .where("bits = shiftleft(1, need) - 1").select("id", "key", "start", "window", "len"))


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, key, total (words), covered (distinct word places), items: a row for each document that holds a window."""
    wins = materialize(windows(benchmark, width, item_col, item_text_col))
    places = materialize(candidates(docs, wins, id_col, text_col))
    keys = materialize(places.select("id", "key").distinct())
    has = same(F.col("id"), F.col(id_col)) & (F.col("key") == F.col("_key"))
    texts = docs.select(F.col(id_col), text_key(F.col(text_col)).alias("_key"), F.col(text_col)).join(
        sized(keys), has, "left_semi")
    texts = texts.select(F.col(id_col).alias("id"), F.col("_key").alias("key"), words(F.col(text_col)).alias("ws"))
    wanted = places.join(wins.select("window", "ws", "items"), "window").groupBy("id", "key").agg(
        F.collect_list(F.struct("start", "len", "ws", "items")).alias("places"))
    both = texts.alias("t").join(wanted.alias("p"), same(F.col("t.id"), F.col("p.id"))
                                 & (F.col("t.key") == F.col("p.key")))
    sure = F.filter("places", lambda p: F.slice(F.col("t.ws"), p["start"] + 1, p["len"]) == p["ws"])
    found = both.select("t.id", "t.key", F.size("t.ws").alias("total"), sure.alias("sure")).where(F.size("sure") > 0).dropDuplicates(["id", "key"])
    return found.select(
        "id", "key", "total",
        F.array_distinct(F.flatten(F.transform("sure", lambda p: F.sequence(p["start"], p["start"] + p["len"] - 1))))
        .alias("covered"),
        F.array_distinct(F.flatten(F.transform("sure", lambda p: p["items"]))).alias("items"))


def contaminated(n_hit: Column, total: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= total)


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs, benchmark, width, id_col, text_col, item_col, item_text_col).select(
        F.col("id").alias("_id"), F.col("key").alias("_k"), F.size("covered").cast("long").alias("hit"),
        F.size("items").cast("long").alias("its"), F.array_join(F.array_sort("items"), ",").alias("ids"))
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"),
                       n_words(F.col(text_col)).alias("n_words"))
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    return rows.join(found, same(F.col("id"), F.col("_id")) & (F.col("key") == F.col("_k")), "left").select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"),
        F.coalesce("its", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        contaminated(n_hit, F.col("n_words")).alias("contaminated"))
