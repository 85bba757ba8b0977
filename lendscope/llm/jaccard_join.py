"""N-gram Jaccard join: size-aware, heavy and light sets treated differently.

A document is the set of its 5-word shingles; two link when 100 |a & b| >= 80 |a | b|.  Documents
with the same set are one class, represented by their smallest id.

Light sets (of at most ``boundary`` shingles) enumerate fixed-size subsets: two linked sets, the
larger of size t, share ceil(0.8 t) shingles, so both emit every subset of that size as one key.
Heavy sets (with the light ones that can link to them) go into inverted lists: the shingles
of a set are ordered - shingles known to be frequent last, the others by hash - and the first
t - ceil(0.8 t) + 1 of them are keys, one of which two linked sets must share.  The boundary is
the size at which enumerating starts to cost more rows than it saves in list scans.

Lists are scanned in rounds, so that a group of near copies does not become all its pairs:
 1. in each of ROUNDS rounds every class is verified against one member of another component: the
    first class of its lists in an order that changes by round, taking the one it shares most
    lists with;
 2. of the classes that share a list but not yet a component, all pairs that can still link by
    their sizes, their places in the lists, the number of lists they can still share and their bitmaps are verified.
So no link between two components is lost, and pairs inside a component are not formed.  The
bitmap of a set has bit i set if an odd number of its shingles hash to i; two bitmaps differ in at
most as many bits as the sets differ in shingles, so it rules out pairs without their sets.

The table of frequent shingles only sets the order: any order gives the same links.  It is made
of all rows (shingles that repeat within a chunk of texts, counted over all chunks) and has at
most FREQUENT rows, hence the broadcast.

Defined results: a text without words (null, empty) has no shingle, n_shingles 0, and is a
component of its own; a text of fewer than five words is one shingle; component_id is the smallest
non-null doc_id of the component; rows keep their multiplicity and repeated rows are one class; an empty table
gives an empty result; only the named columns are used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendscope.llm.common import drop_tables, empty_exchanges, join_hot, materialize, sized, text_key
from lendscope.llm.components import components
from lendscope.llm.nptext import chunks, mix, shingle_sets

WIDTH = 5
NUM, DEN = 80, 100                 # similarity of at least NUM / DEN
FREQUENT = 1 << 17
LOCAL_REPEATS = 2                  # repeats within one chunk of texts that make a shingle a candidate for FREQUENT
ROUNDS = 4                          # of stars at most; what they leave apart is joined pair by pair
FEW = 200                          # a round that links fewer than one class in FEW is the last
BITS = 1024
PARTS = 4                          # of the keys; only one part's exchange is on disk at a time
COUNT_BYTES = 4 << 20
LARGEST_LIGHT = 12
LIST_SCAN = 4                      # cost of a list row (scan, positions, verification) in units of an enumerated row
NO_ID = 1 << 62                    # vertices of rows without an id lie above


def needed(t: int) -> int:
    """Shingles that a set of size t shares at least with any linked set that is not larger."""
    return -(-NUM * t // DEN)


def prefix_len(t: int) -> int:
    return t - needed(t) + 1


def subset_sizes(s: int) -> list[int]:
    """Sizes of the subsets that a light set of size s enumerates: one for each size of a larger partner, and its own."""
    return sorted({needed(t) for t in range(s, DEN * s // NUM + 1)})


def enumerated(s: int) -> int:
    return sum(math.comb(s, c) for c in subset_sizes(s) if c <= s)


def choose_boundary(histogram: dict[int, int]) -> int:
    """Largest light size of least cost.  ``histogram``: number of sets of each size up to LARGEST_LIGHT * DEN / NUM."""
    def cost(b: int) -> int:
        light = sum(n * enumerated(s) for s, n in histogram.items() if s <= b)
        lists = sum(n * prefix_len(s) for s, n in histogram.items() if DEN * s // NUM > b)
        return light + LIST_SCAN * lists
    return min(range(LARGEST_LIGHT + 1), key=lambda b: (cost(b), b))


def keys_of(u: np.ndarray, boundary: int, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places) of a set: places in the order for list keys, -1 for subsets.

    ``frequent``: sorted shingles that come last, in the order of their ``rank``."""
    s, keys, places = len(u), [], []
    if 0 < s <= boundary:
        for c in subset_sizes(s):
            if c <= s:
                subs = np.array([u[list(x)] for x in combinations(range(s), c)], np.uint64)
                with np.errstate(over="ignore"):
                    weight = mix(np.arange(1, c + 1, dtype=np.uint64)) | np.uint64(1)
                    keys.append(mix((subs * weight).sum(1, dtype=np.uint64) + np.uint64(c)))
                places.append(np.full(len(keys[-1]), -1, np.int32))
    if s and DEN * s // NUM > boundary:
        at = np.searchsorted(frequent, u)
        last = frequent[np.minimum(at, len(frequent) - 1)] == u if len(frequent) else np.zeros(s, bool)
        order = np.concatenate([u[~last], u[last][np.argsort(rank[at[last]], kind="stable")]])[:prefix_len(s)]
        keys.append(order)
        places.append(np.arange(len(order), dtype=np.int32))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return np.concatenate(keys), np.concatenate(places)


def _encoded(s: pd.Series) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in s]


def bitmap(u: np.ndarray) -> np.ndarray:
    odd = np.bincount((u >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def statistics(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """(at most FREQUENT frequent shingles, sorted; their ranks; number of sets of each small size), over all rows."""
    small = DEN * LARGEST_LIGHT // NUM

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = _encoded(b["text"])
            for lo, hi in chunks(texts, COUNT_BYTES):
                sets = shingle_sets(texts[lo:hi], WIDTH)
                value, n = np.unique(np.concatenate(sets), return_counts=True)
                often = n >= LOCAL_REPEATS
                sizes = np.bincount([len(s) for s in sets if 0 < len(s) <= small], minlength=1)
                yield pd.DataFrame({"kind": 0, "value": value[often].view(np.int64), "n": n[often]})
                yield pd.DataFrame({"kind": 1, "value": np.arange(len(sizes)), "n": sizes})

    counted = materialize(docs.select(F.col(text_col).alias("text")).mapInPandas(count, "kind int, value long, n long")
                          .groupBy("kind", "value").agg(F.sum("n").alias("n")))
    # the least count that FREQUENT shingles can have together (counts above 1000 as one)
    by_count = {r["c"]: r["m"] for r in counted.where("kind = 0").groupBy(F.least("n", F.lit(1000)).alias("c")).agg(
        F.count("*").alias("m")).collect()}
    least, room = 1001, FREQUENT
    while least - 1 >= LOCAL_REPEATS and by_count.get(least - 1, 0) <= room:
        least -= 1
        room -= by_count.get(least, 0)
    often = counted.where((F.col("kind") == 0) & (F.col("n") >= least)).select("value", "n").toPandas()
    value = often["value"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(value)
    rank = np.empty(len(value), np.int32)
    rank[np.lexsort((value, often["n"].to_numpy()))] = np.arange(len(value), dtype=np.int32)
    sizes = {r["value"]: r["n"] for r in counted.where("kind = 1 and n > 0").collect()}
    return value[order], rank[order], sizes


def vertex(id_col: Column, key: Column) -> Column:
    return F.coalesce(id_col.cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(key, 2))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """vertex, size, set (digest), bits (bitmap), keys, places of every row."""
    frequent, rank, sizes = statistics(docs, text_col)
    boundary = choose_boundary(sizes)
    shared = docs.sparkSession.sparkContext.broadcast((frequent, rank))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        often, rank = shared.value
        for b in batches:
            texts, vs = _encoded(b["text"]), b["vertex"].to_numpy()
            for lo, hi in chunks(texts):
                sets = shingle_sets(texts[lo:hi], WIDTH)
                both = [keys_of(u, boundary, often, rank) for u in sets]
                yield pd.DataFrame({
                    "vertex": vs[lo:hi], "size": [len(u) for u in sets],
                    "set": [hashlib.md5(u.tobytes()).digest() for u in sets], "bits": [bitmap(u) for u in sets],
                    "keys": [k.view(np.int64) for k, _ in both], "places": [p for _, p in both]})

    rows = docs.select(vertex(F.col(id_col), text_key(F.col(text_col))).alias("vertex"), F.col(text_col).alias("text"))
    return rows.mapInPandas(emit, "vertex long, size int, set binary, bits array<long>, keys array<long>, places array<int>")


def close_sizes(a: str, b: str) -> Column:
    return (F.least(a, b) * DEN >= F.greatest(a, b) * NUM)


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) that link, by the exact sets of both; stored."""
    pairs = materialize(pairs)
    ends = materialize(pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct())
    wanted = sized(ends)
    rows = docs.select(vertex(F.col(id_col), text_key(F.col(text_col))).alias("v"), F.col(text_col).alias("text"))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, vs = _encoded(b["text"]), b["v"].to_numpy()
            for lo, hi in chunks(texts):
                yield pd.DataFrame({"v": vs[lo:hi], "u": [u.view(np.int64) for u in shingle_sets(texts[lo:hi], WIDTH)]})

    sets = materialize(rows.join(wanted, "v", "left_semi").mapInPandas(make, "v long, u array<long>"))
    left, right = sets.toDF("a", "ua"), sets.toDF("b", "ub")
    common = F.size(F.array_intersect("ua", "ub"))
    # repeated rows of a document give their pair again
    found = materialize(pairs.join(left, "a").join(right, "b").where(
        DEN * common >= NUM * (F.size("ua") + F.size("ub") - common)).select("a", "b").distinct())
    drop_tables(pairs, ends, sets)
    return found


def representatives(keyed_rows: DataFrame) -> DataFrame:
    """v, size, keys, places of the rows whose vertex stands for a class; stored.

    Rows with their keys are wide, so they are matched once, not for each part, and with the vertices that stand for
    none, which are mostly few."""
    sets = keyed_rows.where("size > 0").select("set", F.col("vertex").alias("v"))
    first = materialize(sets.groupBy("set").agg(F.min("v").alias("v")).select("v").distinct())
    others = materialize(sets.select("v").distinct().join(first, "v", "left_anti"))
    out = materialize(keyed_rows.where("size > 0").select(F.col("vertex").alias("v"), "size", "keys", "places").join(
        sized(others), "v", "left_anti"))
    drop_tables(first, others)
    return out


def lists(reps: DataFrame) -> DataFrame:
    """key, v, size, place of the keys that at least two classes have."""
    flat = reps.select("v", "size", F.explode(F.arrays_zip("keys", "places")).alias("z")).select(
        F.col("z.keys").alias("key"), "v", "size", F.col("z.places").alias("place"))
    found = []
    for part in range(PARTS):
        own = flat.where(F.pmod("key", F.lit(PARTS)) == part)
        # stored, so that the exchange it comes from and that of the join are not on disk together
        counts = materialize(own.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
        empty_exchanges(reps.sparkSession)
        found.append(materialize(join_hot(own, counts, ["key"])))
        drop_tables(counts)
    out = materialize(reduce(DataFrame.unionByName, found))
    drop_tables(*found)
    return out


def labelled(in_lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists that still hold classes of different components, with each class's label."""
    marked = materialize(in_lists.drop("label").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v")))
    mixed = marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    out = materialize(join_hot(marked, mixed, ["key"]))
    drop_tables(marked)
    return out


def star(live: DataFrame, turn: int, sketches: DataFrame) -> DataFrame:
    """a, b: each class with the first class of its lists, of those of another component the one it shares most lists with.

    In the first turn the first class of a list is the one with the fewest rarer shingles of its own (the
    lowest place): a text that others were made from has none.  Later turns draw it by a hash."""
    order = F.xxhash64(F.lit(turn), "label") if turn else F.col("place").cast("long")
    pivot = live.groupBy("key").agg(F.min(F.struct(order.alias("o"), "label", "v", "size")).alias("p"))
    tied = join_hot(live, pivot, ["key"]).select(
        "v", "size", "label", F.col("p.v").alias("b"), F.col("p.size").alias("b_size"), F.col("p.label").alias("b_label")).where(
        (F.col("label") != F.col("b_label")) & close_sizes("size", "b_size"))
    votes = tied.groupBy("v", "b").agg(F.count("*").alias("n"))
    return plausible(votes.groupBy("v").agg(F.max(F.struct("n", (-F.col("b")).alias("nb"))).alias("m")).select(
        F.col("v").alias("a"), (-F.col("m.nb")).alias("b")), sketches)


def rest(live: DataFrame, sketches: DataFrame) -> DataFrame:
    """a, b: all classes of different components that share a list and can link.

    Of the shingles that two linked sets share, the first in the order is a list of both, and it has nothing shared
    before it: all they share follows from its place on.  That is at most what follows in either set, and at most
    what follows of the lists still live in either set (``left``) with what the set whose prefix ends first has
    beyond its prefix.  Subsets (place -1) pass both bounds."""
    later = Window.partitionBy("v").orderBy(F.desc("place"))
    left = F.when(F.col("place") < 0, F.col("size")).otherwise(F.count("*").over(later))
    counted = live.select("key", "v", "size", "place", "label", left.alias("left"),
                          (F.ceil(F.col("size") * NUM / DEN) - 1).alias("beyond"))
    x, y = counted.alias("x"), counted.alias("y")
    follow = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    shared = F.least("x.left", "y.left") + F.greatest("x.beyond", "y.beyond")
    can = (F.least(follow, shared) * (DEN + NUM) >= NUM * (F.col("x.size") + F.col("y.size")))
    return plausible(x.join(y, "key").where(
        (F.col("x.v") < F.col("y.v")) & (F.col("x.label") != F.col("y.label")) & close_sizes("x.size", "y.size") & can).select(
        F.col("x.v").alias("a"), F.col("y.v").alias("b")).distinct(), sketches)


def plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose bitmaps do not rule a link out: bits that differ are shingles in one of the two sets only, and a
    link has at most a share of both sizes of these."""
    both = pairs.join(sketches.toDF("a", "sa", "ba"), "a").join(sketches.toDF("b", "sb", "bb"), "b")
    differ = F.aggregate(F.zip_with("ba", "bb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)
    return both.where(differ * (DEN + NUM) <= (DEN - NUM) * (F.col("sa") + F.col("sb"))).select("a", "b")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows: vertex, size, set; labels: v, label of the classes that are linked)."""
    whole = materialize(keyed(docs, id_col, text_col))
    rows = materialize(whole.select("vertex", "size", "set", "bits"))
    reps = representatives(whole)
    drop_tables(whole)
    stored = lists(reps)
    drop_tables(reps)
    live = stored.withColumn("label", F.col("v"))
    sketches = materialize(rows.select("vertex", "size", "bits").join(
        stored.select(F.col("v").alias("vertex")).distinct(), "vertex", "left_semi").dropDuplicates(["vertex"]))
    classes = sketches.count()
    edges = docs.sparkSession.createDataFrame([], "a long, b long")
    labels = docs.sparkSession.createDataFrame([], "v long, label long")
    for turn in range(ROUNDS):
        found = verified(star(live, turn, sketches), docs, id_col, text_col)
        n = found.count()
        if not n:
            break
        edges = edges.union(found)
        labels = materialize(components(edges))
        live = labelled(live, labels)
        drop_tables(stored)                    # the lists of the round before
        stored = live
        if n * FEW < classes:
            break
    more = verified(rest(live, sketches), docs, id_col, text_col)
    drop_tables(stored, sketches)
    return rows, labels if more.isEmpty() else materialize(components(edges.union(more)))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    rows, labels = linked(docs, id_col, text_col)
    narrow = rows.select("vertex", "size", "set")
    one = narrow.where("size > 0").groupBy("set").agg(F.min("vertex").alias("v"))
    classed = one.join(labels, "v", "left").select("set", F.coalesce("label", "v").alias("component"))
    out = join_hot(narrow, classed, ["set"], "left")
    # a text without words is alone
    component = F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("vertex"))
    return out.select(
        F.when(F.col("vertex") < NO_ID, F.col("vertex")).alias(id_col), F.col("size").cast("long").alias("n_shingles"),
        F.when(component < NO_ID, component).alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents of a group whose smallest doc_id is another one.

    Rows without an id are kept, and so are repeated rows of a document that is kept."""
    found = groups(docs, id_col, text_col)
    gone = materialize(found.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("__gone")).distinct())
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")


__all__ = ["groups", "keep_first", "linked"]
