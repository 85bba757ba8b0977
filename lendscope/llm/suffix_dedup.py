"""Removal of repeated byte strings by longest-previous-factor arrays over partitioned suffixes.

A byte goes when it lies in a LENGTH-byte string that also starts earlier (smaller doc_id, or the
same document and an earlier start); strings are judged on the input.  Position i goes on being a
start of such a string when LPF[i] >= LENGTH, LPF[i] being the longest match of the suffix at i
with any suffix of an earlier position: in suffix order, the longer of the matches with the
previous and the next suffix that have a smaller position.

Suffixes are never gathered as a whole.  They are dealt by content:

1. Anchors.  Of the GRAM-byte strings in every LENGTH-byte window the one with the smallest hash is
   an anchor (winnowing), so two equal windows have the same anchor at the same place.  About 3 % of
   the positions are anchors; only (hash, document, position) of them shuffles, and the anchors
   whose hash occurs once are done with.
2. Contexts.  The context of an anchor is all bytes that a window around it can have; a hash of it
   goes along.  Occurrences of one context after its first one are covered as a whole: within a
   document that is found during the scan, across documents by an aggregate.  That folds the
   groups of copies, however large.
3. Suffix order.  Where an anchor has different contexts, their bytes are cut out of the texts and
   the first occurrences meet in one task: the
   suffixes that start before the anchor are sorted there, place by place, and LPF is taken from
   the previous and next smaller position in each run of suffixes with LENGTH common bytes.  An
   anchor with more than GROUP contexts (a passage between ever different neighbours) is not
   gathered; its suffixes are dealt on by their LENGTH bytes, with the smallest position of each
   aggregated.
4. The covered stretches of each document are joined with its text.

Equal whole texts are folded before all that: the first one stands for them, the later ones go
whole if they have LENGTH bytes.

Defined results: a null text is empty; documents of less than LENGTH bytes lose nothing; doc_id
names one text, and rows that repeat it with the same text are the same document (each gets the
document's result); rows without doc_id come after all others, in order of their text's hash; an
empty table gives an empty result; only the named columns are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import drop_tables, empty_exchanges, join_hot, materialize, sized, text_key
from lendscope.llm.nptext import chunks, mix, powers, sums

LENGTH = 100
GRAM = 32
GROUP = 200_000                   # contexts of one anchor that one task sorts (34 MB)
BATCH_ROWS = 2048                 # contexts sorted at once
NO_ID = 1 << 62
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slide(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every ``width`` neighbours, by doubling."""
    size, out = 1, a
    while 2 * size <= width:
        out = pick(out[:len(out) - size], out[size:])
        size *= 2
    return pick(out[:len(out) - (width - size)], out[width - size:]) if size < width else out


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text number, position, hash, context hash, bytes after the anchor's start) of the anchors of a chunk of texts."""
    a = np.frombuffer(b"".join(texts), np.uint8)
    width = length - gram + 1
    if len(a) < length:
        return (np.zeros(0, np.int64),) * 5
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    begin = ends - sizes
    s, (_, down) = sums(a), powers(len(a) + 1)
    n = len(a) - gram + 1
    h = mix((s[gram:] - s[:n]) * down[:n])
    own = np.repeat(np.arange(len(texts)), sizes)
    h[own[:n] != own[gram - 1:]] = NONE
    least = _slide(h, width, np.minimum)
    least[own[:len(least)] != own[length - 1:]] = 0          # windows across two texts do not count
    around = _slide(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, np.maximum)
    at = np.flatnonzero((around == h) & (h != NONE))
    own, h = own[at], h[at]
    first, last = np.maximum(at - (length - gram), begin[own]), np.minimum(at + length, ends[own])
    c = mix((s[last] - s[first]) * down[first] + (at - first).astype(np.uint64))
    return own, at - begin[own], h.view(np.int64), c.view(np.int64), last - at


def first_in_text(own: np.ndarray, h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which anchors are the first with their context in their text."""
    key = np.stack([own, h, c])
    order = np.lexsort(key[::-1])          # stable: equal contexts stay in order of position
    k = key[:, order]
    out = np.zeros(len(own), bool)
    out[order] = np.concatenate([[True], (k[:, 1:] != k[:, :-1]).any(0)]) if len(own) else False
    return out


def as_words(strings: np.ndarray) -> np.ndarray:
    """The rows of bytes as big-endian 8-byte words, which compare like the bytes."""
    pad = -strings.shape[1] % 8
    return np.ascontiguousarray(np.pad(strings, ((0, 0), (0, pad)))).view(">u8").astype(np.uint64)


def order_suffixes(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of equally long byte strings in lexicographic order within each group."""
    return np.lexsort((*words.T[::-1], group))


def smaller_neighbours(ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one before (else -1) and after it (else the size) with a smaller value."""
    def before(x: np.ndarray) -> np.ndarray:
        near = np.arange(len(x)) - 1
        todo = np.arange(len(x))
        while len(todo):
            todo = todo[near[todo] >= 0]
            todo = todo[x[near[todo]] >= x[todo]]
            near[todo] = near[near[todo]]      # all that lies between is no smaller
        return near

    return before(ranked), len(ranked) - 1 - before(ranked[::-1])[::-1]


def common_prefix(a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Number of first bytes that the rows of a and b (see ``as_words``) share, at most ``length``."""
    differ = a != b
    word = differ.argmax(1)
    at = np.arange(len(a))
    x = a[at, word] ^ b[at, word]
    same = 8 * word + sum((x < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(1, 8))
    return np.where(x == 0, length, np.minimum(same, length))


def longest_previous_factor(group: np.ndarray, words: np.ndarray, position: np.ndarray, length: int) -> np.ndarray:
    """LPF of every string: its longest match with a string of a smaller position in its group.

    In suffix order that is the longer of the matches with the nearest strings on both sides that have a
    smaller position."""
    order = order_suffixes(group, words)
    g, w = group[order], words[order]
    found = np.zeros(len(order), np.int64)
    for other in smaller_neighbours(position[order]):
        at = np.flatnonzero((other >= 0) & (other < len(order)))
        at = at[g[at] == g[other[at]]]
        found[at] = np.maximum(found[at], common_prefix(w[at], w[other[at]], length))
    out = np.zeros(len(order), np.int64)
    out[order] = found
    return out


def covered_starts(group: np.ndarray, position: np.ndarray, left: np.ndarray, ctx: list[bytes],
                   length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, int]]:
    """(rows, bytes before the anchor) of the suffixes with LPF >= length.  ``position``: ranks of the occurrences."""
    reach = length - gram
    table = np.zeros((len(ctx), reach + length), np.uint8)
    sizes = np.array([len(c) for c in ctx])
    for i, c in enumerate(ctx):
        table[i, reach - left[i]:reach - left[i] + len(c)] = np.frombuffer(c, np.uint8)
    for before in range(reach + 1):
        live = np.flatnonzero((left >= before) & (sizes - left >= length - before))
        if len(live) > 1:
            words = as_words(table[live, reach - before:reach - before + length])
            found = longest_previous_factor(group[live], words, position[live], length) >= length
            if found.any():
                yield live[found], before


def _vertex(id_col: Column, key: Column) -> Column:
    return F.coalesce(id_col.cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(key, 2))


def _find_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First occurrences of the anchors of each text (stop -1), and the stretches [pos, stop) that the later ones cover."""
    for b in batches:
        texts, vs = [bytes(t) for t in b["text"]], b["v"].to_numpy()
        for lo, hi in chunks(texts):
            own, pos, h, c, r = anchors(texts[lo:hi])
            k = first_in_text(own, h, c)
            yield pd.DataFrame({"h": h[k], "c": c[k], "v": vs[lo:hi][own[k]], "pos": pos[k].astype(np.int32),
                                "r": r[k].astype(np.int32), "stop": np.int64(-1)})
            k = ~k
            own, start, stop = own[k], pos[k] - np.minimum(pos[k], LENGTH - GRAM), pos[k] + r[k]
            if len(own):
                # in order of position; overlapping neighbours make one stretch
                new = np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] > np.maximum.accumulate(
                    stop + own * (1 << 40))[:-1] - own[1:] * (1 << 40))])
                at = np.flatnonzero(new)
                yield pd.DataFrame({"h": np.int64(0), "c": np.int64(0), "v": vs[lo:hi][own[at]], "pos": start[at].astype(np.int32),
                                    "r": np.int32(0), "stop": np.maximum.reduceat(stop, at)})


def _cut_contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    reach, rows = LENGTH - GRAM, 20_000

    def frame(parts: list[tuple]) -> pd.DataFrame:
        h, many, v, p, k, ctx = zip(*parts)
        return pd.DataFrame({"h": np.concatenate(h), "many": np.concatenate(many), "v": np.concatenate(v),
                             "pos": np.concatenate(p), "l": np.concatenate(k), "ctx": [c for x in ctx for c in x]})

    parts, size = [], 0
    for b in batches:
        for v, text, pos, h, many in zip(b["v"], b["text"], b["pos"], b["h"], b["many"]):
            left = np.minimum(pos, reach)
            for at in range(0, len(pos), rows):
                p, k = pos[at:at + rows], left[at:at + rows]
                ctx = [text[x:x + y + LENGTH] for x, y in zip((p - k).tolist(), k.tolist())]
                parts.append((h[at:at + rows], many[at:at + rows], np.full(len(p), v), p, k, ctx))
                size += len(p)
                if size >= rows:
                    yield frame(parts)
                    parts, size = [], 0
    if parts:
        yield frame(parts)


def _suffix_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come in order of h; whole groups are sorted together, about BATCH_ROWS at once."""
    def sort(df: pd.DataFrame) -> pd.DataFrame:
        rank = np.lexsort((df["pos"], df["v"]))
        position = np.empty(len(df), np.int64)
        position[rank] = np.arange(len(df))
        v, pos = df["v"].to_numpy(), df["pos"].to_numpy()
        out = [(v[r], pos[r] - k) for r, k in covered_starts(
            df["h"].to_numpy(), position, df["l"].to_numpy(), [bytes(c) for c in df["ctx"]])]
        starts = pd.DataFrame({"v": np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64),
                               "start": np.concatenate([y for _, y in out]) if out else np.zeros(0, np.int64)})
        # neighbouring starts make one stretch
        starts = starts.drop_duplicates().sort_values(["v", "start"])
        new = (starts["v"].diff() != 0) | (starts["start"].diff() != 1)
        return starts.groupby(new.cumsum()).agg(v=("v", "first"), start=("start", "first"), stop=("start", "last")).assign(
            stop=lambda x: x["stop"] + LENGTH)

    rest = None
    for b in batches:
        rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
        while len(rest) > BATCH_ROWS:
            h = rest["h"].to_numpy()
            cut = int(np.flatnonzero(h == h[BATCH_ROWS])[0])
            if cut == 0:
                later = np.flatnonzero(h != h[0])
                if not len(later):
                    break
                cut = int(later[0])
            yield sort(rest.iloc[:cut].reset_index(drop=True))
            rest = rest.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield sort(rest)


def stretches(docs: DataFrame) -> DataFrame:
    """v, start, stop: covered stretches, which may overlap.  ``docs``: v, text (binary), one row for each."""
    # stored: three steps read it, and each would look for the anchors of all texts again
    scanned = materialize(docs.mapInPandas(_find_anchors, "h long, c long, v long, pos int, r int, stop long"))
    inside = materialize(scanned.where("stop >= 0").select("v", F.col("pos").cast("long").alias("start"), "stop"))
    found = scanned.where("stop < 0").drop("stop")
    repeated = materialize(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    empty_exchanges(docs.sparkSession)
    met = materialize(join_hot(found, repeated, ["h"]))
    drop_tables(scanned, repeated)
    firsts = materialize(met.groupBy("h", "c").agg(F.min(F.struct("v", "pos")).alias("g"), F.count("*").alias("times")))
    left = F.least("pos", F.lit(LENGTH - GRAM))
    later = join_hot(met, firsts.where("times > 1").drop("times"), ["h", "c"]).where(
        F.struct("v", "pos") != F.col("g")).select(
        "v", (F.col("pos") - left).cast("long").alias("start"), (F.col("pos") + F.col("r")).cast("long").alias("stop"))

    several = firsts.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    reps = join_hot(firsts.select("h", F.col("g.v").alias("v"), F.col("g.pos").alias("pos")), several, ["h"])
    # a document's anchors are fewer than its bytes
    lists = materialize(reps.groupBy("v").agg(F.collect_list("pos").alias("pos"), F.collect_list("h").alias("h"),
                                              F.collect_list(F.col("kinds") > GROUP).alias("many")))
    cut = docs.join(sized(lists.select("v")), "v", "left_semi").join(lists, "v").mapInPandas(
        _cut_contexts, "h long, many boolean, v long, pos int, l int, ctx binary")
    own = materialize(cut)
    few = own.where("not many").drop("many").repartition("h").sortWithinPartitions("h")
    return inside.union(later).union(few.mapInPandas(_suffix_order, "v long, start long, stop long")).union(
        _dealt_on(own.where("many").withColumn("n", F.length("ctx"))))


def _dealt_on(many: DataFrame) -> DataFrame:
    """The same for anchors with many contexts: each suffix is dealt by its own LENGTH bytes."""
    starts = F.sequence(F.greatest(F.lit(0), F.col("l") - (LENGTH - GRAM)), F.least("l", F.col("n") - LENGTH))
    flat = many.select("v", "pos", "l", "h", "ctx", F.explode(starts).alias("at"))
    piece = F.substring("ctx", F.col("at") + 1, F.lit(LENGTH))
    flat = materialize(flat.select(
        "h", (F.col("l") - F.col("at")).alias("before"), F.xxhash64(piece).alias("s1"), F.xxhash64(F.lit(1), piece).alias("s2"),
        "v", (F.col("pos") - F.col("l") + F.col("at")).alias("start")))
    on = ["h", "before", "s1", "s2"]
    first = flat.groupBy(*on).agg(F.min(F.struct("v", "start")).alias("g"), F.count("*").alias("times")).where("times > 1")
    return join_hot(flat, first.drop("times"), on).where(F.struct("v", "start") != F.col("g")).select(
        "v", F.col("start").cast("long"), (F.col("start") + LENGTH).cast("long").alias("stop"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of stretches as maximal runs."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for v, text, starts, stops in zip(b["v"], b["text"], b["starts"], b["stops"]):
            runs, at, kept = merged(list(zip(starts.tolist(), stops.tolist()))), 0, hashlib.sha256()
            for x, y in runs:
                kept.update(text[at:x])
                at = y
            kept.update(text[at:])
            rows.append((v, sum(y - x for x, y in runs), len(runs), kept.hexdigest()))
        yield pd.DataFrame(rows, columns=["v", "removed", "spans", "kept"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    v = _vertex(F.col(id_col), text_key(F.col(text_col)))
    rows = materialize(docs.select(F.col(id_col).alias("id"), v.alias("v"), F.octet_length(text).cast("long").alias("n_bytes"),
                                   F.sha2(text, 256).alias("sha")))
    groups = rows.groupBy("sha").agg(F.min("v").alias("first"), F.count("*").alias("times"))
    again = materialize(join_hot(rows.select("sha", "v"), groups.where("times > 1"), ["sha"]).where(
        F.col("v") != F.col("first")).select("v").distinct())
    single = docs.select(v.alias("v"), text.alias("text")).where(F.octet_length("text") >= LENGTH).join(
        sized(again), "v", "left_anti")
    repeated_ids = materialize(rows.groupBy("v").agg(F.count("*").alias("k")).where("k > 1").select("v"))
    # rows that repeat an id are one document (a few; rows of other ids need no shuffle)
    if not repeated_ids.isEmpty():
        twice = single.join(repeated_ids, "v", "left_semi").dropDuplicates(["v"])
        single = single.join(repeated_ids, "v", "left_anti").union(twice)

    cover = materialize(stretches(single)).groupBy("v").agg(
        F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    cover = materialize(cover)
    texts = single.join(sized(cover.select("v")), "v", "left_semi")
    cleaned = texts.join(cover, "v").mapInPandas(_remove, "v long, removed long, spans long, kept string")

    gone = again.select("v", F.lit(True).alias("copy"))
    out = rows.join(gone, "v", "left").join(cleaned, "v", "left")
    whole = F.coalesce("copy", F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    return out.select(
        F.col("id").alias(id_col), "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))
