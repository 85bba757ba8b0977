"""Target-distribution importance resampling.

Features of a text are its runs of 1 to ``n`` consecutive words, hashed to buckets.  The gain of a
bucket is the log ratio of its smoothed shares in the target (benchmark) and in the corpus.  One
pass counts buckets (each task hands over one array of counts), one pass scores documents against
the array of gains: weight = floored mean gain, score = weight + Gumbel noise drawn from the id.

The highest scores are drawn without sorting the table: a quantile sketch brackets the cutoff, exact
counts of the scores outside confirm that it lies in the bracket or widen it, and only the rows in
the bracket are sorted to find it.  The drawn rows get their ranks from range partitions.

Defined results: a null or empty text has no words, weight 0 and a score of its noise alone; texts
of fewer than ``min_words`` words are scored but never drawn; a null id draws its noise as the text
``null`` and comes last among ties; rows that agree in score and id go by number of features, then
text hash, then row.  Repeated rows are rows of their own.  Empty tables: an empty corpus gives an
empty result, an empty target the gains of its smoothing alone.  Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendscope.llm.common import materialize
from lendscope.llm.nptext import chunks, lowered

BUCKETS = 10_000
SKETCH = 10_000              # the sketch's error is 1 / SKETCH of the rows
LONG_SPAN = 64               # features of more bytes are hashed one at a time


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


CRC = _crc_table()


def crc32(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of each span of a buffer; spans move on together, byte by byte, longest first."""
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-size, kind="stable")
    s, n, c = start[order], size[order], out
    raw = None
    long = int(np.searchsorted(-n, -LONG_SPAN, side="left"))          # spans longer than LONG_SPAN
    alive = np.searchsorted(-n, -np.arange(int(min(n.max(initial=0), LONG_SPAN))), side="left")
    for i, m in enumerate(alive):
        part = c[long:m]
        c[long:m] = CRC[(part ^ buf[s[long:m] + i]) & 255] ^ (part >> np.uint32(8))
    c = c ^ np.uint32(0xFFFFFFFF)
    for i in range(long):
        raw = buf.tobytes() if raw is None else raw
        c[i] = zlib.crc32(raw[s[i]:s[i] + n[i]])
    back = np.empty_like(c)
    back[order] = c
    return back


def features(texts: list[bytes], n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every feature, and the number of words of every text."""
    a = lowered(b"\n".join(texts) + b"\n")
    word = ((a >= 48) & (a <= 57)) | ((a >= 97) & (a <= 122)) | (a >= 128)
    begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
    edge = np.diff(np.concatenate([[0], word.view(np.int8)]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of = np.searchsorted(begin, starts, side="right") - 1
    if n > 1:                                 # words one space apart, so that a run of words is a span of bytes
        size = ends - starts
        kept = np.where(word, a, 32)[word | np.concatenate([[False], word[:-1]])]
        starts = np.cumsum(size + 1) - size - 1
        a, ends = kept, starts + size
    doc, bucket = [], []
    for run in range(1, n + 1):
        first = np.arange(max(0, len(starts) - run + 1))
        first = first[of[first] == of[first + run - 1]]
        doc.append(of[first])
        bucket.append(crc32(a, starts[first], ends[first + run - 1] - starts[first]) % buckets)
    return np.concatenate(doc), np.concatenate(bucket).astype(np.int64), np.bincount(of, minlength=len(texts))


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def bucket_counts(df: DataFrame, text_col: str = "text", n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the whole table fall into each bucket (``buckets`` numbers reach the driver)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = _texts(batch.column(0))
            for lo, hi in chunks(texts):
                total += np.bincount(features(texts[lo:hi], n, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    texts = df.select(F.col(f"`{text_col}`").cast("string")).where(F.col(f"`{text_col}`").isNotNull())
    out = np.zeros(buckets, np.int64)
    for b, c in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[b] = c
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down."""
    k, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(t) + 1) * (s_all + k) / ((int(s) + 1) * (t_all + k))))
                     for s, t in zip(corpus, target)], np.int64)


def weights(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n: int = 1) -> DataFrame:
    """id, tie, n_words, n_features, weight of every row."""
    buckets = len(gain)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("tie"),
                     F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(2))
            words, number, weight = [], [], []
            for lo, hi in chunks(texts):
                doc, bucket, w = features(texts[lo:hi], n, buckets)
                count = np.bincount(doc, minlength=hi - lo)
                total = np.rint(np.bincount(doc, weights=gain[bucket], minlength=hi - lo)).astype(np.int64)
                words.append(w)
                number.append(count)
                weight.append(np.floor_divide(total, np.maximum(count, 1)))
            if texts:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[
                    pa.array(np.concatenate(c).astype(np.int64)) for c in (words, number, weight)]],
                    ["id", "tie", "n_words", "n_features", "weight"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, tie long, n_words long, n_features long, weight long")


def noise(id_: Column, seed: str) -> Column:
    """Thousandths of a Gumbel draw from the id, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000.0 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


#: Order of drawing; the columns of ``weights`` with score and row.
ORDER = [F.desc, F.asc_nulls_last, F.asc, F.asc, F.asc]
KEYS = ["score", "id", "n_features", "tie", "row"]


def _order() -> list[Column]:
    return [how(c) for how, c in zip(ORDER, KEYS)]


def ranked(rows: DataFrame) -> DataFrame:
    """Rows with their place from 1 in the order of drawing: range partitions, counted, then numbered one by one."""
    n = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialize(rows.repartitionByRange(n, *_order()).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)         # at most n rows
    offsets = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("c")).select(
        "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*_order()))
    return dealt.withColumn("rank", place).join(F.broadcast(offsets), "part").withColumn(
        "rank", F.col("rank") + F.col("before")).drop("part", "before")


def bracket(rows: DataFrame, m: int, n: int, margin: float = 2.0 / SKETCH, accuracy: int = SKETCH) -> tuple[int, int, int]:
    """(low, high, above): the m-th highest of n scores lies in [low, high], and ``above`` scores are higher.

    The sketch proposes the range; exact counts decide, and a range that fails is widened."""
    while True:
        ends = [min(max(1 - m / n + d, 0.0), 1.0) for d in (-margin, margin)]
        low, high = rows.agg(F.percentile_approx("score", ends, accuracy)).first()[0]
        if margin >= 1:
            low, high = rows.agg(F.min("score"), F.max("score")).first()
        above, reach = rows.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score") >= low)).first()
        if above < m <= reach:
            return low, high, above
        margin *= 8


def draw(scored: DataFrame, m: int, n: int) -> Column:
    """Whether a row of the stored table is among the first m in the order of drawing."""
    low, high, above = bracket(scored, m, n)
    cut = ranked(scored.where(F.col("score").between(low, high))).where(F.col("rank") == m - above).first()
    ahead, tied = F.lit(False), F.lit(True)
    for c in KEYS:
        mine, last = F.col(c), F.lit(cut[c]).cast(scored.schema[c].dataType)
        if c == "score":
            before = mine > last
        elif cut[c] is None:
            before = mine.isNotNull()                 # nulls come last
        else:
            before = F.coalesce(mine < last, F.lit(False))
        ahead, tied = ahead | (tied & before), tied & mine.eqNullSafe(last)
    return ahead | tied


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, n: int = 1, buckets: int = BUCKETS,
             seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; rank is null for rows that are not drawn."""
    gain = gains(bucket_counts(docs, text_col, n, buckets), bucket_counts(target, target_text_col, n, buckets))
    scored = materialize(weights(docs, gain, id_col, text_col, n).withColumn(
        "score", F.col("weight") + noise(F.col("id"), seed)).withColumn("row", F.monotonically_increasing_id()))
    able = scored.where(F.col("n_words") >= min_words)
    total = able.count()
    m = total * percent // 100
    shown = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not m:
        return scored.select(*shown, none)
    drawn = (F.col("n_words") >= min_words) & draw(able, m, total)
    return ranked(scored.where(drawn)).select(*shown, F.col("rank").cast("long").alias("rank")).union(
        scored.where(~drawn).select(*shown, none))
