"""Rows of vectors in blocks: every query row meets every candidate row, best scores first.

Candidates are dealt by a hash of their row into slices of bounded size, queries into blocks.
Each query block is sent to each slice (an equi-join on the slice number, so Spark shuffles and
retries the work), one task scores a block against a slice, and only the best few rows of each
ask leave it.  An ask is a query row with a range of scores.  A part of the slices runs first;
the k-th best score found there is a lower bound that lets the other slices send almost nothing.

Defined results, for all operators on these blocks: vectors that are null or hold a null or
non-finite component (256 times the component must be finite, too) take no part.  Components
become floor(256 * x).  Only vectors of equal length meet.  A row never meets itself, but rows that
repeat an id are different rows.  An id that is null or cannot be cast to a long is null: such a row is
a candidate, never a query, and comes last among ties; ties of equal ids go by row.  Scores outside the
range of a long are set to its ends.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendscope.llm.common import materialize

SCALE = 256.0
BLOCK_ROWS = 8192            # rows of a slice or query block at most, on average
BLOCK_VALUES = 1 << 20       # components of one at most, on average
LEAST_ROWS = 512             # smaller slices aren't made for the sake of parallel tasks
CHUNK = 512                  # candidates scored at once
LEAST, MOST = -(1 << 63), (1 << 63) - 1
NO_ID = MOST

FOUND = "q_row long, q_id long, ask int, c_row long, c_id long, score long"

#: scores(queries, candidates, lowest) -> int64 matrix; a score below a query's ``lowest`` may be given as LEAST
Scorer = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def valid_rows(df: DataFrame, id_col: str, vector_col: str, label=None) -> DataFrame:
    """row, id, label, v of the rows that take part; v holds whole numbers as doubles."""
    y = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * F.lit(SCALE))
    finite = F.forall(y, lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf)) & ~F.isnan(x))
    whole = F.transform("y", lambda x: F.when(F.abs(x) < F.lit(2.0 ** 52), F.floor(x).cast("double")).otherwise(x))
    label = F.lit(None).cast("long") if label is None else label
    return (df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).try_cast("long").alias("id"),
                      label.alias("label"), F.when(finite, y).alias("y"))
            .where("y is not null").select("row", "id", "label", whole.alias("v")))


def slices(rows: DataFrame) -> DataFrame:
    """The stored candidates: slice, row, id, label, v (arrays), about BLOCK_ROWS rows or BLOCK_VALUES components each."""
    spark = rows.sparkSession
    n, values = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0))).first()
    least = min(math.ceil(n / LEAST_ROWS), 2 * spark.sparkContext.defaultParallelism)
    return _grouped(rows, "slice", max(1, least, _blocks(n, values)))


def _blocks(n: int, values: int) -> int:
    return max(math.ceil(n / BLOCK_ROWS), math.ceil(values / BLOCK_VALUES))


def _grouped(rows: DataFrame, name: str, n: int, *more: str) -> DataFrame:
    fields = ["row", "id", "label", "v", *more]
    return materialize(rows.groupBy(F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias(name))
                       .agg(F.collect_list(F.struct(*fields)).alias("x")).select(name, *[F.col(f"x.{f}").alias(f) for f in fields]))


def queries(table: DataFrame, divisor: int) -> DataFrame:
    """The stored rows of the slices whose id is divisible by ``divisor``."""
    zipped = F.explode(F.arrays_zip("row", "id", "label", "v"))
    return materialize(table.select(zipped.alias("x")).select("x.*").where(F.col("id") % divisor == 0))


def one_ask(rows: DataFrame) -> DataFrame:
    """One ask a row, for any score."""
    return rows.select("row", F.lit(0).alias("ask"), F.lit(LEAST + 1).alias("low"), F.lit(MOST).alias("high"))


def search(rows: DataFrame, asks: DataFrame, table: DataFrame, scorer: Scorer, k: int, labels: str = "any") -> DataFrame:
    """The first ``k`` candidates of each ask, with their rank (FOUND and rank); stored.

    ``rows``: stored queries (row, id, label, v); ``asks``: row, ask, low, high; ``table``: slices.
    ``labels``: candidates of "any", the "same" or a "different" label."""
    n = table.agg(F.max("slice")).first()[0]
    if n is None or rows.isEmpty():
        return _ranked(rows.sparkSession.createDataFrame([], FOUND), k)
    step = math.isqrt(n) + 1
    sizes = rows.agg(F.count(F.lit(1)), F.sum(F.size("v").cast("long"))).first()

    def best(these: DataFrame, pilot: bool) -> DataFrame:
        blocks = _grouped(rows.join(these.groupBy("row").agg(F.collect_list(F.struct("ask", "low", "high")).alias("asks")), "row"),
                          "block", max(1, _blocks(*sizes)), "asks")
        numbers = F.filter(F.sequence(F.lit(0), F.lit(n)), lambda s: (s % step == 0) == F.lit(pilot))
        sent = blocks.select(F.explode(numbers).alias("slice"), *[F.col(c).alias(f"q_{c}") for c in ("row", "id", "label", "v", "asks")])
        # Spark's estimate does not know how often a block is sent, so it may not pick a broadcast here
        return sent.hint("merge").join(table, "slice").drop("slice").mapInArrow(_task(scorer, k, labels), FOUND)

    first = _ranked(best(asks, True), k)
    if step == 1:
        return first
    bound = first.where(F.col("rank") == k).select(F.col("q_row").alias("row"), "ask", F.col("score").alias("reached"))
    rest = asks.join(bound, ["row", "ask"], "left").select(
        "row", "ask", F.greatest("low", F.coalesce("reached", "low")).alias("low"), "high")
    return _ranked(first.drop("rank").union(best(rest, False)), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q_row", "ask").orderBy(F.desc("score"), F.asc_nulls_last("c_id"), "c_row")
    return materialize(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


def _task(scorer: Scorer, k: int, labels: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {f: batch.column(j)[i].values for j, f in enumerate(batch.schema.names)}
                yield from _block(cell, scorer, k, labels)
    return run


def _longs(a: pa.Array, null: int) -> np.ndarray:
    return a.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def _matrices(v: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> positions, matrix of the vectors of that length."""
    ends = v.offsets.to_numpy()
    flat, size = v.values.to_numpy(zero_copy_only=False), np.diff(ends)
    return {int(d): (at, flat[ends[at][:, None] + np.arange(d)[None, :]])
            for d in np.unique(size) for at in [np.flatnonzero(size == d)]}


def _block(cell: dict, scorer: Scorer, k: int, labels: str) -> Iterator[pa.RecordBatch]:
    """The best candidates of one slice for the asks of one query block."""
    q_row, q_id, q_label = _longs(cell["q_row"], 0), _longs(cell["q_id"], NO_ID), cell["q_label"]
    c_row, c_id, c_label = _longs(cell["row"], 0), _longs(cell["id"], NO_ID), cell["label"]
    low, high, number = _asks(cell["q_asks"])
    there = _matrices(cell["v"])
    for d, (qs, qv) in _matrices(cell["q_v"]).items():
        if d not in there:
            continue
        cs, cv = there[d]
        lo, hi = low[qs].copy(), high[qs]
        best = np.full((*lo.shape, k), LEAST, np.int64)
        held: list[np.ndarray] = [np.zeros((4, 0), np.int64)]       # query, ask, candidate, score
        for at in range(0, len(cs), CHUNK):
            part = cs[at:at + CHUNK]
            s = scorer(qv, cv[at:at + CHUNK], lo.min(1))
            s[q_row[qs][:, None] == c_row[part][None, :]] = LEAST
            if labels != "any":
                equal = _longs(q_label, LEAST)[qs][:, None] == _longs(c_label, MOST)[part][None, :]
                s[equal != (labels == "same")] = LEAST
            for j in range(lo.shape[1]):
                t = np.where((s >= lo[:, j, None]) & (s <= hi[:, j, None]), s, LEAST)
                if (t.max(1, initial=LEAST) == LEAST).all():
                    continue
                both = np.concatenate([best[:, j], t], 1)
                best[:, j] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                lo[:, j] = np.maximum(lo[:, j], best[:, j].min(1))
                q, c = np.nonzero((t >= lo[:, j, None]) & (t > LEAST))
                held.append(np.stack([q, np.full_like(q, j), part[c], t[q, c]]))
            held = [_first(np.concatenate(held, 1), c_id, c_row, k)]
        q, j, c, s = held[0]
        q = qs[q]
        ids = pa.array(c_id[c], mask=c_id[c] == NO_ID)
        yield pa.RecordBatch.from_arrays([pa.array(q_row[q]), pa.array(q_id[q]), pa.array(number[q, j].astype(np.int32)),
                                          pa.array(c_row[c]), ids, pa.array(s)], [f.split()[0] for f in FOUND.split(", ")])


def _asks(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """low, high and ask number by query and place; unused places have an empty range."""
    ends = lists.offsets.to_numpy()
    size = np.diff(ends)
    width = max(1, int(size.max(initial=0)))
    x = lists.values.flatten()
    place = np.arange(width)[None, :] < size[:, None]
    out = []
    for a, unused in ((x[1], MOST), (x[2], LEAST), (x[0], 0)):
        m = np.full((len(size), width), unused, np.int64)
        m[place] = _longs(a, 0)[ends[0]:ends[-1]]
        out.append(m)
    return out[0], out[1], out[2]


def _first(held: np.ndarray, c_id: np.ndarray, c_row: np.ndarray, k: int) -> np.ndarray:
    """The first k of each query and ask: highest score, then smallest id, then row."""
    q, j, c, s = held
    order = np.lexsort((c_row[c], c_id[c], -np.maximum(s, LEAST + 1), j, q))
    held = held[:, order]
    new = np.ones(len(order), bool)
    new[1:] = (held[0, 1:] != held[0, :-1]) | (held[1, 1:] != held[1, :-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return held[:, np.arange(len(order)) - start < k]


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in doubles where these are exact, else in Python's integers."""
    if _largest(q) * _largest(x) * max(1, q.shape[1]) < 2.0 ** 53:
        return (q @ x.T).astype(np.int64)
    return clipped(integers(q) @ integers(x).T)


def integers(a: np.ndarray) -> np.ndarray:
    out = np.empty(a.shape, object)
    out.flat = [int(v) for v in a.flat]
    return out


def clipped(a: np.ndarray) -> np.ndarray:
    """Python's integers as longs; LEAST itself means "no score" here."""
    return np.array([min(max(int(v), LEAST + 1), MOST) for v in a.flat], np.int64).reshape(a.shape)


def _largest(a: np.ndarray) -> float:
    return float(np.abs(a).max(initial=0.0))
