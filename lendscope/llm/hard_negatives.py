"""Hard-negative mining with Kronecker-packed products.

The components of several candidates are biased to be nonnegative and put into separated fields of
one wide integer, one integer for each component.  One multiplication by an anchor's component
serves all of them; the sum over the components holds, field by field, the candidates' products.
A field is wide enough for the largest sum of the block, and a constant in every field keeps sums
nonnegative, so no field borrows from its neighbour and the unpacked scores are exact.  Fields go
into 64-bit integers; where one field does not fit, into Python's integers.

First pass: each anchor's best rows of its own label.  Second pass: for each of these, the best
rows of other labels with a score from ``share`` of the positive's to the positive's.  Blocks,
slices and defined results: ``vector_blocks``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm import vector_blocks as vb

WORD_BITS = 63               # the sign of a 64-bit integer stays free
WIDE_FIELDS = 8              # candidates in one of Python's integers


def packed_products(q: np.ndarray, x: np.ndarray, lowest: np.ndarray | None = None) -> np.ndarray:
    """Inner products of whole numbers, several candidates for each multiplication."""
    if not q.shape[1] or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    bias = -int(min(x.min(), 0))
    reach = _total(q) * (int(x.max()) + bias)          # no sum of a field is larger, in absolute value
    bits = (2 * reach + 1).bit_length()
    fields, kind = (WORD_BITS // bits, np.int64) if bits <= WORD_BITS else (WIDE_FIELDS, object)
    whole = (lambda a: a.astype(np.int64)) if kind is np.int64 else vb.integers
    groups = -(-len(x) // fields)
    biased = np.zeros((groups * fields, x.shape[1]), kind)
    biased[:len(x)] = whole(x) + bias
    biased = biased.reshape(groups, fields, -1)
    shifts = [bits * f for f in range(fields)]
    words = sum(biased[:, f] * (1 << s) for f, s in enumerate(shifts))
    anchors = whole(q)
    total = anchors @ words.T + sum(reach << s for s in shifts)      # nonnegative in every field
    mask = (1 << bits) - 1
    out = np.stack([(total >> s) & mask for s in shifts], axis=2).reshape(len(q), -1)[:, :len(x)]
    out = out - reach - bias * anchors.sum(1)[:, None]
    return out if kind is np.int64 else vb.clipped(out)


def _total(q: np.ndarray) -> int:
    """Largest sum of absolute components of an anchor."""
    sums = np.abs(q).sum(1)
    return int(sums.max()) if sums.max() < 2.0 ** 52 else max(sum(abs(int(v)) for v in row) for row in q)


def flipped(label: Column, vec_id: Column, every: int, classes: int) -> Column:
    """Labels with noise: rows whose id is divisible by ``every`` get the next label."""
    label = label.cast("long")
    return F.when(F.coalesce(vec_id % every == 0, F.lit(False)), (label + 1) % classes).otherwise(label)


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 5, divisor: int = 100, share: tuple[int, int] = (80, 100),
         noise: tuple[int, int] | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``divisor``.  A negative's score lies between
    share[0] / share[1] of the positive's and the positive's itself, so a positive with a score
    below 0 has none.  ``noise``: (every, classes) of ``flipped``.  Rows without a label take no part."""
    label, vec_id = F.col(label_col).try_cast("long"), F.col(id_col).try_cast("long")
    label = flipped(label, vec_id, *noise) if noise else label
    table = vb.slices(vb.valid_rows(vectors.where(F.col(label_col).try_cast("long").isNotNull()), id_col, vector_col, label))
    anchors = vb.queries(table, divisor)
    near = vb.search(anchors, vb.one_ask(anchors), table, packed_products, positives, labels="same")
    asks = near.where("score >= 0").select(F.col("q_row").alias("row"), F.col("rank").cast("int").alias("ask"),
                                           _least_of("score", share).alias("low"), F.col("score").alias("high"))
    found = vb.search(anchors, asks, table, packed_products, negatives, labels="different")
    pairs = near.select("q_row", F.col("rank").cast("int").alias("ask"), F.col("c_id").alias("positive_id"),
                        F.col("score").alias("positive_score"))
    return found.join(pairs, ["q_row", "ask"]).select(
        F.col("q_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("c_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _least_of(score: str, share: tuple[int, int]) -> Column:
    """ceil(score * share[0] / share[1]) for scores from 0, without a product beyond a long."""
    a, b = share
    return F.expr(f"{score} div {b}L * {a}L + ({score} % {b}L * {a}L + {b - 1}L) div {b}L")
