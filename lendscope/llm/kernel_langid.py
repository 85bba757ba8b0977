"""Language identification by string-kernel ridge regression.

Kernel: blended-spectrum presence kernel.  x is the set of the 1-, 2- and 3-grams of the
lower-cased text (hashed to DIM positions); k(x, y) = |x & y| / sqrt(|x| |y|).  Nystroem: with
LANDMARKS training texts as landmarks, features are K_nm K_mm^(-1/2).  One ridge regression for
each language against the rest; the language with the largest value wins.  Whole texts are
scored in batches by two matrix products.

Fit: on every labelled row.  The landmarks are LANDMARKS of them, taken from each language in turn by a
hash of their id; then one pass over all rows adds up K_mn K_nm and K_mn of each language.  Kernel values
count in units of 1 / UNIT, so the sums are whole numbers, exact in any order.  The driver gets LANDMARKS
squared numbers and LANDMARKS for each language; the number of languages is that of the world, not of rows.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every text if
no row has a label.  Ties go to the first language in order.  Rows keep their multiplicity; an
empty table gives an empty result; only the named columns are used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM_BITS = 12
DIM = 1 << DIM_BITS
NGRAMS = 3
LANDMARKS = 128
UNIT = 1 << 16           # kernel values are summed in these units
STEPS = 1 << 12          # similarities of held-out rows are counted in these
RIDGE = 1e-2
BATCH = 256
#: Levels of similarity: from at least LEVEL_ROWS held-out rows, MARGIN times what all but LEVEL_SHARE of them reach.
LEVEL_ROWS = 20
LEVEL_SHARE = 0.01
MARGIN = 0.9
LENGTHS = 32             # classes of length: powers of two


def grams(text: str) -> np.ndarray:
    """Hashed 1- to NGRAMS-grams of a text, with repeats."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out, acc = [], np.zeros(len(cp), np.uint32)
    for n in range(1, NGRAMS + 1):
        if len(cp) < n:
            break
        acc = acc[:len(cp) - n + 1] * np.uint32(0x01000193) + cp[n - 1:] + np.uint32(n)
        h = acc * np.uint32(0x9E3779B1)
        out.append((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - DIM_BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def presence(texts) -> np.ndarray:
    x = np.zeros((len(texts), DIM), np.float32)
    for i, t in enumerate(texts):
        x[i, grams(t)] = 1.0
    return x


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.maximum(x.sum(1), 1.0))[:, None] * np.sqrt(np.maximum(landmarks.sum(1), 1.0))[None, :]
    return (x @ landmarks.T) / norm


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray    # LANDMARKS x DIM
    weights: np.ndarray      # LANDMARKS x languages: K_mm^(-1/2) times the ridge solution

    def scored(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The value of each language, and the kernel value of the nearest landmark."""
        k = kernel(presence(texts), self.landmarks)
        return k @ self.weights, k.max(1)

    def values(self, texts) -> np.ndarray:
        return self.scored(texts)[0]


def choose_landmarks(x: np.ndarray, langs: list[str], landmarks: int = LANDMARKS) -> np.ndarray:
    """The first rows in turn from each language."""
    names = sorted(set(langs))
    own = np.array([names.index(v) for v in langs])
    turns = sorted(range(len(own)), key=lambda i: (int((own[:i] == own[i]).sum()), own[i]))
    return x[turns[:landmarks]]


def solve(mark: np.ndarray, names: list[str], counts: np.ndarray, gram: np.ndarray, sums: np.ndarray, ridge: float = RIDGE) -> Model:
    """``counts``: rows of each language; ``gram``: K_mn K_nm of all rows; ``sums``: K_mn summed over each language's rows."""
    value, vector = np.linalg.eigh(kernel(mark, mark).astype(np.float64))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    right = root.T @ (2 * sums - sums.sum(0)).T            # own rows count 1, all others -1
    w = np.linalg.solve(root.T @ gram @ root + ridge * counts.sum() / len(names) * np.eye(len(root)), right)
    return Model(names, mark, (root @ w).astype(np.float32))


def has_letter(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\p{L}"), F.lit(False))


def length_class(c: Column) -> Column:
    return F.least(F.floor(F.log2(F.greatest(F.length(c), F.lit(1)))).cast("int"), F.lit(LENGTHS - 1))


def _labelled(rows: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang, draw (a hash of id and text), text of the rows with a label and a letter."""
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)), F.lit(1 << 30))
    return rows.where(F.col(lang_col).isNotNull() & has_letter(F.col(text_col))).select(
        F.col(lang_col).cast("string").alias("lang"), draw.alias("draw"), F.col(text_col).alias("text"))


def _landmarks(rows: DataFrame, draws: dict[str, int], landmarks: int) -> np.ndarray:
    """Presence rows of the landmarks: those with the smallest draws of each language in turn.

    ``draws``: about how many different ones each language has; repeated rows are one."""
    # about twice what a language can give; all of a language that has no more
    share = F.element_at(F.create_map(*(v for k, n in sorted(draws.items())
                                        for v in (F.lit(k), F.lit(int(min(1.0, (2 * landmarks + 64) / n) * (1 << 30)))))), F.col("lang"))

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), BATCH):
                part = b.iloc[at:at + BATCH]
                packed = np.packbits(presence(list(part["text"])).astype(bool), axis=1)
                yield pd.DataFrame({"lang": part["lang"].to_numpy(), "draw": part["draw"].to_numpy(),
                                    "bits": [p.tobytes() for p in packed]})

    drawn = rows.where(F.col("draw") < share).dropDuplicates(["lang", "draw"])
    got = drawn.mapInPandas(bits, "lang string, draw long, bits binary").collect()
    if not got:
        got = rows.orderBy("draw", "lang").limit(landmarks).mapInPandas(bits, "lang string, draw long, bits binary").collect()
    got = sorted(got, key=lambda r: (r["draw"], r["lang"], bytes(r["bits"])))
    x = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in got), np.uint8).reshape(len(got), -1), axis=1)
    return choose_landmarks(x.astype(np.float32), [r["lang"] for r in got], landmarks)


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        landmarks: int = LANDMARKS) -> Model | None:
    """Model of all labelled rows; None if there are none."""
    rows = _labelled(train, id_col, text_col, lang_col)
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("draw").alias("draws")).collect()
    if not found:
        return None
    counts = {r["lang"]: r["n"] for r in found}
    names = sorted(counts)
    mark = _landmarks(rows, {r["lang"]: max(1, r["draws"]) for r in found}, landmarks)
    m = len(mark)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Row i < m: row i of the gram matrix; row m + c: the sum of language c."""
        total = np.zeros((m + len(names), m), np.int64)
        for b in batches:
            own = np.array([names.index(v) for v in b["lang"]], np.int64)
            for at in range(0, len(b), BATCH):
                k = np.rint(kernel(presence(list(b["text"].iloc[at:at + BATCH])), mark).astype(np.float64) * UNIT)
                total[:m] += (k.T @ k).astype(np.int64)          # below 2^53: exact
                np.add.at(total, m + own[at:at + BATCH], k.astype(np.int64))
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": total[i, j]})

    total = np.zeros((m + len(names), m))
    got = rows.select("lang", "text").mapInPandas(add_up, "i int, j int, v long").groupBy("i", "j").agg(
        F.sum(F.col("v").cast("decimal(20,0)")).cast("double").alias("v")).toPandas()
    total[got["i"], got["j"]] = got["v"]
    return solve(mark, names, np.array([counts[c] for c in names]), total[:m] / UNIT ** 2, total[m:] / UNIT)


def levels(held: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[float]:
    """The least similarity of a text of a known language, by class of length, from all labelled rows that ``model`` has not seen.

    A class with few rows is taken together with shorter ones, whose similarities are lower; one for
    which even that gives less than LEVEL_ROWS has level 0 and rules nothing out.  Similarities are
    counted by class in STEPS steps, rounded down."""
    if model is None:
        return [0.0] * LENGTHS

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), BATCH):
                part = b.iloc[at:at + BATCH]
                like = model.scored(list(part["text"]))[1].astype(float)
                yield pd.DataFrame({"c": part["c"].to_numpy(), "step": np.floor(like * STEPS).astype(np.int32)})

    rows = _labelled(held, id_col, text_col, lang_col).select(length_class(F.col("text")).alias("c"), "text")
    # at most LENGTHS * (STEPS + 1) counts
    got = rows.mapInPandas(measure, "c int, step int").groupBy("c", "step").agg(F.count("*").alias("n")).toPandas()
    by = np.zeros((LENGTHS, max(STEPS, int(got["step"].max()) if len(got) else 0) + 1), np.int64)
    by[got["c"], got["step"]] = got["n"]
    out = []
    for c in range(LENGTHS):
        own = np.zeros(by.shape[1], np.int64)
        for k in range(c, -1, -1):
            own += by[k]
            if own.sum() >= LEVEL_ROWS:
                break
        n = int(own.sum())
        out.append(MARGIN * float(np.searchsorted(own.cumsum(), int(LEVEL_SHARE * n), "right")) / STEPS if n >= LEVEL_ROWS else 0.0)
    # similarity grows with length: no text needs more than longer ones do
    return [min(out[c:]) for c in range(LENGTHS)]


def like_known(similarity: Column, text: Column, least: list[float]) -> Column:
    """Whether a text is as similar to some landmark as texts of its length in a known language are."""
    return similarity >= F.get(F.array(*map(F.lit, least)), length_class(text))


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", lang_out: str = "lang_pred",
            score_out: str = "score", similarity_out: str | None = None) -> DataFrame:
    """``docs`` with the predicted language and, from 0 to 1, how clearly it fits (1: like a training text).

    ``similarity_out`` also names a column for the kernel value of the nearest landmark."""
    if model is None:
        more = {} if similarity_out is None else {similarity_out: F.lit(0.0)}
        return docs.withColumns({lang_out: F.lit("und"), score_out: F.lit(0.0)} | more)

    @F.pandas_udf("struct<lang string, score double, similarity double>")
    def classify(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            lang, score, near = np.full(len(s), "und", object), np.zeros(len(s)), np.zeros(len(s))
            at = np.flatnonzero(s.notna().to_numpy())
            for k in range(0, len(at), BATCH):
                own = at[k:k + BATCH]
                v, near[own] = model.scored(list(s.iloc[own]))
                best = v.argmax(1)
                lang[own] = np.array(model.langs, object)[best]
                score[own] = (np.clip(v[np.arange(len(own)), best], -1, 1) + 1) / 2
            yield pd.DataFrame({"lang": lang, "score": score, "similarity": near})

    text = F.when(has_letter(F.col(text_col)), F.col(text_col))
    more = {} if similarity_out is None else {similarity_out: F.col("__langid.similarity")}
    return (docs.withColumn("__langid", classify(text))
            .withColumns({lang_out: F.col("__langid.lang"), score_out: F.col("__langid.score")} | more).drop("__langid"))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from the rows that are not held out."""
    model = fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    return predict(rows, model).select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")
