"""Mixing to target weights with soft domain membership.

1. A classifier (multinomial logistic regression on hashed words, ``pyspark.ml``) learns the
   domains of labelled rows and gives every document a posterior over the domains.
2. Rates: document i is to be used r_i >= 0 times.  With shares a_i = tokens_i / all tokens, the
   expected share of domain d is sum_i a_i p_id r_i; e is the residual, these shares less the targets.
   Projected gradient descent (accelerated, started again when the sum rises) from r = 1 minimises
   1/2 e . W e over r >= 0, W being the inverse of G = sum_i a_i p_i p_i' over all rows.  Where the
   targets can be reached e is 0 there, whatever W is; W makes rare domains and domains that are hard to
   tell apart converge like the others, and 1 a safe step (no set of rows with r > 0 curves more than G).
   With steps measured in the weights a_i, the gradient of document i is p_i . W e - a handful of
   numbers for all documents.  So a step is one aggregate over the stored (tokens, posterior) table, and
   a document's rate follows from the residuals so far: no state is written between steps, and only
   the residuals pass through the driver.  The steps end when every domain is within CLOSE of its
   target, relative to it, or, where no rates reach the targets, when the sum hardly falls in PATIENCE steps.
3. Copies: floor(r_i + u_i) with u_i a hash of the document, so expected tokens stay as fitted.

Fit bound: at most about SAMPLE labelled rows, chosen by a hash of their id; token counts,
posteriors and sums cover all rows.

Defined results: null and empty texts have no tokens and the prior as posterior; their rate is fitted like any
other but adds nothing.  Rows that are labelled twice count twice in fitting.  A label of null, or of a document
that is not there, is left out.  Without labels all domains are equally likely.  A domain nobody is labelled with
has posterior 0.  Empty tables give empty results.  Rows keep their multiplicity in ``rates``; extra columns are
ignored (``mix`` keeps them).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import materialize, text_key

#: Target token shares of the three domains that the labels table tells apart.
TARGETS = {"low": 0.10, "high": 0.85, "toxic": 0.05}
SAMPLE = 4000
FEATURES = 1 << 12
STEPS = 200
CLOSE = 1e-4
PATIENCE = 20
FALL = 1e-3                       # of the sum, at least, in PATIENCE steps


def label_domain(labels: DataFrame) -> DataFrame:
    """doc_id, domain: toxic rows, then high and low quality ones."""
    domain = (F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low"))
    return labels.select("doc_id", domain.alias("domain")).where(F.col("domain").isNotNull())


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def _features(df: DataFrame) -> DataFrame:
    counted = HashingTF(numFeatures=FEATURES, inputCol="toks", outputCol="tf").transform(df)
    return Normalizer(inputCol="tf", outputCol="features").transform(counted)


def fit_domains(docs: DataFrame, labelled: DataFrame, names: list[str], sample: int = SAMPLE,
                id_col: str = "doc_id", text_col: str = "text") -> LogisticRegressionModel | int | None:
    """Classifier of ``names``; the index of the only labelled domain; or None without labels."""
    known = F.element_at(F.create_map(*(v for i, n in enumerate(names) for v in (F.lit(n), F.lit(float(i))))), F.col("domain"))
    own = labelled.where(F.col("domain").isin(names)).withColumn("label", known)
    share = int(min(1.0, sample / max(1, own.count())) * (1 << 30))
    drawn = own.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) < share).select(
        F.col("doc_id").alias("__id"), "label")
    # about ``sample`` rows whatever the input, hence the broadcast
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(drawn), F.col("id") == F.col("__id")).select("label", tokens(F.col("text")).alias("toks"))
    train = materialize(_features(train).select("label", vector_to_array("features").alias("f")))
    seen = sorted(int(r["label"]) for r in train.select("label").distinct().collect())
    if len(seen) < 2:
        return seen[0] if seen else None
    from pyspark.ml.functions import array_to_vector
    return LogisticRegression(maxIter=20, regParam=1e-3, family="multinomial").fit(
        train.select("label", array_to_vector("f").alias("features")))


def posteriors(docs: DataFrame, model: LogisticRegressionModel | int | None, names: list[str], text_col: str = "text",
               id_col: str = "doc_id") -> DataFrame:
    """row (the whole input row), id, key, tokens, p (array in the order of ``names``) of every row; no shuffle."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"),
                       text_key(F.col(text_col)).alias("key"), tokens(F.col(text_col)).alias("toks"))
    rows = rows.withColumn("tokens", F.size("toks").cast("long"))
    if model is None or isinstance(model, int):
        p = F.array(*(F.lit(1.0 / len(names) if model is None else float(i == model)) for i in range(len(names))))
        return rows.select("row", "id", "key", "tokens", p.alias("p"))
    # no lambda around the probabilities: it would run the model anew for every domain
    missing = F.array_repeat(F.lit(0.0), len(names) - model.numClasses)
    padded = F.concat(vector_to_array("probability"), missing)
    return model.transform(_features(rows)).select("row", "id", "key", "tokens", padded.alias("p"))


def _folded(p: np.ndarray, slopes: list[list[float]], step: float, pull: float = 0.0,
            restarts: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
    """(rates, extrapolated rates) of rows with posteriors p after steps with these slopes by domain.

    ``pull`` holds the rates near 1; the momentum begins anew at the steps in ``restarts``."""
    r = y = np.ones(len(p))
    k = 0
    for i, e in enumerate(slopes):
        k = 0 if i in restarts else k
        new = np.maximum(0.0, y - step * (p @ np.array(e) + pull * (y - 1.0)))
        r, y = new, new + k / (k + 3.0) * (new - r)
        k += 1
    return r, y


def _gram(flat: DataFrame, names: list[str], total: float) -> np.ndarray:
    """Sum of a_i p_i p_i' over all rows."""
    k = len(names)
    got = flat.agg(*(F.sum(F.col("tokens") * F.col(a) * F.col(b)) for a in names for b in names)).first()
    return np.array([round((v or 0.0) / total, 12) for v in got]).reshape(k, k)


def fit_rates(stored: DataFrame, targets: list[float], steps: int = STEPS, close: float = CLOSE) -> Callable[[Column], Column]:
    """From the column of posteriors to the column of rates, fitted to ``stored`` (tokens, p)."""
    total = float(stored.agg(F.sum("tokens")).first()[0] or 0)
    if total == 0:
        return lambda p: F.lit(1.0)
    names = [f"d{d}" for d in range(len(targets))]
    flat = stored.select("tokens", *(F.get("p", F.lit(d)).alias(n) for d, n in enumerate(names)))
    # directions that no posterior tells apart, such as a domain nobody has, stay out
    metric = np.linalg.pinv(_gram(flat, names, total), rcond=1e-7, hermitian=True)
    slopes: list[list[float]] = []
    sums: list[float] = []
    restarts: frozenset[int] = frozenset()
    for n in range(steps):
        def expected(batches: Iterator[pd.DataFrame], so_far=tuple(slopes), anew=restarts) -> Iterator[pd.DataFrame]:
            for b in batches:
                p = b[names].to_numpy()
                _, y = _folded(p, list(so_far), 1.0, restarts=anew)
                yield pd.DataFrame([(b["tokens"].to_numpy() * y) @ p], columns=names)

        got = flat.mapInPandas(expected, ", ".join(f"{c} double" for c in names)).agg(
            *(F.sum(c).alias(c) for c in names)).first()
        # rounded, so that the order of a parallel sum does not show in later steps
        e = np.array([round((got[c] or 0.0) / total - t, 9) for c, t in zip(names, targets)])
        if sums and e @ metric @ e > sums[-1]:
            restarts |= {n}
        sums.append(float(e @ metric @ e))
        slopes.append([float(v) for v in metric @ e])
        if (np.abs(e) <= close * np.array(targets) + 1e-9).all():
            break
        if n >= PATIENCE and min(sums[-PATIENCE:]) > (1 - FALL) * min(sums[:-PATIENCE]):
            break

    @F.pandas_udf("double")
    def rate(p: pd.Series) -> pd.Series:
        return pd.Series(_folded(np.stack(p.to_numpy()), slopes, 1.0, restarts=restarts)[0] if len(p) else [], dtype=float)

    return rate


def fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id",
           text_col: str = "text") -> tuple[DataFrame, Callable, LogisticRegressionModel | int | None]:
    """The stored posteriors (id, key, tokens, p), the function from p to the rate, and the classifier."""
    if not targets or any(t < 0 for t in targets.values()) or sum(targets.values()) <= 0:
        raise ValueError("targets must be weights of 0 or more, one above 0")
    names, whole = list(targets), sum(targets.values())
    model = fit_domains(docs, labels, names, SAMPLE, id_col, text_col)
    stored = materialize(posteriors(docs, model, names, text_col, id_col).drop("row"))
    return stored, fit_rates(stored, [targets[n] / whole for n in names]), model


def copies(rate: Column, id_col: Column, key: Column) -> Column:
    """How often a row is used: its rate, rounded by a hash of the document."""
    u = F.pmod(F.xxhash64(F.lit("copies"), F.coalesce(id_col.cast("string"), F.lit("")), key), F.lit(1 << 40)) / float(1 << 40)
    return F.floor(rate + u).cast("int")


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, one posterior column for each domain, rate, copies of every row.

    ``labels``: doc_id, domain (see ``label_domain``)."""
    stored, rate, _ = fitted(docs, labels, targets, id_col, text_col)
    out = stored.withColumn("rate", rate(F.col("p")))
    return out.select(F.col("id").alias(id_col), F.col("tokens").alias("n_tokens"),
                      *(F.get("p", F.lit(i)).alias(f"p_{n}") for i, n in enumerate(targets)), "rate",
                      copies(F.col("rate"), F.col("id"), F.col("key")).alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id",
        text_col: str = "text") -> DataFrame:
    """``docs`` with every row repeated as often as its rate says (0 times: it goes).

    Posteriors are computed again beside the rows, which is cheaper than shuffling the texts."""
    _, rate, model = fitted(docs, labels, targets, id_col, text_col)
    out = posteriors(docs, model, list(targets), text_col, id_col).withColumn("rate", rate(F.col("p")))
    n = copies(F.col("rate"), F.col("id"), F.col("key"))
    return out.select("row", n.alias("n")).where("n > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
