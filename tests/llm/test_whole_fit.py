"""The language model and the levels of similarity come from every labelled row."""

from __future__ import annotations

import numpy as np

from lendscope.llm import kernel_langid as kl

SCHEMA = "doc_id long, text string, lang string"
A, B = "the cat sat on the mat", "der Hund und die Katze"


def rows(n, extra=()):
    return [(i, f"{A if i % 2 else B} {i}", "en" if i % 2 else "de") for i in range(n)] + list(extra)


def test_every_labelled_row_counts(spark):
    """More rows than the former sample held, all but a few of them the same: each one changes the sums."""
    data = rows(2000)
    model = kl.fit(spark.createDataFrame(data, SCHEMA), landmarks=8)
    x = kl.presence([t for _, t, _ in data])
    k = np.rint(kl.kernel(x, model.landmarks).astype(float) * kl.UNIT) / kl.UNIT
    own = np.array([v == "en" for _, _, v in data])
    sums = np.array([k[~own].sum(0), k[own].sum(0)])
    want = kl.solve(model.landmarks, ["de", "en"], np.array([1000, 1000]), k.T @ k, sums)
    assert np.allclose(model.weights, want.weights, rtol=1e-3, atol=1e-3)


def test_levels_count_every_row(spark):
    data = rows(3000)
    df = spark.createDataFrame(data, SCHEMA)
    model = kl.fit(df, landmarks=8)
    # one row in 50 is unlike the others: with all rows counted the 1 % level falls among these
    odd = [(10_000 + i, "zq" * 12, "en") for i in range(61)]
    like = model.scored(["zq" * 12])[1][0]
    assert kl.levels(spark.createDataFrame(data + odd, SCHEMA), model)[4] <= kl.MARGIN * like + 1e-6


def test_repeated_rows_and_rows_without_id(spark):
    data = [(None, A, "en")] * 1500 + [(None, B, "de")] * 1500
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r.text, r.lang_pred) for r in kl.predict(df, kl.fit(df)).select("text", "lang_pred").distinct().collect()}
    assert got == {(A, "en"), (B, "de")}
