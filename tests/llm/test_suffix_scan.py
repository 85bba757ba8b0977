"""The anchors of a text are looked for once."""

import random

from lendscope.llm import suffix_dedup as sd


def test_anchors_are_found_once(spark, monkeypatch):
    seen, real = [], sd.materialize
    monkeypatch.setattr(sd, "materialize", lambda df, *a: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df, *a))[1])
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400))
    docs = spark.createDataFrame([(1, text + "-" + text), (2, "x" * 50 + text), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in sd.dedup(docs).collect()}
    assert sum("_find_anchors" in p for p in seen) == 1
    assert got == {1: 400, 2: 400, 3: 0}
