"""The pipeline's stages on awkward rows, and its queries in the entry file."""

import base64
import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import fixtures as X  # noqa: E402
from test_operators import brute_hits, brute_join  # noqa: E402

import corpus_pipeline as C


def tables(spark, path, rows):
    X.docs(spark, rows).write.parquet(f"{path}/documents.parquet")
    X.bench(spark, [x for x in X.ITEMS if x[0] is not None]).write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (17, 0, 0), (18, 0, 1), (103, 1, 0), (104, 0, 0), (105, 1, 0)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, tmp_path):
    sf = tables(spark, tmp_path, X.texts())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = dict(C.STAGES)
    assert list(steps) == ["language_id", "near_duplicates", "benchmark_decontamination", "mix_sources", "shards"]

    first = steps["language_id"](spark, docs, sf)
    assert first.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in first.collect()} == {6, 7, 8, 9, 10}

    second = steps["near_duplicates"](spark, docs, sf)
    comp = brute_join(X.texts())
    assert {r.doc_id for r in second.collect()} - {None} == {i for i, (_, c) in comp.items() if i == c}

    third = steps["benchmark_decontamination"](spark, docs, sf)
    items = [x for x in X.ITEMS if x[0] is not None]
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in third.collect()} == {i for i, t in X.texts() if brute_hits(t, items)[-1]}

    fourth = steps["mix_sources"](spark, docs, sf)
    assert fourth.columns == docs.columns
    last = steps["shards"](spark, fourth, sf)
    assert last.count() == fourth.count() and {"doc_id", "shard", "slot"} <= set(last.columns)


def test_language_id_rejects_junk(spark):
    rnd = random.Random(2)
    words = {"en": "the quick thing over that with which there and she from have this would".split(),
             "de": "der und nicht eine schön über auch werden durch ich wir haben mit noch".split()}
    clean = [(i, " ".join(rnd.choice(words["de" if i % 2 else "en"]) for _ in range(rnd.randint(15, 120))), "de" if i % 2 else "en")
             for i in range(600)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    junk = ["z" * 300, "q" * 100, "".join(rnd.choice(letters) for _ in range(400)),
            " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 9))) for _ in range(60)),
            base64.b64encode(rnd.randbytes(300)).decode(), "съешь ещё этих мягких французских булок да выпей же чаю " * 3]
    docs = spark.createDataFrame(clean + [(1000 + i, t, None) for i, t in enumerate(junk)], "doc_id long, text string, lang string")
    got = {r.doc_id for r in C.language_id(spark, docs, "").collect()}
    assert not got & set(range(1000, 1000 + len(junk))) and got == set(range(600))


def test_run_and_empty(spark, tmp_path):
    sf = tables(spark, tmp_path / "a", X.texts())
    got = C.run(spark, sf).collect()
    assert got and all(0 <= r.shard < 24 for r in got)
    assert C.run(spark, tables(spark, tmp_path / "b", [])).count() == 0


def test_registered():
    import __spark_entry__ as E
    names = [n for n in E.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()


def test_a_stage_run_by_itself_sends_small_batches(spark, tmp_path):
    """A stage that is not run through ``queries()`` must not send Spark's 10,000 whole texts at a time to a worker."""
    import pandas as pd
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    sf = tables(spark, tmp_path, X.texts())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = spark.conf.get(size)

    def lengths(batches):
        for b in batches:
            yield pd.DataFrame({"n": [len(b)]})

    try:
        for name, step in C.STAGES:
            spark.conf.set(size, "10000")
            step(spark, docs, sf)
            sent = spark.range(0, 9000, 1, 1).mapInPandas(lengths, "n long").collect()
            assert max(r["n"] for r in sent) <= 2000, name
    finally:
        spark.conf.set(size, before)
