"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage handles nulls, empty and long texts, repeated rows, empty tables and extra columns as
its operator states; all but the last return the columns of their input.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.llm import decontaminate, jaccard_join, kernel_langid, mixing, shard_tree
from lendscope.llm.common import materialize, read, same, text_key
from lendscope.llm.queries import SHARD_TREE
from lendscope.session import apply_defaults

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(fn: Stage) -> Stage:
    """A stage may be run by itself, not through ``queries()``, and its Arrow batches must be as small there."""
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        apply_defaults(spark)
        return fn(spark, docs, sf_dir)
    return run_stage


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: no letter, or too unlike all landmarks for a text of their length."""
    held = kernel_langid.held_out("doc_id")
    model = kernel_langid.fit(docs.where(~held))
    least = kernel_langid.levels(docs.where(held), model)
    out = kernel_langid.predict(docs, model, "text", "__lang", "__fit", "__like")
    known = kernel_langid.like_known(F.col("__like"), F.col("text"), least)
    return out.where((F.col("__lang") != "und") & known).select(*_columns(docs))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, the one with the smallest doc_id."""
    return jaccard_join.keep_first(docs)


@stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    found = decontaminate.hits(docs, read(spark, sf_dir, "benchmark"))
    bad = materialize(found.where(decontaminate.contaminated(F.size("covered"), F.col("total"))).select(
        F.col("id").alias("__id"), F.col("key").alias("__key")))
    has = same(F.col("doc_id"), F.col("__id")) & (text_key(F.col("text")) == F.col("__key"))
    return docs.join(decontaminate.sized(bad), has, "left_anti")


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated or dropped as their fitted rates say."""
    return mixing.mix(docs, mixing.label_domain(read(spark, sf_dir, "labels")))


@stage
def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard of every row."""
    return shard_tree.assign(docs, SHARD_TREE)


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates),
          ("benchmark_decontamination", benchmark_decontamination), ("mix_sources", mix_sources), ("shards", shards)]

#: Language identification and the classifier of the mixing stage cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = materialize(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
