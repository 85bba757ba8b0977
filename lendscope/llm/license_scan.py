"""License scans: an exact set-similarity join of text blocks with license templates.

A block (a line of a text) matches a template when it holds at least ``threshold`` of the
template's distinct words.  Words are put in one global order, rarest in the corpus first; a
matching block must hold one of the first |T| - need + 1 words of the template (prefix), have
``need`` template words at all (length), and, at a shared prefix word with i and j words before
it in the two lists, min(|T| - i, |B| - j) of them must still be able to reach ``need``
(position).  Candidates are verified by the exact overlap.  Only a block's words that occur in
some template matter, so lists stay short however long the block is.

The vocabulary and the templates are settings of at most MAX_TEMPLATES rows; they go into the
plan as literals or hinted broadcasts.  Corpus frequencies come from all rows.

Defined results: a null or empty text has no words and no matches; a text is never cut; rows that
repeat doc_id and text get equal results; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import ascii_lower, n_words, same, text_key, words

MAX_TEMPLATES = 1000
THRESHOLD = 0.8

# Base phrases and labels (fixed by the result contract).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Well-known license sentences: label, text.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License "
               "is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def blocks(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[str]) -> DataFrame:
    """id, key, block, toks: the distinct template words of every block that has any."""
    vocab = F.array(*map(F.lit, vocabulary))
    lines = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"),
                        F.posexplode(F.split(ascii_lower(F.col(text_col)), "\n")).alias("block", "line"))
    return lines.select("id", "key", "block",
                        F.array_intersect(words(F.col("line")), vocab).alias("toks")).where(F.size("toks") > 0)


def template_rows(docs: DataFrame, templates) -> DataFrame:
    """template, label, toks of each template."""
    spark = docs.sparkSession
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    rows = spark.createDataFrame([(i, lab, t) for i, (lab, t) in enumerate(templates)],
                                 "template int, label string, text string")
    return rows.select("template", "label", F.array_distinct(words(F.col("text"))).alias("toks")).where(
        F.size("toks") > 0)


def matches(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key, block, template, label, containment of every match."""
    temps = template_rows(docs, templates)
    listed = temps.collect()                       # settings, at most MAX_TEMPLATES rows
    vocabulary = sorted({w for t in listed for w in t["toks"]})
    found = blocks(docs, id_col, text_col, vocabulary)

    # global order: blocks of the whole corpus that hold each template word, rarest first
    counted = found.select(F.explode("toks").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    df = {r["w"]: r["n"] for r in counted.collect()}   # at most one row per template word
    order = sorted(vocabulary, key=lambda w: (df.get(w, 0), w))
    ranked = F.array(*map(F.lit, order))

    rank = {w: i for i, w in enumerate(order)}
    prefix = []
    for t in listed:
        toks = sorted(t["toks"], key=rank.__getitem__)
        need = math.ceil(threshold * len(toks) - 1e-9)
        prefix += [(w, i, t["template"], t["label"], toks, len(toks), need)
                   for i, w in enumerate(toks[:len(toks) - need + 1])]
    prefixes = docs.sparkSession.createDataFrame(
        prefix, "w string, i int, template int, label string, t_toks array<string>, t_size int, need int")
    prefix_words = F.array(*map(F.lit, sorted({p[0] for p in prefix})))
    least = min((p[6] for p in prefix), default=1)

    ordered = (found.where((F.size("toks") >= least) & F.arrays_overlap("toks", prefix_words))
               .withColumn("toks", F.array_intersect(ranked, F.col("toks"))))
    return (ordered.select("id", "key", "block", "toks", F.posexplode("toks").alias("j", "w"))
            .join(F.broadcast(prefixes), "w")
            .where((F.size("toks") >= F.col("need"))
                   & (F.least(F.col("t_size") - F.col("i"), F.size("toks") - F.col("j")) + F.least("i", "j")
                      >= F.col("need")))
            .withColumn("common", F.size(F.array_intersect("toks", "t_toks")))
            .where("common >= need")
            .groupBy("id", "key", "block", "template", "label")
            .agg((F.max("common") / F.max("t_size")).alias("containment")))


def phrase_places(ws: Column, phrase: str) -> Column:
    """Starts of the places where the phrase's words stand consecutively."""
    parts = phrase.split(" ")

    def at(_, i):
        cond = F.lit(True)
        for k, p in enumerate(parts):
            cond = cond & F.coalesce(F.get(ws, i + k) == p, F.lit(False))
        return F.when(cond, i)

    return F.filter(F.transform(ws, at), lambda x: x.isNotNull())


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1.0 with a base place, else the best containment of a matching template, else 0.
    """
    text = F.col(text_col)
    has = F.coalesce(text.rlike("(?i)license"), F.lit(False))
    base = docs.select(F.col(id_col).alias("id"), text_key(text).alias("key"), n_words(text).alias("n_words"),
                       F.when(has, words(text)).alias("ws"))
    base = base.select("id", "key", "n_words",
                       *(F.when(F.col("ws").isNotNull(), phrase_places(F.col("ws"), p)).alias(lab)
                         for p, lab in BASE))
    places = F.flatten(F.array(*(F.coalesce(F.col(lab), F.array().cast("array<int>")) for _, lab in BASE)))
    base = base.select("id", "key", "n_words", places.alias("places"),
                       F.array_compact(F.array(*(F.when(F.size(lab) > 0, F.lit(lab)) for _, lab in BASE))).alias("bl"))

    found = matches(docs, templates, threshold, id_col, text_col).groupBy(
        F.col("id").alias("mid"), F.col("key").alias("mkey")).agg(
        F.collect_set("label").alias("ml"), F.max("containment").alias("best"))
    out = base.join(found, same(F.col("id"), F.col("mid")) & (F.col("key") == F.col("mkey")), "left")
    n_base = F.size("places")
    return out.select(
        F.col("id").alias(id_col), "n_words", n_base.cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("bl"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("bl", F.coalesce("ml", F.array().cast("array<string>")))), ",")
        .alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
