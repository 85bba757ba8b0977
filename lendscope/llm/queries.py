"""The queries of this package: name -> builder, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lendscope.llm import (bloom_dedup, decontaminate, grammar_secrets, hard_negatives, importance_resampling, jaccard_join,
                           kernel_langid, license_scan, line_dedup, mixing, segment_search, shard_tree, suffix_dedup)
from lendscope.llm.common import read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: 2 regions of 3 racks of 4 shards.
SHARD_TREE = shard_tree.grid(2, 3, 4)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(read(spark, sf_dir, "documents"), mixing.label_domain(read(spark, sf_dir, "labels")))


@query
def op2_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    out = shard_tree.assign(read(spark, sf_dir, "documents"), SHARD_TREE)
    return out.withColumn("law", F.lit("key")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read(spark, sf_dir, "documents"))


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


@query
def op5_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_dedup.dedup(read(spark, sf_dir, "documents"))


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read(spark, sf_dir, "documents"))


@query
def op7_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_langid.identify(read(spark, sf_dir, "documents"))


@query
def op8_grammar_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar_secrets.scan(read(spark, sf_dir, "documents"))


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(read(spark, sf_dir, "documents"))


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op11_segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_search.top_k(read(spark, sf_dir, "embeddings"))


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), noise=(7, 10))


# --- DuckDB twins -----------------------------------------------------------------------------

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(translate({t}, '" + _UPPER + "', '" + _LOWER + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _draw(name: str, weight: int) -> str:
    return f"-ln((('0x' || substr(md5(k || ':' || {name}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / {weight}"


ORACLE["op2_shard_tree"] = f"""
WITH docs AS (SELECT doc_id, text, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents),
regions AS (
  SELECT *, CASE WHEN {_draw("'0'", 12)} <= {_draw("'1'", 12)} THEN 0 ELSE 1 END AS region,
    {_draw("'2'", 1)} < least({_draw("'0'", 12)}, {_draw("'1'", 12)}) AS to_new
  FROM docs),
racks AS (
  SELECT *, list_position([a, b, c], least(a, b, c)) - 1 AS rack
  FROM (SELECT *, {_draw("region || '/0'", 4)} AS a, {_draw("region || '/1'", 4)} AS b,
          {_draw("region || '/2'", 4)} AS c FROM regions)),
shards AS (
  SELECT doc_id, text, k, to_new, region * 12 + rack * 4 + list_position([d, e, f, g], least(d, e, f, g)) - 1 AS shard
  FROM (SELECT *, {_draw("region || '/' || rack || '/0'", 1)} AS d, {_draw("region || '/' || rack || '/1'", 1)} AS e,
          {_draw("region || '/' || rack || '/2'", 1)} AS f, {_draw("region || '/' || rack || '/3'", 1)} AS g
        FROM racks)),
crc_table AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
    lambda c, i: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
sums AS (
  SELECT s.*, CASE WHEN text IS NULL THEN NULL ELSE xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) END AS crc
  FROM shards s, crc_table)
SELECT doc_id, (coalesce(strlen(text), 0) + 8)::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law,
  shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(k || '#slot'), 1, 4))::INT % 256, doc_id NULLS FIRST,
    strlen(text), crc) - 1 AS slot,
  CASE WHEN to_new THEN 24 ELSE shard END::INT AS grown_shard
FROM sums"""


ORACLE["op4_license_scan"] = f"""
WITH templates AS (
  SELECT label, list_distinct({_WORDS.format(t='body')}) AS toks FROM (VALUES
    {", ".join(f"('{lab}', '{t}')" for lab, t in license_scan.TEMPLATES)}) v(label, body)),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS.format(t="coalesce(text, '')")} AS ws
  FROM documents),
found AS (
  SELECT r, label, len(list_intersect(toks, bw)) / len(toks) AS score
  FROM (SELECT r, {_WORDS.format(t='line')} AS bw
        FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)), templates
  WHERE len(list_intersect(toks, bw)) >= ceil(0.8 * len(toks) - 1e-9)),
best AS (SELECT r, list(DISTINCT label) AS labels, max(score) AS score FROM found GROUP BY r),
places AS (
  SELECT r, doc_id, len(ws) AS n_words, score, coalesce(labels, []) AS more,
    list_filter(range(len(ws)), lambda i: ws[i + 1] = 'mit' AND ws[i + 2] = 'license') AS mit,
    list_filter(range(len(ws)), lambda i: ws[i + 1] = 'apache' AND ws[i + 2] = 'license') AS apache,
    list_filter(range(len(ws)), lambda i: ws[i + 1] = 'general' AND ws[i + 2] = 'public' AND ws[i + 3] = 'license') AS gpl
  FROM docs LEFT JOIN best USING (r)),
based AS (
  SELECT *, list_concat(mit, apache, gpl) AS p,
    list_concat(list_concat(CASE WHEN len(apache) > 0 THEN ['apache'] ELSE [] END,
      CASE WHEN len(gpl) > 0 THEN ['gpl'] ELSE [] END), CASE WHEN len(mit) > 0 THEN ['mit'] ELSE [] END) AS bl
  FROM places)
SELECT doc_id, n_words::BIGINT AS n_words, len(p)::BIGINT AS n_base, list_min(p)::BIGINT AS first_word,
  list_max(p)::BIGINT AS last_word, array_to_string(bl, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(bl, more))), ',') AS labels,
  CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM based"""


ORACLE["op5_bloom_dedup"] = f"""
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY h)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, h AS text_sha256
FROM n JOIN g USING (h)"""


ORACLE["op10_decontaminate"] = f"""
WITH items AS (SELECT item_id, {_WORDS.format(t='text')} AS ws FROM benchmark WHERE text IS NOT NULL),
wins AS (
  SELECT item_id::VARCHAR AS item, least(len(ws), 13) AS n, unnest(list_transform(
    range(len(ws) - least(len(ws), 13) + 1), lambda i: ws[i + 1:i + least(len(ws), 13)])) AS w
  FROM items WHERE len(ws) > 0),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(t="coalesce(text, '')")} AS ws FROM documents),
grams AS (
  SELECT r, n, unnest(range(len(ws) - n + 1)) AS start, unnest(list_transform(range(len(ws) - n + 1), lambda i: ws[i + 1:i + n])) AS w
  FROM docs, (SELECT DISTINCT n FROM wins) WHERE len(ws) >= n),
found AS (SELECT r, start, n, item FROM grams JOIN wins USING (n, w)),
hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(start, start + n)) AS p FROM found) GROUP BY r),
its AS (SELECT r, list_sort(list(DISTINCT item)) AS ids FROM found GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(len(ids), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""


# Sums of products of whole numbers below 2^53 are exact in doubles.
_VECTORS = """
rows AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(256 * x::DOUBLE))) = 0)"""

ORACLE["op11_segment_search"] = f"""
WITH {_VECTORS},
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM rows q JOIN rows c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored) WHERE rank <= 5"""

ORACLE["op12_importance_resampling"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(t="coalesce(text, '')")} AS ws FROM documents),
feats AS (SELECT r, unnest(ws) AS w FROM docs),
aims AS (SELECT unnest({_WORDS.format(t="coalesce(text, '')")}) AS w FROM benchmark),
crc_table AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
    lambda c, i: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
vocabulary AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b
  FROM (SELECT w FROM feats UNION SELECT w FROM aims), crc_table),
s AS (SELECT b, count(*) AS n FROM feats JOIN vocabulary USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM aims JOIN vocabulary USING (w) GROUP BY b),
gain AS (
  SELECT s.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM feats) + 10000)
    / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM aims) + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (b)),
mean AS (
  SELECT r, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight
  FROM feats JOIN vocabulary USING (w) JOIN gain USING (b) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN mean USING (r)),
places AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS p, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN p <= 10 * n // 100 THEN p END AS rank
FROM scored LEFT JOIN places USING (r)"""

ORACLE["op13_hard_negatives"] = f"""
WITH {_VECTORS},
labelled AS (
  SELECT r, vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label FROM rows WHERE label IS NOT NULL),
scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, c.r, c.vec_id, a.label = c.label AS alike, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM labelled a JOIN labelled c ON a.r <> c.r AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor, r, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) AS p FROM scored WHERE alike) WHERE p <= 5),
negatives AS (
  SELECT anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY s.anchor, p.r ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
  FROM scored s JOIN positives p ON s.anchor = p.anchor AND NOT s.alike
    AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5"""
