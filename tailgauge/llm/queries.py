"""One query for each operator, over its whole tables, and the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bagminhash,
    bpe_tree,
    context_mixing,
    conversation_tree,
    fill_in_middle,
    histogram_sort,
    hnsw,
    license_scan,
    paragraph_dedup,
    ppm_language,
    run_length_dedup,
    suffix_automaton,
    suffix_repetition,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """Rank file and pattern of the public multilingual byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op1_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.removal_report(table(spark, sf_dir, "documents"), paragraph_dedup.PASSAGES)


@query
def op2_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_length_dedup.removal_report(table(spark, sf_dir, "documents"))


@query
def op3_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort.shard_report(table(spark, sf_dir, "documents"))


@query
def op5_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_automaton.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
SQL["op5_suffix_automaton"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
b2 AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b2)
),
dw AS (
  SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
),
hits AS (SELECT r, i, n, item FROM dw JOIN bw USING (n, g)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""


@query
def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encoded(table(spark, sf_dir, "documents"), *vocabulary()).drop("ids")


@query
def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.language_model_scores(table(spark, sf_dir, "documents"))


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_matches(table(spark, sf_dir, "documents"))


@query
def op9_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repetition.quality(table(spark, sf_dir, "documents"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_language.language_id(table(spark, sf_dir, "documents"))


@query
def op11_displacement_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


SQL["op11_displacement_scatter"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
),
x AS (
  SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
      OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
),
p AS (
  SELECT doc_id, t, n, form, substr(t, 1, least(a, b)) AS pre, substr(t, least(a, b) + 1, abs(a - b)) AS mid,
    substr(t, greatest(a, b) + 1) AS suf, least(a, b) AS np, abs(a - b) AS nm
  FROM x
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form != 'plain' THEN np END AS prefix_chars,
  CASE WHEN form != 'plain' THEN nm END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


@query
def op12_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


SQL["op12_hnsw_dedup"] = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
),
fine AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x != 0)) > 0
),
links AS (
  SELECT a.r AS a, b.r AS b FROM fine a JOIN fine b ON a.label = b.label AND a.r != b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
),
reach AS (SELECT r, r AS other FROM v UNION SELECT reach.r, b FROM reach JOIN links ON a = other),
parts AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = other GROUP BY ALL),
counts AS (SELECT a AS r, count(*) AS n FROM links GROUP BY ALL)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN parts USING (r) LEFT JOIN counts USING (r)
"""


@query
def op13_euler_tour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_tree.prefix_tree(table(spark, sf_dir, "conversations")).drop("tour_position")


# the table of the crc32 polynomial follows from the rule; DuckDB has no function for it
SQL["op13_euler_tour"] = """
WITH crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(range(8),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS tab
),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
),
c0 AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
      lambda c, b: xor(any_value(tab)[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % 9 AS h
  FROM t, crc GROUP BY conv_id
),
c1 AS (
  SELECT a.conv_id, a.base, a.h, least(a.h, coalesce(b.n, 0)) AS taken,
    least(a.h, coalesce(b.n, 0)) + greatest(a.n - a.h, 0) AS total
  FROM c0 a LEFT JOIN c0 b ON b.conv_id = a.base
),
turns AS (
  SELECT c1.conv_id, place + 1 AS depth, role, text FROM c1 JOIN t ON t.conv_id = c1.base WHERE place < h
  UNION ALL
  SELECT c1.conv_id, taken + place - h + 1, role, text FROM c1 JOIN t USING (conv_id) WHERE place >= h
),
m AS (
  SELECT conv_id, depth, strlen(text) AS bytes,
    sha256(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k
  FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM c1
),
nodes AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM m GROUP BY k, depth),
linked AS (
  SELECT n.*, p.k AS parent FROM nodes n LEFT JOIN m p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
),
kids AS (SELECT parent AS k, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
sums AS (
  SELECT a.k, a.depth, count(*) FILTER (x.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved
  FROM nodes n LEFT JOIN kids x USING (k, depth) JOIN m a ON a.conv_id = n.conv_id AND a.depth <= n.depth
  GROUP BY ALL
),
ends AS (
  SELECT m.k, m.depth, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS digest
  FROM m JOIN c1 USING (conv_id) WHERE m.depth = total GROUP BY ALL
)
SELECT l.conv_id, l.depth, p.conv_id AS parent_conv_id, l.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
FROM linked l JOIN sums USING (k, depth) LEFT JOIN kids USING (k, depth) LEFT JOIN ends USING (k, depth)
LEFT JOIN nodes p ON p.k = l.parent AND p.depth = l.depth - 1
"""
