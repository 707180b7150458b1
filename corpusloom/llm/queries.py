"""The queries of this subpackage, over whole tables, and their SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, exact_dedup, fill_in_middle, license_scan, near_dedup, packing, prefix_trie, quality_classifier, quality_rules, sentencepiece_bpe, token_counts, toxicity, url_filter

#: The rules of the url query (host, path, allow).
URL_RULES = [
    ("org", "/", True),
    ("example.org", "/es/", False),
    ("example.org", "/en/1", False),
    ("com", "/fr/", True),
    ("com", "/de/", False),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold():
    """crc32 of doc_id as text."""
    return F.crc32(F.col("doc_id").cast("string"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), fold() % 3 != 1)
    return quality_classifier.score(docs, model).select("doc_id", F.coalesce(fold() % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold() % 5 != 0)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(fold() % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), path, then=bpe.digest(path), schema=bpe.DIGESTS)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.with_digests(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_bpe.encode_documents(table(spark, sf_dir, "documents"), path, then=sentencepiece_bpe.digest(path), schema=sentencepiece_bpe.DIGESTS)


_ALL = (
    op1_quality_classifier, op2_token_counts, op3_url_filter, op4_quality_rules, op5_toxicity, op6_packing, op7_bpe, op8_near_dedup, op9_exact_dedup, op10_license_scan,
    op11_prefix_trie, op12_fill_in_middle, op13_sentencepiece,
)
QUERIES = {f.__name__: f for f in _ALL}

_URL_SQL = """
WITH split AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM split
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC) AS k
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN (SELECT DISTINCT page_id, rule, verdict FROM fits WHERE k = 1) f ON parts.page_id = f.page_id
"""

EXACT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
"""

NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(CASE len(words) WHEN 0 THEN [] WHEN 1 THEN words ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingle FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)
), sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reached.a, sides.b FROM reached JOIN sides ON reached.b = sides.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) r ON d.doc_id = r.a
"""

#: crc32 of a decimal number in text, as a fold over its bytes and their bits.
_CRC = """xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::UBIGINT)), lambda c, b:
  list_reduce(list_concat([xor(c, b)], range(8)::UBIGINT[]), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)))"""

TRIE_SQL = rf"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC.format("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
), r AS (
  SELECT c.conv_id, o.pos, role, text FROM c JOIN o ON o.conv_id = base AND o.pos <= h UNION ALL SELECT c.conv_id, o.pos, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > h
), t AS (
  SELECT conv_id, row_number() OVER w AS depth, text, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w) AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
), p AS (SELECT conv_id, depth, text, path FROM t UNION ALL SELECT conv_id, 0, '', '' FROM c
), len AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id
), n AS (SELECT p.depth, path, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * len(list_filter(string_split_regex(any_value(text), '[ 	-
]+'), lambda x: x <> '')) AS saved,
    sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE p.depth = len.depth), '')) AS ends_sha256
  FROM p JOIN len ON p.conv_id = len.conv_id GROUP BY p.depth, path
), up AS (SELECT n.*, q.path AS parent, m.conv_id AS parent_conv_id FROM n LEFT JOIN p q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1 LEFT JOIN n m ON m.depth = q.depth AND m.path = q.path
), k AS (SELECT depth - 1 AS depth, parent AS path, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY ALL
), full_ AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN k ON k.depth = up.depth AND k.path = up.path
), sums AS (SELECT p.depth, p.path, sum(f.saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves FROM full_ f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY ALL)
SELECT conv_id, f.depth::BIGINT AS depth, parent_conv_id, n_convs, n_children::BIGINT AS n_children, n_leaves, saved_tokens, ends_sha256 FROM full_ f JOIN sums ON sums.depth = f.depth AND sums.path = f.path
"""

ORACLE_SQL = {"op11_prefix_trie": TRIE_SQL, "op3_url_filter": _URL_SQL, "op8_near_dedup": NEAR_SQL, "op9_exact_dedup": EXACT_SQL}
