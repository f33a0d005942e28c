"""Queries of the training-data operators and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chroma, language_id, license_scan, ngram_join, packing, quality, sentencepiece_codec, sharding, spotsigs, url_filter
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op4_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio, so each document's text is played as a recording."""
    media = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("audio"))
    return chroma.match_recordings(media, chroma.text_decoder)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(read(spark, sf_dir, "documents"))


#: What follows ``sets (doc_id, g)``: rows of the joins of similar sets, with the Jaccard to reach in place of ``{t}``.
_CLASS_SQL = """, lead AS MATERIALIZED (SELECT g, row_number() OVER () AS k, min(doc_id) AS lead, count(*) AS w FROM sets GROUP BY g),
flat AS (SELECT k, len(g) AS size, unnest(g) AS x FROM lead),
edge AS MATERIALIZED (
  SELECT a.k AS a, b.k AS b FROM flat a JOIN flat b ON a.x = b.x AND a.k <> b.k
  GROUP BY a.k, b.k, a.size, b.size HAVING count(*) / (a.size + b.size - count(*)) >= {t}
), reach(a, b) AS (SELECT k, k FROM lead UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
class AS (SELECT a AS k, min(lead) AS class_id FROM reach JOIN lead ON b = lead.k GROUP BY 1),
links AS (SELECT a AS k, sum(w) AS n FROM edge JOIN lead ON edge.b = lead.k GROUP BY 1)
SELECT doc_id, class_id, (coalesce(n, 0) + w - 1)::BIGINT AS links FROM sets JOIN lead USING (g) JOIN class USING (k) LEFT JOIN links USING (k)
"""

_OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [w[i] || ' ' || w[i+1] || ' ' || w[i+2] FOR i IN range(1, len(w) - 1)] END)) AS g
  FROM words WHERE len(w) > 0
)""" + _CLASS_SQL.format(t=0.6)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(read(spark, sf_dir, "documents"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.similar_documents(read(spark, sf_dir, "documents"))


def _spot_sql() -> str:
    words = lambda ws: ", ".join(f"'{w}'" for w in dict.fromkeys(ws))
    return (
        rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS ws FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), word AS MATERIALIZED (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
content AS (
  SELECT r, x, i, lead(x) OVER (PARTITION BY r ORDER BY i) AS y FROM word WHERE x NOT IN ({words(spotsigs.COMMON)})
), anchor AS (
  SELECT a.r, a.x, min(c.i) AS at FROM word a JOIN content c ON a.r = c.r AND c.i > a.i
  WHERE a.x IN ({words(spotsigs.ANCHORS)}) GROUP BY a.r, a.x, a.i
), sig AS (
  SELECT DISTINCT a.r, a.x || ' ' || c.x || ' ' || c.y AS s FROM anchor a JOIN content c ON a.r = c.r AND c.i = a.at WHERE c.y IS NOT NULL
), sets AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT r, list_sort(list(s)) AS g FROM sig GROUP BY 1) JOIN w USING (r))"""
        + _CLASS_SQL.format(t=0.5)
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over 64 shards by bytes; copies of a text stay together."""
    return sharding.shard(read(spark, sf_dir, "documents"), F.md5("text"), F.octet_length("text"))


_OP8_SQL = """
WITH RECURSIVE grouped AS (
  SELECT md5(text) AS group_key, sum(coalesce(strlen(text), 0))::BIGINT AS group_size FROM documents GROUP BY 1
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY group_size DESC, group_key ASC NULLS FIRST) AS i FROM grouped
), placed(i, loads, shard) AS (
  SELECT 0::BIGINT, [0::BIGINT FOR x IN range(64)], NULL::INTEGER
  UNION ALL
  SELECT r.i, [p.loads[j + 1] + CASE WHEN j = p.least THEN r.group_size ELSE 0 END FOR j IN range(64)], p.least::INTEGER
  FROM (SELECT i, loads, list_position(loads, list_min(loads)) - 1 AS least FROM placed) p JOIN ranked r ON r.i = p.i + 1
)
SELECT d.doc_id, r.group_key, r.group_size, p.shard
FROM documents d JOIN ranked r ON md5(d.text) IS NOT DISTINCT FROM r.group_key JOIN placed p ON p.i = r.i
"""

QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_chroma_fingerprints": op4_chroma_fingerprints,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_url_filter": op7_url_filter,
    "op8_sharding": op8_sharding,
    "op9_spotsigs": op9_spotsigs,
    "op10_quality_classifier": op10_quality_classifier,
}


ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": _OP3_SQL,
    "op7_url_filter": url_filter.oracle_sql(),
    "op8_sharding": _OP8_SQL,
    "op9_spotsigs": _spot_sql(),
}
