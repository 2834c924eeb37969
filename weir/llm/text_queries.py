"""Queries of the operators on whole texts, with SQL twins where SQL has the words for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.tables import table
from .decontaminate import contamination
from .jaccard_join import near_components
from .licenses import license_scan, license_sql
from .line_dedup import MOST_EDITS, line_dedup
from .periodic import digests, periodic_runs
from .personal import personal_data
from .quality import quality
from .registry import query
from .sharding import shard_documents
from .variants import spelling_variants, word_counts


@query("op1_shard_documents")
def op1(spark: SparkSession, d: str) -> DataFrame:
    return shard_documents(table(spark, d, "documents"), 8)


@query("op2_personal_data")
def op2(spark: SparkSession, d: str) -> DataFrame:
    return personal_data(table(spark, d, "documents"))


SQL_DECONTAMINATE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)
), hit AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, win)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
item AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word ON d.doc_id = word.doc_id LEFT JOIN item ON d.doc_id = item.doc_id
"""


@query("op4_decontaminate", SQL_DECONTAMINATE)
def op4(spark: SparkSession, d: str) -> DataFrame:
    return contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op6_quality_rules")
def op6(spark: SparkSession, d: str) -> DataFrame:
    return quality(table(spark, d, "documents"))


@query("op3_license_scan", license_sql())
def op3(spark: SparkSession, d: str) -> DataFrame:
    return license_scan(table(spark, d, "documents"))


@query("op9_jaccard_join")
def op9(spark: SparkSession, d: str) -> DataFrame:
    return near_components(table(spark, d, "documents"))


@query("op10_line_dedup")
def op10(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup(table(spark, d, "documents"), MOST_EDITS)


@query("op12_periodic_runs")
def op12(spark: SparkSession, d: str) -> DataFrame:
    return digests(periodic_runs(table(spark, d, "documents"), plant=True))


@query("op13_spelling_variants")
def op13(spark: SparkSession, d: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, d, "documents"), plant=True))
