"""Queries of the training-data operators and the SQL that says the same, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm.toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm.warc import page_captures, resolve_revisits

    out = resolve_revisits(page_captures(_table(spark, sf_dir, "pages")))
    header = {f"h_{k.replace('-', '_')}": F.element_at("headers", k) for k in ("etag", "date", "content-length", "content-type")}
    return out.select("record_id", "canonical_url", F.col("at").alias("captured_at"), "response_id", "response_at", "outcome", *[v.alias(k) for k, v in header.items()])


OP2_SQL = r"""
WITH bare AS (
  SELECT page_id, md5(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS bytes,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages
), cut AS (
  SELECT *, lower(regexp_extract(u, '^([^/?]*)', 1)) AS host, regexp_replace(u, '^[^/?]*', '') AS rest FROM bare
), canon AS (
  SELECT *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') || regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '') AS base,
    regexp_replace(regexp_replace(regexp_extract(rest, '\?(.*)$', 1), '(^|&)utm_[^&]*', '', 'g'), '^&+', '') AS q FROM cut
), p AS (
  SELECT page_id, digest, bytes, base || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical_url FROM canon
), pairs AS (
  SELECT v.page_id * 2 + 1 AS record_id, v.canonical_url, v.page_id + 1000 AS captured_at, r.page_id * 2 AS response_id, r.page_id AS response_at, v.digest AS own, r.digest AS theirs, r.bytes, v.page_id
  FROM p v JOIN p r ON v.canonical_url = r.canonical_url AND (r.page_id < v.page_id + 1000)
), latest AS (
  SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY response_at DESC, response_id DESC) = 1
)
SELECT record_id, canonical_url, captured_at, response_id, response_at, CASE WHEN own = theirs THEN 'resolved' ELSE 'changed' END AS outcome,
  CASE WHEN own = theirs THEN 'W/"' || own || '"' END AS h_etag, CASE WHEN own = theirs THEN page_id::VARCHAR END AS h_date,
  CASE WHEN own = theirs THEN bytes::VARCHAR END AS h_content_length, CASE WHEN own = theirs THEN 'text/html' END AS h_content_type
FROM latest
"""


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm.embeddings import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm.substrings import remove_repeats

    kept = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm.decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm.lines import deduplicate_lines

    kept = deduplicate_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), carry=False).select("doc_id", "size", "source_size", "target", "taken")


def op10_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm.common import word_count
    from veridoc.llm.token_rollups import document_changes, scratch_rollups

    rollups = scratch_rollups(spark)
    for _ in range(2):  # the second time changes nothing: batches commit once
        for batch, changes in document_changes(_table(spark, sf_dir, "documents"), word_count(F.col("text")), F.coalesce(F.length("text"), F.lit(0)).cast("long")).items():
            rollups.commit(batch, changes)
    return rollups.totals()


OP10_SQL = r"""
WITH d AS (
  SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, length(coalesce(text, '')) AS chars,
    doc_id > min(doc_id) OVER (PARTITION BY md5(coalesce(text, ''))) AS copy
  FROM documents
), both_versions AS (
  SELECT source, lang, 'words-1' AS tokenizer, words AS tokens FROM d WHERE copy IS NOT TRUE
  UNION ALL SELECT source, lang, 'chars-1', chars FROM d WHERE copy IS NOT TRUE
)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(tokens)::BIGINT AS n_tokens FROM both_versions GROUP BY ALL
"""

OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS k FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM sums
), filled AS (
  SELECT *, (3 * source_size)::DOUBLE / w AS ratio,
    ((sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0))::DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS level
  FROM ranked WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, CASE WHEN ratio > level THEN max(CASE WHEN ratio > level THEN level END) OVER () * w ELSE (3 * source_size)::DOUBLE END AS target FROM filled
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
    (coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS earlier
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(budget - epochs * source_size - earlier, size)))::BIGINT AS taken FROM cut
"""

QUERIES = {"op1_toxicity": op1_toxicity, "op5_substrings": op5_substrings, "op2_revisits": op2_revisits, "op3_licenses": op3_licenses, "op4_embeddings": op4_embeddings, "op10_token_rollups": op10_token_rollups, "op6_decontaminate": op6_decontaminate, "op8_lines": op8_lines, "op7_simhash": op7_simhash, "op9_mix": op9_mix}
ORACLES = {"op2_revisits": OP2_SQL, "op10_token_rollups": OP10_SQL, "op9_mix": OP9_SQL}
