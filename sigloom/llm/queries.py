"""The queries of this subpackage, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sigloom.llm.packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sigloom.llm.sentences import encode_texts

    return encode_texts(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigloom.llm.secrets import secret_report

    return secret_report(_read(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigloom.llm.lines import line_report

    return line_report(_read(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigloom.llm.simhash import simhash_report

    return simhash_report(_read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigloom.llm.language import language_report

    return language_report(_read(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigloom.llm.neighbours import neighbour_report

    return neighbour_report(_read(spark, sf_dir, "embeddings"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigloom.llm.pii import pii_report

    return pii_report(_read(spark, sf_dir, "documents"), key="sigloom-example-key")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigloom.llm.sharding import shard_documents

    return shard_documents(_read(spark, sf_dir, "documents"))  # a map of its own: the same table, the same rows


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigloom.llm.jpeg import decode_media, encode_media

    return decode_media(encode_media(_read(spark, sf_dir, "documents")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigloom.llm.audit import audit

    return audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigloom.llm.substrings import repeat_report

    return repeat_report(_read(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigloom.llm.whitening import whiten

    return whiten(_read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_sentencepiece, op3_secret_scans, op4_line_dedup, op5_simhash_near_dedup, op6_language_id, op7_nearest_neighbours, op8_pii, op9_sharding,
    op10_media_columns, op11_filter_audit, op12_substring_dedup, op13_embedding_whitening, pipeline,
)}

_AUDIT = r"""
WITH told AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
texts AS (SELECT coalesce(doc_id, 9223372036854775807) AS id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(id) OVER (PARTITION BY text) AS first FROM texts),
failed AS (
  SELECT id, part, (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN first < id THEN 16 ELSE 0 END) AS cell
  FROM worded),
cells AS (SELECT part, cell, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM failed LEFT JOIN told ON id = doc_id GROUP BY part, cell),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step, bits[step] AS own, CAST(list_sum(bits[1:step]) AS BIGINT) AS upto FROM orders, (SELECT unnest(range(1, 6)) AS step)),
counted AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own, sum(CASE WHEN cell & upto = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN cell & upto = own THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN cell & own <> 0 AND cell & upto <> own THEN n ELSE 0 END) AS redundant, sum(CASE WHEN cell = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN cell & upto = own THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN cell & upto = own THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""

_SUBSTRINGS = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
words AS (SELECT r, coalesce(doc_id, 9223372036854775807) AS id, len(words) AS n, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS spot FROM texts),
windows AS (
  SELECT r, id, n, word, spot, CASE WHEN spot + 49 <= n THEN md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY spot ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS window_hash FROM words),
firsts AS (SELECT window_hash, min(id) AS first FROM windows WHERE window_hash IS NOT NULL GROUP BY window_hash),
marked AS (SELECT r, word, spot, coalesce(first < id, false) AS again FROM windows LEFT JOIN firsts USING (window_hash)),
covered AS (SELECT r, word, spot, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY spot ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM marked),
kept AS (SELECT r, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY spot) FILTER (gone = 0) AS kept FROM covered GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (r)
"""

ORACLES: dict[str, str] = {"op11_filter_audit": _AUDIT, "op12_substring_dedup": _SUBSTRINGS}
