"""Registered queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagforge.llm import ctw, html_extract, huffman, langid, matroska, mixing, neardup, packing, phrases, quality, rules, toxicity, whitening
from tagforge.llm.common import load

END_ID = 1


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(load(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, load(spark, sf_dir, "labels")))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, load(spark, sf_dir, "labels")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return rules.apply(docs, rules.train(docs, load(spark, sf_dir, "labels")))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digest(load(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(load(spark, sf_dir, "documents"), width=3, percent=85)


def op7_token_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(load(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(load(spark, sf_dir, "documents"))


def op11_context_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return ctw.score(docs, ctw.train(docs, size=None))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(load(spark, sf_dir, "embeddings"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(load(spark, sf_dir, "documents"))


#: Mixing in DuckDB: water level over sources, then one running total per source in key order.
OP10_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
      / round(greatest(0.05, greatest(0.0::DOUBLE, 1 - 8.0::DOUBLE * (chars - length(regexp_replace(t, '[#*$%&|<>]', '', 'g'))) / greatest(chars, 1)) * greatest(0.0::DOUBLE, 1 - 2.0::DOUBLE * (chars - length(regexp_replace(t, '[0-9]', '', 'g'))) / greatest(chars, 1))
        * least(1.0::DOUBLE, mean / 3.0::DOUBLE, 12.0::DOUBLE / greatest(mean, 1.0::DOUBLE)) * len(list_distinct(string_split(t, chr(10)))) / len(string_split(t, chr(10)))), 6) AS key
  FROM (SELECT *, length(t) AS chars, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) / greatest(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')), 1)::DOUBLE AS mean FROM (SELECT *, coalesce(text, '') AS t FROM documents))),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM totals),
weighed AS (SELECT *, CASE r % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, 3.0::DOUBLE * source_size AS top FROM ranked),
levels AS (SELECT *, ((SELECT sum(source_size) FROM totals) - coalesce(sum(top) OVER before, 0)) / ((SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY top / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT source, source_size, CASE WHEN level * w >= top THEN top
    ELSE w * (SELECT arg_min(level, top / w) FROM levels WHERE level * w < top) END AS target FROM levels),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END::BIGINT AS epochs FROM goal),
run AS (SELECT s.doc_id, s.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (epochs * size + CASE WHEN upto + size <= rest OR (upto < rest AND upto + size / 2.0 <= rest) THEN size ELSE 0 END)::BIGINT AS taken
FROM run
"""


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_toxicity, op3_quality_classifier, op4_quality_rules, op5_media_columns, op6_minhash_near_dedup, op7_token_huffman, op8_best_fit_packing, op9_language_id, op10_source_mixing, op11_context_tree_lm, op12_embedding_whitening, op13_phrase_mining)}
ORACLE_SQL = {"op10_source_mixing": OP10_SQL, "op13_phrase_mining": phrases.SQL}
