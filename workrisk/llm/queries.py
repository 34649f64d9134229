"""Registered queries of the training-data operators: each applies its operator
with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from workrisk.llm import bpe_codec, count_transducer, fm_quality, hash_tree, hyperminhash, importance, line_quality, packing, pca_neighbours, soft_mix, sql, token_store, toxicity, variants


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    encoded = bpe_codec.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe_codec.digests(encoded)


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_quality.judge_documents(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    back = token_store.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=0)
    return back.select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_quality.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, held=0)


def op5_count_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return count_transducer.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=4, held=2)


def op7_soft_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return soft_mix.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), threshold_percent=75)


def op9_pca_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pca_neighbours.link(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op10_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = hash_tree.tree(8)
    return hash_tree.shard_documents(table(spark, sf_dir, "documents"), shards, hash_tree.grow(shards))


def op11_exact_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_byte_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_codec": op1_bpe_codec,
        "op2_line_quality": op2_line_quality,
        "op3_token_store": op3_token_store,
        "op4_fm_quality": op4_fm_quality,
        "op5_count_transducer": op5_count_transducer,
        "op6_toxicity": op6_toxicity,
        "op7_soft_mix": op7_soft_mix,
        "op8_hyperminhash": op8_hyperminhash,
        "op9_pca_neighbours": op9_pca_neighbours,
        "op10_hash_tree": op10_hash_tree,
        "op11_exact_complement": op11_exact_complement,
        "op12_byte_automaton": op12_byte_automaton,
        "op13_spelling_variants": op13_spelling_variants,
    }


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def line_quality_sql() -> str:
    """The rules of line_quality in DuckDB's SQL."""
    word = r"[^\x20\x09-\x0D]+"
    endings = _quoted(line_quality.ENDINGS)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, k, line, regexp_extract_all(line, '{word}') AS w
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM docs)
),
told AS (
  SELECT r, k, len(w) AS n, w, row_number() OVER (PARTITION BY r, line ORDER BY k) > 1 AS again,
    len(list_filter(w, lambda x: x IN ({_quoted(line_quality.SEPARATORS)}))) AS bars,
    len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
    len(list_filter(w, lambda x: ends_with(x, '!!'))) AS loud,
    len(list_distinct(w)) AS kinds,
    regexp_matches(line, '{"|".join(line_quality.BOILERPLATE)}', 'i') AS notice,
    right(w[len(w)], 1) IN ({endings}) AS ended
  FROM lines WHERE len(w) > 0
),
judged AS (
  SELECT *, 5 * bars >= n OR 3 * symbols > n OR (loud > 0 AND 3 * loud >= n) OR (n >= 10 AND 3 * kinds < n)
    OR (again AND n >= 3) OR (n < {line_quality.LONG_LINE} AND (notice OR NOT ended)) AS failed
  FROM told
),
by_doc AS (
  SELECT r, sum(n) AS n_words, sum(CASE WHEN again THEN 1 ELSE 0 END) AS dup, sum(CASE WHEN failed THEN n ELSE 0 END) AS lost
  FROM judged GROUP BY r
),
spread AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT r, regexp_extract_all(text, '{word}') AS w FROM docs)),
windows AS (
  SELECT r, i, word AS a, lead(word) OVER (PARTITION BY r ORDER BY i) AS b, lead(word, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM spread
),
found AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS times FROM windows WHERE c IS NOT NULL),
covered AS (
  SELECT r, count(DISTINCT i + d) AS n_repeat FROM found, (SELECT unnest([0, 1, 2]) AS d) WHERE times > 1 GROUP BY r
),
chars AS (SELECT r, sum(length(word)) AS word_chars FROM spread GROUP BY r),
stats AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM docs LEFT JOIN by_doc USING (r) LEFT JOIN covered USING (r) LEFT JOIN chars USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 50 * n_words AS kept
FROM stats"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_quality": line_quality_sql(),
        "op8_hyperminhash": sql.near_duplicates_sql(),
        "op9_pca_neighbours": sql.neighbours_sql(),
        "op12_byte_automaton": sql.importance_sql(),
        "op13_spelling_variants": sql.variants_sql(),
    }
