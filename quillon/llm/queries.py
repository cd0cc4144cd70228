"""Queries of the training-data operators over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import table
from quillon.llm.cover_tree import exact_top_k
from quillon.llm.jaccard_join import ngram_jaccard_join
from quillon.llm.oracles import ORACLE_SQL  # noqa: F401
from quillon.llm.quality_classifier import quality_scores
from quillon.llm.quality_rules import quality_rules
from quillon.llm.sentencepiece_fst import sentencepiece_round_trip
from quillon.llm.soft_mixing import soft_mixing_rates
from quillon.llm.suffix_dedup import suffix_array_dedup
from quillon.llm.token_parquet import encode_to_parquet, new_path, read_tokens, token_digests
from quillon.llm.toxicity import toxicity_scores
from quillon.llm.url_filter import RULES, url_filter


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return soft_mixing_rates(table(spark, sf_dir, "documents"), domain="lang")


def op5_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = encode_to_parquet(table(spark, sf_dir, "documents"), new_path(spark), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_digests(read_tokens(spark, path))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(table(spark, sf_dir, "documents"), min_bytes=200, keep="none")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), k=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_quality_classifier, op3_sentencepiece, op4_soft_mixing, op5_token_parquet, op6_suffix_array_dedup, op7_exact_top_k, op8_toxicity, op9_url_filter, op10_ngram_jaccard_join)}
