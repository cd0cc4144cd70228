"""A corpus pipeline of training-data operators, each stage over what the one before kept.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read back as the next one's docs.  All but the last return the columns of
documents; the last returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialize, table
from quillon.llm.jaccard_join import ngram_jaccard_join
from quillon.llm.sentencepiece_fst import sentencepiece_ids
from quillon.llm.soft_mixing import mix_documents
from quillon.llm.suffix_dedup import suffix_array_dedup
from quillon.llm.toxicity import toxicity_scores

#: The stages are not expressible in SQL: learned models, transducers and byte-level repeats.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on all labelled rows, rejects go."""
    scores = toxicity_scores(docs, table(spark, sf_dir, "labels"), remainder=None)
    toxic = scores.where("predicted = 1 and doc_id is not null").select("doc_id").distinct()
    return docs.join(toxic, "doc_id", "left_anti").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents at a Jaccard similarity of 0.8 over five-word shingles the smallest doc_id stays."""
    links = ngram_jaccard_join(docs, k=5, num=80, den=100)
    gone = links.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 200 bytes or more are cut out; documents left without a word go."""
    kept = suffix_array_dedup(docs, min_bytes=200, keep="first", with_text=True, pass_columns=True)
    cut = F.col("n_removed") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    columns = [F.when(cut, new[c]).otherwise(F.col(f"document.`{c}`")).alias(c) if c in new else F.col(f"document.`{c}`").alias(c) for c in docs.columns]
    return kept.where(F.col("kept_text").rlike(r"[^\x20\x09-\x0D]") | ~cut).select(columns)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat at rates that bring languages to their tempered shares; none is dropped."""
    return mix_documents(docs, domain="lang", temper=0.7, keep_all=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and SentencePiece ids of each row."""
    import public_tokenizers

    return sentencepiece_ids(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("mixing", mix_languages),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
