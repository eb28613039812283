"""A training-data pipeline over ``documents``: quality, near-duplicates, leaks, personal data, tokens.

Each stage is a function of (spark, docs, sf_dir). Its result is written as Parquet in the shared
checkpoint folder and read again as the next stage's documents; all but the last keep the columns of ``documents``.

Null, empty and blank texts fail the plain quality rules, so none of them passes the first stage; a later stage given one keeps it. Rows with
different ids and equal texts are near-duplicates; rows that share a doc_id stay or go together. A null doc_id is no obstacle. Extra columns are carried along, whatever their names, up to the
last stage, which returns token counts and digests by doc_id. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession

from muniframe.llm import bpe, decontaminate, neardup, pii, quality
from muniframe.llm.tables import reachable, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and lie within their language's perplexity band."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every group of near-duplicates: 80 percent of their 5-word shingles shared."""
    return neardup.keep_one(docs, size=5)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets in their texts replaced by their kind."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return bpe.digests(docs, tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("byte_bpe", tokens),
]

#: The perplexity bands and the minimum hashes have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    reachable(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
