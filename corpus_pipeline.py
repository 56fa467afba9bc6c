"""A training corpus from raw documents: language ID, near-duplicates, shared passages, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes it as
Parquet to the shared scratch folder and reads it back as the next one's input.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetscope.llm import bpe, langid, mixing, queries, simhash, suffix
from fleetscope.session import scratch_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier can tell; the rest goes."""
    return langid.keep_identified(docs, langid.fit(docs, langid.training_rows()))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id."""
    return simhash.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; ``n_chars`` follows."""
    return suffix.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix's proportions: a row for each time that it takes a document."""
    return mixing.mixed_documents(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.encode_decode(docs, queries.tokenizer_path())


STAGES = [("language_id", language_id), ("simhash_dedup", simhash_dedup), ("suffix_dedup", suffix_dedup),
          ("source_mix", source_mix), ("bpe_tokens", bpe_tokens)]
#: The classifier and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
