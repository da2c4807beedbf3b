"""Training-corpus pipeline: each stage works on all documents its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewlake.llm import language, mixing, packing, simhash, toxicity
from reviewlake.llm.scratch import save


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that score below 0.5, by a network fitted on the table of labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language isn't rejected."""
    return language.keep_known(docs, language.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash group (4-word shingles, 4 differing bits): the one with the smallest id.

    Null and wordless texts are one group; equal rows leave one.
    """
    return simhash.keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix of its source asks for: not at all, once or twice."""
    return mixing.repeat_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic), ("language_id", drop_unknown_language), ("simhash_near_dedup", near_dedup),
    ("source_mixing", mix_sources), ("best_fit_packing", pack_sequences),
]

#: Model and hash stages have no SQL; they are tested against brute force on small fixtures.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order; every stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir))
    return docs
