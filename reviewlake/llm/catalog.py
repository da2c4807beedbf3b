"""Queries of the numbered operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import (
    alignment, digest, extract, gridjoin, language, licences, mixing, packing, sharding, simhash, spelling, toxicity, treepacking,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at cosine 0.98."""
    return gridjoin.near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by source weights takes of every document."""
    docs = _table(spark, sf_dir, "documents").withColumn("size", mixing.word_count("text"))
    mixed = mixing.mix(docs, "doc_id", "source", "size")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 2048 tokens."""
    placed = packing.pack_documents(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_improbable_feature_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how like they and the next document's are."""
    docs = _table(spark, sf_dir, "documents")
    return digest.edited_fingerprints(docs, digest.rarity(docs))


def op5_subword_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; documents of fold 0 are held out of the fit."""
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.where(language.fold("doc_id") != 0))
    found = language.predict(docs, model)
    return found.select("doc_id", (language.fold("doc_id") == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op6_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of fold 0 are held out of the fit."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(language.fold("doc_id") != 0))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (language.fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_tag_ratio_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = extract.extract(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op8_sampled_splitter_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of near-equal bytes over all documents."""
    placed = sharding.shard(_table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence whose text a document is, and those that stand in it as a line; notices joined by commas."""
    return licences.scan(_table(spark, sf_dir, "documents")).withColumn("notices", F.array_join("notices", ","))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document by SimHash."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op11_tournament_tree_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 2048 tokens or a power of two below."""
    return treepacking.pack_documents(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every frequent word, with planted slips of one run in 199."""
    return spelling.variants(spelling.vocabulary(_table(spark, sf_dir, "documents"), slip=199))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document."""
    return alignment.align_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    """One query per numbered operator."""
    return {f.__name__: f for f in (
        op1_epsilon_grid_join, op2_pivotal_mixing, op3_best_fit_packing,
        op4_improbable_feature_digest, op5_subword_language_id, op6_gru_toxicity, op7_tag_ratio_extraction, op8_sampled_splitter_sharding, op9_licence_digests, op10_simhash_near_dedup,
        op11_tournament_tree_packing, op12_spelling_variants, op13_tokenizer_alignment,
    )}
