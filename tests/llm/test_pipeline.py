"""Each stage against what its operator says of the same input, and the whole on a small table."""

import os

import corpus_pipeline
from reviewlake.llm import language, mixing, packing, simhash, toxicity


def test_stages(spark, folder):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stage(spark, before, source)
        kept.write.parquet(os.path.join(folder, name))
        kept = spark.read.parquet(os.path.join(folder, name))
        if name != "best_fit_packing":
            assert kept.columns == docs.columns
        ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect())
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{source}/labels.parquet"))
            assert ids == sorted(r["doc_id"] for r in toxicity.score(before, model).where("score < 0.5").collect())
        elif name == "language_id":
            found = language.predict(before, language.fit(before))
            assert ids == sorted(r["doc_id"] for r in found.where("not rejected").collect())
        elif name == "simhash_near_dedup":
            assert ids == sorted(r["doc_id"] for r in simhash.near_duplicates(before).where("doc_id = component_id").collect())
        elif name == "source_mixing":
            mixed = mixing.mix(before.withColumn("n", mixing.word_count("text")), "doc_id", "source", "n").collect()
            assert ids == sorted(r["doc_id"] for r in mixed for _ in range(r["copies"]))
        else:
            pieces = packing.pieces(before).count()
            assert kept.count() == pieces and kept.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_without_documents(spark, folder):
    source = "/root/testdata/sf0.001"
    for table in ("documents", "labels"):
        spark.read.parquet(f"{source}/{table}.parquet").limit(0).write.parquet(os.path.join(folder, f"{table}.parquet"))
    assert corpus_pipeline.run(spark, folder).collect() == []
