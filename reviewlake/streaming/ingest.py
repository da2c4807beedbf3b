"""Incremental silver reviews: new raw files are picked up, transformed and appended exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from reviewlake import schemas
from reviewlake.operators.silver import silver_reviews


def stream_raw_reviews(spark: SparkSession, source: str, files_per_batch: int = 100) -> DataFrame:
    """Raw review files of a directory as a stream."""
    return (
        spark.readStream.schema(schemas.RAW_REVIEWS).option("maxFilesPerTrigger", files_per_batch).json(source)
    )


def ingest_reviews(
    spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 100
) -> StreamingQuery:
    """Append silver reviews for all files not seen yet, then stop.

    The file sink commits each batch once in its log, so a retried batch adds nothing twice. Run it again for new files
    with the same checkpoint directory (on storage all executors share).
    """
    silver = silver_reviews(stream_raw_reviews(spark, source, files_per_batch))
    return (
        silver.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def for_each_batch(
    spark: SparkSession, source: str, checkpoint: str, handle: Callable[[DataFrame, int], None],
    files_per_batch: int = 100,
) -> StreamingQuery:
    """Hand the raw reviews over in batches of files, each with its number.

    A batch can be handed over again after a failure; its number tells a handler what it has already stored.
    """
    return (
        stream_raw_reviews(spark, source, files_per_batch).writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
