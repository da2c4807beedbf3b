"""Writing layer tables and small exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewlake.sources.inventory import try_read


def write_table(
    df: DataFrame, path: str, overwrite: bool = False, partition_by: tuple[str, ...] = ()
) -> str:
    """Write Parquet. A table that is already there is kept unless ``overwrite``."""
    writer = df.write.mode("overwrite" if overwrite else "ignore")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def table_exists(spark: SparkSession, path: str) -> bool:
    return try_read(spark, path) is not None


def materialize_aggregate(df: DataFrame, gold: str, name: str, dataset: str) -> str:
    """Store an aggregate in the gold layer as ``agg_<name>_<dataset>`` and return its path."""
    return write_table(df, f"{gold}/agg_{name}_{dataset}", overwrite=True)


def export_json(df: DataFrame, path: str) -> str:
    """Export a small result as JSON lines, such as the last weeks with revenue."""
    df.write.mode("overwrite").json(path)
    return path
