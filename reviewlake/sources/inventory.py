"""What is stored where: existence, rows and columns of layer tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def try_read(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """The table at a path, or None when nothing is there."""
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def table_inventory(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet") -> DataFrame:
    """One row per table: path, existence, rows (from file footers for Parquet), column count and names."""
    rows = None
    for name, path in paths.items():
        df = try_read(spark, path, fmt)
        if df is None:
            row = spark.range(1).select(
                F.lit(name).alias("table_name"), F.lit(path).alias("path"), F.lit(False).alias("exists"),
                F.lit(None).cast("bigint").alias("row_count"), F.lit(None).cast("int").alias("column_count"),
                F.lit(None).cast("array<string>").alias("columns"),
            )
        else:
            row = df.agg(F.count("*").alias("row_count")).select(
                F.lit(name).alias("table_name"), F.lit(path).alias("path"), F.lit(True).alias("exists"), "row_count",
                F.lit(len(df.columns)).alias("column_count"), F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
            )
        rows = row if rows is None else rows.unionByName(row)
    return rows.orderBy("table_name")
