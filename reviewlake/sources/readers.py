"""Readers of the raw tables. Every reader takes a path and an explicit schema; nothing is inferred or collected."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from reviewlake import schemas
from reviewlake.operators.sampling import first_rows

BAD_ROW = "_corrupt_record"


def _with_bad_rows(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(BAD_ROW, T.StringType(), True)])


def read_json(
    spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None, keep_bad_rows: bool = False
) -> DataFrame:
    """JSON lines. Malformed lines become all-null rows; ``keep_bad_rows`` also keeps their text."""
    wanted = _with_bad_rows(schema) if keep_bad_rows else schema
    df = spark.read.schema(wanted).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_ROW).json(path)
    return first_rows(df, schema.fieldNames()[0], limit)


def _utf8(c: Column) -> Column:
    """Text whose characters stand for bytes, read as UTF-8; null where the bytes are none."""
    return F.try_validate_utf8(F.encode(c, "ISO-8859-1").cast("string"))


def _by_file_encoding(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Texts of byte characters decoded file by file: as UTF-8 where all of a file's texts are, else as Latin-1.

    The files that are not UTF-8 are found by an aggregate; there is at most one row per file, fewer than the listing that
    the driver holds of them, so they are broadcast.
    """
    texts = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"))
    broken = [F.col(c).isNotNull() & _utf8(F.col(c)).isNull() for c in texts]
    wrong = broken[0]
    for b in broken[1:]:
        wrong = wrong | b
    latin = placed.where(wrong).groupBy("_file").agg(F.lit(True).alias("_latin"))
    joined = placed.join(F.broadcast(latin), "_file", "left")
    decoded = {c: F.when(F.col("_latin"), F.col(c)).otherwise(_utf8(F.col(c))) for c in texts}
    return joined.withColumns(decoded).select(*schema.fieldNames())


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None, encoding: str | None = "UTF-8",
    multiline: bool = False,
) -> DataFrame:
    """CSV with a header and doubled quotes.

    Large files are split over tasks. ``multiline=True`` also reads line breaks inside quoted fields, but then a file is
    one task's work. ``encoding=None`` reads every file as UTF-8 or, if it holds other bytes, as Latin-1.
    """
    df = (
        spark.read.schema(schema).option("header", True).option("multiLine", multiline).option("escape", '"')
        .option("encoding", encoding or "ISO-8859-1").option("mode", "PERMISSIVE").csv(path)
    )
    return first_rows(df if encoding else _by_file_encoding(df, schema), schema.fieldNames()[0], limit)


def read_reviews(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return read_json(spark, path, schemas.RAW_REVIEWS, limit)


def read_users(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return read_json(spark, path, schemas.RAW_USERS, limit)


def read_businesses(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schemas.RAW_BUSINESSES)


def read_undated_reviews(
    spark: SparkSession, path: str, limit: int | None = None, encoding: str | None = None,
    schema: T.StructType = schemas.RAW_UNDATED, multiline: bool = True,
) -> DataFrame:
    """Undated reviews from CSV. Each file is read as UTF-8 or else as Latin-1; ``encoding`` states another one.

    Review bodies may hold line breaks; ``multiline=False`` splits a file that has none.
    """
    return read_csv(spark, path, schema, limit, encoding, multiline)


def read_shop_table(
    spark: SparkSession, directory: str, table: str, limit: int | None = None, multiline: bool | None = None
) -> DataFrame:
    """One e-commerce table by name, from ``<directory>/<table>.csv``. Only review comments may hold line breaks by default."""
    if table not in schemas.SHOP_TABLES:
        raise ValueError(f"unknown table {table!r}; known tables are {sorted(schemas.SHOP_TABLES)}")
    breaks = table == "reviews" if multiline is None else multiline
    return read_csv(spark, f"{directory}/{table}.csv", schemas.SHOP_TABLES[table], limit, multiline=breaks)


def read_shop(spark: SparkSession, directory: str) -> dict[str, DataFrame | None]:
    """All e-commerce tables; a table without a file is None."""
    out: dict[str, DataFrame | None] = {}
    for name in schemas.SHOP_TABLES:
        try:
            out[name] = read_shop_table(spark, directory, name)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            out[name] = None
    return out
