"""Table profiles: one pass over a table, one row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from reviewlake.functions.numeric import pct, rnd
from reviewlake.operators.shares import unpivot_row
from reviewlake.schemas import capabilities, require

DATE_COLUMNS = ("date", "purchase_date", "review_creation_date")


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _column_stats(df: DataFrame) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """All column statistics in one row, and where each column's values are found in it."""
    numeric = set(_numeric(df))
    aggregates, places = [F.count("*").alias("_rows")], {}
    for i, field in enumerate(df.schema.fields):
        c = F.col(f"`{field.name}`")
        is_number = field.name in numeric
        missing = F.lit(None).cast("double")
        aggregates += [
            F.count_if(c.isNull()).alias(f"_nulls{i}"),
            (F.min(c).cast("double") if is_number else F.max(missing)).alias(f"_min{i}"),
            (F.max(c).cast("double") if is_number else F.max(missing)).alias(f"_max{i}"),
            (rnd(F.avg(c), 2) if is_number else F.max(missing)).alias(f"_mean{i}"),
            F.lit(field.dataType.simpleString()).alias(f"_type{i}"),
        ]
        places[field.name] = {
            "dtype": f"_type{i}", "row_count": "_rows", "null_count": f"_nulls{i}", "min": f"_min{i}",
            "max": f"_max{i}", "mean": f"_mean{i}",
        }
    return df.agg(*aggregates), places


def profile(df: DataFrame) -> DataFrame:
    """Per column: type, rows, nulls with share, and min, max and mean of numbers."""
    row, places = _column_stats(df)
    rows = unpivot_row(
        row, "column_name", places,
        "column_name string, dtype string, row_count bigint, null_count bigint, min double, max double, mean double",
    )
    return rows.withColumn("null_pct", pct(F.col("null_count"), F.col("row_count"), 2))


def profile_column(df: DataFrame, column: str) -> DataFrame:
    """The profile of one column; the other columns are not read."""
    return profile(require(df, column).select(column))


def sample_values(df: DataFrame, size: int = 5) -> DataFrame:
    """Up to ``size`` different values per column as text, in one pass with bounded buffers.

    Each sample is the value with the smallest salted hash, so the choice depends on the values only.
    """
    salts = [F.lit(7919 * (k + 1)) for k in range(size)]
    picks = []
    for i, name in enumerate(df.columns):
        c = F.col(f"`{name}`").cast("string")
        drawn = F.array(*[F.min_by(c, F.when(c.isNotNull(), F.xxhash64(c, salt))) for salt in salts])
        picks.append(F.array_compact(F.array_distinct(drawn)).alias(f"_s{i}"))
    places = {name: {"sample_values": f"_s{i}"} for i, name in enumerate(df.columns)}
    return unpivot_row(df.agg(*picks), "column_name", places, "column_name string, sample_values array<string>")


def capability_flags(df: DataFrame) -> DataFrame:
    """The capability flags of a table as one row, from its schema alone."""
    flags = capabilities(df)
    return df.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in flags.items()])


def numeric_summary(result: DataFrame) -> DataFrame:
    """Min, max and mean of every numeric column of a result."""
    numbers = _numeric(result)
    row, places = _column_stats(result.select(*numbers))
    kept = {name: {k: src for k, src in p.items() if k in ("min", "max", "mean")} for name, p in places.items()}
    return unpivot_row(row, "column_name", kept, "column_name string, min double, max double, mean double")


def null_coverage(df: DataFrame, key: str) -> DataFrame:
    """Null count and coverage per column, with the number of different keys."""
    names = [c for c in df.columns if c != key]
    row = df.agg(
        F.count("*").alias("_n"),
        F.countDistinct(key).alias("_keys"),
        *[F.count_if(F.col(c).isNull()).alias(f"_nulls{i}") for i, c in enumerate(names)],
    )
    rows = unpivot_row(
        row, "column_name",
        {c: {"row_count": "_n", "distinct_keys": "_keys", "null_count": f"_nulls{i}"} for i, c in enumerate(names)},
        "column_name string, row_count bigint, distinct_keys bigint, null_count bigint",
    )
    return rows.withColumn("coverage", rnd(1 - F.try_divide(F.col("null_count"), F.col("row_count")), 4))


def available_values(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """The different values of a column in order: all, or the first ``limit``."""
    values = require(df, column).select(column).distinct().orderBy(column)
    return values if limit is None else values.limit(limit)


def date_column(df: DataFrame) -> str | None:
    return next((c for c in DATE_COLUMNS if c in df.columns), None)


def date_range(df: DataFrame) -> DataFrame | None:
    """First and last date as text, or None for a table without dates."""
    name = date_column(df)
    if name is None:
        return None

    def text(c: Column) -> Column:
        return c if isinstance(df.schema[name].dataType, T.StringType) else F.date_format(c, "yyyy-MM-dd")

    return df.agg(text(F.min(name)).alias("min_date"), text(F.max(name)).alias("max_date"))
