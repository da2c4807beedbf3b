"""Totals and shares over grouped results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlake.functions.numeric import pct


def share_of(column: str = "count", digits: int = 2) -> Column:
    """A group's count as percent of all groups' counts. The window runs over the grouped rows, not over the table."""
    return pct(F.col(column), F.sum(column).over(Window.partitionBy()), digits)


def unpivot_row(row: DataFrame, key: str, fields: dict[str, dict[str, str]], schema: str) -> DataFrame:
    """Turn a one-row result into one row per key: ``fields`` maps key -> {output column: input column}."""
    structs = [
        F.struct(F.lit(name).alias(key), *[F.col(src).alias(out) for out, src in columns.items()])
        for name, columns in fields.items()
    ]
    return row.select(F.inline(F.array(*structs).cast(f"array<struct<{schema}>>")))
