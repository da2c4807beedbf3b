"""Checks on result tables: one pass, one row per check, all rows of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reviewlake.functions.sentiment import LABELS
from reviewlake.operators.shares import unpivot_row

# Allowed ranges and label sets.
RANGES = {"sentiment": (-1.0, 1.0), "stars": (1.0, 5.0), "pct": (0.0, 100.0)}
DOMAINS = {"sentiment_label": LABELS, "confidence_level": ("high", "medium", "low")}


def _range_of(name: str) -> tuple[float, float] | None:
    lowered = name.lower()
    if "sentiment" in lowered and not lowered.endswith(("label", "count", "confidence")):
        return RANGES["sentiment"]
    if "stars" in lowered or lowered == "review_score":
        return RANGES["stars"]
    if "pct" in lowered or "percentage" in lowered:
        return RANGES["pct"]
    return None


def range_checks(result: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """Violations per check: value ranges and label domains by column name, required columns, and non-emptiness."""
    numbers = {name for name, kind in result.dtypes if kind not in ("string", "boolean", "date") and "<" not in kind}
    checks = {"has_data": F.when(F.count("*") > 0, 0).otherwise(1)}
    for name in result.columns:
        bounds = _range_of(name) if name in numbers else None
        if bounds:
            checks[f"range:{name}"] = F.count_if(~F.col(name).between(*bounds))
        if name in DOMAINS:
            checks[f"domain:{name}"] = F.count_if(~F.col(name).isin(*DOMAINS[name]))
    for name in required:
        checks[f"required:{name}"] = F.max(F.lit(0 if name in result.columns else 1))
    row = result.agg(
        F.count("*").alias("_rows"), *[c.cast("bigint").alias(f"_c{i}") for i, c in enumerate(checks.values())]
    )
    rows = unpivot_row(
        row, "check_name",
        {name: {"rows_checked": "_rows", "violations": f"_c{i}"} for i, name in enumerate(checks)},
        "check_name string, rows_checked bigint, violations bigint",
    )
    return rows.withColumn("passed", F.coalesce(F.col("violations"), F.lit(0)) == 0)


def odd_weeks(weekly: DataFrame) -> DataFrame:
    """Weeks with a review score but no orders."""
    return weekly.where((F.col("order_count") == 0) & F.col("avg_review_score").isNotNull())
