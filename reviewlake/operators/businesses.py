"""Business statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reviewlake.functions.numeric import count_if, mean, pct


def business_stats(businesses: DataFrame) -> DataFrame:
    out = businesses.agg(
        F.count("*").alias("total_businesses"),
        count_if(F.col("is_open") == 1).alias("open_businesses"),
        mean(F.col("stars"), 2).alias("avg_stars"),
        mean(F.col("review_count"), 1).alias("avg_review_count"),
        mean(F.col("category_count"), 1).alias("avg_category_count"),
    )
    total, opened = F.col("total_businesses"), F.col("open_businesses")
    return out.withColumns({"closed_businesses": total - opened, "open_pct": pct(opened, total, 1)})


def open_counts(businesses: DataFrame) -> DataFrame:
    return businesses.groupBy("is_open").agg(F.count("*").alias("count")).orderBy("is_open")


def top_states(businesses: DataFrame, n: int = 10) -> DataFrame:
    return businesses.groupBy("state").agg(
        F.count("*").alias("count"), mean(F.col("stars"), 2).alias("avg_stars")
    ).orderBy(F.desc("count"), "state").limit(n)


def top_cities(businesses: DataFrame, n: int = 15) -> DataFrame:
    known = businesses.where(F.col("city").isNotNull() & F.col("state").isNotNull())
    return known.groupBy(F.concat_ws(", ", "city", "state").alias("city_state")).agg(
        F.count("*").alias("city_businesses"), mean(F.col("stars"), 2).alias("avg_stars")
    ).orderBy(F.desc("city_businesses"), "city_state").limit(n)


def business_ratings(businesses: DataFrame) -> DataFrame:
    return businesses.groupBy("stars").agg(F.count("*").alias("count")).orderBy("stars")


def category_counts(df: DataFrame, column: str = "categories", separator: str = ", ") -> DataFrame:
    """Rows per single category of a separated list; a row with several categories counts in each."""
    listed = df.where(F.col(column).isNotNull() & (F.col(column) != ""))
    return listed.select(F.explode(F.split(column, separator)).alias("category")).groupBy("category").agg(
        F.count("*").alias("count")
    ).orderBy(F.desc("count"), "category")
