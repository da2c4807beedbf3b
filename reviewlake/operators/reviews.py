"""Aggregates over silver review tables. Each is one scan with map-side partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reviewlake.errors import DatasetError
from reviewlake.functions.numeric import bin_label, bin_ordinal, count_if, mean, pct, pearson, rnd
from reviewlake.operators.shares import share_of, unpivot_row
from reviewlake.schemas import rating_column, require

LENGTH_BINS = [0, 50, 200, 500, 1000, 5000]


def by_year(df: DataFrame, year: int | None) -> DataFrame:
    """Keep one year. A table without a year column is rejected instead of answering for all years."""
    return df if year is None else require(df, "year").where(F.col("year") == year)


def by_rating(df: DataFrame, stars: int | None) -> DataFrame:
    return df if stars is None else df.where(F.col(rating_column(df)) == stars)


def reviews_by_month(df: DataFrame, year: int | None = None) -> DataFrame:
    """Reviews per month: count, mean rating, three-star count and share, mean length."""
    rating = rating_column(df)
    monthly = by_year(require(df, "year", "month"), year).groupBy("year", "month").agg(
        F.count("*").alias("review_count"),
        mean(F.col(rating), 2).alias("avg_stars"),
        count_if(F.col("is_ambiguous")).alias("ambiguous_count"),
        mean(F.col("text_length"), 0).alias("avg_text_length"),
    )
    return monthly.withColumn("pct_ambiguous", pct(F.col("ambiguous_count"), F.col("review_count"), 1)).orderBy(
        "year", "month"
    )


def reviews_by_stars(df: DataFrame) -> DataFrame:
    """Count and share per rating value; unrated reviews count towards the total."""
    rating = rating_column(df)
    counts = df.groupBy(rating).agg(F.count("*").alias("count"))
    return counts.withColumn("percentage", share_of()).orderBy(rating)


def rating_summary(df: DataFrame) -> DataFrame:
    """Positive (4-5), negative (1-2) and ambiguous (3) counts and shares in one row."""
    rating = F.col(rating_column(df))
    counts = df.agg(
        F.count("*").alias("total_reviews"),
        count_if(rating >= 4).alias("positive_count"),
        count_if(rating <= 2).alias("negative_count"),
        count_if(rating == 3).alias("ambiguous_count"),
    )
    total = F.col("total_reviews")
    return counts.withColumns({
        f"{band}_pct": pct(F.col(f"{band}_count"), total, 1) for band in ("positive", "negative", "ambiguous")
    })


def column_distribution(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Values of a column with shares, the most frequent first, plus the distinct count (null counts as a value).

    All values, or the first ``limit``.
    """
    counts = require(df, column).groupBy(column).agg(F.count("*").alias("count"))
    totals = counts.agg(F.struct(F.sum("count").alias("rows"), F.count("*").alias("values"))).scalar()
    ranked = (
        counts.withColumn("_t", totals)
        .select(
            column, "count", pct(F.col("count"), F.col("_t.rows"), 2).alias("percentage"),
            F.col("_t.values").alias("unique_values"), F.col("_t.rows").alias("total_rows"),
        )
        .orderBy(F.desc("count"), F.asc_nulls_first(column))
    )
    return ranked if limit is None else ranked.limit(limit)


def top_entities(
    df: DataFrame, entity: str, metric: str = "count", n: int = 10, ascending: bool = False
) -> DataFrame:
    """The n entities with the highest (or lowest) count, mean rating or revenue; ties go to the smaller id."""
    aggregates = {"count": F.count("*").alias("count")}
    if metric == "avg_stars":
        aggregates["avg_stars"] = mean(F.col(rating_column(df)), 2).alias("avg_stars")
    elif metric == "total_revenue":
        require(df, "order_total")
        aggregates["total_revenue"] = rnd(F.sum("order_total"), 2).alias("total_revenue")
    elif metric != "count":
        raise DatasetError(f"unknown metric {metric!r}: use count, avg_stars or total_revenue")
    order = F.asc_nulls_last(metric) if ascending else F.desc_nulls_last(metric)
    return require(df, entity).groupBy(entity).agg(*aggregates.values()).orderBy(order, F.asc(entity)).limit(n)


def by_text_length(df: DataFrame, bins: list[int] | None = None) -> DataFrame:
    """Reviews per text-length bin (right-closed), with shares."""
    bins = bins or LENGTH_BINS
    length = F.col("text_length")
    grouped = (
        df.groupBy(bin_ordinal(length, bins).alias("bin_order"), bin_label(length, bins).alias("length_bin"))
        .agg(
            F.count("*").alias("count"),
            mean(F.col(rating_column(df)), 2).alias("avg_stars"),
            count_if(F.col("is_ambiguous")).alias("ambiguous_count"),
        )
    )
    return (
        grouped.withColumn("pct", share_of(digits=1))
        .withColumn("pct_ambiguous", pct(F.col("ambiguous_count"), F.col("count"), 1))
        .orderBy("bin_order")
    )


def ambiguous_stats(df: DataFrame) -> DataFrame:
    """Three-star reviews against the rest: counts and mean lengths, one scan."""
    rating, length, flag = F.col(rating_column(df)), F.col("text_length"), F.col("is_ambiguous")

    def mean_length(cond: Column) -> Column:
        return F.coalesce(rnd(F.avg(F.when(cond, length)), 0), F.lit(0.0))

    out = df.agg(
        F.count("*").alias("total_reviews"),
        count_if(flag).alias("ambiguous_count"),
        mean_length(flag).alias("avg_text_length_ambiguous"),
        mean_length(~flag).alias("avg_text_length_non_ambiguous"),
        count_if(rating >= 4).alias("positive_count"),
        count_if(rating <= 2).alias("negative_count"),
        mean_length(rating >= 4).alias("positive_avg_length"),
        mean_length(rating <= 2).alias("negative_avg_length"),
    )
    return out.withColumn("ambiguous_pct", pct(F.col("ambiguous_count"), F.col("total_reviews"), 2))


def text_stats(df: DataFrame) -> DataFrame:
    """Length and word statistics of a review table in one row.

    Lengths are whole numbers, so the exact median buffers at most one entry per different length.
    """
    length, words = F.col("text_length"), F.col("word_count")
    return df.agg(
        mean(length, 2).alias("avg_length"),
        F.median(length).alias("median_length"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
        rnd(F.stddev_samp(length), 2).alias("std_length"),
        mean(words, 2).alias("avg_words"),
        F.median(words).alias("median_words"),
        count_if(length < 10).alias("very_short"),
        count_if(length == 0).alias("empty"),
    )


def text_by_stars(df: DataFrame, commented_only: bool = False) -> DataFrame:
    """Text length per rating; ``commented_only`` keeps reviews with a comment."""
    rating = rating_column(df)
    rows = require(df, "has_comment").where("has_comment") if commented_only else df
    return rows.groupBy(rating).agg(
        mean(F.col("text_length"), 2).alias("avg_length"),
        F.median("text_length").alias("median_length"),
        mean(F.col("word_count"), 2).alias("avg_words"),
        F.count("*").alias("count"),
    ).orderBy(rating)


def text_length_histogram_input(df: DataFrame, below: int = 2000) -> DataFrame:
    """Rows kept for a length distribution: outliers at or above ``below`` are trimmed."""
    return df.where(F.col("text_length") < below)


def reviews_by_year(df: DataFrame) -> DataFrame:
    return require(df, "year").groupBy("year").agg(
        F.count("*").alias("count"), mean(F.col(rating_column(df)), 4).alias("avg_stars")
    ).orderBy("year")


def count_by(df: DataFrame, part: Column, name: str) -> DataFrame:
    """Row counts by a derived value such as the weekday."""
    return df.groupBy(part.alias(name)).agg(F.count("*").alias("count")).orderBy(name)


def ambiguous_comparison(df: DataFrame) -> DataFrame:
    """Mean length, words and votes of ambiguous and other reviews: one grouped pass."""
    return df.groupBy("is_ambiguous").agg(
        mean(F.col("text_length"), 2).alias("avg_text_length"),
        mean(F.col("word_count"), 2).alias("avg_word_count"),
        mean(F.col("useful"), 4).alias("avg_useful_votes"),
        mean(F.col("funny"), 4).alias("avg_funny_votes"),
        mean(F.col("cool"), 4).alias("avg_cool_votes"),
    ).orderBy("is_ambiguous")


def star_distribution(df: DataFrame) -> DataFrame:
    """All five ratings including empty ones, with mean, population deviation and imbalance flag."""
    rating = F.col(rating_column(df))
    row = df.agg(
        F.count("*").alias("total"),
        *[count_if(rating == k).alias(f"c{k}") for k in range(1, 6)],
        mean(rating, 2).alias("mean"),
        rnd(F.stddev_pop(rating), 2).alias("std"),
    )
    row = row.withColumns({f"p{k}": pct(F.col(f"c{k}"), F.col("total"), 2) for k in range(1, 6)})
    row = row.withColumns({
        "pos": rnd(F.col("p4") + F.col("p5"), 2),
        "neg": rnd(F.col("p1") + F.col("p2"), 2),
    }).withColumn("skewed", (F.col("pos") > 60) | (F.col("neg") > 60))
    shared = {"total": "total", "mean": "mean", "std": "std", "pct_positive": "pos", "pct_negative": "neg",
              "is_imbalanced": "skewed"}
    return unpivot_row(
        row, "star", {str(k): {"count": f"c{k}", "percentage": f"p{k}", **shared} for k in range(1, 6)},
        "star int, count bigint, percentage double, total bigint, mean double, std double, pct_positive double, "
        "pct_negative double, is_imbalanced boolean",
    )


def reviews_per_business(df: DataFrame) -> DataFrame:
    return df.groupBy("business_id").agg(
        F.count("*").alias("review_count_calc"),
        mean(F.col("stars"), 2).alias("avg_review_stars"),
        mean(F.col("text_length"), 0).alias("avg_text_length"),
        count_if(F.col("is_ambiguous")).alias("ambiguous_count"),
    )


def business_review_corr(reviews: DataFrame, businesses: DataFrame, min_reviews: int = 10) -> DataFrame:
    """Correlation of a business's own stars with the mean of its reviews.

    Reviews collapse to one row per business before the join, so a business holding many reviews cannot skew it.
    """
    joined = (
        businesses.select("business_id", "stars")
        .join(reviews_per_business(reviews), "business_id", "inner")
        .where(F.col("review_count_calc") >= min_reviews)
    )
    return joined.agg(
        F.count("*").alias("businesses_analyzed"),
        pearson(F.col("stars"), F.col("avg_review_stars")).alias("correlation_business_vs_review_stars"),
        mean(F.col("stars"), 2).alias("avg_business_stars"),
        mean(F.col("avg_review_stars"), 2).alias("avg_review_stars"),
    )
