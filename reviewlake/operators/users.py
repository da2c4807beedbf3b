"""User statistics and the three influence scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reviewlake.functions.numeric import count_if, mean, pct, rnd
from reviewlake.operators.quantiles import exact_quantiles

# Caps and weights of the influence scores.
CAPS = {"fans": 10000, "total_compliments": 10000, "review_count": 5000, "friends_count": 5000}
WEIGHTS = {"fans": 0.30, "total_compliments": 0.20, "review_count": 0.20, "friends_count": 0.10}
ELITE_WEIGHT = 0.20
VOTE_WEIGHTS = {"review_count": 0.3, "fans": 0.3, "useful": 0.3}
VOTE_ELITE_WEIGHT = 0.1


def user_stats(users: DataFrame) -> DataFrame:
    out = users.agg(
        F.count("*").alias("total_users"),
        mean(F.col("review_count"), 1).alias("avg_review_count"),
        mean(F.col("fans"), 1).alias("avg_fans"),
        mean(F.col("average_stars"), 2).alias("avg_average_stars"),
        count_if(F.col("is_elite")).alias("elite_users"),
    )
    return out.withColumn("elite_pct", pct(F.col("elite_users"), F.col("total_users"), 1))


def user_overview(users: DataFrame) -> DataFrame:
    """Wider one-row overview: medians, maxima, friends and compliments."""
    return users.agg(
        mean(F.col("review_count"), 2).alias("avg_reviews"),
        F.median("review_count").alias("median_reviews"),
        F.max("review_count").alias("max_reviews"),
        mean(F.col("friends_count"), 2).alias("avg_friends"),
        mean(F.col("fans"), 2).alias("avg_fans"),
        rnd(F.avg(F.col("is_elite").cast("int")), 4).alias("pct_elite"),
        mean(F.col("average_stars"), 4).alias("avg_avg_stars"),
        mean(F.col("total_compliments"), 2).alias("avg_compliments"),
    )


def top_reviewers(users: DataFrame, n: int = 10) -> DataFrame:
    return users.orderBy(F.desc("review_count"), "user_id").limit(n).select(
        "user_id", "review_count", "fans", "average_stars"
    )


def elite_comparison(users: DataFrame) -> DataFrame:
    return users.groupBy("is_elite").agg(
        F.count("*").alias("count"),
        mean(F.col("review_count"), 2).alias("avg_reviews"),
        mean(F.col("friends_count"), 2).alias("avg_friends"),
        mean(F.col("fans"), 2).alias("avg_fans"),
        mean(F.col("average_stars"), 4).alias("avg_rating"),
        mean(F.col("total_compliments"), 2).alias("avg_compliments"),
    ).orderBy("is_elite")


def _with_maxima(users: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``_max``: column maxima of the whole table, at least 1, as a one-row scalar subquery."""
    maxima = users.agg(F.struct(*[F.greatest(F.max(c), F.lit(1)).alias(c) for c in columns])).scalar()
    return users.withColumn("_max", maxima)


def user_influence(users: DataFrame) -> DataFrame:
    """Score from reviews, fans and useful votes relative to their maxima, plus an elite bonus; 4 digits."""
    score = F.lit(0.0)
    for name, weight in VOTE_WEIGHTS.items():
        score = score + F.col(name) / F.col(f"_max.{name}") * weight
    score = score + F.col("is_elite").cast("double") * VOTE_ELITE_WEIGHT
    return _with_maxima(users, list(VOTE_WEIGHTS)).withColumn("influence_score", rnd(score, 4)).drop("_max")


def user_influence_capped(users: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Score against fixed caps, each part clipped at 1; no pass over the table is needed first."""
    caps = {**CAPS, **(caps or {})}
    score = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        score = score + F.least(F.col(name) / max(caps[name], 1), F.lit(1.0)) * weight
    score = score + F.when(F.col("is_elite"), 1.0).otherwise(0.0) * ELITE_WEIGHT
    return users.withColumn("influence_score", rnd(F.least(score, F.lit(1.0)), 4))


def user_influence_relative(users: DataFrame) -> DataFrame:
    """The capped score's weights with caps read from the data (at least 1); not rounded."""
    score = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        score = score + F.col(name) / F.col(f"_max.{name}") * weight
    score = score + F.col("is_elite").cast("double") * ELITE_WEIGHT
    return _with_maxima(users, list(WEIGHTS)).withColumn("influence_score", score).drop("_max")


def influence_stats(scored: DataFrame) -> DataFrame:
    """Mean, deviation, median and upper quantiles (nearest rank) of an influence score."""
    out = exact_quantiles(
        scored, "influence_score",
        {"median": (0.5, "linear"), "p90": (0.9, "nearest"), "p99": (0.99, "nearest")},
        moments={"mean": F.avg, "std": F.stddev_samp},
    )
    return out.select(*[rnd(F.col(c), 4).alias(c) for c in ("mean", "median", "std", "p90", "p99")])


def top_influencers(scored: DataFrame, n: int = 10) -> DataFrame:
    return scored.orderBy(F.desc("influence_score"), "user_id").limit(n).select(
        "user_id", "name", "review_count", "fans", "is_elite", "elite_years_count",
        rnd(F.col("influence_score"), 6).alias("influence_score"),
    )


def trimmed_users(users: DataFrame, below: int = 500) -> DataFrame:
    """Users kept for a reviews-against-fans distribution: heavy tails trimmed."""
    return users.where((F.col("review_count") < below) & (F.col("fans") < below))
