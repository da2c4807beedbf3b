"""The weekly sales and review series, its lag features and its correlations.

Rows shrink to one per week (and group) in a map-side aggregate before any window runs, so the ordered windows see weeks,
never orders or reviews.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, WindowSpec, functions as F, types as T

from reviewlake.functions import dates
from reviewlake.functions.numeric import pearson, pearson_or_null, rnd

SCORE_COLUMNS = ("avg_review_score", "std_review_score")
MATRIX_COLUMNS = (
    "total_revenue", "order_count", "avg_review_score", "review_count", "revenue_lag_1", "revenue_roll_4",
    "week_of_year",
)
BASIC_PAIRS = (
    ("avg_review_score", "total_revenue"), ("avg_review_score", "order_count"),
    ("review_count", "total_revenue"), ("review_count", "order_count"),
)
CROSS_METRICS = ("avg_review_score", "review_count")
LAGS = (0, 1, 2)
STEPS = {"week": "interval 7 days", "month": "interval 1 month"}
SIGNIFICANCE = 0.05

# The p-value helper travels with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _in_order(groups: list[str]) -> WindowSpec:
    return Window.partitionBy(*groups).orderBy("week")


def weekly_series(
    orders: DataFrame, order_reviews: DataFrame, group_by: list[str] | None = None, granularity: str = "week"
) -> DataFrame:
    """Orders, revenue, items, review count, mean score and score spread for every week of the calendar.

    Weeks end on Sunday. Weeks without sales count 0; weeks without reviews carry the last known score forward, and
    leading gaps take the mean. ``group_by`` names columns of both tables (a category, a state) to keep series apart.
    ``granularity="month"`` gives calendar months, ``week`` then being a month's first day.
    """
    if granularity not in STEPS:
        raise ValueError(f"unknown granularity {granularity!r}; known ones are {sorted(STEPS)}")
    groups, step = group_by or [], F.expr(STEPS[granularity])

    def period(c: Column) -> Column:
        return dates.week_ending_sunday(c) if granularity == "week" else F.trunc(c.cast("date"), "month")

    sales = (
        orders.where(F.col("purchase_date").isNotNull())
        .groupBy(*groups, period(F.col("purchase_date")).alias("week"))
        .agg(
            F.count("order_id").alias("order_count"),
            F.sum("order_total").alias("total_revenue"),
            F.sum("item_count").alias("total_items"),
        )
    )
    moment = F.col("review_answer_timestamp")
    if isinstance(order_reviews.schema["review_answer_timestamp"].dataType, T.StringType):
        moment = dates.parse_datetime(moment)
    reviews = (
        order_reviews.where(moment.isNotNull())
        .groupBy(*groups, period(moment).alias("week"))
        .agg(
            F.count("review_id").alias("review_count"),
            F.avg("review_score").alias("avg_review_score"),
            F.stddev_samp("review_score").alias("std_review_score"),
        )
    )
    observed = sales.select(*groups, "week").unionByName(reviews.select(*groups, "week"))
    span = observed.agg(F.min("week").alias("first"), F.max("week").alias("last"))
    calendar_range = F.sequence("first", "last", step)
    if groups:
        bounds = span.select(F.struct("first", "last")).scalar()
        keys = observed.select(*groups).distinct().withColumn("_s", bounds)
        calendar = keys.select(*groups, F.explode(F.sequence("_s.first", "_s.last", step)).alias("week"))
    else:
        calendar = span.select(F.explode(calendar_range).alias("week"))

    joined = calendar.join(sales, [*groups, "week"], "left").join(reviews, [*groups, "week"], "left")
    joined = joined.fillna(0, subset=["order_count", "total_revenue", "total_items", "review_count"])
    known = _in_order(groups).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = joined.withColumns({c: F.last(c, ignorenulls=True).over(known) for c in SCORE_COLUMNS})
    whole = Window.partitionBy(*groups)
    return carried.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(whole)) for c in SCORE_COLUMNS})


def weekly_features(
    series: DataFrame, group_by: list[str] | None = None, include_current: bool = False, drop_incomplete: bool = True
) -> DataFrame:
    """Lags, the 4-week mean and calendar columns.

    The mean covers the four weeks before the current one. ``include_current=True`` covers the current week and three
    before it, which puts the value to be predicted among its own predictors.
    """
    w = _in_order(group_by or [])
    frame = w.rowsBetween(-3, 0) if include_current else w.rowsBetween(-4, -1)
    revenue = F.col("total_revenue")
    out = series.withColumns({
        "revenue_lag_1": F.lag(revenue, 1).over(w),
        "revenue_lag_2": F.lag(revenue, 2).over(w),
        "revenue_lag_4": F.lag(revenue, 4).over(w),
        "orders_lag_1": F.lag("order_count", 1).over(w),
        "revenue_roll_4": F.avg(revenue).over(frame),
        "week_of_year": F.weekofyear("week"),
        "month": F.month("week"),
    })
    return out.dropna(subset=["revenue_lag_1", "revenue_lag_2", "revenue_lag_4"]) if drop_incomplete else out


def latest_weeks(features: DataFrame, n: int = 4) -> DataFrame:
    """The last weeks with revenue: what a forecast starts from."""
    return features.where(F.col("total_revenue") > 0).orderBy(F.desc("week")).limit(n)


def _pair_rows(df: DataFrame, pairs: list[tuple[str, str]], groups: list[str]) -> DataFrame:
    """One row per column pair with complete-pair count and r, from a single aggregation."""
    aggregates = []
    for i, (x, y) in enumerate(pairs):
        complete = F.col(x).isNotNull() & F.col(y).isNotNull()
        aggregates += [
            F.count_if(complete).alias(f"n{i}"), pearson_or_null(F.col(x), F.col(y)).alias(f"r{i}"),
        ]
    row = df.groupBy(*groups).agg(*aggregates)
    structs = F.array(*[
        F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r"))
        for i, (x, y) in enumerate(pairs)
    ])
    return row.select(*groups, F.inline(structs)).withColumn("r", F.when(F.col("n") >= 3, F.col("r")))


def weekly_corr(features: DataFrame, group_by: list[str] | None = None) -> DataFrame:
    """Same-week correlations of reviews and sales."""
    return _pair_rows(features, list(BASIC_PAIRS), group_by or [])


def weekly_corr_matrix(features: DataFrame) -> DataFrame:
    """Correlation matrix of the weekly columns in long form."""
    pairs = [(x, y) for x in MATRIX_COLUMNS for y in MATRIX_COLUMNS]
    row = features.agg(*[pearson(F.col(x), F.col(y)).alias(f"r{i}") for i, (x, y) in enumerate(pairs)])
    structs = F.array(*[
        F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"r{i}").alias("r")) for i, (x, y) in enumerate(pairs)
    ])
    return row.select(F.inline(structs))


def weekly_cross_corr(
    features: DataFrame, group_by: list[str] | None = None, metrics: tuple[str, ...] = CROSS_METRICS
) -> DataFrame:
    """Correlation of this week's reviews with the revenue of this and the next two weeks, and the strongest lag."""
    groups = group_by or []
    w = _in_order(groups)
    led = features.withColumns({f"revenue_t{k}": F.lead("total_revenue", k).over(w) for k in LAGS})
    pairs = [(m, f"revenue_t{k}") for m in metrics for k in LAGS]
    rows = _pair_rows(led, pairs, groups).select(
        *groups, F.col("x").alias("metric"), F.regexp_extract("y", r"(\d)$", 1).cast("int").alias("lag"), "n", "r"
    )
    best = Window.partitionBy(*groups).orderBy(F.desc_nulls_last(F.abs("r")), "metric", "lag")
    return rows.withColumn("is_best", F.row_number().over(best) == 1)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the standard modified Lentz recurrence."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 400):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return value


def two_sided_p(r: float, n: int) -> float:
    """p-value of a Pearson r over n pairs (Student t with n - 2 degrees of freedom)."""
    if n is None or r is None or math.isnan(r) or n < 3:
        return float("nan")
    if n == 2 or abs(r) >= 1.0:
        return 0.0
    dof = n - 2
    a, b, x = dof / 2.0, 0.5, 1.0 - r * r
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) if r != 0.0 else 0.0
    if r == 0.0:
        return 1.0
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([
        None if pd.isna(x) or k < 3 else two_sided_p(float(x), int(k)) for x, k in zip(r, n)
    ], dtype="float64")


def with_significance(correlations: DataFrame) -> DataFrame:
    """Add the p-value and a p < 0.05 flag to a correlation result (a handful of rows)."""
    out = correlations.withColumn("p", p_value(F.col("r"), F.col("n").cast("long")))
    return out.withColumn("p", F.when(~F.isnan("p"), F.col("p"))).withColumn(
        "significant", F.coalesce(F.col("p") < SIGNIFICANCE, F.lit(False))
    )


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round result columns, for display or comparison."""
    return df.withColumns({c: rnd(F.col(c), k) for c, k in digits.items()})
