"""Aggregates over orders, order items, products and order reviews.

Joins that would multiply reviews by items are replaced by joins of per-key sums and counts, which give the same totals
whatever the number of reviews or items behind one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reviewlake.functions.dates import year_month_label
from reviewlake.functions.numeric import count_if, mean, money_mean, pearson, rnd
from reviewlake.operators.quantiles import exact_quantiles
from reviewlake.operators.silver import with_review_month
from reviewlake.schemas import require


def sales_by_month(orders: DataFrame) -> DataFrame:
    return orders.groupBy("year", "month").agg(
        F.count("*").alias("order_count"),
        rnd(F.sum("order_total"), 2).alias("total_revenue"),
        money_mean(F.col("order_total")).alias("avg_order_value"),
        F.sum("item_count").alias("total_items"),
    ).orderBy("year", "month")


def sales_summary(orders: DataFrame) -> DataFrame:
    """Revenue, orders and revenue per order over all orders; 0 per order when there are none."""
    revenue, n = F.sum("order_total"), F.count("*")
    return orders.agg(
        rnd(revenue, 2).alias("total_revenue"),
        n.alias("total_orders"),
        F.coalesce(rnd(F.try_divide(rnd(revenue, 2), n), 2), F.lit(0.0)).alias("avg_order_value"),
    )


def orders_by_month(orders: DataFrame) -> DataFrame:
    return (
        orders.groupBy("year", "month").agg(F.count("*").alias("orders_count"))
        .withColumn("year_month", year_month_label(F.col("year"), F.col("month")))
        .orderBy("year", "month")
    )


def revenue_by_month(order_items: DataFrame) -> DataFrame:
    """Item revenue and mean item price per purchase month."""
    return order_items.groupBy(F.col("purchase_year").alias("year"), F.col("purchase_month").alias("month")).agg(
        rnd(F.sum("price"), 2).alias("total_revenue"), money_mean(F.col("price")).alias("avg_price"),
    ).orderBy("year", "month")


def sales_by_category(order_items: DataFrame, top_n: int = 20) -> DataFrame:
    """Orders, revenue and revenue per order of the best-selling categories.

    An order counts once per category; lines are summed per order and category first.
    """
    per_order = require(order_items, "category_en").groupBy("category_en", "order_id").agg(
        F.sum("price").alias("order_total")
    )
    return per_order.groupBy("category_en").agg(
        F.count("*").alias("order_count"),
        rnd(F.sum("order_total"), 2).alias("total_revenue"),
        money_mean(F.col("order_total")).alias("avg_order_value"),
    ).orderBy(F.desc("total_revenue"), "category_en").limit(top_n)


def product_sales(items: DataFrame) -> DataFrame:
    """Sales per product: the pre-aggregate every category report starts from."""
    return items.groupBy("product_id").agg(
        F.count("*").alias("times_sold"), money_mean(F.col("price")).alias("avg_price"), F.sum("price").alias("total_revenue"),
    )


def revenue_by_category(items: DataFrame, products: DataFrame, top_n: int = 15) -> DataFrame:
    """Top categories by item revenue. Items collapse per product before products are joined."""
    named = products.select("product_id", "product_category_name")
    return (
        product_sales(items).join(named, "product_id", "left")
        .groupBy("product_category_name")
        .agg(rnd(F.sum("total_revenue"), 2).alias("total_revenue"), F.sum("times_sold").alias("items_sold"))
        .orderBy(F.desc("total_revenue"), F.asc("product_category_name"))
        .limit(top_n)
    )


def top_product_categories(products: DataFrame, top_n: int = 15) -> DataFrame:
    return products.groupBy("product_category_name").agg(F.count("*").alias("product_count")).orderBy(
        F.desc("product_count"), "product_category_name"
    ).limit(top_n)


def product_review_scores(order_reviews: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    """Summed scores and review counts per product (null product: reviewed orders without items).

    Every review of an order counts for every item of it. Reviews are summed per order and items counted per order and
    product, so review x item pairs are never produced.
    """
    scored = order_reviews.groupBy("order_id").agg(
        F.sum("review_score").alias("_sum"), F.count("review_score").alias("_rated")
    )
    lines = items.groupBy("order_id", "product_id").agg(F.count("*").alias("_lines"))
    known = scored.join(orders.select("order_id"), "order_id", "inner")
    times = F.coalesce(F.col("_lines"), F.lit(1))
    return known.join(lines, "order_id", "left").groupBy("product_id").agg(
        F.sum(F.col("_sum") * times).alias("score_sum"), F.sum(F.col("_rated") * times).alias("review_count")
    )


def rating_by_category(
    order_reviews: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame, min_reviews: int = 100
) -> DataFrame:
    """Mean score per product category with at least ``min_reviews`` reviews."""
    scores = product_review_scores(order_reviews, orders, items)
    named = products.select("product_id", "product_category_name")
    return (
        scores.join(named, "product_id", "left")
        .groupBy("product_category_name")
        .agg(F.sum("score_sum").alias("_sum"), F.sum("review_count").alias("review_count"))
        .where(F.col("review_count") >= min_reviews)
        .select(
            "product_category_name",
            rnd(F.try_divide(F.col("_sum"), F.col("review_count")), 4).alias("avg_score"),
            "review_count",
        )
        .orderBy(F.desc("avg_score"), "product_category_name")
    )


def product_features(
    order_reviews: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame
) -> DataFrame:
    """Per sold product: sales, mean price, revenue, mean score, review count and product attributes."""
    scores = product_review_scores(order_reviews, orders, items).select(
        "product_id",
        F.try_divide(F.col("score_sum"), F.col("review_count")).alias("avg_review_score"),
        "review_count",
    )
    attributes = products.select("product_id", "product_category_name", "product_weight_g")
    return product_sales(items).join(scores, "product_id", "left").join(attributes, "product_id", "left")


def product_corr(features: DataFrame, min_reviews: int = 3) -> DataFrame:
    """Product-level correlations of score, price, volume and revenue."""
    score, sold = F.col("avg_review_score"), F.col("times_sold")
    return features.where(F.col("review_count") >= min_reviews).agg(
        pearson(score, sold).alias("corr_score_sold"),
        pearson(score, F.col("total_revenue")).alias("corr_score_revenue"),
        pearson(F.col("avg_price"), sold).alias("corr_price_sold"),
    )


def _scored_orders(orders: DataFrame, order_reviews: DataFrame) -> DataFrame:
    """Orders with their reviews; an order with several reviews appears once per review."""
    right = order_reviews.select("order_id", "review_score", "has_comment")
    return orders.select("order_id", "order_total").join(right, "order_id", "inner")


def score_metrics(orders: DataFrame, order_reviews: DataFrame) -> DataFrame:
    """Order value per review score."""
    return _scored_orders(orders, order_reviews).groupBy("review_score").agg(
        F.count("*").alias("order_count"),
        money_mean(F.col("order_total")).alias("avg_order_value"),
        rnd(F.sum("order_total"), 2).alias("total_revenue"),
        count_if(F.col("has_comment")).alias("with_comment"),
    ).orderBy("review_score")


def score_value_corr(orders: DataFrame, order_reviews: DataFrame) -> DataFrame:
    """Correlation of score and order value; a missing value counts as 0, unlike in the means above."""
    joined = _scored_orders(orders, order_reviews)
    return joined.agg(
        F.count("*").alias("orders_with_reviews"),
        pearson(F.col("review_score"), F.coalesce(F.col("order_total"), F.lit(0.0))).alias(
            "correlation_score_vs_value"
        ),
    )


def price_by_score(orders: DataFrame, order_reviews: DataFrame) -> DataFrame:
    """Mean and median order price per score, over reviews whose order has items."""
    priced = order_reviews.select("order_id", "review_score").join(
        orders.select("order_id", F.col("order_total").alias("order_price")), "order_id", "left"
    ).where(F.col("order_price").isNotNull())
    out = exact_quantiles(
        priced, "order_price", {"median_price": (0.5, "linear")}, by=["review_score"],
        moments={"avg_price": money_mean, "count": F.count},
    )
    return out.select(
        "review_score", "avg_price", rnd(F.col("median_price"), 3).alias("median_price"), "count",
    ).orderBy("review_score")


def status_counts(orders: DataFrame) -> DataFrame:
    return orders.groupBy("order_status").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "order_status")


def price_stats(items: DataFrame) -> DataFrame:
    """Price statistics over all items, with revenue including freight."""
    prices = exact_quantiles(
        items, "price", {"median_price": (0.5, "linear")},
        moments={"avg_price": money_mean, "min_price": F.min, "max_price": F.max, "_revenue": F.sum},
    )
    freight = items.agg(F.struct(money_mean(F.col("freight_value"), cents=4).alias("mean"), F.sum("freight_value").alias("total"))).scalar()
    return prices.withColumn("_f", freight).select(
        "avg_price", "min_price", "max_price",
        rnd(F.col("median_price"), 3).alias("median_price"),
        rnd(F.col("_revenue"), 2).alias("total_revenue"),
        F.col("_f.mean").alias("avg_freight"),
        rnd(F.col("_revenue") + F.col("_f.total"), 1).alias("revenue_with_freight"),
    )


def product_stats(products: DataFrame) -> DataFrame:
    return products.agg(
        mean(F.col("product_name_length"), 2).alias("avg_name_length"),
        mean(F.col("product_description_length"), 2).alias("avg_desc_length"),
        mean(F.col("product_photos_qty"), 2).alias("avg_photos"),
        mean(F.col("product_weight_g"), 2).alias("avg_weight_g"),
        F.countDistinct("product_category_name").alias("unique_categories"),
    )


def sales_features(
    orders: DataFrame, order_reviews: DataFrame | None = None, by_category: bool = False
) -> DataFrame:
    """Gold monthly sales, with the mean score and number of reviews answered in the same month."""
    keys = ["year", "month"] + (["category_en"] if by_category else [])
    monthly = require(orders, *keys).groupBy(*keys).agg(
        F.count("*").alias("order_count"),
        rnd(F.sum("order_total"), 2).alias("total_revenue"),
        money_mean(F.col("order_total")).alias("avg_order_value"),
        F.sum("item_count").alias("total_items"),
    )
    if order_reviews is not None:
        answered = with_review_month(order_reviews).groupBy("year", "month").agg(
            mean(F.col("review_score"), 2).alias("avg_review_score"), F.count("*").alias("review_count")
        )
        monthly = monthly.join(answered, ["year", "month"], "left")
    return monthly.orderBy(*keys)


def orders_by_item_category(order_items: DataFrame) -> DataFrame:
    """Item-level sales rolled up to one row per order and category, the input of category-level sales features."""
    return order_items.groupBy(
        "order_id", "category_en", F.col("purchase_year").alias("year"), F.col("purchase_month").alias("month")
    ).agg(F.sum("price").alias("order_total"), F.count("*").alias("item_count"))
