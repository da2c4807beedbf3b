"""Every operator as a named query over the demo tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewlake.functions import dates, text as txt
from reviewlake.functions.numeric import rnd
from reviewlake.functions.vocabulary import DEFAULT_LEXICON, DEFAULT_TAXONOMY
from reviewlake.operators import (
    aspects, businesses, classify, evaluation, filters, forecast, matching, profile, quality, reviews, sales, sampling,
    sentiment, silver, terms, users, weekly,
)
from reviewlake.plans.demo_tables import DemoTables
from reviewlake.sources import inventory
from reviewlake.streaming import aggregates

Query = Callable[[SparkSession, str], DataFrame]
FILTER = filters.FilterSpec(
    date_start="2024-01-05", date_end="2024-01-20", min_stars=2, stars=(2, 4, 5), is_ambiguous=False, language="en"
)
_QUERIES: dict[str, Query] = {}


def query(build: Callable[[DemoTables], DataFrame]) -> Callable[[DemoTables], DataFrame]:
    """Register a query under its function name."""
    _QUERIES[build.__name__] = lambda spark, directory: build(DemoTables(spark, directory))
    return build


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _joined(column: str) -> Column:
    """Lists are compared as text."""
    return F.array_join(column, ",").alias(column)


# --- silver tables and sources ------------------------------------------------------------------


@query
def silver_reviews(t):
    return t.reviews


@query
def silver_users(t):
    return t.users


@query
def user_years_active(t):
    return silver.with_years_active(t.users).select("user_id", "years_active")


@query
def silver_businesses(t):
    return t.businesses


@query
def silver_reviews_undated(t):
    return t.undated_reviews


@query
def silver_orders(t):
    return t.orders.withColumn("freight_total", rnd(F.col("freight_total"), 3)).withColumn(
        "order_total", rnd(F.col("order_total"), 2)
    )


@query
def silver_order_reviews(t):
    return t.order_reviews


@query
def silver_order_items(t):
    return t.order_items.withColumns({c: rnd(F.col(c), 3) for c in ("freight_value", "total_value")})


@query
def order_totals(t):
    return silver.order_totals(t.raw_order_items).select(
        "order_id", rnd(F.col("order_total"), 2).alias("order_total"),
        rnd(F.col("freight_total"), 3).alias("freight_total"), "item_count",
    )


@query
def unified_reviews(t):
    return t.corpus.groupBy("dataset", "language").agg(
        F.count("*").alias("n"), F.count("stars").alias("rated"), F.count("category").alias("with_category"),
        F.count("has_comment").alias("with_flag"), F.sum("text_length").alias("characters"),
    )


@query
def table_inventory(t):
    names = (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
        "benchmark", "labels", "conversations", "not_written",
    )
    return inventory.table_inventory(t.spark, {n: f"{t.directory}/{n}.parquet" for n in names}).select(
        "table_name", "exists", "row_count", "column_count"
    )


# --- review aggregates --------------------------------------------------------------------------


@query
def reviews_by_stars(t):
    return reviews.reviews_by_stars(t.reviews)


@query
def rating_summary(t):
    return reviews.rating_summary(t.reviews)


@query
def reviews_by_month(t):
    monthly = silver.with_review_month(t.order_reviews)
    return reviews.reviews_by_month(monthly)


@query
def reviews_by_month_year(t):
    return reviews.reviews_by_month(silver.with_review_month(t.order_reviews), year=1997)


@query
def reviews_by_month_merged(t):
    batches = silver.with_review_month(t.order_reviews).withColumn("batch", F.pmod("order_id", F.lit(7)))
    merged = aggregates.monthly_reviews(aggregates.review_partials(batches, ["batch"]))
    return merged.withColumn("std_stars", rnd(F.col("std_stars"), 4))


@query
def column_distribution(t):
    return reviews.column_distribution(t.reviews, "language")


@query
def top_entities_count(t):
    return reviews.top_entities(t.reviews, "user_id", "count", n=10)


@query
def top_entities_avg_stars(t):
    return reviews.top_entities(t.reviews, "business_id", "avg_stars", n=10)


@query
def top_entities_revenue(t):
    return reviews.top_entities(t.orders, "customer_id", "total_revenue", n=10)


@query
def by_text_length(t):
    return reviews.by_text_length(t.reviews)


@query
def ambiguous_stats(t):
    return reviews.ambiguous_stats(t.reviews)


@query
def ambiguous_comparison(t):
    return reviews.ambiguous_comparison(t.reviews)


@query
def ambiguous_sample(t):
    three = t.reviews.where("is_ambiguous").select("review_id", "text", "text_length")
    return sampling.sample_rows(three, "review_id", 5)


@query
def text_stats(t):
    return reviews.text_stats(t.reviews)


@query
def text_by_stars(t):
    return reviews.text_by_stars(t.order_reviews, commented_only=True)


@query
def reviews_by_year(t):
    return reviews.reviews_by_year(silver.with_review_month(t.order_reviews))


@query
def by_weekday(t):
    return reviews.count_by(t.reviews, dates.iso_weekday(F.col("date")), "day_of_week")


@query
def star_distribution(t):
    return reviews.star_distribution(t.reviews)


@query
def reviews_per_business(t):
    return reviews.reviews_per_business(t.reviews)


@query
def business_review_corr(t):
    return reviews.business_review_corr(t.reviews, t.businesses, min_reviews=3)


@query
def filtered_reviews(t):
    return filters.apply_filters(t.reviews, FILTER).select("review_id", "stars", "date", "language", "text_length")


@query
def generic_aggregate(t):
    spec = filters.FilterSpec(date_start="2024-01-03", is_ambiguous=False)
    return filters.aggregate(t.reviews, "avg_text_length", ["language", "stars"], spec)


# --- sales --------------------------------------------------------------------------------------


@query
def sales_by_month(t):
    return sales.sales_by_month(t.orders)


@query
def sales_summary(t):
    return sales.sales_summary(t.orders)


@query
def orders_by_month(t):
    return sales.orders_by_month(t.orders)


@query
def revenue_by_month(t):
    return sales.revenue_by_month(t.order_items)


@query
def sales_by_category(t):
    return sales.sales_by_category(t.order_items)


@query
def revenue_by_category(t):
    return sales.revenue_by_category(t.raw_order_items, t.raw_products)


@query
def rating_by_category_min100(t):
    return sales.rating_by_category(t.order_reviews, t.raw_orders, t.raw_order_items, t.raw_products)


@query
def product_features(t):
    features = sales.product_features(t.order_reviews, t.raw_orders, t.raw_order_items, t.raw_products)
    return weekly.rounded(features, {"total_revenue": 2, "avg_review_score": 4})


@query
def product_corr(t):
    return sales.product_corr(
        sales.product_features(t.order_reviews, t.raw_orders, t.raw_order_items, t.raw_products)
    )


@query
def score_metrics(t):
    return sales.score_metrics(t.orders, t.order_reviews)


@query
def score_value_corr(t):
    return sales.score_value_corr(t.orders, t.order_reviews)


@query
def price_by_score(t):
    return sales.price_by_score(t.orders, t.order_reviews)


@query
def status_counts(t):
    return sales.status_counts(t.orders)


@query
def price_stats(t):
    return sales.price_stats(t.raw_order_items)


@query
def product_stats(t):
    return sales.product_stats(t.raw_products)


@query
def top_product_categories(t):
    return sales.top_product_categories(t.raw_products)


@query
def sales_features(t):
    return sales.sales_features(t.orders, t.order_reviews)


@query
def sales_features_by_category(t):
    return sales.sales_features(sales.orders_by_item_category(t.order_items), t.order_reviews, by_category=True)


# --- users and businesses -----------------------------------------------------------------------


@query
def user_stats(t):
    return users.user_stats(t.users)


@query
def user_overview(t):
    return users.user_overview(t.users)


@query
def top_reviewers(t):
    return users.top_reviewers(t.users)


@query
def elite_comparison(t):
    return users.elite_comparison(t.users)


@query
def user_influence(t):
    return users.user_influence(t.users).select("user_id", "is_elite", "influence_score")


@query
def user_influence_capped(t):
    return users.user_influence_capped(t.users).select("user_id", "is_elite", "influence_score")


@query
def top_influencers(t):
    return users.top_influencers(users.user_influence_relative(t.users))


@query
def influence_stats(t):
    return users.influence_stats(users.user_influence_relative(t.users))


@query
def business_stats(t):
    return businesses.business_stats(t.businesses)


@query
def top_states(t):
    return businesses.top_states(t.businesses)


@query
def top_cities(t):
    return businesses.top_cities(t.businesses)


@query
def business_ratings(t):
    return businesses.business_ratings(t.businesses)


@query
def open_counts(t):
    return businesses.open_counts(t.businesses)


@query
def category_counts(t):
    return businesses.category_counts(t.businesses)


# --- profiles and checks ------------------------------------------------------------------------


@query
def null_coverage(t):
    return profile.null_coverage(t.raw_businesses, "business_id")


@query
def numeric_summary(t):
    return profile.numeric_summary(reviews.reviews_by_stars(t.reviews))


@query
def table_profile(t):
    ends = {c: rnd(F.col(c), 6) for c in ("min", "max")}  # sums of money end in float noise
    return profile.profile(t.orders).withColumns(ends)


@query
def profile_column(t):
    return profile.profile_column(t.order_reviews, "text_length")


@query
def sample_values(t):
    return profile.sample_values(t.orders).select(
        "column_name", _joined("sample_values")
    )


@query
def available_values(t):
    return profile.available_values(t.businesses, "city")


@query
def date_range(t):
    return profile.date_range(t.reviews)


@query
def range_checks(t):
    gold = sentiment.gold_features(t.reviews)
    return quality.range_checks(
        gold.select("stars", "sentiment_score", "sentiment_label"), required=("stars", "topic_id")
    )


# --- text ---------------------------------------------------------------------------------------


def _cleaned(t, clean):
    return t.raw_reviews.select("review_id", clean(F.col("text")).alias("cleaned"))


@query
def clean_text(t):
    return _cleaned(t, txt.clean_text)


@query
def clean_basic(t):
    return _cleaned(t, txt.clean_basic)


@query
def clean_nlp(t):
    return _cleaned(t, txt.clean_nlp)


@query
def clean_spanish(t):
    return _cleaned(t, txt.clean_spanish)


@query
def clean_portuguese(t):
    return _cleaned(t, txt.clean_portuguese)


@query
def clean_ml(t):
    return _cleaned(t, txt.clean_ml)


@query
def text_stats_ws(t):
    return t.raw_reviews.select("review_id", *[c.alias(n) for n, c in txt.cleaned_stats(F.col("text")).items()])


@query
def text_features(t):
    return t.raw_reviews.select("review_id", *[c.alias(n) for n, c in txt.text_features(F.col("text")).items()])


@query
def term_counts(t):
    return terms.term_counts(t.raw_reviews)


# --- sentiment ----------------------------------------------------------------------------------


def _scored(t, **options):
    return sentiment.flatten(sentiment.score(t.reviews, **options), ["review_id"])


@query
def sentiment_baseline(t):
    return _scored(t, method="stars")


@query
def sentiment_lexicon(t):
    return _scored(t, method="lexicon")


@query
def sentiment_heuristic(t):
    return _scored(t, method="heuristic")


@query
def sentiment_combined(t):
    return _scored(t, method="combined")


@query
def sentiment_combined_soft(t):
    return _scored(t, method="combined", variant="soft")


@query
def ambiguous_reclassified(t):
    return sentiment.reclassify_ambiguous(t.reviews)


@query
def sentiment_distribution(t):
    return sentiment.sentiment_distribution(t.reviews)


@query
def sentiment_distribution_stars3(t):
    return sentiment.sentiment_distribution(t.reviews, stars=3)


@query
def ambiguous_sentiment(t):
    return sentiment.ambiguous_sentiment(t.order_reviews)


@query
def gold_features(t):
    return sentiment.gold_features(t.reviews).select(
        "review_id", "sentiment_score", "sentiment_label", "sentiment_confidence", "model_version"
    )


@query
def gold_sentiment_stats(t):
    return sentiment.gold_sentiment_stats(sentiment.gold_features(t.reviews, batched=True))


@query
def sentiment_by_month(t):
    return sentiment.sentiment_by_month(sentiment.gold_features(t.reviews), "reviews")


@query
def sentiment_by_category(t):
    gold = sentiment.gold_features(t.undated_reviews)
    return aspects.sentiment_by_category(gold, "undated").withColumn("top_aspects", _joined("top_aspects"))


@query
def user_sentiment_stats(t):
    gold = sentiment.gold_features(t.reviews, batched=True)
    return aspects.user_sentiment_stats(gold, t.raw_users, t.businesses).withColumn(
        "top_categories", _joined("top_categories")
    )


# --- aspects ------------------------------------------------------------------------------------


@query
def aspect_mentions(t):
    return aspects.mentions(t.reviews, ["review_id"])


@query
def aspect_mentions_joined(t):
    lists = (matching.TermTable.of(t.reviews.sparkSession, x) for x in (DEFAULT_TAXONOMY, DEFAULT_LEXICON))
    return matching.mentions(t.reviews, "review_id", *lists)


@query
def aspect_distribution(t):
    return aspects.aspect_distribution(t.reviews)


@query
def aspects_negative(t):
    return aspects.aspect_distribution(t.reviews, sentiment="negative")


@query
def aspect_by_source(t):
    return aspects.aspect_by_source(t.corpus, ["reviews", "undated", "orders"], batched=True)


@query
def aspect_sentiment_crosstab(t):
    return aspects.aspect_sentiment_crosstab(t.reviews, batched=True)


@query
def aspect_overlap_metrics(t):
    return aspects.aspect_overlap_metrics(t.annotated)


@query
def review_analysis(t):
    out = aspects.analyze_reviews(t.reviews)
    pairs = F.transform(F.map_entries("aspect_sentiments"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.withColumn("aspect_sentiments", pairs).select(
        "review_id", "text_preview", "global_sentiment", "num_aspects",
        *[_joined(c) for c in ("aspects", "aspect_sentiments", "positive_aspects", "negative_aspects")],
    )


# --- weekly series ------------------------------------------------------------------------------


def _series(t):
    return weekly.weekly_series(t.orders, t.order_reviews)


def _features(t):
    return weekly.weekly_features(_series(t))


_SERIES_DIGITS = {"total_revenue": 2, "avg_review_score": 4, "std_review_score": 4}


@query
def weekly_series(t):
    return weekly.rounded(_series(t), _SERIES_DIGITS)


@query
def weekly_features(t):
    digits = {**_SERIES_DIGITS, **{c: 2 for c in ("revenue_lag_1", "revenue_lag_2", "revenue_lag_4")}}
    return weekly.rounded(_features(t), {**digits, "revenue_roll_4": 4})


@query
def weekly_features_current(t):
    frame = weekly.weekly_features(_series(t), include_current=True)
    return frame.select("week", rnd(F.col("revenue_roll_4"), 4).alias("revenue_roll_4"))


@query
def latest_weeks(t):
    return weekly.rounded(weekly.latest_weeks(_features(t)), {"total_revenue": 2}).select(
        "week", "total_revenue", "order_count", "week_of_year"
    )


@query
def weekly_corr(t):
    return weekly.rounded(weekly.weekly_corr(_features(t)), {"r": 4})


@query
def weekly_corr_matrix(t):
    return weekly.weekly_corr_matrix(_features(t))


@query
def weekly_cross_corr(t):
    return weekly.rounded(weekly.weekly_cross_corr(_features(t)), {"r": 4})


@query
def weekly_corr_significance(t):
    return weekly.rounded(weekly.with_significance(weekly.weekly_cross_corr(_features(t))), {"r": 4, "p": 4})


@query
def monthly_corr(t):
    series = weekly.weekly_series(t.orders, t.order_reviews, granularity="month")
    return weekly.rounded(weekly.weekly_corr(weekly.weekly_features(series)), {"r": 4})


@query
def odd_weeks(t):
    return quality.odd_weeks(weekly.weekly_series(t.orders, t.order_reviews)).select(
        "week", "order_count", "review_count", rnd(F.col("avg_review_score"), 4).alias("avg_review_score")
    )


# --- evaluation and models ----------------------------------------------------------------------


def _judged(t):
    """Lexicon predictions on documents against the quality labels."""
    documents = t.base("documents").select("doc_id", "text", F.col("lang").alias("language"))
    by_text = sentiment.with_lexicon_sentiment(documents).select(
        "doc_id", F.when(F.col("sentiment.label") == "negative", 0).otherwise(1).alias("prediction")
    )
    truth = t.base("labels").select("doc_id", F.col("quality").alias("label"))
    return evaluation.join_predictions(by_text, truth, "doc_id")


@query
def eval_confusion(t):
    return evaluation.confusion(_judged(t))


@query
def eval_metrics(t):
    judged = sentiment.score(t.reviews, "lexicon").withColumn("stars_label", F.when(F.col("stars") >= 4, "positive").when(
        F.col("stars") <= 2, "negative").otherwise("neutral"))
    counts = evaluation.confusion(judged, "stars_label", "sentiment.label", by=["language"])
    return evaluation.classification_metrics(counts, by=["language"])


@query
def stratified_split(t):
    rows = t.reviews.select("review_id", "stars")
    return sampling.stratified_split(rows, "review_id", "stars").groupBy("stars", "is_test").agg(
        F.count("*").alias("count")
    )


@query
def stratified_folds(t):
    rows = t.reviews.select("review_id", "stars")
    return sampling.stratified_folds(rows, "review_id", "stars").groupBy("stars", "fold").agg(
        F.count("*").alias("count")
    )


@query
def sentiment_model_metrics(t):
    rows = classify.training_rows(t.reviews).select("review_id", "_clean", "_terms", "label_name")
    return classify.sentiment_model_metrics(rows, "review_id")


@query
def sentiment_cross_validation(t):
    rows = classify.training_rows(t.reviews).select("review_id", "_clean", "_terms", "label_name")
    return classify.cross_validate(rows, "review_id")


@query
def neutral_trends(t):
    rows = classify.training_rows(t.reviews)
    model = classify.train_sentiment(rows, "logistic")
    return classify.neutral_trends(t.reviews, model)


@query
def aspect_model_metrics(t):
    return classify.aspect_model_metrics(classify.aspect_training_rows(t.reviews, "review_id"), "review_id")


@query
def forecast_metrics(t):
    return forecast.forecast_metrics(_features(t))


@query
def model_quality(t):
    return forecast.model_quality(forecast.forecast_metrics(_features(t)))


@query
def forecast_importance(t):
    return forecast.forecast_importance(t.spark, forecast.train_forecaster(_features(t)))


@query
def sales_forecast(t):
    series = _series(t)
    forecaster = forecast.train_forecaster(weekly.weekly_features(series))
    return forecast.sales_forecast(forecaster, series)


@query
def sales_forecast_weeks(t):
    series = _series(t)
    forecaster = forecast.train_forecaster(weekly.weekly_features(series))
    return forecast.sales_forecast(forecaster, series, weeks=8)


@query
def forecast_inputs(t):
    money = {c: 2 for c in ("revenue_lag_1", "revenue_lag_2", "revenue_lag_4")}
    return weekly.rounded(forecast.next_week_inputs(_series(t)), {**money, "revenue_roll_4": 4, "avg_review_score": 4})


def _by_status(t):
    status = t.orders.select("order_id", "order_status")
    return weekly.weekly_series(t.orders, t.order_reviews.join(status, "order_id"), ["order_status"])


@query
def group_forecast_inputs(t):
    inputs = forecast.next_week_inputs(_by_status(t), ["order_status"])
    return weekly.rounded(inputs.select("order_status", "week", "revenue_lag_1", "revenue_lag_4"), {"revenue_lag_1": 2, "revenue_lag_4": 2})


@query
def group_sales_forecast(t):
    return forecast.group_forecast(_by_status(t), ["order_status"], weeks=4)


@query
def forecast_history(t):
    return forecast.forecast_history(_features(t), "ridge_1")
