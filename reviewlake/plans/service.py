"""The named analyses over stored layers: one method per question, each returning DataFrames.

Bronze, silver and gold are directories of tables under one root. Datasets are ``reviews`` (dated reviews),
``undated`` (reviews without dates) and ``orders`` (order reviews with sales).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlake import schemas
from reviewlake.errors import DatasetError, MissingTableError
from reviewlake.operators import (
    aspects, businesses, classify, forecast, profile, reviews, sales, sampling, sentiment, silver, users, weekly,
)
from reviewlake.sources import inventory, readers, sinks

BUILDS = ("reviews", "users", "businesses", "undated", "orders")


class ReviewLake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- layers -------------------------------------------------------------------------------

    def path(self, layer: str, table: str) -> str:
        return f"{self.root}/{layer}/{table}"

    def silver(self, table: str) -> DataFrame:
        return self._stored("silver", schemas.SILVER[table])

    def gold(self, table: str) -> DataFrame:
        return self._stored("gold", schemas.GOLD[table])

    def _stored(self, layer: str, table: str) -> DataFrame:
        df = inventory.try_read(self.spark, self.path(layer, table))
        if df is None:
            raise MissingTableError(f"{layer} table {table!r} is not built yet: {self.path(layer, table)}")
        return df

    def _dataset(self, name: str, dated: bool = False, with_sales: bool = False) -> schemas.Dataset:
        if name not in schemas.DATASETS:
            raise DatasetError(f"unknown dataset {name!r}; known datasets are {sorted(schemas.DATASETS)}")
        found = schemas.DATASETS[name]
        if dated and not found.dated:
            raise DatasetError(f"dataset {name!r} has no dates")
        if with_sales and not found.sales:
            raise DatasetError(f"dataset {name!r} has no sales")
        return found

    def _reviews(self, dataset: str, dated: bool = False) -> DataFrame:
        found = self._dataset(dataset, dated)
        df = self.silver(found.table)
        return silver.with_review_month(df) if dataset == "orders" else df

    # --- builds -------------------------------------------------------------------------------

    def build_dataset_silver(self, dataset: str, overwrite: bool = False, limit: int | None = None) -> list[str]:
        """Build the silver tables of one dataset from bronze; existing tables are kept unless ``overwrite``."""
        spark, out = self.spark, []

        def store(table: str, df: DataFrame, **options) -> None:
            out.append(sinks.write_table(df, self.path("silver", schemas.SILVER[table]), overwrite, **options))

        if dataset == "reviews":
            raw = readers.read_reviews(spark, self.path("bronze", "reviews"), limit)
            store("reviews", silver.silver_reviews(raw))
        elif dataset == "users":
            store("users", silver.silver_users(readers.read_users(spark, self.path("bronze", "users"), limit)))
        elif dataset == "businesses":
            store("businesses", silver.silver_businesses(readers.read_businesses(spark, self.path("bronze", "businesses"))))
        elif dataset == "undated":
            raw = readers.read_undated_reviews(spark, self.path("bronze", "undated_reviews"), limit)
            store("undated_reviews", silver.silver_undated_reviews(raw))
        elif dataset == "orders":
            shop = readers.read_shop(spark, self.path("bronze", "shop"))
            missing = [t for t in ("orders", "items", "reviews", "products") if shop[t] is None]
            if missing:
                raise MissingTableError(f"bronze tables {missing} are missing")
            store("orders", silver.silver_orders(shop["orders"], shop["items"]))
            store("order_items", silver.silver_order_items(shop["orders"], shop["items"], shop["products"], shop["categories"]))
            store("order_reviews", silver.silver_order_reviews(shop["reviews"]))
        else:
            raise DatasetError(f"nothing to build for {dataset!r}; known builds are {BUILDS}")
        return out

    def build_all_silver(self, overwrite: bool = False, sample_size: int | None = None) -> DataFrame:
        """Build every silver table from all its rows, or from the first ``sample_size`` by key if that is given.

        A table that fails is reported and does not stop the others.
        """
        rows = []
        for dataset in BUILDS:
            try:
                for path in self.build_dataset_silver(dataset, overwrite, sample_size):
                    rows.append((dataset, path, "built"))
            except (AnalysisException, MissingTableError, DatasetError) as e:
                rows.append((dataset, None, f"error: {e}"[:500]))
        return self.spark.createDataFrame(rows, "dataset string, path string, status string")

    def build_gold_features(
        self, dataset: str, overwrite: bool = False, sample_size: int | None = None, use_text: bool = True,
        model: classify.SentimentModel | None = None, extract_aspects: bool = False,
    ) -> str:
        """Store the scored reviews of a dataset."""
        found = self._dataset(dataset)
        rows = sampling.first_rows(self.silver(found.table), "review_id", sample_size)
        scored = sentiment.gold_features(rows, use_text, model, language=found.language)
        if extract_aspects:
            scored = aspects.with_aspects(scored).withColumn(
                "aspect_keywords", aspects.mentioned(aspects.DEFAULT_TAXONOMY)
            ).drop("clean_text", "clean_length", "text_sentiment", "aspect_labels")
        return sinks.write_table(scored, self.path("gold", schemas.GOLD[found.table]), overwrite)

    def build_sales_features(self, overwrite: bool = False) -> str:
        df = sales.sales_features(self.silver("orders"), self.silver("order_reviews"))
        return sinks.write_table(df, self.path("gold", schemas.GOLD["sales"]), overwrite)

    def build_user_features(self, overwrite: bool = False) -> str:
        df = users.user_influence(silver.with_years_active(self.silver("users")))
        return sinks.write_table(df, self.path("gold", schemas.GOLD["users"]), overwrite)

    # --- questions ----------------------------------------------------------------------------

    def get_reviews_distribution(self, dataset: str) -> dict[str, DataFrame]:
        df = self._reviews(dataset)
        return {"distribution": reviews.reviews_by_stars(df), "summary": reviews.rating_summary(df)}

    def get_reviews_by_month(self, dataset: str, year: int | None = None, materialize: bool = False) -> DataFrame:
        out = reviews.reviews_by_month(self._reviews(dataset, dated=True), year)
        if materialize:
            path = sinks.materialize_aggregate(out, f"{self.root}/gold", "reviews_by_month", dataset)
            return self.spark.read.parquet(path)
        return out

    def get_sales_by_month(self) -> dict[str, DataFrame]:
        orders = self.silver("orders")
        return {"months": sales.sales_by_month(orders), "summary": sales.sales_summary(orders)}

    def get_user_stats(self) -> dict[str, DataFrame]:
        table = self.silver("users")
        return {"stats": users.user_stats(table), "top_reviewers": users.top_reviewers(table)}

    def get_business_stats(self) -> dict[str, DataFrame]:
        table = self.silver("businesses")
        return {
            "stats": businesses.business_stats(table), "top_states": businesses.top_states(table),
            "rating_distribution": businesses.business_ratings(table),
        }

    def get_ambiguous_reviews_analysis(self, dataset: str, sample: int = 5) -> dict[str, DataFrame]:
        df = self._reviews(dataset)
        three = df.where("is_ambiguous").select("review_id", "text", "text_length")
        return {"stats": reviews.ambiguous_stats(df), "sample": sampling.sample_rows(three, "review_id", sample)}

    def get_text_length_analysis(self, dataset: str, bins: list[int] | None = None) -> DataFrame:
        return reviews.by_text_length(self._reviews(dataset), bins)

    def get_sales_by_category(self, top_n: int = 20) -> DataFrame:
        return sales.sales_by_category(self.silver("order_items"), top_n)

    def get_reviews_sales_correlation_basic(self) -> dict[str, DataFrame]:
        orders, order_reviews = self.silver("orders"), self.silver("order_reviews")
        return {
            "by_score": sales.score_metrics(orders, order_reviews),
            "correlation": sales.score_value_corr(orders, order_reviews),
        }

    def weekly_series(self, granularity: str = "week") -> DataFrame:
        return weekly.weekly_series(self.silver("orders"), self.silver("order_reviews"), granularity=granularity)

    def get_reviews_sales_correlation(self, granularity: str = "week") -> dict[str, DataFrame]:
        """Correlations of the same week and of later ones with significance, or of months."""
        features = weekly.weekly_features(self.weekly_series(granularity))
        return {
            "basic": weekly.with_significance(weekly.weekly_corr(features)),
            "cross": weekly.with_significance(weekly.weekly_cross_corr(features)),
        }

    def get_sentiment_sales_correlation(self, granularity: str = "week") -> DataFrame:
        features = weekly.weekly_features(self.weekly_series(granularity))
        return weekly.with_significance(weekly.weekly_cross_corr(features, metrics=("avg_review_score",)))

    def train_sales_model(self) -> str:
        """Fit, choose and store the weekly forecast model."""
        path = self.path("models", "sales_forecast")
        forecast.train_forecaster(weekly.weekly_features(self.weekly_series())).save(path)
        return path

    def predict_weekly_sales(self, weeks: int = 1, **overrides: float) -> DataFrame:
        """Revenue of the coming weeks from the stored model; keyword arguments replace inputs of the first one."""
        forecaster = forecast.Forecaster.load(self.spark, self.path("models", "sales_forecast"))
        return forecast.sales_forecast(forecaster, self.weekly_series(), overrides=overrides, weeks=weeks)

    def get_prediction_model_info(self) -> DataFrame:
        forecaster = forecast.Forecaster.load(self.spark, self.path("models", "sales_forecast"))
        return forecast.model_quality(forecaster.metrics).withColumn("chosen", F.col("model") == forecaster.name)

    def get_dataset_status(self, dataset: str | None = None) -> DataFrame:
        """Existence, rows and columns of every bronze, silver and gold table, or of those of one dataset."""
        shop = {n: (f"{self.path('bronze', 'shop')}/{n}.csv", "csv") for n in schemas.SHOP_TABLES}
        raw = {n: (self.path("bronze", n), "json") for n in ("reviews", "users", "businesses")}
        raw["undated_reviews"] = (self.path("bronze", "undated_reviews"), "csv")
        paths = {f"bronze.{n}": p for n, p in (raw | {f"shop.{n}": p for n, p in shop.items()}).items()}
        paths |= {f"silver.{n}": (self.path("silver", t), "parquet") for n, t in schemas.SILVER.items()}
        paths |= {f"gold.{n}": (self.path("gold", t), "parquet") for n, t in schemas.GOLD.items()}
        if dataset is not None:
            own = {self._dataset(dataset).table} | ({"orders", "order_items", "sales"} if dataset == "orders" else set())
            shown = lambda n: n.split(".")[-1] in own or (dataset == "orders" and ".shop." in n)
            paths = {n: p for n, p in paths.items() if shown(n)}
        status = None
        for fmt in ("json", "csv", "parquet"):
            if chosen := {n: path for n, (path, kind) in paths.items() if kind == fmt}:
                part = inventory.table_inventory(self.spark, chosen, fmt)
                status = part if status is None else status.unionByName(part)
        return status.orderBy("table_name")

    def get_nlp_models_status(self, names: tuple[str, ...] = ("sentiment", "aspects", "sales_forecast")) -> DataFrame:
        """Which fitted models are stored: a model directory always holds metadata text files."""
        rows = []
        for name in names:
            found = inventory.try_read(self.spark, f"{self.path('models', name)}/*/metadata", "text")
            rows.append((name, self.path("models", name), found is not None))
        return self.spark.createDataFrame(rows, "model string, path string, exists boolean")

    def train_sentiment_model(self, dataset: str, kind: str = "logistic") -> str:
        """Fit a sentiment model on all rated reviews of a dataset and store it with its held-out metrics."""
        path = self.path("models", "sentiment")
        rows = classify.training_rows(self._reviews(dataset))
        classify.train_sentiment(rows, kind).save(path)
        kept = rows.select("review_id", "_clean", "_terms", "label_name")
        classify.sentiment_model_metrics(kept, "review_id", (kind,)).write.mode("overwrite").parquet(f"{path}/quality")
        return path

    def get_sentiment_distribution(
        self, dataset: str, year: int | None = None, stars: int | None = None, model: classify.SentimentModel | None = None
    ) -> DataFrame:
        """Labels by the lexicon, or by a fitted model."""
        df = self._reviews(dataset, dated=year is not None)
        if model is None:
            return sentiment.sentiment_distribution(df, year, stars)
        return sentiment.sentiment_distribution(classify.predict_sentiment(df, model), year, stars, label=F.col("predicted_label"))

    def get_aspect_distribution(
        self, dataset: str, sentiment_filter: str | None = None, stars: int | None = None
    ) -> DataFrame:
        return aspects.aspect_distribution(self._reviews(dataset), sentiment_filter, stars)

    def get_ambiguous_reviews_sentiment(self, dataset: str) -> DataFrame:
        return sentiment.ambiguous_sentiment(self._reviews(dataset))

    def analyze_sentiment(self, df: DataFrame, model: classify.SentimentModel | None = None) -> DataFrame:
        """Sentiment of a table with a ``text`` column, by a fitted model or by the lexicon."""
        return classify.predict_sentiment(df, model) if model else sentiment.score(df, "lexicon")

    def analyze_review_complete(self, df: DataFrame) -> DataFrame:
        """Sentiment and aspects of a table with ``review_id`` and ``text`` columns."""
        return aspects.analyze_reviews(df)

    def correlate_reviews_business(self, min_reviews: int = 10) -> DataFrame:
        return reviews.business_review_corr(self.silver("reviews"), self.silver("businesses"), min_reviews)

    def get_distribution(self, table: str, column: str) -> DataFrame:
        return reviews.column_distribution(self.silver(table), column)

    def get_top_entities(self, table: str, entity: str, metric: str = "count", n: int = 10, ascending: bool = False) -> DataFrame:
        """Top entities of a silver table. Mean stars of orders come from their reviews."""
        df = self.silver(table)
        if table == "orders" and metric == "avg_stars":
            df = df.join(self.silver("order_reviews").select("order_id", "review_score"), "order_id", "inner")
        return reviews.top_entities(df, entity, metric, n, ascending)

    def profile_dataset(self, table: str) -> dict[str, DataFrame]:
        df = self.silver(table)
        return {
            "profile": profile.profile(df), "samples": profile.sample_values(df), "capabilities": profile.capability_flags(df),
        }

    def get_column_stats(self, table: str, column: str) -> DataFrame:
        return profile.profile_column(self.silver(table), column)

    def get_available_values(self, table: str, column: str, limit: int | None = None) -> DataFrame:
        return profile.available_values(self.silver(table), column, limit)

    def get_date_range(self, table: str) -> DataFrame | None:
        return profile.date_range(self.silver(table))

    def export_latest_weeks(self, path: str, weeks: int = 4) -> None:
        """Write the last weeks of the weekly features as JSON."""
        sinks.export_json(weekly.latest_weeks(weekly.weekly_features(self.weekly_series()), weeks), path)

    def get_feature_stats(self, dataset: str) -> DataFrame:
        return sentiment.gold_sentiment_stats(self.gold(self._dataset(dataset).table))
