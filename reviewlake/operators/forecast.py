"""Weekly revenue forecast: training, choice of model, scoring and reporting on MLlib.

All inputs are weekly rows (one per week and group), already aggregated on the executors.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel, cloudpickle
from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from reviewlake.functions.dates import next_week_of_year
from reviewlake.operators.evaluation import regression_metrics
from reviewlake.operators.weekly import weekly_features

FEATURES = [
    "revenue_lag_1", "revenue_lag_2", "revenue_lag_4", "orders_lag_1", "revenue_roll_4", "avg_review_score",
    "week_of_year",
]
TARGET = "total_revenue"
TRAIN_SHARE = 0.80
MODELS = ("ridge_1", "ridge_10", "lasso_1", "random_forest")

# Inputs assumed when nothing is known, and the R2 cuts of the quality classes.
DEFAULT_INPUTS = {
    "revenue_lag_1": 200000.0, "orders_lag_1": 1500.0, "avg_review_score": 4.1, "week_of_year": 1.0,
}
DEFAULT_RATIOS = {"revenue_lag_2": 0.95, "revenue_lag_4": 0.9}
QUALITY_CUTS = (("excellent", 0.8), ("good", 0.6), ("moderate", 0.4), ("low", 0.0))

# The ridge solver travels with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def chronological_split(features: DataFrame, train_share: float = TRAIN_SHARE) -> DataFrame:
    """Add ``is_test``: the last weeks of the calendar are held out."""
    order = Window.orderBy("week")
    cut = F.floor(F.count("*").over(Window.partitionBy()) * F.lit(train_share))
    weeks = features.select("week").distinct().withColumn("is_test", F.row_number().over(order) > cut)
    return features.join(weeks, "week", "inner")


def _estimator(name: str, n: int, target_std: float, target: str):
    """Penalties are given per row and for a scaled target here, hence the factors for the squared penalty."""
    if name == "random_forest":
        return RandomForestRegressor(
            featuresCol="features", labelCol=target, numTrees=100, maxDepth=5, minInstancesPerNode=3, seed=42
        )
    kind, alpha = name.split("_")
    penalty, mixing = (float(alpha), 1.0) if kind == "lasso" else (float(alpha) / n * target_std, 0.0)
    return LinearRegression(
        featuresCol="features", labelCol=target, regParam=penalty, elasticNetParam=mixing, standardization=False,
        maxIter=500,
    )


def fit_model(train: DataFrame, name: str, features: list[str] = FEATURES, target: str = TARGET) -> PipelineModel:
    """Fit one of ``MODELS`` on a weekly frame. Linear models see standardized inputs, trees see raw ones."""
    stats = train.agg(F.count("*").alias("n"), F.stddev_pop(target).alias("s")).first()
    assembler = VectorAssembler(inputCols=features, outputCol="_raw" if name != "random_forest" else "features")
    stages = [assembler]
    if name != "random_forest":
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True))
    stages.append(_estimator(name, max(stats["n"], 1), stats["s"] or 1.0, target))
    return Pipeline(stages=stages).fit(train)


@dataclass
class Forecaster:
    """The chosen model refitted on all weeks, with the held-out metrics of every candidate."""

    name: str
    model: PipelineModel
    metrics: DataFrame
    features: list[str] = field(default_factory=lambda: list(FEATURES))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        self.metrics.withColumn("chosen", F.col("model") == self.name).write.mode("overwrite").parquet(f"{path}/metrics")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Forecaster":
        metrics = spark.read.parquet(f"{path}/metrics")
        name = metrics.where("chosen").select("model").first()["model"]
        return Forecaster(name, PipelineModel.load(f"{path}/model"), metrics.drop("chosen"))


def _held_out(features: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """Held-out weeks with a prediction per candidate model, in long form."""
    split = chronological_split(features)
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    out = None
    for name in models:
        predicted = fit_model(train, name).transform(test).select(
            F.lit(name).alias("model"), *features.columns, F.col("prediction").alias("predicted_revenue")
        )
        out = predicted if out is None else out.unionByName(predicted)
    return out


def forecast_metrics(features: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """MAE, RMSE and R2 of every candidate on the held-out weeks, best R2 first."""
    ready = features.dropna(subset=FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
    found = regression_metrics(_held_out(ready, models), TARGET, "predicted_revenue", by=["model"])
    settled = features.sparkSession.createDataFrame(found.collect(), found.schema)  # one row per model
    ready.unpersist()
    return settled.orderBy(F.desc("r2"), "model")


def train_forecaster(features: DataFrame, models: tuple[str, ...] = MODELS) -> Forecaster:
    """Judge the candidates on the last fifth of the weeks, then refit the best on all of them."""
    ready = features.dropna(subset=FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
    metrics = forecast_metrics(ready, models)
    best = metrics.first()["model"]
    fitted = Forecaster(best, fit_model(ready, best), metrics)
    ready.unpersist()
    return fitted


def _next_week(series: DataFrame, group_by: list[str] | None, overrides: dict[str, float] | None) -> DataFrame:
    """Inputs of the coming week and ``_revenue_lag_3``, which only later weeks need."""
    groups = group_by or []
    whole = Window.partitionBy(*groups)
    ends = F.max(F.when(F.col(TARGET) > 0, F.col("week"))).over(whole)
    past = series.withColumn("_last", ends).where(F.col("week") <= F.col("_last"))
    last = past.where(F.col("week") == F.col("_last"))
    upcoming = last.select(
        *groups, F.date_add("week", 7).alias("week"), F.col("avg_review_score"),
        F.lit(None).cast("double").alias(TARGET), F.lit(None).cast("bigint").alias("order_count"),
        next_week_of_year(F.weekofyear("week")).alias("_next_week"),
    )
    joined = past.drop("_last").unionByName(upcoming, allowMissingColumns=True)
    third = F.lag(TARGET, 3).over(Window.partitionBy(*groups).orderBy("week"))
    framed = weekly_features(joined, groups, drop_incomplete=False).withColumn("_third", third)
    rows = framed.where(F.col("_next_week").isNotNull())
    inputs: dict[str, Column] = {c: F.col(c).cast("double") for c in FEATURES}
    inputs["week_of_year"] = F.col("_next_week").cast("double")
    for name, value in (overrides or {}).items():
        inputs[name] = F.lit(float(value))
    for name, value in DEFAULT_INPUTS.items():
        inputs[name] = F.coalesce(inputs[name], F.lit(value))
    for name, ratio in DEFAULT_RATIOS.items():
        inputs[name] = F.coalesce(inputs[name], inputs["revenue_lag_1"] * ratio)
    inputs["revenue_roll_4"] = F.coalesce(inputs["revenue_roll_4"], inputs["revenue_lag_1"])
    third = F.coalesce(F.col("_third").cast("double"), (inputs["revenue_lag_2"] + inputs["revenue_lag_4"]) / 2)
    return rows.select(*groups, "week", *[c.alias(n) for n, c in inputs.items()], third.alias("_revenue_lag_3"))


def next_week_inputs(
    series: DataFrame, group_by: list[str] | None = None, overrides: dict[str, float] | None = None
) -> DataFrame:
    """The model inputs of the week after the last one with revenue, one row per group.

    The next week is appended to the series and takes its lags and means from the same windows as the training rows.
    Missing inputs take defaults; ``overrides`` replaces any input.
    """
    return _next_week(series, group_by, overrides).drop("_revenue_lag_3")


def _weeks_ahead(first: DataFrame, keys: list[str], predict: Callable[[DataFrame], DataFrame], weeks: int) -> DataFrame:
    """One row per week to come: each prediction moves into the lags of the week after it.

    ``predict`` adds ``prediction``. The state is one row per group, so weeks are projections of that row and nothing is
    shuffled between them. The order count and the score stay as last seen.
    """
    if weeks < 1:
        raise ValueError("a forecast covers one week at least")
    state, steps = first, []
    for k in range(weeks):
        steps.append(f"_step{k}")
        shown = F.struct("week", *FEATURES, F.col("prediction").alias("predicted_revenue"))
        now = predict(state).select(*first.columns, *steps[:-1], "prediction", shown.alias(steps[-1]))
        revenue = [F.col(c) for c in ("prediction", "revenue_lag_1", "revenue_lag_2", "_revenue_lag_3")]
        state = now.withColumns({
            "week": F.date_add("week", 7), "week_of_year": next_week_of_year(F.col("week_of_year")),
            "revenue_lag_1": revenue[0], "revenue_lag_2": revenue[1], "_revenue_lag_3": revenue[2],
            "revenue_lag_4": revenue[3], "revenue_roll_4": (revenue[0] + revenue[1] + revenue[2] + revenue[3]) / 4,
        }).drop("prediction")
    return state.select(*keys, F.inline(F.array(*steps)))


def sales_forecast(
    forecaster: Forecaster, series: DataFrame, group_by: list[str] | None = None,
    overrides: dict[str, float] | None = None, weeks: int = 1,
) -> DataFrame:
    """Predicted revenue of the coming weeks per group, with the inputs used. ``overrides`` hold for the first week."""
    out = _weeks_ahead(_next_week(series, group_by, overrides), group_by or [], forecaster.model.transform, weeks)
    return out.withColumn("model_version", F.lit(forecaster.name))


def _ridge_weights(count: np.ndarray, mean: pd.Series, covariance: pd.Series, alpha: float) -> pd.Series:
    """Intercept and weights of raw inputs for each row of moments; the last of the means is the target's."""
    out = []
    for n, m, c in zip(count, mean, covariance):
        m = np.asarray(m, float)
        size = len(m)
        full = np.zeros((size, size))
        full[np.triu_indices(size)] = np.asarray(c, float)
        full = full + np.triu(full, 1).T
        x, y = full[:-1, :-1], full[:-1, -1]
        spread = np.sqrt(np.diag(x))
        scale = np.where(spread > 0, spread, 1.0)
        weights = np.linalg.solve(n * x / np.outer(scale, scale) + alpha * np.eye(size - 1), n * y / scale) / scale
        out.append([m[-1] - float(weights @ m[:-1]), *weights.tolist()])
    return pd.Series(out, dtype=object)


def group_ridge(
    features: DataFrame, group_by: list[str], alpha: float = 1.0, inputs: list[str] = FEATURES, target: str = TARGET
) -> DataFrame:
    """(groups, weeks, intercept, weights): a ridge regression for every group, all fitted by one aggregate.

    Means and co-moments add up on the executors without loss for large values; a group then is one small system. Inputs
    are standardized within the group, constant ones get no weight, and weights are given for raw inputs. Rows with a
    missing input or target are left out; a group without complete rows has no row.
    """
    if alpha <= 0:
        raise ValueError("the penalty must be above 0")
    names = [*inputs, target]
    known = features.dropna(subset=names).select(*group_by, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(names)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    moments = known.groupBy(*group_by).agg(
        F.count("*").alias("weeks"),
        F.array(*[F.avg(f"_x{i}") for i in range(len(names))]).alias("_mean"),
        F.array(*[F.covar_pop(f"_x{i}", f"_x{j}") for i, j in pairs]).alias("_covariance"),
    )

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(n: pd.Series, mean: pd.Series, covariance: pd.Series) -> pd.Series:
        return _ridge_weights(n.to_numpy(), mean, covariance, alpha)

    solved = moments.select(*group_by, "weeks", solve("weeks", "_mean", "_covariance").alias("_w"))
    return solved.select(
        *group_by, "weeks", F.col("_w")[0].alias("intercept"), F.slice("_w", 2, len(inputs)).alias("weights")
    )


def group_forecast(
    series: DataFrame, group_by: list[str], alpha: float = 1.0, overrides: dict[str, float] | None = None, weeks: int = 1
) -> DataFrame:
    """Predicted revenue of the coming weeks, each group by a ridge regression of its own.

    A group without a complete week is predicted by its mean of four weeks.
    """
    models = group_ridge(weekly_features(series, group_by), group_by, alpha).drop("weeks")
    same = [F.col(f"s.{g}").eqNullSafe(F.col(f"m.{g}")) for g in group_by]
    state = _next_week(series, group_by, overrides).alias("s").join(models.alias("m"), same, "left").select(
        "s.*", "intercept", "weights"
    )
    terms = [F.col("weights")[i] * F.col(c) for i, c in enumerate(FEATURES)]
    line = sum(terms, F.col("intercept"))
    out = _weeks_ahead(state, group_by, lambda df: df.withColumn("prediction", F.coalesce(line, "revenue_roll_4")), weeks)
    return out.withColumn("model_version", F.lit(f"group_ridge_{alpha:g}"))


def forecast_history(features: DataFrame, model: str, group_by: list[str] | None = None) -> DataFrame:
    """Actual against predicted revenue of the held-out weeks."""
    ready = features.dropna(subset=FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
    predicted = F.col("predicted_revenue")
    return _held_out(ready, (model,)).select(
        F.col("week").alias("date"), *(group_by or []), F.col(TARGET).alias("actual_revenue"), predicted,
        F.abs(F.col(TARGET) - predicted).alias("prediction_error"), F.lit(model).alias("model_version"),
    )


def forecast_importance(spark: SparkSession, forecaster: Forecaster) -> DataFrame:
    """Importance (trees) or coefficient (linear models) per input, strongest first."""
    last = forecaster.model.stages[-1]
    tree = forecaster.name == "random_forest"
    values = last.featureImportances.toArray() if tree else last.coefficients.toArray()
    rows = [(f, float(v), "importance" if tree else "coefficient") for f, v in zip(forecaster.features, values)]
    return spark.createDataFrame(rows, "feature string, value double, kind string").orderBy(
        F.desc(F.abs("value")), "feature"
    )


def model_quality(metrics: DataFrame) -> DataFrame:
    """Quality class of every candidate by its R2."""
    quality = F.lit("very_low")
    for name, cut in reversed(QUALITY_CUTS):
        quality = F.when(F.col("r2") > cut, name).otherwise(quality)
    return metrics.withColumn("quality", quality)
