"""Monthly review aggregates kept up to date: each ingested batch adds mergeable partials, and nothing is recounted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewlake.functions.numeric import count_if, pct, rnd
from reviewlake.operators.silver import silver_reviews
from reviewlake.schemas import rating_column, require
from reviewlake.streaming.ingest import for_each_batch

PARTIALS = (
    "year int, month int, review_count bigint, rated_count bigint, stars_sum double, stars_spread double, "
    "ambiguous_count bigint, sized_count bigint, length_sum bigint"
)


def review_partials(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Monthly counts, sums and squared deviations of the rating around its own mean, per month and ``by``.

    Reviews without a date are counted under a null month, as in the full count.
    """
    rating = F.col(rating_column(df)).cast("double")
    return require(df, "year", "month").groupBy(*by, F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month")).agg(
        F.count("*").alias("review_count"),
        F.count(rating).alias("rated_count"),
        F.coalesce(F.sum(rating), F.lit(0.0)).alias("stars_sum"),
        F.coalesce(F.var_pop(rating) * F.count(rating), F.lit(0.0)).alias("stars_spread"),
        count_if(F.col("is_ambiguous")).alias("ambiguous_count"),
        F.count("text_length").alias("sized_count"),
        F.coalesce(F.sum(F.col("text_length").cast("bigint")), F.lit(0)).alias("length_sum"),
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    """One partial per month out of any number of them.

    Squared deviations move to the common mean by the distance of the means, so large ratings lose nothing.
    """
    month = Window.partitionBy("year", "month")
    centre = F.try_divide(F.sum("stars_sum").over(month), F.sum("rated_count").over(month))
    away = F.try_divide(F.col("stars_sum"), F.col("rated_count")) - centre
    moved = F.col("stars_spread") + F.coalesce(F.col("rated_count") * away * away, F.lit(0.0))
    sums = ("review_count", "rated_count", "stars_sum", "stars_spread", "ambiguous_count", "sized_count", "length_sum")
    return partials.withColumn("stars_spread", moved).groupBy("year", "month").agg(*[F.sum(c).alias(c) for c in sums])


def monthly_reviews(partials: DataFrame) -> DataFrame:
    """The columns of ``reviews_by_month`` and the spread of the ratings, from partials."""
    return merge_partials(partials).select(
        "year", "month", "review_count",
        rnd(F.try_divide("stars_sum", "rated_count"), 2).alias("avg_stars"),
        "ambiguous_count",
        rnd(F.try_divide("length_sum", "sized_count"), 0).alias("avg_text_length"),
        pct(F.col("ambiguous_count"), F.col("review_count"), 1).alias("pct_ambiguous"),
        F.sqrt(F.try_divide(F.col("stars_spread"), F.when(F.col("rated_count") > 1, F.col("rated_count") - 1))).alias("std_stars"),
    ).orderBy("year", "month")


class MonthlyReviews:
    """A monthly table that grows by batches, below a folder that all executors share.

    ``batches/batch=<n>`` holds the partials of batch n. A batch that is handed over again replaces its own folder, so it
    counts once. ``merged/upto=<n>`` holds all batches up to n as one; the latest one is read together with later batches.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _read(self, part: str, number: str) -> DataFrame:
        schema = f"{PARTIALS}, {number} bigint"
        folder = f"{self.path}/{part}"
        nothing = self.spark.createDataFrame([], schema)
        nothing.limit(0).drop(number).write.mode("append").parquet(f"{folder}/{number}=-1")
        return self.spark.read.schema(schema).parquet(folder)

    def _latest(self) -> int:
        """Number of the last merged batch, -1 without one."""
        last = self._read("merged", "upto").agg(F.max("upto")).first()[0]
        return -1 if last is None else last

    def partials(self) -> DataFrame:
        """All partials not yet merged and the merged ones."""
        last = self._latest()
        later = self._read("batches", "batch").where(F.col("batch") > last).drop("batch")
        return later.unionByName(self._read("merged", "upto").where(F.col("upto") == last).drop("upto"))

    def add(self, reviews: DataFrame, batch: int) -> None:
        """Store the partials of one batch of silver reviews; a batch already merged is left as it is."""
        if batch > self._latest():
            review_partials(reviews).write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch}")

    def merge(self) -> int:
        """Merge all batches stored so far and return the number of the last one."""
        last, newest = self._latest(), self._read("batches", "batch").agg(F.max("batch")).first()[0]
        if newest is None or newest <= last:
            return last
        later = self._read("batches", "batch").where(f"batch > {last} and batch <= {newest}").drop("batch")
        known = self._read("merged", "upto").where(f"upto = {last}").drop("upto")
        merge_partials(later.unionByName(known)).write.mode("overwrite").parquet(f"{self.path}/merged/upto={newest}")
        return newest

    def table(self) -> DataFrame:
        return monthly_reviews(self.partials())

    def ingest(self, source: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
        """Add all raw review files not seen yet, then stop. Always use the same checkpoint: it numbers the batches."""
        return for_each_batch(
            self.spark, source, checkpoint, lambda raw, batch: self.add(silver_reviews(raw), batch), files_per_batch
        )
