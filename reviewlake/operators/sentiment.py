"""Sentiment scoring of review tables and the reports on it.

Scoring is staged in a few projections so that a text is cleaned and split once however many outputs use it, and reports
use conditional aggregates instead of filters on derived text, which would be pushed below the projection and computed
twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlake.errors import DatasetError
from reviewlake.functions import sentiment as S, text as txt
from reviewlake.functions.numeric import count_if, mean, pct, rnd
from reviewlake.functions.vocabulary import DEFAULT_LEXICON, Lexicon
from reviewlake.schemas import rating_column, require

METHODS = ("stars", "lexicon", "heuristic", "combined")
SENTIMENT_CUT = 0.2
TENDENCY_CUT = 0.10
MIN_CLEAN_LENGTH = 6
FIELDS = ("score", "label", "confidence", "is_ambiguous", "model")


def with_lexicon_sentiment(
    df: DataFrame, text: str = "text", name: str = "sentiment", lexicon: Lexicon = DEFAULT_LEXICON, batched: bool = False
) -> DataFrame:
    """Add the lexicon score of a text column as a struct. ``batched`` finds its words in Arrow batches."""
    pos, neg = S.polar_counts(F.col("_polar"), lexicon)
    return (
        df.withColumn("_polar", S.polar_words(F.col(text), lexicon, batched))
        .withColumn("_hits", txt.once(F.struct(pos.alias("pos"), neg.alias("neg"))))
        .withColumn(name, txt.once(S.lexicon_score(F.col("_hits.pos"), F.col("_hits.neg"))))
        .drop("_polar", "_hits")
    )


def score(
    df: DataFrame,
    method: str = "lexicon",
    name: str = "sentiment",
    lexicon: Lexicon = DEFAULT_LEXICON,
    weight_text: float = 0.6,
    variant: str = "cut",
    score_udf: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add a sentiment struct by the chosen method.

    ``combined`` uses the text score for English reviews with text and the stars otherwise. ``score_udf`` replaces the
    lexicon with any column function (a pandas UDF, say) that maps a text column to a score in [-1, 1].
    """
    rating = F.col(rating_column(df)) if {"stars", "review_score"} & set(df.columns) else F.lit(None).cast("int")
    if method == "stars":
        return df.withColumn(name, S.baseline(rating))
    if method == "heuristic":
        return df.withColumn(name, S.heuristic(F.col("text"), F.col("language")))
    if method not in METHODS:
        raise DatasetError(f"unknown method {method!r}: use one of {METHODS}")
    if score_udf is not None:
        value = score_udf(F.col("text"))
        label = S.label_by_cut(F.col("_score"), S.TEXT_CUT)
        by_text = df.withColumn("_score", value).withColumn(
            "_text", F.struct(F.col("_score").alias("score"), label.alias("label"),
                              F.abs("_score").alias("confidence"), (label == S.NEUTRAL).alias("is_ambiguous"),
                              F.lit("custom").alias("model"))
        ).drop("_score")
    else:
        by_text = with_lexicon_sentiment(df, name="_text", lexicon=lexicon)
    if method == "lexicon":
        return by_text.withColumnRenamed("_text", name)
    has_text = F.coalesce(txt.strip(F.col("text")), F.lit("")) != ""
    english = F.col("language") == "en" if "language" in df.columns else F.lit(True)
    chosen = F.when(english & has_text, F.col("_text")).otherwise(S.baseline(rating)) if variant == "cut" else F.col("_text")
    return by_text.withColumn("_chosen", chosen).withColumn(
        name, S.combined(F.col("_chosen"), S.baseline(rating), weight_text, variant)
    ).drop("_text", "_chosen")


def flatten(df: DataFrame, keep: list[str], name: str = "sentiment") -> DataFrame:
    """Selected columns plus the fields of a sentiment struct as ``sentiment_*`` columns."""
    return df.select(*keep, *[F.col(f"{name}.{f}").alias("model_version" if f == "model" else f"sentiment_{f}") for f in FIELDS])


def reclassify_ambiguous(df: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Three-star reviews judged by their text: the lexicon for English, the keyword heuristic otherwise."""
    three = df.where(F.col(rating_column(df)) == 3)
    scored = with_lexicon_sentiment(three, name="_text", lexicon=lexicon).withColumn(
        "_s", F.when(F.col("language") == "en", F.col("_text")).otherwise(S.heuristic(F.col("text"), F.col("language")))
    )
    return scored.select(
        "review_id",
        F.lit(S.NEUTRAL).alias("original_label"),
        F.col("_s.label").alias("inferred_label"),
        F.col("_s.score").alias("inferred_score"),
        F.col("_s.confidence").alias("confidence"),
        F.col("_s.model").alias("model"),
    )


def sentiment_distribution(
    df: DataFrame,
    year: int | None = None,
    stars: int | None = None,
    lexicon: Lexicon = DEFAULT_LEXICON,
    label: Column | None = None,
) -> DataFrame:
    """Counts, shares and mean of the labels of all reviews with enough text.

    ``label`` supplies labels that are already in the table (from a model, or the gold layer); by default the lexicon
    labels the texts. The same pass counts all rows; only those that the filters keep have their text looked at.
    """
    wanted = F.lit(True)
    if year is not None:
        wanted = wanted & (F.col("year") == year)
        require(df, "year")
    if stars is not None:
        wanted = wanted & (F.col(rating_column(df)) == stars)
    rows = df.withColumn("_wanted", F.coalesce(wanted, F.lit(False)))
    if label is None:
        rows = rows.withColumn("_words", F.when(F.col("_wanted"), txt.ml_words(F.col("text"))))
        words = F.filter(F.col("_words"), lambda w: w.isin(lexicon.words))
        length = F.char_length(F.array_join("_words", " "))
        # plain columns and not fields of a struct, which the optimizer would write out again at every use
        rows = rows.withColumn("_polar", F.when(length >= MIN_CLEAN_LENGTH, words))
        pos, neg = S.polar_counts(F.col("_polar"), lexicon)
        rows = rows.withColumn("_hits", F.when(F.col("_polar").isNotNull(), F.struct(pos.alias("pos"), neg.alias("neg"))))
        scored = S.lexicon_score(F.col("_hits.pos"), F.col("_hits.neg"))["label"]
        rows = rows.withColumn("_label", F.when(F.col("_hits").isNotNull(), scored))
    else:
        rows = rows.withColumn("_label", F.when(F.col("_wanted"), label))
    # the label is a grouping key, so that its text work stands in the plan once and not in every count
    grouped = rows.groupBy("_label").agg(F.count("*").alias("_n"))
    some = lambda kept: F.coalesce(F.sum(F.when(kept, F.col("_n"))), F.lit(0).cast("bigint"))
    counts = grouped.agg(
        some(F.lit(True)).alias("original_count"), some(F.col("_label").isNotNull()).alias("total_analyzed"),
        *[some(F.col("_label") == name).alias(name) for name in S.LABELS],
    )
    total = F.col("total_analyzed")
    average = F.try_divide(F.col("positive") - F.col("negative"), total)
    return counts.select(
        total, "original_count", *S.LABELS,
        *[pct(F.col(name), total, 1).alias(f"{name}_pct") for name in S.LABELS],
        rnd(average, 3).alias("average_sentiment"),
        F.when(average > SENTIMENT_CUT, S.POSITIVE).when(average < -SENTIMENT_CUT, S.NEGATIVE)
        .when(average.isNotNull(), S.NEUTRAL).alias("sentiment_label"),
    )


def ambiguous_sentiment(df: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON, label: Column | None = None) -> DataFrame:
    """Distribution over three-star reviews and which way they lean."""
    average = F.col("average_sentiment")
    tendency = (
        F.when(average > TENDENCY_CUT, S.POSITIVE).when(average < -TENDENCY_CUT, S.NEGATIVE)
        .when(average.isNotNull(), S.NEUTRAL)
    )
    return sentiment_distribution(df, stars=3, lexicon=lexicon, label=label).withColumn("tendency", tendency)


def gold_features(
    df: DataFrame,
    use_text: bool = True,
    model=None,
    lexicon: Lexicon = DEFAULT_LEXICON,
    language: str | None = None,
    batched: bool = False,
) -> DataFrame:
    """Silver reviews plus sentiment score, label, confidence and model version.

    The ladder per row: the fitted model when given and the text is usable; else the lexicon for English texts longer
    than 10 characters; else the stars. ``language`` overrides the language column; ``batched`` finds the lexicon's words in Arrow batches.
    """
    from reviewlake.operators.classify import predict_sentiment

    stars = S.baseline(F.col(rating_column(df)))
    length = F.char_length(F.coalesce(txt.strip(F.col("text")), F.lit("")))
    if model is not None:
        scored = predict_sentiment(df, model).withColumn(
            "_s",
            F.when(
                (length >= 3) & (F.col("_clean") != ""),
                F.struct(
                    S.label_value(F.col("predicted_label"), S.GOLD_SCORES).cast("double").alias("score"),
                    F.col("predicted_label").alias("label"),
                    F.coalesce(F.col("predicted_confidence"), F.lit(0.7)).alias("confidence"),
                ),
            ).otherwise(F.struct(*[stars[f].alias(f) for f in ("score", "label", "confidence")])),
        )
        version = "ml_unified_v1"
    else:
        spoken = F.lit(language) if language else F.col("language")
        if use_text:
            # only texts that the lexicon is to judge are split
            judged = df.withColumn("_judged", F.when((spoken == "en") & (length > 10), F.col("text")))
            scored = with_lexicon_sentiment(judged, "_judged", "_text", lexicon, batched).withColumn(
                "_s", F.when(F.col("_judged").isNotNull(), F.col("_text")).otherwise(stars)
            )
            version = "lexicon_polarity_v1"
        else:
            scored, version = df.withColumn("_s", stars), "baseline_stars_v1"
    return scored.select(
        *df.columns,
        F.col("_s.score").alias("sentiment_score"),
        F.col("_s.label").alias("sentiment_label"),
        F.col("_s.confidence").alias("sentiment_confidence"),
        F.lit(version).alias("model_version"),
    )


def gold_sentiment_stats(gold: DataFrame) -> DataFrame:
    """Label counts of a gold table with its mean score and optional-feature flags."""
    counts = gold.groupBy("sentiment_label").agg(
        F.count("*").alias("count"), F.sum("sentiment_score").alias("_sum"), F.count("sentiment_score").alias("_n")
    )
    labels = Window.partitionBy()  # one row per label
    average = rnd(F.try_divide(F.sum("_sum").over(labels), F.sum("_n").over(labels)), 3)
    return counts.select(
        "sentiment_label", "count",
        average.alias("avg_sentiment_score"),
        F.lit("embedding_vector" in gold.columns).alias("has_embeddings"),
        F.lit("topic_id" in gold.columns).alias("has_topics"),
    ).orderBy("sentiment_label")


def _sentiment_aggregates(gold: DataFrame) -> list[Column]:
    label = F.col("sentiment_label")
    return [
        F.count("*").alias("review_count"),
        mean(F.col(rating_column(gold)), 2).alias("avg_stars"),
        mean(F.col("sentiment_score"), 3).alias("avg_sentiment"),
        pct(count_if(label == S.POSITIVE), F.count("*"), 2).alias("pct_positive"),
        pct(count_if(label == S.NEGATIVE), F.count("*"), 2).alias("pct_negative"),
        pct(count_if(F.col(rating_column(gold)) == 3), F.count("*"), 2).alias("pct_ambiguous"),
    ]


def sentiment_by_month(gold: DataFrame, dataset: str) -> DataFrame:
    """Monthly sentiment of one dataset."""
    monthly = gold.groupBy("year", "month").agg(*_sentiment_aggregates(gold))
    return monthly.select(F.lit(dataset).alias("dataset"), *monthly.columns).orderBy("year", "month")
