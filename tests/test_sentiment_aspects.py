import random

import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from reviewlake.errors import DatasetError
from reviewlake.functions import sentiment as S
from reviewlake.functions.vocabulary import DEFAULT_LEXICON as LEX, DEFAULT_TAXONOMY as TAX
from reviewlake.operators import aspects, sentiment


def test_baseline(spark):
    df = spark.createDataFrame([(5,), (4,), (3,), (2,), (1,), (None,)], "stars int")
    got = [tuple(r) for r in df.select(S.baseline(F.col("stars")).alias("s")).select("s.score", "s.label", "s.is_ambiguous").collect()]
    assert got == [
        (1.0, "positive", False), (0.5, "positive", False), (0.0, "neutral", True), (-0.5, "negative", False),
        (-1.0, "negative", False), (None, None, None),
    ]


def test_lexicon(spark):
    df = spark.createDataFrame([("Great, excellent!", ), ("terrible and bad",), ("good bad",), ("",), (None,)], "text string")
    got = [tuple(r) for r in sentiment.with_lexicon_sentiment(df).select("sentiment.score", "sentiment.label", "sentiment.is_ambiguous").collect()]
    assert got == [(1.0, "positive", False), (-1.0, "negative", False), (0.0, "neutral", True), (0.0, "neutral", True), (0.0, "neutral", True)]


def test_heuristic(spark):
    df = spark.createDataFrame([("muy bueno y excelente", "es"), ("ruim", "pt"), ("good bad", "xx"), (None, "es")], "text string, language string")
    got = [tuple(r) for r in df.select(S.heuristic(F.col("text"), F.col("language")).alias("s")).select("s.score", "s.label", "s.confidence", "s.model").collect()]
    assert got == [(0.7, "positive", 1.0, "heuristic_es_v1"), (-0.6, "negative", 1.0, "heuristic_pt_v1"),
                   (0.0, "neutral", 0.0, "heuristic_xx_v1"), (0.0, "neutral", 0.0, "heuristic_es_v1")]


def test_combined_contradiction(spark):
    df = spark.createDataFrame([("terrible bad", 5, "en"), ("terrible", 5, "es")], "text string, stars int, language string")
    rows = sentiment.score(df, "combined").select("sentiment.score", "sentiment.label", "sentiment.is_ambiguous").collect()
    assert [tuple(r) for r in rows] == [(-0.2, "neutral", True), (1.0, "positive", False)]


def test_custom_scorer(spark):
    @F.pandas_udf(T.DoubleType())
    def by_length(s: pd.Series) -> pd.Series:
        return s.str.len() / 10.0

    df = spark.createDataFrame([("abcde",)], "text string")
    assert sentiment.score(df, score_udf=by_length).select("sentiment.label").first()[0] == "positive"


def test_unknown_method(spark):
    with pytest.raises(DatasetError):
        sentiment.score(spark.createDataFrame([("a",)], "text string"), "magic")


def test_year_filter_needs_a_year(spark):
    df = spark.createDataFrame([("a long text", 3)], "text string, stars int")
    with pytest.raises(DatasetError):
        sentiment.sentiment_distribution(df, year=2020)


def test_gold_ladder(spark):
    df = spark.createDataFrame(
        [(1, "Great great product", 1, "en"), (2, "great", 1, "en"), (3, "Great great product", 1, "es")],
        "review_id int, text string, stars int, language string",
    )
    rows = sentiment.gold_features(df).orderBy("review_id").collect()
    assert [r["sentiment_label"] for r in rows] == ["positive", "negative", "negative"]
    assert {r["model_version"] for r in rows} == {"lexicon_polarity_v1"}


def brute(text):
    words = text.split()
    out = {}
    for aspect, keys in TAX.keywords.items():
        at = [i for i, w in enumerate(words) if w in keys]
        if not at and not any(" " in k and k in text for k in keys):
            continue
        pos = neg = 0
        for i in at:
            for w in words[max(0, i - 5):i + 6]:
                if w in LEX.positive:
                    pos += 1
                elif w in LEX.negative:
                    neg += 1
        out[aspect] = "positive" if pos > neg else "negative" if neg > pos else "neutral"
    return out


def test_aspects_match_brute_force(spark):
    rng = random.Random(7)
    pool = TAX.all_words + LEX.words + ["well made", "mal feito"] + ["zz"] * 200
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "review_id int, text string")
    got: dict[int, dict] = {i: {} for i in range(len(texts))}
    for r in aspects.mentions(df, ["review_id"]).collect():
        got[r["review_id"]][r["aspect"]] = r["sentiment"]
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_analysis_of_one_review(spark):
    df = spark.createDataFrame([(1, "Great delivery and awful price here"), (2, "short")], "review_id int, text string")
    rows = aspects.analyze_reviews(df).orderBy("review_id").collect()
    assert rows[0]["aspects"] == ["price", "shipping"]
    assert set(rows[0]["aspect_sentiments"]) == {"price", "shipping"}
    assert rows[1]["aspects"] is None and rows[1]["global_sentiment"] is None


def test_distribution_adds_up(tables):
    rows = aspects.aspect_distribution(tables.reviews).collect()
    assert all(r["count"] == r["positive"] + r["neutral"] + r["negative"] for r in rows)
    assert sum(r["count"] for r in rows) == rows[0]["total_aspect_mentions"]
    assert sum(r["is_top"] for r in rows) == min(5, len(rows))
