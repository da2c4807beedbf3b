"""Work on a text that is done once, or only where the text needs it."""

import pytest
from pyspark.sql import functions as F

from reviewlake.functions import text as T
from reviewlake.functions.vocabulary import DEFAULT_TAXONOMY
from reviewlake.operators import aspects, sentiment

LETTERS = r"[^a-z\u00C0-\u017F]+"


@pytest.fixture
def reviews(spark):
    rows = [(1, "Great delivery and awful price here", "price"), (2, "well made, WWW.x.y good", None), (3, None, None), (4, "bad box даbox", "shipping")]
    return spark.createDataFrame(rows, "review_id bigint, text string, aspects string")


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("report", [
    aspects.aspect_distribution, lambda df: aspects.aspect_distribution(df, sentiment="negative"), aspects.analyze_reviews,
    aspects.aspect_overlap_metrics, aspects.aspect_sentiment_crosstab,
])
def test_labels_are_worked_out_once(reviews, report):
    """A balance is two nested sums; it stands in the plan once an aspect, whatever the number of outputs."""
    plan = plan_of(report(reviews))
    assert plan.count("aggregate(") == 2 * len(DEFAULT_TAXONOMY.aspects) and plan.count(LETTERS) == 1


def test_polar_words_come_from_one_split(reviews):
    scored = sentiment.with_lexicon_sentiment(reviews)
    plan = plan_of(scored.select("sentiment.*"))
    assert plan.count("split(") == 1 and "regexp_replace(" + LETTERS not in plan and f", {LETTERS}, -1)" in plan
    assert plan.count(LETTERS) == 1
    assert [r["sentiment"]["label"] for r in scored.orderBy("review_id").collect()] == ["neutral", "positive", "neutral", "negative"]


def test_words_are_those_of_the_cleaned_text(spark):
    texts = [None, "", " \n", "One, two.", "HTTP://a.b c", "x http", "×5× a 5", "даgoodд étÉ", "a@b c \U0001F600d"]
    want = [[], [], [], ["one", "two"], ["c"], ["x", "http"], ["××", "a"], ["good", "été"], ["c", "d"]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", T.ml_words(F.col("t")).alias("w"), T.clean_ml(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r["w"] for r in rows] == want and [r["c"] for r in rows] == [" ".join(w) for w in want]


def test_contractions_only_where_there_is_an_apostrophe(spark):
    df = spark.createDataFrame([(1, "I don't"), (2, "no such thing"), (3, None), (4, "'s' it's")], "i int, t string")
    cleaned = df.select("i", T.clean_nlp(F.col("t")).alias("c"))
    assert "Contains(t" in plan_of(cleaned) and [r["c"] for r in cleaned.orderBy("i").collect()] == ["i do not", "no such thing", "", "is' it is"]
