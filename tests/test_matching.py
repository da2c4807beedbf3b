"""Word lists as tables: equal to brute force and to the expressions, whatever the size of the list."""

import json
import random

import pytest
from pyspark.sql import functions as F

from reviewlake.functions.vocabulary import DEFAULT_LEXICON, DEFAULT_TAXONOMY, Taxonomy
from reviewlake.operators import aspects, matching, sentiment
from reviewlake.operators.matching import TermTable
from reviewlake.sources import lexicons


def found(spark, texts, terms, **conf):
    """(text number, place, name), phrases once per text."""
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, clean string").repartition(3)
    hits = matching.find_terms(rows, "k", F.col("clean"), spark.createDataFrame(terms, "name string, word string"))
    return {(r["k"], r["at"], r["name"]) for r in hits.collect()}


def brute(texts, terms):
    out = set()
    for k, text in enumerate(texts):
        words = text.split() if text else []
        for name, word in terms:
            if " " in word:
                if word in (text or ""):
                    out.add((k, None, name))
            else:
                out |= {(k, at, name) for at, w in enumerate(words) if w == word}
    return out


SHAPES = ["a b", "ab c", "b", "bc", "c a", "b ca", "a ", " a", " b c", "abc abc abc", "bc abc a", "c c c c c c", "zzz", "ç a", "abcabc ab"]


def test_every_shape_of_phrase(spark):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcç") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    texts += ["", None, "a", "abc", "abc abc abc", "xabc abc abcx", "c " * 40 + "c"]
    terms = [(f"n{k % 4}", w) for k, w in enumerate(SHAPES)]
    assert found(spark, texts, terms) == brute(texts, terms) != set()


def test_only_words_or_nothing(spark):
    texts = ["a b a", None, "b"]
    assert found(spark, texts, [("n", "a")]) == {(0, 0, "n"), (0, 2, "n")}
    assert found(spark, texts, []) == set()


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_a_million_phrases(spark, threshold):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    listed = sorted({" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 2, 3, 3]))) for _ in range(1_500_000)})
    assert len(listed) > 1_000_000
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(30)] + [listed[k * 7] + "xx" for k in range(10)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        terms = spark.range(1).select(F.lit("n").alias("name")).crossJoin(spark.createDataFrame([(w,) for w in listed], "word string"))
        rows = spark.createDataFrame(list(enumerate(texts)), "k long, clean string")
        hits = matching.find_terms(rows, "k", F.col("clean"), terms)
        got = {(r["k"], r["at"], r["name"]) for r in hits.collect()}
        assert "SortMergeJoin" in hits._jdf.queryExecution().executedPlan().toString() or threshold != "-1"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    single, longer = {w for w in listed if " " not in w}, [w for w in listed if " " in w]
    expected = {(k, at, "n") for k, t in enumerate(texts) for at, w in enumerate(t.split()) if w in single}
    for k, t in enumerate(texts):
        if any(w in t for w in longer):
            expected.add((k, None, "n"))
    assert got == expected


def test_mentions_equal_the_expressions(spark, tables):
    texts = tables.reviews.select("review_id", "text")
    taxonomy, lexicon = (TermTable.of(spark, x) for x in (DEFAULT_TAXONOMY, DEFAULT_LEXICON))
    by_join = {tuple(r) for r in aspects.mentions(texts, ["review_id"], taxonomy, lexicon).collect()}
    assert by_join == {tuple(r) for r in aspects.mentions(texts, ["review_id"]).collect()} != set()
    # windows that overlap, words on both sides of the lexicon, one table and one small list
    odd = spark.createDataFrame([
        (1, "great price great quality bad value terrible"), (2, "price " + "x " * 4 + "good"), (3, "price " + "x " * 5 + "good"),
        (4, "well made and worst good"), (5, ""), (6, None), (7, "cheap cheap good"),
    ], "review_id long, text string")
    assert {tuple(r) for r in aspects.mentions(odd, ["review_id"], taxonomy).collect()} == {tuple(r) for r in aspects.mentions(odd, ["review_id"]).collect()}
    with pytest.raises(ValueError, match="key"):
        aspects.mentions(odd, ["review_id", "text"], taxonomy)


def test_long_lists_are_read_as_tables(spark, folder, monkeypatch):
    path = f"{folder}/lists.json"
    with open(path, "w") as f:
        json.dump({"one": {"en": [f"word{chr(97 + k % 26)}{k}" for k in range(60_000)] + ["Good Price"]}, "two": {"es": ["precio"] * 3 + [f"otra{k}" for k in range(50_000)]}}, f)
    table = lexicons.load_taxonomy(spark, path)
    assert isinstance(table, TermTable) and table.terms.count() == 110_002
    df = spark.createDataFrame([(1, "a good price for otra mesa"), (2, "el precio malo"), (3, "nothing")], "review_id long, text string")
    got = {tuple(r) for r in aspects.mentions(df, ["review_id"], table).collect()}
    small = Taxonomy({"one": frozenset(["good price"]), "two": frozenset(["precio"])})
    assert got == {tuple(r) for r in aspects.mentions(df, ["review_id"], small).collect()} and len(got) == 2


def test_texts_are_split_once_for_all_counts(spark, tables):
    plan = sentiment.sentiment_distribution(tables.reviews)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_spread_far_from_zero(spark):
    rng = random.Random(4)
    rows = [(f"u{k % 5}", f"b{k % 3}", 1e6 + rng.random() if k % 5 else 1e9 + rng.random(), "neutral", 3, None) for k in range(500)] + [("one", "b", 5.0, "neutral", 1, None)]
    gold = spark.createDataFrame(rows, "user_id string, business_id string, sentiment_score double, sentiment_label string, text_length int, date date")
    listed = spark.createDataFrame([("b0", "x")], "business_id string, categories string")
    who = spark.createDataFrame([("u0", "2010-01-01")], "user_id string, yelping_since string")
    got = {r["user_id"]: r["sentiment_std"] for r in aspects.user_sentiment_stats(gold, who, listed).collect()}
    expected = {r[0]: r[1] for r in gold.groupBy("user_id").agg(F.round(F.stddev_samp("sentiment_score"), 3)).collect()}
    assert got == expected and got["one"] is None and got["u1"] > 0.2
