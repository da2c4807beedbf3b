"""Work and memory that must not grow faster than the input: what is shuffled, exploded and kept."""

import collections

import pytest

from conftest import SF_DIR
from reviewlake.functions.vocabulary import DEFAULT_LEXICON, DEFAULT_TAXONOMY
from reviewlake.operators import classify, evaluation, matching, terms
from reviewlake.plans.demo_tables import DemoTables


def plan_of(df, kind: str = "executedPlan") -> str:
    return getattr(df._jdf.queryExecution(), kind)().toString()


@pytest.fixture
def sorted_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_categories_join_before_texts(spark, sorted_joins):
    joins = [x for x in plan_of(DemoTables(spark, SF_DIR).undated_reviews).splitlines() if "Join" in x]
    assert len(joins) == 2 and "_doc#" in joins[0] and "_product#" in joins[1]


def brute_counts(texts, top):
    counts = collections.Counter()
    for t in texts:
        words = [w for w in (t or "").split() if len(w) >= 2]
        counts.update(words + [" ".join(p) for p in zip(words, words[1:])])
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top]


TEXTS = ["aa bb cc aa bb dd", "aa bb x ee", None, "", "bb aa", "ff gg hh ii", "cc dd cc dd"]


@pytest.mark.parametrize("top", [0, 1, 2, 3, 4, 9, 200])
@pytest.mark.parametrize("ties", [terms.TIES, 1])
def test_first_terms_equal_brute_force(spark, monkeypatch, top, ties):
    monkeypatch.setattr(terms, "TIES", ties)
    found = terms.term_counts(spark.createDataFrame([(t,) for t in TEXTS], "text string"), top=top).collect()
    assert [tuple(r) for r in found] == brute_counts(TEXTS, top)


def test_rare_bigrams_are_not_made(spark):
    df = spark.createDataFrame([("aa bb cc dd aa bb",)], "text string")
    assert "concat_ws" not in plan_of(terms.term_counts(df, top=2), "optimizedPlan")


def test_words_are_ruled_out_before_anything_is_made_of_them(spark):
    df = spark.createDataFrame([(1, "well made and great")], "review_id bigint, text string")
    lists = (matching.TermTable.of(spark, x) for x in (DEFAULT_TAXONOMY, DEFAULT_LEXICON))
    found = matching.mentions(df, "review_id", *lists)
    assert [tuple(r) for r in found.collect()] == [(1, "quality", "neutral")]
    plan = plan_of(found, "optimizedPlan")
    assert "posexplode(" in plan and plan.index("Generate inline(") < plan.index("posexplode(")


def test_texts_are_cleaned_once(spark):
    """Outside of the plan's fitted parts, one pattern for the letters a text."""
    df = spark.createDataFrame([(1, 5, "aa bb product cc dd " * 3)], "review_id bigint, stars int, text string")
    lists = (matching.TermTable.of(spark, x) for x in (DEFAULT_TAXONOMY, DEFAULT_LEXICON))
    for made in (
        classify.training_rows(df), classify.aspect_training_rows(df, "review_id"), terms.term_counts(df, top=None), terms.term_counts(df, top=2),
        matching.mentions(df, "review_id", *lists),
    ):
        assert plan_of(made, "optimizedPlan").count(r"[^a-z\u00C0-\u017F]+") == 1


def test_models_keep_no_terms(spark, monkeypatch):
    kept, kind = [], type(spark.range(0))
    persist = kind.persist

    def recorded(self, *level):
        kept.append(self.columns)
        return persist(self, *level)

    monkeypatch.setattr(kind, "persist", recorded)
    words = {5: "good love great sunny", 1: "bad hate awful rainy", 3: "plain usual normal grey"}
    df = spark.createDataFrame([(k, f"{words[s]} price box product", s) for k in range(90) for s in [(1, 3, 5)[k % 3]]], "review_id bigint, text string, stars int")
    rows = classify.training_rows(df).select("review_id", "_clean", "_terms", "label_name")
    assert classify.sentiment_model_metrics(rows, "review_id", max_iter=2).count() == 2
    assert classify.cross_validate(rows, "review_id", folds=2, max_iter=2).count() == 2
    assert classify.aspect_model_metrics(classify.aspect_training_rows(df, "review_id"), "review_id", max_iter=2).count() == 14
    assert kept and not any("_terms" in columns for columns in kept)


def test_metrics_read_the_predictions_once(spark):
    rows = [("a", "x", "x"), ("a", "x", "y"), ("a", "y", "y"), ("a", None, "x"), ("a", None, None), ("a", "z", None), ("b", "x", "w"), (None, "x", "x")]
    df = spark.createDataFrame(rows, "g string, label string, prediction string")
    found = evaluation.classification_metrics(evaluation.confusion(df, by=["g"]), by=["g"])
    assert "Join" not in plan_of(found, "optimizedPlan")
    got = {r["g"]: (r["accuracy"], r["precision"], r["recall"]) for r in found.collect()}
    assert got == {"a": (0.5, 0.25, 0.5), "b": (0.0, 0.0, 0.0), None: (1.0, 0.0, 1.0)}
