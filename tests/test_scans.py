"""Batch scans against the patterns they stand in for, and against Python's own string semantics."""

import random
import re

import pytest
from pyspark.sql import functions as F

from reviewlake.functions import aspects as A, scans, text as T
from reviewlake.functions.vocabulary import DEFAULT_LEXICON, DEFAULT_TAXONOMY, Lexicon, Taxonomy
from reviewlake.operators import aspects, sentiment

TEXTS = [
    None, "", "   ", " \x00 ", "a \x00 b", "a\x00b\x07c", "\x00 a", "\x85a\x86\x1cb", "good", " good  great\n", "swell made!", "well  made",
    "well", "made well", "bem-feito", "MAL HECHO price", "Karo caro", "İgood good", "good@x bad", "http bad", "baHTTPd bad", "good www.bad bad",
    "× good", "5÷5 bad", "rápido envío lento", "böx box", "a b c", "\U0001F600good\U0001D400bad", "Ünïcode ÀÉ", "Hi! You? Yes... no", "?! .", "..",
    "¿Qué? ¡Sí!", "good" * 50, "x", "﻿good", "góod", "great\n\nwell\nmade", "well", "made", "", None,
]


def random_texts(n=400):
    rng = random.Random(5)
    parts = [*DEFAULT_LEXICON.words, *DEFAULT_TAXONOMY.all_words, *DEFAULT_TAXONOMY.all_phrases, *TEXTS[3:30], "\t", " ", "\x1f", "9", "É", "ſ", "ß", "Ÿ"]
    return ["".join(rng.choice(parts).swapcase() if rng.random() < 0.2 else rng.choice(parts) + rng.choice(["", " ", " ", ", "]) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    rows = list(enumerate(TEXTS + random_texts()))
    return spark.createDataFrame(rows, "i int, t string").repartition(3).cache()


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cleaned_counts_are_those_of_the_cleaned_text(texts):
    cleaned, n = T.clean_text(F.col("t")), T.cleaned_stats(F.col("t"))
    rows = texts.select("t", T.text_length(cleaned).alias("a"), T.word_count(cleaned).alias("b"), n["text_length"].alias("c"), n["word_count"].alias("d")).collect()
    assert len(rows) == len(TEXTS) + 400
    for r in rows:
        assert (r["a"], r["b"]) == (r["c"], r["d"]), r["t"]
    assert "regexp_replace" not in plan_of(texts.select(n["text_length"], n["word_count"]))


def test_features_are_those_of_python(texts):
    counted = texts.select("t", *[c.alias(k) for k, c in T.text_features(F.col("t")).items()])
    assert "split(" not in plan_of(counted)  # words are counted without parting them
    for r in counted.collect():
        t = r["t"] or ""
        words = t.split()
        want = (
            len(t), len(words), len([s for s in re.split(r"[.!?]+", t) if s.strip()]), t.count("!"), t.count("?"),
            pytest.approx(sum(map(len, words)) / max(len(words), 1), abs=0.00501), pytest.approx(sum(c.isupper() for c in t) / max(len(t), 1), abs=0.0000501),
        )
        assert (r["char_count"], r["word_count"], r["sentence_count"], r["exclamation_count"], r["question_count"], r["avg_word_length"], r["uppercase_ratio"]) == want, t


@pytest.mark.parametrize("fold", [False, True])
def test_found_words_are_those_of_the_split_text(texts, fold):
    words = T.ml_words(F.col("t"), fold)
    found = texts.select(
        "t", A.scan(F.col("t"), DEFAULT_TAXONOMY, DEFAULT_LEXICON, fold).alias("s"), A.marks(words, DEFAULT_TAXONOMY, DEFAULT_LEXICON).alias("m"),
        F.array_join(words, " ").alias("c"),
    ).collect()
    scanned = [r for r in found if r["s"] is not None]
    assert len(scanned) > 40
    for r in scanned:
        assert r["s"]["marks"] == r["m"] and r["s"]["length"] == len(r["c"]), r["t"]
        assert sorted(r["s"]["phrases"]) == [p for p in DEFAULT_TAXONOMY.all_phrases if p in r["c"]], r["t"]
    for r in found:  # only what a pattern has to clean is left out
        low = (r["t"] or "").lower()
        assert (r["s"] is None) == ("İ" in (r["t"] or "") or any(x in low for x in ("@", "×", "÷", "http", "www"))), r["t"]


def test_every_character_parts_words_alike(spark):
    """Each character between two listed words, and as the whole of a word."""
    points = [p for p in range(1, 1 << 16) if not 0xD800 <= p < 0xE000 and p not in (0xD7, 0xF7, 0x130, 0x40)] + [0x1D400, 0x1F600, 0x10FFFF]
    every = spark.createDataFrame([("".join(f"good{chr(p)}bad bad{chr(p)} " for p in points[i:i + 500]),) for i in range(0, len(points), 500)], "t string")
    lexicon = Lexicon(frozenset({"good", "bad", "badé", "badk"}), frozenset())
    split = F.filter(T.ml_words(F.col("t")), lambda w: w.isin(lexicon.words))
    scanned = every.withColumn("s", scans.find(F.col("t"), lexicon.words))
    rows = scanned.select(split.alias("a"), F.col("s.marks.word").alias("b"), F.char_length(T.clean_ml(F.col("t"))).alias("c"), "s.length")
    for r in rows.collect():
        assert r["a"] == r["b"] and r["c"] == r["length"]


def test_slices_and_empty_batches(spark):
    """Long texts and many: words of one slice do not count in the next, and an empty table has no rows."""
    rows = [(i, ["well", "made good", "", None, "x " * 200_000 + "bad"][i % 5]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, t string").coalesce(1)
    found = df.select("i", A.scan(F.col("t"), DEFAULT_TAXONOMY, DEFAULT_LEXICON).alias("s")).orderBy("i").collect()
    want = [([], 4), ([(1, "good")], 9), ([], 0), ([], 0), ([(200_000, "bad")], 400_003)]
    assert [([tuple(m) for m in r["s"]["marks"]], r["s"]["length"]) for r in found] == want * 12
    assert not any(r["s"]["phrases"] for r in found)
    none = df.where("i < 0")
    assert none.select(scans.find(F.col("t"), ["good"])).collect() == [] and none.select(*T.cleaned_stats(F.col("t")).values()).collect() == []


def test_lists_without_phrases_and_odd_entries(spark):
    """Entries that no cleaned word can equal are never found; blanks around a phrase count."""
    taxonomy = Taxonomy({"one": frozenset({"a-b", "x y", "  z", "w ", "é"}), "two": frozenset({"q"})})
    df = spark.createDataFrame([("a-b x y", ), ("x z",), ("w",), ("w é",), ("q w",), (None,)], "text string")
    got = [tuple(r["aspect_labels"]) for r in aspects.with_aspects(df, taxonomy=taxonomy, lexicon=Lexicon(frozenset(), frozenset()), batched=True).collect()]
    assert got == [("neutral", None), (None, None), (None, None), ("neutral", None), (None, "neutral"), (None, None)]


def test_left_out_texts_are_scored_alike(spark):
    """An address leaves a text to the patterns; its scores are those of the same text without one."""
    plain = ["well made, good price", "bad box. Bad", "no word", "good bad"]
    df = spark.createDataFrame([(i, t + tail) for i, t in enumerate(plain) for tail in ("", " me@host.org", " www.x.y")], "i int, text string")
    rows = aspects.with_aspects(sentiment.with_lexicon_sentiment(df, batched=True), batched=True).drop("text").collect()
    assert len({str(sorted(r.asDict(True).items(), key=str)) for r in rows}) == len(plain)
    assert {r["clean_length"] == len(r["clean_text"]) for r in rows} == {True}


def test_only_judged_texts_are_scanned(spark):
    df = spark.createDataFrame(
        [(5, "good good good", "en"), (1, "good good good", "de"), (3, " good     ", "en"), (4, None, "en"), (2, "bad bad bad", None)], "stars int, text string, language string")
    rows = sentiment.gold_features(df, batched=True).collect()
    assert rows == sentiment.gold_features(df).collect()
    assert [r["sentiment_score"] for r in rows] == [1.0, -1.0, 0.0, 0.5, -0.5]
    assert "CASE WHEN ((language" in plan_of(sentiment.gold_features(df, batched=True).select("sentiment_score")).split("find_words(")[1]


def test_batched_reports_are_the_native_ones(spark):
    rows = [(i, 1 + i % 5, t, "en" if i % 3 else "de") for i, t in enumerate(TEXTS + random_texts(60))]
    df = spark.createDataFrame(rows, "review_id int, stars int, text string, language string")
    for report in (aspects.aspect_sentiment_crosstab, aspects.analyze_reviews, lambda d, **o: aspects.aspect_distribution(d, sentiment="negative", **o)):
        assert sorted(map(str, report(df, batched=True).collect())) == sorted(map(str, report(df).collect()))
    assert sorted(map(str, sentiment.gold_features(df, batched=True).collect())) == sorted(map(str, sentiment.gold_features(df).collect()))
