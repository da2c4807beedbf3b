"""Text functions against Python's own string and regex semantics."""

import re

from pyspark.sql import functions as F

from reviewlake.functions import text as T

TEXTS = [
    None, "", "   ", "  hello world  ", "hello    world", "a\x00b\x07c", "Visit http://x.y/z or www.q.com now",
    "Mail me@host.org, @user said hi @", "a@b", "@@foo", "a@", "x@y@z rest", "foo@barhttp://x tail", "xhttp://a@b c",
    "I don't know, it's what we've got; they'll say you're I'm he'd", "El niño comió ¿qué? ¡Sí!",
    "Não é bom, coração!", "call 123 now 4x4 5 6", "×5× 7 a× 5", "tab\tnew\nline nbsp em\x1csep",
    "WOW! Great... really? yes", "...", "\U0001F600 smile 12", "ÉTAT À 12é ą3",
]


def run(spark, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    return [r["x"] for r in df.select("i", fn(F.col("t")).alias("x")).orderBy("i").collect()]


def links(t):
    return re.sub(r"\S+@\S+", "", re.sub(r"http\S+|www\S+", "", t.lower()))


def test_clean_text(spark):
    want = [
        re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "", re.sub(r"\s+", " ", t.strip())) if t else "" for t in TEXTS
    ]
    assert run(spark, T.clean_text) == want


def test_clean_basic(spark):
    want = [re.sub(r"\s+", " ", re.sub(r"@\w+", "", links(t))).strip() if t else "" for t in TEXTS]
    assert run(spark, T.clean_basic) == want


def test_clean_nlp(spark):
    def clean(t):
        out = re.sub(r"\s+", " ", re.sub(r"@\w+", "", links(t))).strip()
        out = re.sub(r"[^a-zA-Z0-9'\s]", "", out)
        for short, full in T.CONTRACTIONS:
            out = out.replace(short, full)
        return out.strip()

    assert run(spark, T.clean_nlp) == [clean(t) if t else "" for t in TEXTS]


def test_clean_languages(spark):
    for fn, letters in ((T.clean_spanish, T.SPANISH_LETTERS), (T.clean_portuguese, T.PORTUGUESE_LETTERS)):
        want = [
            re.sub(r"\s+", " ", re.sub(rf"[^{letters}\s]", "", links(t))).strip() if t else "" for t in TEXTS
        ]
        assert run(spark, fn) == want


def test_clean_ml(spark):
    def clean(t):
        out = re.sub(r"\b\d+\b", "", links(t))
        return re.sub(r"\s+", " ", re.sub("[^a-zA-Z\\sÀ-ſ]", " ", out)).strip()

    assert run(spark, T.clean_ml) == [clean(t) if t else "" for t in TEXTS]


def test_fold_accents(spark):
    df = spark.createDataFrame([("rápido ótimo preço",)], "t string")
    assert df.select(T.clean_ml(F.col("t"), fold_accents=True)).first()[0] == "rapido otimo preco"


def test_counts(spark):
    assert run(spark, T.word_count) == [len(t.split()) if t else 0 for t in TEXTS]
    assert run(spark, T.text_length) == [None if t is None else len(t) for t in TEXTS]
    assert run(spark, T.space_word_count) == [None if t is None else len(t.split(" ")) for t in TEXTS]
    assert run(spark, T.strip) == [None if t is None else t.strip() for t in TEXTS]


def test_features(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    rows = df.select("i", *[c.alias(n) for n, c in T.text_features(F.col("t")).items()]).orderBy("i").collect()
    for row, t in zip(rows, TEXTS):
        t = t or ""
        words = t.split()
        assert row["char_count"] == len(t) and row["word_count"] == len(words)
        assert row["sentence_count"] == len([s for s in re.split(r"[.!?]+", t) if s.strip()])
        assert abs(row["avg_word_length"] - sum(map(len, words)) / max(len(words), 1)) < 0.006
        assert (row["exclamation_count"], row["question_count"]) == (t.count("!"), t.count("?"))
        assert abs(row["uppercase_ratio"] - sum(c.isupper() for c in t) / max(len(t), 1)) < 0.0001


def test_long_token_is_linear(spark):
    """A token of 200,000 characters without blanks must not make the e-mail rule quadratic."""
    df = spark.createDataFrame([("a" * 200_000 + " @ " + "b" * 200_000,)], "t string")
    assert df.select(F.char_length(T.clean_basic(F.col("t")))).first()[0] == 400_003


def test_tokens_and_bigrams(spark):
    df = spark.createDataFrame([("",), ("one",), ("one two three",)], "t string")
    got = [tuple(r) for r in df.select(T.tokens(F.col("t")), T.bigrams(T.tokens(F.col("t")))).collect()]
    assert got == [([], []), (["one"], []), (["one", "two", "three"], ["one two", "two three"])]


def test_preview(spark):
    df = spark.createDataFrame([("abcdef",), ("abc",)], "t string")
    assert [r[0] for r in df.select(T.preview(F.col("t"), 3)).collect()] == ["abc...", "abc"]
