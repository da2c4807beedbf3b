"""Held-out accuracy on the test tables, gradients against finite differences, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import language, subwords, toxicity

SF = "/root/testdata/sf0.01"


def test_grams_equal_a_plain_loop():
    words = ["a", "bc", "ñandú", "word" * 3]
    for n in (2, 3):
        having, starts, bucket = subwords.grams(words, n, n, 1 << 15)[0]
        expected = [len(w) + 2 - n + 1 for w in words]
        assert having.tolist() == [0, 1, 2, 3] and np.diff([*starts, len(bucket)]).tolist() == expected
        alone = [subwords.grams([w], n, n, 1 << 15)[0][2].tolist() for w in words]
        assert bucket.tolist() == sum(alone, [])


def test_gradients(monkeypatch):
    rng = np.random.default_rng(0)
    net = toxicity.Network(["ab", "cd"])
    for k, v in net.p.items():
        net.p[k] = rng.normal(0, 0.3, v.shape)
    net.p["word"][0] = 0
    words, place, live = toxicity._windowed([["ab", "cd", "xyz"], ["xyz", "ab"], ["q"] * 5])
    label = np.array([1, 0, 1])
    monkeypatch.setattr(net, "inputs", lambda w: np.c_[net.p["word"][[net.known.get(x, 0) for x in w]], (lambda s, c: s / c[:, None])(*_sums(net, w))])

    def loss():
        score, _ = net.forward(net.projected(words), place, live)
        return np.mean(np.logaddexp(0, score) - label * score)

    grad = net.gradients(words, place, live, lambda s: (1 / (1 + np.exp(-s)) - label) / 3)
    for name, g in grad.items():
        flat, flat_g = net.p[name].reshape(-1), np.asarray(g).reshape(-1)
        for k in np.argsort(-np.abs(flat_g))[:4]:
            old = flat[k]
            flat[k] = old + 1e-2
            up = loss()
            flat[k] = old - 1e-2
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-2 - flat_g[k]) < 2e-3 + 0.05 * abs(flat_g[k]), name


def _sums(net, words):
    sums, count = subwords.gram_sums(words, net.p["gram"], toxicity.LOW, toxicity.HIGH)
    return sums.astype(float), count


def test_windows_cover_every_word():
    counts = np.array([0, 1, toxicity.WINDOW, toxicity.WINDOW + 1, 500])
    text, start, size = toxicity.windows(counts)
    begin = np.cumsum(counts) - counts
    for k, n in enumerate(counts):
        seen = set()
        for t, s, w in zip(text, start, size, strict=True):
            if t == k:
                assert 0 < w <= toxicity.WINDOW
                seen |= set(range(s - begin[k], s - begin[k] + w))
        assert seen == set(range(n))


def test_passages_lie_whole_in_a_window_at_every_offset():
    passage = toxicity.WINDOW // 2
    _, start, size = toxicity.windows(np.array([300]))
    for at in range(300 - passage + 1):
        assert any(s <= at and at + passage <= s + n for s, n in zip(start, size, strict=True)), at


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_languages_of_held_out_rows(documents, docs, no_docs):
    model = language.fit(documents.where(language.fold("doc_id") != 0))
    found = language.predict(documents.where(language.fold("doc_id") == 0), model, extra=("lang",))
    right, kept, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg((~F.col("rejected")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.97 and kept > 0.99
    odd = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert set(odd) == set(texts)
    for k, text in texts.items():
        unknown = not any(c.isalpha() for c in text or "")
        assert (odd[k]["lang_pred"] == "und") == unknown and 0 <= odd[k]["score"] <= 1 and (not unknown or odd[k]["rejected"])
    assert language.predict(no_docs, model).collect() == []
    assert language.keep_known(docs, model).columns == docs.columns


UNKNOWN_TEXTS = [
    "".join(np.random.default_rng(1).choice(list("asdfghjklqwertyuiopzxcvbnm    "), 600)),
    "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。",
    "SELECT o_orderkey, SUM(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "WHERE o_orderdate < DATE '1995-03-15' GROUP BY o_orderkey ORDER BY revenue DESC LIMIT 10",
    "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
]


@pytest.mark.parametrize("learned", [["de", "en"], ["de", "en", "es", "fr"]])
def test_unknown_languages_are_rejected_and_mixed_texts_kept(documents, spark, learned):
    own = documents.where(F.col("lang").isin(learned))
    model = language.fit(own.where(language.fold("doc_id") != 0))
    assert model.languages == learned
    held = language.predict(own.where(language.fold("doc_id") == 0), model)
    assert held.where("rejected").count() <= 0.01 * held.count()
    others = documents.where(~F.col("lang").isin(learned))
    if n := others.count():
        assert language.predict(others, model).where("rejected").count() > 0.9 * n
    first = [documents.where((F.col("lang") == x) & (F.length("text") > 500)).orderBy("doc_id").first()["text"] for x in learned[:2]]
    rows = [(k, t) for k, t in enumerate([*UNKNOWN_TEXTS, " ".join(first)])]
    found = language.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["rejected"] for r in found] == [True] * len(UNKNOWN_TEXTS) + [False]


def test_predictions_equal_a_plain_loop(documents):
    model = language.fit(documents.where(language.fold("doc_id") != 0), rows_per_language=40)
    known = np.unpackbits(model.familiar)
    rows = documents.where(F.col("doc_id") % 40 == 0)
    found = {r["doc_id"]: r for r in language.predict(rows, model).collect()}
    for r in rows.collect():
        words, total, count, held, of = language.words_of(r["text"]), 0.0, 0, 0, 0
        for w in words:
            for n in range(language.LOW, language.HIGH + 1):
                for *_, bucket in subwords.grams([w], n, n, language.BUCKETS):
                    total, count = total + model.scores[bucket].astype(float).sum(axis=0), count + len(bucket)
            for n in range(language.FAMILIAR_LOW, language.HIGH + 1):
                for *_, bucket in subwords.grams([w], n, n, language.FAMILIAR_BUCKETS):
                    held, of = held + int(known[bucket].sum()), of + len(bucket)
        odds = np.exp((total / count + model.bias) / model.temperature)
        assert found[r["doc_id"]]["lang_pred"] == model.languages[int(odds.argmax())]
        assert abs(found[r["doc_id"]]["score"] - odds.max() / odds.sum()) < 1e-3
        error = (model.least * (1 - model.least) / len(words)) ** 0.5
        assert found[r["doc_id"]]["rejected"] == (held / of + language.SURE * error < model.least)


def test_fits_take_whole_texts_and_rows_once(spark):
    words = [f"w{k}" for k in range(1000)]
    assert sum(language._runs(words), []) == words and list(language._runs([])) == []
    letters = ["a" * (k % 7 + 1) + "bcdefg"[k % 6] for k in range(500)]
    seen = [w for _, w in toxicity._cut([None, "", " ".join(letters)])]
    _, start, size = toxicity.windows(np.array([500]))
    assert seen == [" ".join(letters[s : s + n]) for s, n in zip(start, size, strict=True)]
    docs = spark.createDataFrame([(7, f"text {k % 3}", "en") for k in range(300)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(7, 1), (7, 0)], "doc_id long, toxic int")
    assert toxicity.sample(docs, labels, "doc_id", "text", "toxic", 10).count() == 1
    assert language.fit(docs).languages == ["en"]


def test_raw_scores_are_the_highest_of_single_windows(documents):
    model = toxicity.ToxicityModel(toxicity.train([("vile word here".split(), 1, 0), ("plain word here".split(), 0, 1)]))
    texts = [r["text"] for r in documents.where(F.col("doc_id") % 50 == 0).select("text").collect()]
    table = model.table()
    for text, raw in zip(texts, model.raw(table, texts), strict=True):
        alone = [model.raw(table, [own])[0] for _, own in toxicity._cut([text])] or [toxicity.WORDLESS]
        assert abs(raw - max(alone)) < 1e-4


def test_a_model_without_rows(no_docs, docs):
    model = language.fit(no_docs)
    assert {r["lang_pred"] for r in language.predict(docs, model).collect()} == {"und"}


def test_toxicity_learns_and_scores_whole_texts(spark, no_docs):
    rng = np.random.default_rng(4)
    plain = ["".join(rng.choice(list("aeionrst"), rng.integers(2, 8))) for _ in range(400)]
    bad = ["vileword", "vilething", "vilest"]
    rows = []
    for k in range(600):
        words = rng.choice(plain, rng.integers(20, 200)).tolist()
        if k % 4 == 0:
            words.insert(int(rng.integers(len(words))), bad[k % 3])
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    docs = spark.createDataFrame([(k, t, "x", 1.0) for k, t, _ in rows], "doc_id long, text string, label string, raw double").repartition(4)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels.where(language.fold("doc_id") != 0))
    held = toxicity.score(docs.where(language.fold("doc_id") == 0), model).collect()
    wrong = sum((r["score"] >= 0.5) != (r["doc_id"] % 4 == 0) for r in held)
    assert wrong <= 0.05 * len(held)
    late = " ".join([*rng.choice(plain, 20_000).tolist(), "vileword"])
    odd = spark.createDataFrame([(1, late), (1, late), (2, None), (3, ""), (None, "... ! 123")], "doc_id long, text string")
    scores = {}
    for r in toxicity.score(odd, model).collect():
        scores.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(scores[1]) == 1 and max(scores[1]) > 0.5 and scores[2] == scores[3] == scores[None] and max(scores[2]) < 0.5
    assert toxicity.score(no_docs, model).collect() == []
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] < 0.5 for r in toxicity.score(docs, model).collect())


def test_toxicity_without_labels(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == docs.count()
