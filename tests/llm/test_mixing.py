import re
from collections import Counter

from pyspark.sql import functions as F

from reviewlake.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    weight = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    left, rest, found = set(names), share * sum(sizes.values()), {}
    while left:
        level = rest / sum(weight[n] for n in left)
        over = {n for n in left if level * weight[n] > cap * sizes[n]}
        if not over:
            return found | {n: level * weight[n] for n in left}
        for n in over:
            found[n] = cap * sizes[n]
            rest -= found[n]
        left -= over
    return found


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def mixed(docs):
    return mixing.mix(docs.withColumn("n", mixing.word_count("text")), "doc_id", "source", "n")


def test_mix_meets_targets(docs, texts, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 5)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    found = mixed(docs).collect()
    assert {r["doc_id"]: r["size"] for r in found} == {k: words(t) for k, t in enumerate(texts)}
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
    expected = brute_targets(sizes)
    for r in found:
        assert abs(r["target"] - expected[r["source"]]) < 1e-6 * expected[r["source"]] and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[n] - expected[n]) <= longest[n] for n in expected)
    assert sorted(found) == sorted(mixed(docs.repartition(2)).collect(), key=tuple) or Counter(map(tuple, found)) == Counter(map(tuple, mixed(docs.repartition(2)).collect()))


def test_rounding_is_unbiased(spark):
    docs = spark.range(4000).select(F.col("id"), (F.col("id") % 4).cast("string").alias("s"), F.lit(10).alias("n"))
    taken = mixing.mix(docs, "id", "s", "n").groupBy("source").agg(F.sum("taken"), F.first("target")).collect()
    assert all(abs(total - target) <= 10 for _, total, target in taken)


def test_rows_are_repeated_as_taken(docs):
    expected = {r["doc_id"]: r["copies"] for r in mixed(docs).collect()}
    out = mixing.repeat_rows(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: n for k, n in expected.items() if n})


def test_no_rows_and_no_words(spark, no_docs):
    assert mixed(no_docs).collect() == [] and mixing.repeat_rows(no_docs).collect() == []
    empty = spark.createDataFrame([(1, None, None), (1, "", None), (None, " ", "a")], "doc_id long, text string, source string")
    assert {(r["taken"], r["target"]) for r in mixed(empty).collect()} == {(0, 0.0)}
