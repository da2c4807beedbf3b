import zlib
from collections import Counter, defaultdict

from reviewlake.llm import sharding


def check(found, texts, shards):
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (k, size(t), zlib.crc32((t or "").encode())) for k, t in enumerate(texts))
    slots, sizes, homes, group = defaultdict(list), Counter(), defaultdict(set), Counter()
    for r in found:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        homes[texts[r["doc_id"]] or ""].add(r["shard"])
        group[texts[r["doc_id"]] or ""] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = sum(sizes.values())
    fits = {t for t, n in group.items() if n * shards <= total}
    assert all(len(homes[t]) == 1 for t in fits)
    most = max([0, *(group[t] for t in fits), *(size(t) for t in texts)])
    assert all(abs(sizes[s] - total / shards) <= most for s in range(shards))


def test_even_shards_keep_equal_texts_together(docs, texts, spark):
    plain = docs.where("length(text) < 5000 or text is null")
    kept = {r["doc_id"] for r in plain.select("doc_id").collect()}
    found = sharding.shard(plain, shards=4).collect()
    known = [t for k, t in enumerate(texts)]
    sizes = Counter(r["shard"] for r in found)
    assert {r["doc_id"] for r in found} == kept and set(sizes) == {0, 1, 2, 3}
    renumber = {k: n for n, k in enumerate(sorted(kept))}
    rows = [{**r.asDict(), "doc_id": renumber[r["doc_id"]]} for r in found]
    check(rows, [known[k] for k in sorted(kept)], 4)


def test_a_text_above_a_share_is_split(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEAST_FULL", 50)
    texts = ["hot text of many copies"] * 300 + [f"text {k}" for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(sharding.shard(docs, shards=8, ranges=32).collect(), texts, 8)


def test_no_rows_and_repeated_rows(spark, no_docs):
    assert sharding.shard(no_docs).collect() == []
    same = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    assert sharding.shard(same, shards=2).count() == 3
