from itertools import combinations

import numpy as np
import xxhash

from reviewlake.llm import simhash


def brute_print(text, width=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {k: k for k in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in prints}


def test_every_four_positions_hold_a_triple():
    triples = [set(t) for t in simhash.position_triples()]
    assert len(triples) == 20
    assert all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_components_equal_brute_force(docs, texts):
    prints = {k: brute_print(t) for k, t in enumerate(texts)}
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(texts)
    assert {r["doc_id"]: r["fingerprint"] & (2**64 - 1) for r in found} == prints
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_components(prints)


def test_long_lists_are_cut_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    prints = sorted({base ^ sum(1 << int(b) for b in rng.integers(0, 62, rng.integers(0, 6))) for _ in range(150)})
    links = simhash.links(spark.createDataFrame([(p,) for p in prints], "fingerprint long")).collect()
    expected = brute_components(dict(zip(prints, prints, strict=True)))
    parent = {p: p for p in prints}
    for _ in prints:
        for r in links:
            parent[r["a"]] = parent[r["b"]] = min(parent[r["a"]], parent[r["b"]])
    assert parent == expected


def test_one_row_of_each_group_stays(spark, docs, texts):
    expected = {k for k, v in brute_components({k: brute_print(t) for k, t in enumerate(texts)}).items() if k == v}
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(expected)
    again = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "other words of its own")], "doc_id long, text string")
    assert {(r["doc_id"]) for r in simhash.keep_representatives(again).collect()} == {None, 2}


def test_no_rows(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []
    assert simhash.keep_representatives(no_docs).collect() == []
