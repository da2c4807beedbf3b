import hashlib

import numpy as np

from reviewlake.llm import digest


def brute_sum(window):
    return sum(int(digest._TERM[window.count(b)]) for b in set(window))


def test_sliding_sums_equal_counting(texts):
    data, starts, windows = digest._laid_out([(t or "").encode()[:3000] for t in texts[:8]] + [b"", b"ab"])
    sums = digest._sums(data)
    raw = data.tobytes()
    assert all(sums[k] == brute_sum(raw[k : k + digest.WINDOW]) for k in range(0, len(sums), 7))


def test_rarity_counts_every_window(docs, texts):
    total = {}
    for t in texts:
        raw = (t or "").encode()
        for k in range(max(1, len(raw) - digest.WINDOW + 1) if raw else 0):
            value = brute_sum(raw[k : k + digest.WINDOW].ljust(digest.WINDOW, b"\0"))
            total[value] = total.get(value, 0) + 1
    rank = digest.rarity(docs)
    strong = sorted((v for v in total if v < digest._LOW), key=lambda v: (total[v], v))
    assert [v for v in sorted(strong, key=lambda v: rank[v])] == strong


def test_digests_do_not_depend_on_company(docs, texts):
    rank = digest.rarity(docs)
    raw = [(t or "").encode() for t in texts]
    together = digest.digests(raw, rank)
    for text, (filters, held) in zip(raw, together, strict=True):
        alone = digest.digests([text], rank)[0]
        assert np.array_equal(alone[0], filters) and np.array_equal(alone[1], held)
        same = digest.decoded(digest.encoded(alone))
        assert np.array_equal(same[0], filters) and digest.likeness(alone, same) == 1.0
    assert all(len(h) for t, (_, h) in zip(raw, together, strict=True) if t)


def test_edited_texts_and_next_documents(docs, texts):
    found = {r["doc_id"]: r for r in digest.edited_fingerprints(docs, digest.rarity(docs)).collect()}
    assert set(found) == set(range(len(texts)))
    plain = [t or "" for t in texts]
    for k, text in enumerate(plain):
        after, cut = plain[(k + 1) % len(plain)], len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = found[k]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_next"] - digest.likeness(digest.decoded(r["fingerprint"]), digest.decoded(found[(k + 1) % len(plain)]["fingerprint"]))) < 1e-9
        if len(text) > 500:
            assert 0.5 < r["near_edited"] <= 1
    assert np.mean([r["near_next"] for r in found.values() if r["n_chars"] > 200]) < 0.2
    by_text = {}
    for k, text in enumerate(plain):
        assert by_text.setdefault(text, found[k]["fingerprint"]) == found[k]["fingerprint"]


def test_odd_tables(spark, no_docs):
    assert digest.edited_fingerprints(no_docs, digest.rarity(no_docs)).collect() == []
    one = spark.createDataFrame([(None, "abcd" * 40)], "doc_id long, text string")
    assert digest.edited_fingerprints(one, digest.rarity(one)).count() == 1
    same = spark.createDataFrame([(1, "abcd efgh"), (1, "abcd efgh"), (2, None), (None, "z")], "doc_id long, text string")
    assert digest.edited_fingerprints(same, digest.rarity(same)).count() == 4


def test_likeness_in_blocks_equals_one_block(monkeypatch):
    rng = np.random.default_rng(5)
    make = lambda n: (np.packbits(rng.random((n, digest.BITS)) < rng.random((n, 1)) * 0.6, axis=1).view(np.uint64), rng.integers(1, 200, n))
    some = [make(n) for n in (1, 2, 7, 40)]
    some.append((some[3][0][5:30].copy(), some[3][1][5:30]))
    whole = [digest.likeness(a, b) for a in some for b in some]
    monkeypatch.setattr(digest, "PAIR_WORDS", 100)
    assert [digest.likeness(a, b) for a in some for b in some] == whole and max(whole) == 1.0


def test_likeness_of_long_texts_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(6)
    a, b = ((rng.integers(0, 1 << 63, (6000, digest.BITS // 64), np.uint64), np.full(6000, 100)) for _ in range(2))
    tracemalloc.start()
    digest.likeness(a, b)
    assert tracemalloc.get_traced_memory()[1] < 64e6
