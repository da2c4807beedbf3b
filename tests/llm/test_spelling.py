import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewlake.llm import spelling


def one_apart(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute_words(rows, slip=199, min_length=6, min_count=5):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if slip and h % slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}


def brute(counts, ratio=5):
    """(form, root, n, n_near, form_n) of every word."""
    near = {w: [] for w in counts}
    names = sorted(counts)
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            if abs(len(a) - len(b)) < 2 and one_apart(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, held in near.items():
        best = min(held, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def as_dict(found):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    stems = ["".join(rng.choice("aehnorstié") for _ in range(rng.randint(5, 11))) for _ in range(120)]
    words = [s for k, s in enumerate(stems) for _ in range(1 + 400 // (k + 1))]
    for s in stems[:60]:
        k = rng.randrange(len(s))
        words += [s[:k] + s[k + 1 :], s[:k] + rng.choice("xñz") + s[k + 1 :], s[:k] + "q" + s[k:], s[:k] + s[k] + s[k:]] * rng.randint(3, 9)
    rng.shuffle(words)
    texts = [" ".join(w.upper() if rng.random() < 0.1 else w for w in words[k : k + 50]) for k in range(0, len(words), 50)]
    return [*enumerate(texts), (None, texts[0]), (3, None), (4, ""), (5, " ÷×ÿÀ 12 — "), (6, "aaaaaaa aaaaaaaa " * 30 + "Aaaaaab " * 6), (6, "x" * 100_000)]


def test_words_equal_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("id", F.lit(1)).repartition(4)
    for slip in (None, 199, 3):
        found = {r["word"]: r["n"] for r in spelling.vocabulary(docs, slip=slip).collect()}
        assert found == brute_words(rows, slip) and found


def test_variants_equal_brute_force(spark, rows):
    counts = brute_words(rows, 3)
    expected = brute(counts)
    assert any(x[0] for x in expected.values()) and any(x[3] for x in expected.values())
    found = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert as_dict(found) == expected


@pytest.mark.parametrize("seed", range(3))
def test_near_words_lose_no_pair(spark, seed):
    rng = random.Random(seed)
    names = {"".join(rng.choice("abéß") for _ in range(rng.randint(6, 9))) for _ in range(500)}
    pairs = {(a, b) for a in names for b in names if one_apart(a, b)}
    found = spelling.near_words(spark.createDataFrame([(w, 1) for w in names], "word string, n long"))
    rows = [(r["word"], r["near"]) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == pairs


def test_chains_reach_their_end(spark):
    # each word one letter longer and five times as frequent
    counts = {"abcdef" + "ghijkl"[:k]: 5 * 5**k for k in range(7)}
    found = as_dict(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert found == brute(counts) and found["abcdef"][1] == "abcdefghijkl"


def test_ties_go_to_the_smallest_word(spark):
    counts = {"letters": 50, "lettera": 50, "letterz": 50, "letter": 10, "letterñ": 5}
    found = as_dict(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert found == brute(counts) and found["letter"][0] == "lettera"


def test_chains_without_a_ratio_are_refused(spark):
    with pytest.raises(ValueError, match="ratio"):
        spelling.roots(spark.createDataFrame([], "word string, form string"), 10, ratio=1)


def test_no_rows(no_docs):
    assert spelling.variants(spelling.vocabulary(no_docs)).collect() == []


def test_exploded_signatures_are_not_broadcast(spark):
    words = spark.createDataFrame([("letters", 50), ("letter", 10)], "word string, n long")
    for made in (spelling.near_words(words), spelling.variants(words)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
