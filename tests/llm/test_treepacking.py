import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reviewlake.llm import treepacking
from reviewlake.llm.units import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_ids_equal_the_tokenizer():
    texts = ["", " ", "a", "  Two  Spaces \n\n new\tline ", "don't we'll I'M 's", "é É İ ß Σας é ́x", "a\x1cb\x1f c\x85d\xa0e",
             "tail <|endoftext|> in text", "Ñandú 12345 ½ ٣٤ !!! ?? $9.99", "emoji 👩‍👩‍👧 ok 漢字 가", "\r\n\r\n", "word " * 500, "no" * 3000, "　wide line "]
    encoder = WordEncoder(PATH)
    expected = [e.ids for e in WHOLE.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from the cache
        flat, lengths = encoder.encode(texts)
        assert lengths.tolist() == [len(e) for e in expected]
        assert flat.tolist() == [i for e in expected for i in e]


@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40))
@settings(max_examples=300, deadline=None)
def test_ids_of_any_text(text):
    encoder = WordEncoder(PATH) if not hasattr(test_ids_of_any_text, "encoder") else test_ids_of_any_text.encoder
    test_ids_of_any_text.encoder = encoder
    assert encoder.encode([text])[0].tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def slow_first_fit(sizes, context):
    bins = []
    for k, size in enumerate(sizes):
        for held in bins:
            if sum(sizes[i] for i in held) + size <= context:
                held.append(k)
                break
        else:
            bins.append([k])
    return bins


@given(st.lists(st.integers(1, 100), max_size=60), st.integers(100, 128))
@settings(max_examples=300, deadline=None)
def test_tree_is_first_fit_decreasing_and_nothing_is_padded(sizes, context):
    sizes = sorted(sizes, reverse=True)
    bins = treepacking.first_fit_decreasing(sizes, context)
    assert bins == slow_first_fit(sizes, context)
    sequences = treepacking.without_padding(bins, sizes, context)
    parts = defaultdict(list)
    for held in sequences:
        total = sum(n for _, _, n in held)
        assert total == context or (total < context and total & (total - 1) == 0)
        for k, start, n in held:
            assert n > 0
            parts[k].append((start, n))
    for k, size in enumerate(sizes):
        at = 0
        for start, n in sorted(parts[k]):
            assert start == at
            at += n
        assert at == size


def check(rows, texts, context):
    """Every id in one piece, offsets gapless, no padding."""
    own, places = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(own) == set(range(len(texts)))
    for k, text in enumerate(texts):
        ids = [*WHOLE.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(own[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end and length > 0
            end += length
        assert end == context or (end < context and end & (end - 1) == 0)


@pytest.mark.parametrize("options", [{}, {"context": 256}, {"context": 64, "group": 7}])
def test_pieces_and_places(docs, texts, options):
    found = treepacking.pack_documents(docs, **options)
    assert found.columns == COLUMNS
    check(found.collect(), texts, options.get("context", 2048))


def test_reruns_agree(docs):
    first, again = (sorted(map(tuple, treepacking.pack_documents(docs, context=256).collect())) for _ in range(2))
    assert first == again


def test_equal_rows_are_dealt_over_tasks(spark):
    same = spark.createDataFrame([(1, "one text for all of them")] * 4000 + [(None, None)] * 3, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few bytes are one task's work
    try:
        rows = treepacking.pack_documents(same, context=256, group=100).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["start"] == 0 for r in rows) == 4003
    assert sum(r["length"] for r in rows) == 4000 * rows[[r["doc_id"] for r in rows].index(1)]["doc_tokens"] + 3
    assert len({r["sequence_id"] >> 40 for r in rows}) == 8


def test_long_texts_are_cut_into_full_sequences(spark):
    one = spark.createDataFrame([(0, "word " * 3_000_000)], "doc_id long, text string")
    rows = treepacking.pack_documents(one).collect()
    assert sum(r["length"] for r in rows) == 3_000_001 and max(r["length"] for r in rows) == 2048


def test_no_rows(no_docs):
    assert treepacking.pack_documents(no_docs).collect() == []
