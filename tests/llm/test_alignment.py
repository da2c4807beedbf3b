import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reviewlake.llm import alignment
from reviewlake.llm.units import PieceEncoder

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_of():
    """Inverse of the byte-level alphabet: printable Latin-1 stands for itself, the rest for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


ALPHABET = byte_of()


def tokens(text):
    """((id, bytes) of A, of B) of a text, by the tokenizers themselves, or two empty lists."""
    if not text:
        return [], []
    a = [(i, bytes(ALPHABET[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [
        (i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode())
        for i in B.encode(text) for p in [B.id_to_piece(i)]
    ]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def ends(side):
    at, out = 0, []
    for _, x in side:
        at += len(x)
        out.append(at)
    return out


def brute(texts):
    """Result rows but for the id, from all pairs of tokens."""
    found, counts = [], Counter()
    for text in texts:
        a, b = tokens(text)
        a_ends, b_ends = ends(a), ends(b)
        shared = sorted(set(a_ends) & set(b_ends))
        b_at = {e: k for k, e in enumerate(b_ends)}
        links = [(a[k][0], b[b_at[e]][0]) for k, e in enumerate(a_ends) if e in b_at]
        groups, low = [], 0
        for high in shared:
            side = [",".join(str(i) for (i, _), e in zip(s, es, strict=True) if low < e <= high) for s, es in ((a, a_ends), (b, b_ends))]
            groups.append("|".join(side))
            low = high
        counts.update(links)
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [
        (n_a, n_b, n, len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(groups.encode()).hexdigest() if n_a else "")
        for n_a, n_b, n, links, groups in found
    ]


ODD = ["a  b   c ", " ", "  ", "\n", "a\n b\t c", "tail  ", "x▁y", "<|endoftext|> <s> <0x41>", "<unk>", "漢字 かな 👩‍👩‍👧 é é", "a\x00b\x1c \x1fc",
       "don't we'll ١٢٣ 12345 $9.99", "unbroken" * 300, "　wide line\xa0space", "﻿bom"]


@pytest.fixture(scope="module")
def all_texts(texts):
    return [t and t[:3000] for t in texts] + ODD + ODD[:3]


@pytest.mark.parametrize("hot_pairs", [alignment.HOT_PAIRS, 40, 0])
def test_equal_brute_force(spark, all_texts, hot_pairs):
    docs = spark.createDataFrame([(k, t, "n") for k, t in enumerate(all_texts)], "doc_id long, text string, n string").repartition(5)
    found = alignment.align_documents(docs, hot_pairs=hot_pairs)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect())) == [(k, *row) for k, row in enumerate(brute(all_texts))]


@given(st.text(alphabet=st.one_of(st.sampled_from("ab  é'\n▁.<>s"), st.characters(exclude_categories=["Cs"])), max_size=30))
@settings(max_examples=300, deadline=None)
def test_piece_ids_of_any_text(text):
    encoder = getattr(test_piece_ids_of_any_text, "encoder", None) or PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    test_piece_ids_of_any_text.encoder = encoder
    own = encoder.encode([" " + text])[0].tolist()
    known = encoder.token_bytes()
    whole = (" " + text).encode()
    ids = B.encode(text)
    kept = b"".join(known[i] for i in ids) == whole
    assert (b"".join(known[i] for i in own) == whole) == kept or not text
    assert own == ids or not kept


@pytest.mark.parametrize("hot_pairs", [alignment.HOT_PAIRS, 0])
def test_null_and_repeated_ids(spark, hot_pairs):
    texts = ["one text", "one text", "another one", None, "one text"]
    docs = spark.createDataFrame(list(zip([None, None, 7, 7, 7], texts, strict=True)), "doc_id long, text string")
    found = alignment.align_documents(docs, hot_pairs=hot_pairs).collect()
    expected = list(zip([None, None, 7, 7, 7], brute(texts), strict=True))
    assert sorted((str(r[0]), *r[1:]) for r in found) == sorted((str(k), *row) for k, row in expected)


def test_windows_are_forgotten_when_full(spark, texts, monkeypatch):
    paths = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
    aligner = alignment.Aligner(*paths)
    own = [t for t in texts[:20] if t]
    first = aligner.align(own)
    monkeypatch.setattr(alignment, "MEMO_BYTES", 1000)
    again = aligner.align(own)
    assert first["groups_sha256"] == again["groups_sha256"] and first["pairs"].tolist() == again["pairs"].tolist()


def test_a_very_long_text(spark):
    text = ("lorem ipsum " * 20 + "x" * 50 + "\n") * 20_000
    row = alignment.align_documents(spark.createDataFrame([(0, text)], "doc_id long, text string")).first()
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    assert (row["n_a"], row["n_b"]) == (len(a), len(b)) and row["n_links"] == row["n_groups"] > 800_000


def test_no_rows(no_docs):
    assert alignment.align_documents(no_docs).collect() == []
