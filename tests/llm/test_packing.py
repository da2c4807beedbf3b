import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from reviewlake.llm import packing
from reviewlake.llm.tokens import Encoder

WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizer():
    texts = ["", " ", "a", "  two  spaces \n\n new\tline ", "don't we'll I'M 's", "x y z 　", "a\x1cb\x1f c", "tail <|endoftext|> in text",
             "Ñandú 12345 ½ ٣٤ !!! ??", "emoji 👩‍👩‍👧 ok", "\r\n\r\n", "word " * 500, "no" * 3000, " leading", "trailing  "]
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    flat, lengths = encoder.encode(texts)
    expected = [e.ids for e in WHOLE.encode_batch(texts, add_special_tokens=False)]
    assert lengths.tolist() == [len(e) for e in expected]
    assert flat.tolist() == [i for e in expected for i in e]


def check(rows, texts, context):
    own = defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
    assert set(own) == set(range(len(texts)))
    for k, text in enumerate(texts):
        ids = [*WHOLE.encode(text or "", add_special_tokens=False).ids, 0]
        found = sorted(own[k], key=lambda r: r["piece"])
        assert [r["piece"] for r in found] == list(range(len(found)))
        at = 0
        for n, r in enumerate(found):
            assert r["start"] == at and (n == 0 or r["length"] == context)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids) and (len(found) == 1 or len(ids) > context)
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= context
    return len(places), sum(r["length"] for r in rows)


def test_pieces_and_places(docs, texts):
    sequences, tokens = check(packing.pack_documents(docs, context=256).collect(), texts, 256)
    assert sequences <= 1.05 * tokens / 256 + 1


def test_few_open_bins_and_small_blocks_stay_right(spark, docs, texts):
    found = packing.save(packing.pieces(docs, context=256))
    check(packing.pack(found, context=256, open_bins=2, block=7).collect(), texts, 256)


def test_ids_can_be_kept(docs, texts):
    row = packing.pieces(docs, with_ids=True).where("doc_id = 3").first()
    assert list(row["ids"]) == [*WHOLE.encode(texts[3], add_special_tokens=False).ids, 0][: row["length"]]


def test_no_rows(no_docs):
    assert packing.pack_documents(no_docs).collect() == []
