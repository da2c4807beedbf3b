"""Alignment of two tokenizers' tokens by byte offsets: whitespace-token anchors, windows memoised by their ids.

Texts are tokenised whole by both vocabularies. Where a token of either side that starts with a space begins at the same
byte, the tokens before it end together: such anchors cut a document into windows of ids of both sides. A window's
alignment depends on its ids alone, so each distinct pair of id tuples is aligned once and remembered.

Counts of linked id pairs over the corpus go back to the documents in two ways that give the same: pairs at or above a
count that at most `HOT_PAIRS` pairs reach are sent to every task as arrays; the rare rest, of which each holds few rows,
is joined. So no very common pair meets in one task, and what is sent doesn't grow with the corpus.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.llm.scratch import save
from reviewlake.llm.tokens import Encoder
from reviewlake.llm.units import PieceEncoder, gather

#: Characters that a task tokenises at once.
CHUNK_CHARS = 2_000_000
#: Most id pairs sent to every task: 17 bytes each.
HOT_PAIRS = 1 << 18
#: Bytes of remembered windows; when full, they are forgotten.
MEMO_BYTES = 200_000_000


class PlainEncoder(Encoder):
    """Byte-level ids where a special token's string is ordinary text."""

    def __init__(self, tokenizer_path: str, ranks_path: str) -> None:
        super().__init__(tokenizer_path, ranks_path)
        self._whole.encode_special_tokens = True
        self._special = []

    def token_bytes(self) -> list[bytes]:
        return [self._word.decode_single_token_bytes(k) for k in range(len(self._word._mergeable_ranks))]


class Vocabulary:
    """Bytes of a vocabulary's tokens as arrays."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.size = len(tokens)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.spaced = np.array([t[:1] == b" " for t in tokens])


class Windows(dict):
    """Place of each window's alignment by its two id tuples, held as bytes with an id between them that no token has."""

    def __init__(self, a: Vocabulary, b: Vocabulary) -> None:
        super().__init__()
        narrow = max(a.size, b.size) < 0xFF00  # else a mark could be read across two ids
        self.dtype, self._code, self.mark = ("<u2", "H", b"\xff" * 2) if narrow else ("<u4", "I", b"\xff" * 4)
        self._a_lengths, self._b_lengths, self._b_size = a.lengths.tolist(), b.lengths.tolist(), b.size
        self._a_names, self._b_names = ([str(k) for k in range(side.size)] for side in (a, b))
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.groups: list[str] = []
        self.pairs, self.starts, self.held = array("q"), array("q", [0]), 0

    def __missing__(self, key: bytes) -> int:
        cut, whole = key.index(self.mark), memoryview(key)
        a = whole[:cut].cast(self._code).tolist()
        b = whole[cut + len(self.mark) :].cast(self._code).tolist()
        a_lengths, b_lengths, a_names, b_names = self._a_lengths, self._b_lengths, self._a_names, self._b_names
        groups, left, right, ahead, n = [], [], [], 0, 0
        for x in a:
            left.append(a_names[x])
            ahead += a_lengths[x]  # bytes by which a's tokens are ahead of b's
            while ahead > 0:
                y = b[n]
                right.append(b_names[y])
                ahead -= b_lengths[y]
                n += 1
            if not ahead:
                groups.append(f"{','.join(left)}|{','.join(right)}")
                self.pairs.append(x * self._b_size + y)
                left, right = [], []
        text = ";".join(groups)
        self.groups.append(text)
        self.starts.append(len(self.pairs))
        self.held += 250 + len(key) + len(text)
        place = self[key] = len(self.groups) - 1
        return place


class Aligner:
    """Alignments of whole texts by two vocabularies."""

    def __init__(self, a_path: str, a_ranks: str, b_path: str) -> None:
        self._a, self._b = PlainEncoder(a_path, a_ranks), PieceEncoder(b_path)
        self.a, self.b = Vocabulary(self._a.token_bytes()), Vocabulary(self._b.token_bytes())
        self._windows = Windows(self.a, self.b)

    @staticmethod
    def _whole(side: Vocabulary, ids: np.ndarray, counts: np.ndarray, expected: list[bytes]) -> np.ndarray:
        """Which texts' joined token bytes are the text."""
        joined, ends = gather(side.flat, side.starts, ids.astype(np.int64))
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        if joined.tobytes() == b"".join(expected) and (np.diff(bounds) == [len(x) for x in expected]).all():
            return np.ones(len(expected), bool)
        return np.array([joined[i:j].tobytes() == x for i, j, x in zip(bounds, bounds[1:], expected, strict=False)], bool)

    def align(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """Per text n_a, n_b, n_groups, groups_sha256; links of all texts as `pairs` (id of a * size of b + id of b) with their
        `times`, each once per text, and `bounds` of the texts in them."""
        if self._windows.held > MEMO_BYTES:
            self._windows.forget()
        spaced = [" " + t if t else "" for t in texts]
        expected = [t.encode() for t in spaced]
        a, n_a = self._a.encode(spaced)
        b, n_b = self._b.encode(spaced)
        good = self._whole(self.a, a, n_a, expected) & self._whole(self.b, b, n_b, expected)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b = n_a * good, n_b * good

        a_ends, b_ends = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        a_starts, b_starts = a_ends - self.a.lengths[a], b_ends - self.b.lengths[b]
        # both sides' tokens are gapless, so those before two tokens that begin together end together
        anchors = np.intersect1d(a_starts[self.a.spaced[a]], b_starts[self.b.spaced[b]], assume_unique=True)
        a_cuts = np.r_[np.searchsorted(a_starts, anchors), len(a)]
        b_cuts = np.r_[np.searchsorted(b_starts, anchors), len(b)]
        windows = self._windows
        a_bytes, b_bytes, mark = a.astype(windows.dtype).tobytes(), b.astype(windows.dtype).tobytes(), windows.mark
        i, k = (len(mark) * a_cuts).tolist(), (len(mark) * b_cuts).tolist()
        place = [windows[a_bytes[p:q] + mark + b_bytes[r:s]] for p, q, r, s in zip(i, i[1:], k, k[1:], strict=False)]

        # a text begins with a space on both sides, so its start is an anchor
        first = np.searchsorted(a_cuts[:-1], np.r_[0, np.cumsum(n_a)]).tolist()
        hashes = []
        for p, q in zip(first, first[1:], strict=False):
            groups = ";".join([windows.groups[x] for x in place[p:q]])
            hashes.append(hashlib.sha256(groups.encode()).hexdigest() if q > p else "")
        links, ends = gather(np.array(windows.pairs, np.int64), np.array(windows.starts, np.int64), np.array(place, np.int64))
        n_links = np.diff(np.r_[0, ends][first])
        text = np.repeat(np.arange(len(texts)), n_links)
        if self.a.size * self.b.size * (len(texts) + 1) < 1 << 62:  # one number sorts faster than two
            both = np.sort(text * (self.a.size * self.b.size) + links)
            text, links = np.divmod(both, self.a.size * self.b.size)
        else:
            order = np.lexsort((links, text))
            links, text = links[order], text[order]
        fresh = np.flatnonzero(np.r_[True, (links[1:] != links[:-1]) | (text[1:] != text[:-1])][: len(links)])
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": n_links, "groups_sha256": hashes, "pairs": links[fresh],
            "times": np.diff(np.r_[fresh, len(links)]), "bounds": np.searchsorted(text[fresh], np.arange(len(texts) + 1)),
        }


def alignments(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, a_ranks: str | None = None,
    b_path: str | None = None,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256, pairs, times) of every document.

    Vocabulary a takes a space and the text, vocabulary b the text, before which it puts a space itself. `pairs` are the
    different linked id pairs, a's id * size of b + b's id, and `times` how often each is linked: the last tokens of a
    group end together and are its link. Texts that are null or empty, or that either vocabulary changes, have no tokens.
    """
    a_path = a_path or public_tokenizers.path("byte_bpe_50k.json")
    a_ranks = a_ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    b_path = b_path or public_tokenizers.path("piece_bpe_32k.model")

    def found(ids: pa.Array, texts: list[str], aligner: Aligner) -> pa.RecordBatch:
        out = aligner.align(texts)
        bounds = pa.array(out["bounds"], pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(out[x], pa.int64())) for x in ("pairs", "times")]
        counts = [pa.array(out[x], pa.int64()) for x in ("n_a", "n_b", "n_groups")]
        return pa.RecordBatch.from_arrays(
            [ids, *counts, pa.array(out["groups_sha256"], pa.string()), *lists],
            ["id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner(a_path, a_ranks, b_path)
            texts, size, first = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= CHUNK_CHARS:
                    yield found(batch.column(0).slice(first, len(texts)), texts, aligner)
                    texts, size, first = [], 0, k + 1
            if texts:
                yield found(batch.column(0).slice(first, len(texts)), texts, aligner)

    fields = [T.StructField("id", docs.schema[id_col].dataType)]
    fields += [T.StructField(name, T.LongType()) for name in ("n_a", "n_b", "n_groups")]
    fields.append(T.StructField("groups_sha256", T.StringType()))
    fields += [T.StructField(name, T.ArrayType(T.LongType())) for name in ("pairs", "times")]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, T.StructType(fields))


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best) over all documents of `aligned`; best: n is the highest of all pairs with that id of b, ties included.

    Pairs are counted per task before they are shuffled. The highest counts are one row per id of b, so they are sent whole.
    """
    counts = save(aligned.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")))
    highest = counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("n").alias("highest"))
    named = counts.join(F.broadcast(highest), F.col("pair") % b_size == F.col("b"))
    return save(named.select("pair", "n", (F.col("n") == F.col("highest")).alias("best")))


def _hot(counts: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The pairs whose count reaches the smallest power of two that at most `most` pairs reach; number of other pairs."""
    power = F.length(F.bin("n")) - 1
    sizes = dict(counts.groupBy(power.alias("power")).agg(F.count(F.lit(1))).collect())
    held, least = 0, 64
    for power in sorted(sizes, reverse=True):
        if held + sizes[power] > most:
            break
        held, least = held + sizes[power], power
    return counts.where(F.col("n") >= (1 << least) if least < 63 else F.lit(False)), sum(sizes.values()) - held


def align_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, a_ranks: str | None = None,
    b_path: str | None = None, hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of `docs`.

    Byte offsets where tokens of both sides end cut a text's tokens into groups; groups_sha256 is over "a1,a2|b1;a3|b2,b3".
    A link is a pair of tokens whose byte ranges end together: the last two of a group. A pair of ids counts as often as it
    is linked in all documents. n_best: links whose count is the highest of their id of b, ties included; count_sum: the sum
    over links. Null and empty texts and texts whose joined tokens differ from the text with its space have zeros and ''.
    Repeated rows count and are returned each time; null ids are kept; other columns of `docs` are not looked at.
    """
    aligned = save(alignments(docs, id_col, text_col, a_path, a_ranks, b_path))
    b_size = Vocabulary(PieceEncoder(b_path or public_tokenizers.path("piece_bpe_32k.model")).token_bytes()).size
    counts = pair_counts(aligned, b_size)
    hot, others = _hot(counts, hot_pairs)
    table = hot.orderBy("pair").toArrow()
    pair, n, best = (table.column(x).to_numpy() for x in ("pair", "n", "best"))
    best = best.astype(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # lists of a batch may be slices of longer ones
            links = batch.column(batch.schema.get_field_index("pairs"))
            times = batch.column(batch.schema.get_field_index("times")).flatten().to_numpy()
            bounds = np.r_[0, np.cumsum(links.value_lengths().to_numpy())].astype(np.int64)
            links = links.flatten().to_numpy()
            at = np.minimum(np.searchsorted(pair, links), max(0, len(pair) - 1))
            hit = pair[at] == links if len(pair) else np.zeros(len(links), bool)
            at = at[hit]

            def per_row(values: np.ndarray, bounds: np.ndarray = bounds) -> np.ndarray:
                return np.diff(np.r_[0, np.cumsum(values, dtype=np.int64)][bounds])

            most, total = np.zeros(len(links), np.int64), np.zeros(len(links), np.int64)
            most[hit], total[hit] = times[hit] * best[at], times[hit] * n[at]
            rest = pa.array(np.r_[0, np.cumsum(per_row(~hit))], pa.int32())
            lists = [pa.ListArray.from_arrays(rest, pa.array(x[~hit], pa.int64())) for x in (links, times)]
            names = ["id", "n_a", "n_b", "n_groups", "groups_sha256"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(x)) for x in names), pa.array(per_row(most)), pa.array(per_row(total)), *lists],
                [*names, "n_best", "count_sum", "pairs", "times"],
            )

    kept = ["id", "n_a", "n_b", "n_groups", "groups_sha256"]
    fields = [*(aligned.schema[name] for name in kept), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]
    fields += [aligned.schema[name] for name in ("pairs", "times")]
    scored = aligned.mapInArrow(run, T.StructType(fields))
    if others:
        # rows alike in id and groups hold the same links
        rare = scored.select("id", "groups_sha256", F.inline(F.arrays_zip("pairs", "times"))).distinct()
        more = rare.join(counts, F.col("pairs") == F.col("pair")).groupBy(F.col("id").alias("_id"), F.col("groups_sha256").alias("_sha")).agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum")
        )
        scored = scored.join(more, F.col("id").eqNullSafe(F.col("_id")) & (F.col("groups_sha256") == F.col("_sha")), "left")
        scored = scored.withColumns({
            "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0)),
        })
    return scored.select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"
    )
