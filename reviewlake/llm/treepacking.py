"""First-fit-decreasing packing of tokenised documents with a tournament tree, in randomised groups.

Documents are cut at full sequences; what is left of each goes to a random group of about 4,096. A group's rests are
placed longest first, each into the first bin that holds it, which a tournament tree of the bins' free capacities finds in
steps that grow with the logarithm of their number. A sequence is padded unless its length is a power of two, and cuts
are free. So the group's emptiest bins are taken apart to fill the gaps of the fullest, and the last tokens, less than a
sequence, go to sequences whose lengths are powers of two: no padding is left, at about one cut in a hundred documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.llm.units import WordEncoder

CONTEXT = 2048
#: Rests of documents in a group.
GROUP = 4096
#: Characters that a task encodes at once.
CHUNK_CHARS = 2_000_000


class TournamentTree:
    """Free capacities of bins; an inner node holds the larger of its two children, so the first bin that fits is found
    from the root."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for `size`, which it takes."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        best[node] -= size
        found = node - self.leaves
        while node > 1:
            node //= 2
            left, right = best[2 * node], best[2 * node + 1]
            best[node] = left if left > right else right
        return found


def first_fit_decreasing(sizes: list[int], context: int) -> list[list[int]]:
    """Bins as lists of places in `sizes`, which fall."""
    tree = TournamentTree(len(sizes), context)
    bins: list[list[int]] = []
    for k, size in enumerate(sizes):
        chosen = tree.place(size)
        if chosen == len(bins):
            bins.append([])
        bins[chosen].append(k)
    return bins


def without_padding(bins: list[list[int]], sizes: list[int], context: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (place in `sizes`, start, length): those bins with their gaps filled by cutting.

    The emptiest bins give, the fullest take. What no gap is left for, less than `context`, goes to sequences of falling
    powers of two. A bin whose fill is a power of two needs no padding and stays.
    """
    fill = [sum(sizes[k] for k in held) for held in bins]
    order = sorted(range(len(bins)), key=lambda b: -fill[b])
    done, gaps = [], []
    for b in order:
        whole = [(k, 0, sizes[k]) for k in bins[b]]
        (done if fill[b] & (fill[b] - 1) == 0 or fill[b] == context else gaps).append(whole)
    rest: list[tuple[int, int, int]] = []  # parts to hand out, the next one last

    def take(n: int) -> list[tuple[int, int, int]]:
        taken = []
        while n:
            k, start, length = rest.pop()
            used = min(n, length)
            taken.append((k, start, used))
            if used < length:
                rest.append((k, start + used, length - used))
            n -= used
        return taken

    left = 0
    first, last = 0, len(gaps)
    while first < last:
        free = context - sum(x[2] for x in gaps[first])
        while left < free and last - 1 > first:
            last -= 1
            rest += gaps[last]
            left += sum(x[2] for x in gaps[last])
        if left < free:  # the last bin that isn't full joins what is left
            rest += gaps[first]
            left += context - free
        else:
            done.append(gaps[first] + take(free))
            left -= free
        first += 1
    size = context
    while left:
        while size > left:
            size = size // 2 if size & (size - 1) == 0 else 1 << (size.bit_length() - 1)
        done.append(take(size))
        left -= size
    return done


def rests(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, tokenizer_path: str | None = None,
    end_id: int = 1,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, ids) of every document: its ids and `end_id`, cut at full sequences.

    Full sequences come first and have null `ids`; the rest of a document, shorter than `context`, has its ids as
    little-endian unsigned integers of 16 bits, or 32 where the vocabulary needs them, and a null ids_crc32. Null and empty
    texts are one rest of `end_id` alone.
    """
    tokenizer_path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")

    def cut(ids: pa.Array, texts: list[str], encoder: WordEncoder) -> Iterator[pa.RecordBatch]:
        flat, lengths = encoder.encode(texts)
        narrow = "<u2" if encoder.size <= 1 << 16 and end_id < 1 << 16 else "<u4"
        row, start, length, crc, total, values = [], [], [], [], [], []
        at = 0
        for k, n in enumerate(lengths.tolist()):
            own = np.full(n + 1, end_id, "<u4")
            own[:n] = flat[at : at + n]
            at += n
            for a in range(0, n + 1, context):
                part = own[a : a + context]
                row.append(k)
                start.append(a)
                length.append(len(part))
                crc.append(zlib.crc32(part.tobytes()) if len(part) == context else None)
                total.append(n + 1)
                values.append(part.astype(narrow).tobytes() if len(part) < context else None)
        columns = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(row, pa.int64())), *columns, pa.array(values, pa.binary())],
            ["id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or WordEncoder(tokenizer_path)
            texts, size, first = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= CHUNK_CHARS:
                    yield from cut(batch.column(0).slice(first, len(texts)), texts, encoder)
                    texts, size, first = [], 0, k + 1
            if texts:
                yield from cut(batch.column(0).slice(first, len(texts)), texts, encoder)

    fields = [T.StructField("id", docs.schema[id_col].dataType)]
    fields += [T.StructField(name, T.LongType()) for name in ("start", "length", "ids_crc32", "doc_tokens")]
    fields.append(T.StructField("ids", T.BinaryType()))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, T.StructType(fields))


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, group: int = GROUP,
    tokenizer_path: str | None = None, end_id: int = 1,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every document.

    Each id of a document, `end_id` at its end, lies in exactly one piece; a sequence holds `context` ids, or a power of two
    below. ids_crc32 is unsigned, over little-endian unsigned 32-bit ids. Null and empty texts are one piece of one id; rows
    with a null or repeated id are packed one by one like any other, and so are equal rows: rests are dealt round-robin in
    the order of a hash, so no key can gather them in one task, and a task that is run again packs alike. An empty table
    gives no rows. Other columns of `docs` are not looked at.
    """
    found = rests(docs, id_col, text_col, context, tokenizer_path, end_id)
    # the hash makes groups random, its order makes them the same in every run of a task
    dealt = found.hint("rebalance").withColumn("_hash", F.xxhash64("id", "start", "doc_tokens", "ids"))
    dealt = dealt.sortWithinPartitions("_hash", "id", "doc_tokens", "start", "ids_crc32", "ids")

    def pack(held: list[tuple[pa.Array, list]], first_sequence: int) -> Iterator[tuple[pa.RecordBatch, int]]:
        """Pieces of the group's rows, and the number of sequences made."""
        ids = pa.concat_arrays([x[0] for x in held])
        rows = [row for x in held for row in x[1]]
        out: list[tuple[int, int, int, int, int, int, int]] = []
        sequence = first_sequence
        open_rows = []
        for k, (start, length, crc, total, values) in enumerate(rows):
            if values is None:
                out.append((k, start, length, crc, total, sequence, 0))
                sequence += 1
            else:
                open_rows.append(k)
        open_rows.sort(key=lambda k: -rows[k][1])  # equal lengths stay in the order of their hash
        sizes = [rows[k][1] for k in open_rows]
        own: dict[int, np.ndarray] = {}
        for parts in without_padding(first_fit_decreasing(sizes, context), sizes, context):
            offset = 0
            for place, start, length in parts:
                k = open_rows[place]
                first, size, _, total, values = rows[k]
                if place not in own:
                    own[place] = np.frombuffer(values, "<u2" if len(values) == 2 * size else "<u4").astype("<u4")
                crc = zlib.crc32(own[place][start : start + length].tobytes())
                out.append((k, first + start, length, crc, total, sequence, offset))
                offset += length
            sequence += 1
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        batch = pa.RecordBatch.from_arrays(
            [ids.take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:])],
            ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )
        yield batch, sequence - first_sequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        held, count = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, group - count)
                rows = list(zip(*(part.column(c).to_pylist() for c in range(1, 6)), strict=True))
                held.append((part.column(0), rows))
                count += part.num_rows
                at += part.num_rows
                if count == group:
                    for packed, n in pack(held, sequence):
                        yield packed
                        sequence += n
                    held, count = [], 0
        if held:
            for packed, _ in pack(held, sequence):
                yield packed

    fields = [T.StructField("id", docs.schema[id_col].dataType)]
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([*fields, *(T.StructField(name, T.LongType()) for name in names)])
    return dealt.select("id", *names[:4], "ids").mapInArrow(run, schema).withColumnRenamed("id", id_col)
