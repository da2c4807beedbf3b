"""Bounded-space best-fit packing of tokenised documents into sequences of fixed length.

Pieces are dealt into blocks by hash, about 4,096 each, and a block's pieces come to the packer longest first. It keeps a
fixed number of open bins in a bitset keyed by free space: the lowest set bit at or above a piece's length is the bin that
it fits best. When a new bin is needed and all are open, the fullest closes. A block ends with one poorly filled bin at
most, so packing by blocks costs no more than a bin in some thousand pieces, and no task holds more than the open bins.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.llm.scratch import save
from reviewlake.llm.tokens import Encoder

CONTEXT = 2048
BLOCK_PIECES = 4096
OPEN_BINS = 2048
#: Characters that a task encodes at once.
CHUNK_CHARS = 2_000_000


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, with_ids: bool = False,
    tokenizer_path: str | None = None, ranks_path: str | None = None,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document: its ids, then id 0, cut only if longer than `context`.

    A longer document is cut into pieces of `context` ids; the first piece takes what is over and may be shorter. Null and
    empty texts are one piece of one id. ids_crc32 is over little-endian unsigned 32-bit ids.
    """
    tokenizer_path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def cut(ids: pa.Array, texts: list[str], encoder: Encoder) -> pa.RecordBatch:
        flat, lengths = encoder.encode(texts)
        row, piece, start, length, crc, values = [], [], [], [], [], []
        at = 0
        for k, n in enumerate(lengths.tolist()):
            own = np.zeros(n + 1, "<u4")
            own[:n] = flat[at : at + n]
            at += n
            edges = list(range((n + 1) % context or context, n + 2, context)) if n + 1 > context else [n + 1]
            for no, (a, b) in enumerate(zip([0, *edges], edges, strict=False)):
                row.append(k)
                piece.append(no)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(own[a:b].tobytes()))
                if with_ids:
                    values.append(own[a:b].astype(np.int32))
        columns = [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
        names = ["id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.array(values, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(tokenizer_path, ranks_path)
            texts, size, first = [], 0, 0
            for k, text in enumerate(batch.column(1).to_pylist()):
                texts.append(text or "")
                size += len(texts[-1])
                if size >= CHUNK_CHARS:
                    yield cut(batch.column(0).slice(first, len(texts)), texts, encoder)
                    texts, size, first = [], 0, k + 1
            if texts:
                yield cut(batch.column(0).slice(first, len(texts)), texts, encoder)

    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(name, T.LongType()) for name in ("start", "length", "ids_crc32")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, T.StructType(fields))
    return found.withColumnRenamed("id", id_col)


class OpenBins:
    """Open bins of one block, keyed by free space."""

    def __init__(self, context: int, limit: int) -> None:
        self.context, self.limit = context, limit
        self.bits, self.open, self.made = 0, 0, 0
        self.bins: dict[int, list[int]] = defaultdict(list)

    def _take(self, free: int) -> int:
        found = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            chosen = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, chosen = self.context, self.made
            self.made += 1
        if rest := free - length:
            self.bins[rest].append(chosen)
            self.bits |= 1 << rest
            self.open += 1
        return chosen, self.context - free


def pack(
    found: DataFrame, length_col: str = "length", context: int = CONTEXT, open_bins: int = OPEN_BINS, block: int = BLOCK_PIECES
) -> DataFrame:
    """`found`, all its columns, with sequence_id and offset: places in sequences of at most `context`, gapless from 0.

    `found` is read twice: give a saved table. Lengths lie between 1 and `context`. Equal rows are placed one by one.
    """
    blocks = max(1, -(-found.count() // block))
    names = found.columns
    dealt = found.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("_length", F.col(f"c{names.index(length_col)}"))
    mixed = F.xxhash64(*(f"c{i}" for i in range(len(names))))
    dealt = dealt.withColumns({"_hash": mixed, "_block": F.pmod(mixed, F.lit(blocks))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins = None, None
        for batch in batches:
            n = batch.num_columns
            sequence, offset = [], []
            for length, of in zip(batch.column(n - 3).to_pylist(), batch.column(n - 1).to_pylist(), strict=True):
                if of != now:
                    now, bins = of, OpenBins(context, open_bins)
                chosen, at = bins.place(length)
                sequence.append((of << 24) + chosen)
                offset.append(at)
            columns = [*batch.columns[: n - 3], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[: n - 3], "sequence_id", "offset"])

    dealt = dealt.repartition("_block").sortWithinPartitions("_block", F.desc("_length"), "_hash")
    fields = [*dealt.schema.fields[: len(names)], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return dealt.mapInArrow(run, T.StructType(fields)).toDF(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, **options) -> DataFrame:
    """Pieces of all documents with their places. Options are those of `pieces`."""
    return pack(save(pieces(docs, id_col, text_col, context, **options)), context=context)
