"""Improbable-feature digests: byte windows ranked by entropy-based rarity, chained Bloom filters, normalised bit overlap.

Every window of 16 bytes has an entropy; how rare that entropy is among all windows of the corpus ranks it. A window that
is the rarest of its neighbourhood often enough is a feature. Distinct features go into Bloom filters of 2,048 bits, 160 to
a filter, one filter after the other. Two digests are as like as their filters' bits overlap beyond chance.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of a window, neighbouring windows that compete, and how many of its neighbourhoods a feature must win.
WINDOW, NEIGHBOURS, WINS = 16, 32, 8
#: Texts of fewer bytes than the first have too few windows to choose from: all their windows of the second size are features.
SHORT, SHORT_WINDOW = 64, 4
#: Bits of a filter, bits that a feature sets, features of a filter.
BITS, PROBES, FEATURES = 2048, 5, 160
#: Windows of lower entropy than this, of 4 bits at most, are runs of a few bytes and no features unless a text has no others.
LEAST_ENTROPY = 1.0
CHUNK_BYTES = 1_000_000
#: Words of eight bytes that a comparison of two digests holds at a time.
PAIR_WORDS = 1 << 19
_UNIT = 64
#: c log2 c for c equal bytes of a window, in fixed point; a window's sum over its bytes is WINDOW * _UNIT * (4 - entropy).
_TERM = np.array([0, *(round(c * np.log2(c) * _UNIT) for c in range(1, WINDOW + 1))], np.int64)
_LOW = int(WINDOW * _UNIT * (np.log2(WINDOW) - LEAST_ENTROPY))


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with zeros between texts, start of each text, windows of each text)."""
    gap = bytes(NEIGHBOURS + WINDOW)
    data = np.frombuffer(gap.join(texts) + gap, np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return data, np.cumsum(size + len(gap)) - size - len(gap), np.where(size > 0, np.maximum(1, size - WINDOW + 1), 0)


def _sums(data: np.ndarray) -> np.ndarray:
    """Sum of c log2 c over the byte counts of the window at every place, by sliding."""
    n = len(data) - WINDOW + 1
    after, before = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        after[:-d] += same
        before[d:] += same
    leaves = -np.diff(_TERM, prepend=0)  # a byte that the window has c times goes
    comes = np.diff(_TERM)  # and one comes
    change = leaves[after[: n - 1] + 1] + comes[before[WINDOW:]]
    first = _TERM[np.bincount(data[:WINDOW], minlength=256)].sum()
    return np.cumsum(np.r_[first, change])


def _inside(starts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Places of all texts' windows."""
    ends = np.cumsum(windows)
    return np.repeat(starts - (ends - windows), windows) + np.arange(ends[-1] if len(ends) else 0)


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rank of each entropy value: 0 for the rarest among all windows of all whole texts. The table has some 4,000 entries."""
    entries = int(_TERM[-1]) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(entries, np.int64)
        for batch in batches:
            for texts in _byte_chunks(t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()):
                data, starts, windows = _laid_out(texts)
                total += np.bincount(_sums(data)[_inside(starts, windows)], minlength=entries)
        value = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(total[value])], ["value", "n"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))
    total = np.zeros(entries, np.int64)
    for r in counts.collect():
        total[r["value"]] = r["n"]
    rank = np.empty(entries, np.int64)
    rank[np.argsort(total, kind="stable")] = np.arange(entries)
    rank[_LOW:] += entries  # weak windows come after all others
    return rank


def _byte_chunks(texts) -> Iterator[list[bytes]]:
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= CHUNK_BYTES:
            yield run
            run, size = [], 0
    if run:
        yield run


def digests(texts: list[bytes], rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(filters as rows of 32 words, features of each) of every text; no filter for an empty text."""
    data, starts, windows = _laid_out(texts)
    place = _inside(starts, windows)
    key = np.full(len(data) + NEIGHBOURS, np.iinfo(np.int64).max)
    key[place] = (rank[_sums(data)[place]] << 40) | place  # the leftmost wins a tie
    width = 1
    while width < NEIGHBOURS:
        key[:-width] = np.minimum(key[:-width], key[width:])
        width *= 2
    wins = np.bincount(key[place] & ((1 << 40) - 1), minlength=len(data))[place]
    owner = np.repeat(np.arange(len(texts)), windows)
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, owner, wins)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    chosen = (wins >= np.minimum(WINS, most[owner])) & (size[owner] >= SHORT)
    at, owner = place[chosen], owner[chosen]
    small = np.where((size > 0) & (size < SHORT), np.maximum(1, size - SHORT_WINDOW + 1), 0)
    at, owner = np.r_[at, _inside(starts, small)], np.r_[owner, np.repeat(np.arange(len(texts)), small)]
    order = np.lexsort((at, owner))
    at, owner = at[order], owner[order]
    held = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at].copy()
    held[size[owner] < SHORT, SHORT_WINDOW:] = 0
    words = held.view("<u8")
    value = words[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ words[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        value = (value ^ (value >> np.uint64(shift))) * np.uint64(factor)
    value ^= value >> np.uint64(31)
    order = np.lexsort((at, value, owner))
    fresh = np.r_[True, (owner[order][1:] != owner[order][:-1]) | (value[order][1:] != value[order][:-1])] if len(at) else order
    kept = np.sort(order[fresh.astype(bool)]) if len(at) else order  # first of equal features, in text order
    owner, value = owner[kept], value[kept]
    count = np.bincount(owner, minlength=len(texts))
    filters = -(-count // FEATURES)
    first = np.cumsum(filters) - filters
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    home = first[owner] + nth // FEATURES
    bits = np.zeros((int(filters.sum()), BITS), bool)
    for probe in range(PROBES):
        bits[home, (value >> np.uint64(11 * probe)) % np.uint64(BITS)] = True
    packed = np.packbits(bits, axis=1).view(np.uint64)
    held = np.bincount(home, minlength=len(packed))
    return [(packed[a : a + n], held[a : a + n]) for a, n in zip(first.tolist(), filters.tolist(), strict=True)]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1: each filter of the digest with fewer features takes its best match in the other; the mean goes by features.

    A match is the share of common bits beyond chance among those possible, 0 if chance alone explains it. Two empty
    digests are alike, an empty one is like no other.
    """
    if not len(a[1]) or not len(b[1]):
        return float(len(a[1]) == len(b[1]))
    if a[1].sum() > b[1].sum():
        a, b = b, a
    y = np.bitwise_count(b[0]).sum(axis=1, dtype=np.int64)[None, :]
    best, step = np.zeros(len(a[0])), max(1, PAIR_WORDS // b[0].size)
    for at in range(0, len(best), step):  # some filters against all of the other digest at a time
        one = a[0][at : at + step, None, :]
        common = np.bitwise_count(one & b[0][None, :, :]).sum(axis=2, dtype=np.int64)
        x = np.bitwise_count(one).sum(axis=2, dtype=np.int64)
        chance = x * y / BITS
        spread = np.sqrt(chance * (1 - np.maximum(x, y) / BITS))
        least = np.minimum(x, y)
        score = np.where((common - chance > 2 * spread) | (common == np.maximum(x, y)), (common - chance) / (least - chance), 0.0)
        best[at : at + step] = score.max(axis=1)
    return float(min(1.0, (best * a[1]).sum() / a[1].sum()))


def encoded(digest: tuple[np.ndarray, np.ndarray]) -> str:
    """A digest as text: for each filter its features and its bits in base64."""
    return ";".join(f"{n}:{base64.b64encode(f.tobytes()).decode()}" for f, n in zip(*digest, strict=True))


def decoded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The digest that `encoded` wrote."""
    parts = [p.split(":") for p in text.split(";") if p]
    bits = [np.frombuffer(base64.b64decode(bits), np.uint64) for _, bits in parts]
    return np.array(bits, np.uint64).reshape(len(parts), BITS // 64), np.array([int(n) for n, _ in parts], np.int64)


def fingerprints(docs: DataFrame, rank: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row by a table of `rarity`. Null counts as empty; equal texts have equal fingerprints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for texts in _byte_chunks(t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()):
                found += map(encoded, digests(texts, rank))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["id", "fingerprint"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fingerprint", T.StringType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges_per_task: int = 4) -> DataFrame:
    """(range, guest, id, text) so that each row is followed by its next document within its range, by ascending id.

    Ranges of ids are cut at sampled ids. The first row of a range is also a guest at the end of the range before, that of
    the table at the end of the last one. So one shuffle of the texts is enough, and a task reads its ranges as a stream.
    Rows that share an id follow each other by text hash; null ids come last.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.select("id").where("id is not null")
    wanted = ranges_per_task * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, least = ids.agg(F.count(F.lit(1)), F.min("id")).first()
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 53)) / float(1 << 53)
    drawn = sorted(r[0] for r in ids.where(share < min(1.0, 16 * wanted / max(1, n))).distinct().collect())
    edges = sorted({drawn[len(drawn) * k // wanted] for k in range(1, wanted)} - {least}) if drawn else []
    head = {edge: k + 1 for k, edge in enumerate(edges)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, range_, guest = [], [], []
            for k, own in enumerate(batch.column(0).to_pylist()):
                place = bisect_right(edges, own) if own is not None else len(edges)
                homes = [(place, 0)]
                if own is not None and own in head:
                    homes.append((place - 1, 1))
                if own is not None and own == least:
                    homes.append((len(edges), 2))
                for home, kind in homes:
                    at.append(k)
                    range_.append(home)
                    guest.append(kind)
            chosen = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(range_, pa.int32()), pa.array(guest, pa.int32())], ["id", "text", "range", "guest"])

    schema = T.StructType([*rows.schema.fields, T.StructField("range", T.IntegerType()), T.StructField("guest", T.IntegerType())])
    dealt = rows.mapInArrow(run, schema).repartition("range")
    return dealt.sortWithinPartitions("range", "guest", F.col("id").asc_nulls_last(), F.xxhash64("text"))


def edited_fingerprints(docs: DataFrame, rank: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last quarter of code points, rounded down, replaced by the first as many (or all) of the next
    document's; after the last comes the first, and a document alone is its own next. Null counts as empty.
    """
    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str]]:
        """(id, text, next text)"""
        open_row = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "range", "guest")), strict=True):
                if open_row is not None:
                    yield open_row[0], open_row[1], row[1] if row[2] == open_row[2] else open_row[1]
                open_row = row if row[3] == 0 else None
        if open_row is not None:
            yield open_row[0], open_row[1], open_row[1]

    def finished(rows: list[tuple[object, str, str]], kind: pa.DataType) -> pa.RecordBatch:
        texts = [text for _, text, _ in rows]
        edited = []
        for _, text, after in rows:
            cut = len(text) // 4
            edited.append(text[: len(text) - cut] + after[:cut])
        plain = [t.encode() for t in (*texts, rows[-1][2])]
        changed = [t.encode() for t in edited]
        found = digests(plain + changed, rank)
        own, other = found[: len(plain)], found[len(plain) :]
        following = [own[k + 1] if rows[k][2] == (*texts, rows[-1][2])[k + 1] else digests([rows[k][2].encode()], rank)[0] for k in range(len(rows))]
        columns = [
            pa.array([i for i, *_ in rows], kind), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in changed]), pa.array([encoded(d) for d in own[: len(rows)]]),
            pa.array([encoded(d) for d in other]), pa.array([likeness(a, b) for a, b in zip(own, other, strict=False)]),
            pa.array([likeness(a, b) for a, b in zip(own, following, strict=False)]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kind = [], 0, arrow_type
        for row in followed(batches):
            held.append(row)
            size += len(row[1])
            if size >= CHUNK_BYTES:
                yield finished(held, kind)
                held, size = [], 0
        if held:
            yield finished(held, kind)

    arrow_type = to_arrow_type(docs.schema[id_col].dataType)
    names = ["edited_sha256", "fingerprint", "edited_fingerprint"]
    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_chars", T.LongType())]
    fields += [T.StructField(name, T.StringType()) for name in names]
    fields += [T.StructField(name, T.DoubleType()) for name in ("near_edited", "near_next")]
    return pairs(docs, id_col, text_col).mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id_col)
