"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has 64 bits in 8 bytes. Two fingerprints that differ in at most 4 bits differ in at most 4 bytes, so they
share at least 4 of the 8 positional bytes. Posting lists are keyed by the bytes at three positions; 20 triples are
chosen so that any 4 positions hold one of them, hence every linked pair meets in a list. Pairs that meet have their
shared positional bytes tallied; those below the guaranteed minimum go, the rest are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.llm.graph import components
from reviewlake.llm.scratch import save

BYTES = 8
SEED = 42
#: Fingerprints of one list that a task compares at once; longer lists are cut into parts, and each two parts are a task's work.
BLOCK = 2048


def position_triples() -> list[tuple[int, int, int]]:
    """20 triples of the 8 positions of which every 4 positions hold one.

    Positions lie in three groups; a triple is taken if it lies in one group, or has two in a group and one in the next.
    Four positions have either three in one group, or two in a group and one in the next, or two and two.
    """
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    taken = []
    for triple in combinations(range(BYTES), 3):
        n = [sum(group[p] == g for p in triple) for g in range(3)]
        if 3 in n or any(n[g] == 2 and n[(g + 1) % 3] == 1 for g in range(3)):
            taken.append(triple)
    return taken


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text: A-Z lower-cased, words split at ASCII white space, word shingles with
    repeats, XXH64 with seed 42; a bit is 1 if set in over half the hashes. A text without words has fingerprint 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        hashes = digest(joined, SEED)
    else:
        starts = [0, *ends]
        hashes = b"".join([digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=False)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, BYTES), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fingerprint) of every row; the fingerprint is the 64 bits as a signed long. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t or b"", shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            values = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["id", "fingerprint"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fingerprint", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def spanning_links(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links a[i]-b[i] between n places: each linked place and the smallest place of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def _compare(cell: np.ndarray, part: np.ndarray, own: np.ndarray, prints: np.ndarray, max_bits: int) -> pa.RecordBatch:
    """Links between equal cells of sorted rows, as a forest. own: the cell compares a part with itself."""
    n, step, left, a, b = len(cell), 1, np.arange(len(cell)), [], []
    while True:
        left = left[left + step < n]
        left = left[cell[left] == cell[left + step]]
        if not len(left):
            break
        differ = prints[left] ^ prints[left + step]
        shared = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        keep = (shared >= BYTES - max_bits) & (own[left] | (part[left] != part[left + step]))
        keep &= np.bitwise_count(differ) <= max_bits
        a.append(left[keep])
        b.append(left[keep] + step)
        step += 1
    child, root = spanning_links(n, np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int),) * 2
    return pa.RecordBatch.from_arrays(
        [pa.array(prints[child].view(np.int64)), pa.array(prints[root].view(np.int64))], ["a", "b"]
    )


def links(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints that differ in `max_bits` or fewer.

    prints: one column `fingerprint`, distinct. max_bits is 4 at most: beyond it four shared bytes aren't guaranteed.
    Each list gives a spanning forest of its links, so the output grows with the lists, not with their pairs.
    """
    if not 0 <= max_bits <= BYTES // 2:
        raise ValueError("max_bits must lie between 0 and 4")
    byte = lambda p: F.shiftrightunsigned("fingerprint", 8 * p).bitwiseAND(F.lit(255))
    keys = [
        F.lit(no << 24) + F.shiftleft(byte(x), 16) + F.shiftleft(byte(y), 8) + byte(z)
        for no, (x, y, z) in enumerate(position_triples())
    ]
    index = prints.select("fingerprint", F.explode(F.array(*keys)).alias("key"))
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = sizes.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    cells = (
        index.join(sizes, "key")
        .select("key", "fingerprint", "parts", part.alias("part"))
        .select("key", "fingerprint", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .select("key", "fingerprint", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            key, i, j = now[0], now[3], now[4]
            fresh = np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])] if len(key) else key
            if not len(key):
                continue
            end = np.flatnonzero(fresh)[-1]  # the last cell may go on
            rest = [x[end:] for x in now]
            if end:
                cell = np.cumsum(fresh[:end])
                yield _compare(cell, now[2][:end], (i == j)[:end], now[1][:end].view(np.uint64), max_bits)
        if rest is not None:
            yield _compare(np.zeros(len(rest[0])), rest[2], rest[3] == rest[4], rest[1].view(np.uint64), max_bits)

    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4
) -> DataFrame:
    """(id, fingerprint, component_id) of every row of `docs`, the id column under its own name.

    Texts are linked if their fingerprints differ in `max_bits` bits or fewer; component_id is the smallest id reachable.
    Null and wordless texts have fingerprint 0 and are linked like any other. Repeated rows give repeated results. Rows
    with a null id take part; a component that has no other id has a null component_id. Other columns are not looked at.
    """
    prints = save(fingerprints(docs, id_col, text_col, shingle))
    classes = save(prints.groupBy("fingerprint").agg(F.min("id").alias("first_id")))
    roots = components(links(classes.select("fingerprint"), max_bits))
    linked = save(classes.join(roots, classes["fingerprint"] == roots["node"]).select("fingerprint", "first_id", "root"))
    least = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = linked.join(least, "root").select("fingerprint", "least_id")
    named = classes.join(linked, "fingerprint", "left").select(
        "fingerprint", F.when(F.col("least_id").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("component_id")
    )
    return prints.join(named, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all their columns, that stand for their near-duplicate group: one row each.

    The row with the group's smallest id stays, of rows that share it the one with the smallest text hash; equal rows
    leave one. A null id counts as the smallest.
    """
    keys = [F.xxhash64(F.col(id_col)).alias("_id_hash"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text_hash")]
    named = docs.select(F.struct(F.col(id_col).alias("id"), keys[1]).alias("row"), F.col(text_col).alias("text"))
    found = near_duplicates(named, "row", "text")
    chosen = found.select(F.col("component_id")).distinct().select(
        F.xxhash64("component_id.id").alias("_id_hash"), F.col("component_id._text_hash").alias("_text_hash")
    )
    rows = docs.select(*docs.columns, *keys).join(chosen, ["_id_hash", "_text_hash"], "left_semi")
    return rows.dropDuplicates(["_id_hash", "_text_hash"]).select(*docs.columns)
