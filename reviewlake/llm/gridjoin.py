"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are projected on leading principal dimensions, where distances only shrink, and sorted by their grid cells of
width epsilon, the distance that belongs to the cosine. The sequence is cut into intervals; two intervals whose boxes lie
further apart than epsilon hold no link and never meet. Those that meet are joined recursively: both are halved, halves
provably apart are skipped, and small ones are compared by exact cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.llm.graph import components
from reviewlake.llm.scratch import save
from reviewlake.llm.simhash import spanning_links

#: Principal dimensions of the grid; vectors sampled to find them; vectors of an interval and of a leaf of the recursion.
DIMENSIONS, SAMPLE = 6, 4096
INTERVAL, LEAF = 512, 64
#: Room for rounding in the bound on distances.
SLACK = 1e-6


def _valid(embedding: str) -> F.Column:
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _unit(vec: np.ndarray) -> np.ndarray:
    """Vectors of length one. Scaled by their largest component first, so that no square overflows or vanishes."""
    vec = vec / np.abs(vec).max(axis=1, keepdims=True)
    return vec / np.linalg.norm(vec, axis=1, keepdims=True)


def principal_directions(classes: DataFrame, epsilon: float) -> np.ndarray:
    """Columns are leading directions of a bounded sample of unit vectors of the commonest length.

    Any orthonormal directions give right results; the sample only decides how much the grid skips.
    """
    sizes = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return np.eye(1)
    dim, n = sizes
    share = F.pmod(F.xxhash64("vec"), F.lit(1 << 53)) / float(1 << 53)
    rows = classes.where((F.col("dim") == dim) & (share < min(1.0, SAMPLE / n))).orderBy("rep").limit(2 * SAMPLE).collect()
    if not rows:
        return np.eye(dim)[:, :DIMENSIONS]
    x = _unit(np.array([r["vec"] for r in rows], float))
    return np.linalg.svd(x, full_matrices=True)[2][:DIMENSIONS].T


def _project(vec: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Leading coordinates of unit vectors; those of another length than the directions give their first components."""
    unit = _unit(vec)
    if unit.shape[1] == len(directions):
        low = unit @ directions
    else:
        low = unit[:, : directions.shape[1]]
    return np.pad(low, ((0, 0), (0, directions.shape[1] - low.shape[1])))


def _apart(a: np.ndarray, b: np.ndarray) -> float:
    """Distance of the boxes around two sets of points."""
    gap = np.maximum(0, np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)))
    return float(np.sqrt(gap @ gap))


def interval_links(low: np.ndarray, unit: np.ndarray, rows: slice, columns: slice, epsilon: float, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Linked (row, column) places of two sequence intervals, by recursion."""
    if _apart(low[rows], low[columns]) > epsilon + SLACK:
        return []
    sizes = rows.stop - rows.start, columns.stop - columns.start
    if max(sizes) <= LEAF:
        a, b = np.nonzero(unit[rows] @ unit[columns].T >= least)
        return [(a + rows.start, b + columns.start)]
    halve = lambda s: [slice(s.start, (s.start + s.stop) // 2), slice((s.start + s.stop) // 2, s.stop)] if s.stop - s.start > LEAF else [s]
    return [found for r in halve(rows) for c in halve(columns) for found in interval_links(low, unit, r, c, epsilon, least)]


def _meet(side: np.ndarray, node: list, copies: np.ndarray, low: np.ndarray, vec: np.ndarray, epsilon: float, least: float) -> list[tuple]:
    """Of two intervals (or one with itself, if all sides are 0): (node, vectors linked, root or None) for linked ones."""
    unit = _unit(vec)
    middle, n = int((side == 0).sum()), len(side)
    own = middle == n
    found = interval_links(low, unit, slice(0, middle), slice(0, n) if own else slice(middle, n), epsilon, least)
    a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, int)
    b = np.concatenate([x for _, x in found]) if found else np.zeros(0, int)
    if own:
        a, b = a[a < b], b[a < b]
    if not len(a):
        return []
    count = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
    child, root = spanning_links(n, a, b)
    above = dict(zip(child.tolist(), root.tolist(), strict=True))
    return [(node[k], int(count[k]), node[above[k]] if k in above else None) for k in np.flatnonzero(count).tolist()]


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", embedding_col: str = "embedding", label_col: str = "label", least_cosine: float = 0.98
) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector.

    Vectors of one label and one length are linked if their cosine in double precision is at least `least_cosine`. Null and
    zero vectors, vectors with null or non-finite components and those with a null label link with nothing. n_links counts
    the other vectors linked directly, copies included; component_id is the smallest id reachable; kept if it's the own id.
    Equal vectors are one class with a count, so copies are never paired. Rows may repeat, and an id may stand for different
    vectors: each has its own links. Rows with a null id are linked and counted like others; they take the smallest id they
    reach, null if there is none, and are never kept.
    """
    epsilon = float(np.sqrt(2 - 2 * least_cosine))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(embedding_col).alias("vec"), F.col(label_col).alias("label"))
    good = _valid("vec") & F.col("label").isNotNull()
    classes = rows.where(good).groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    by_rep = [F.col("rep").asc_nulls_last(), F.xxhash64("vec")]
    ordered = classes.repartitionByRange(*by_rep).sortWithinPartitions(*by_rep)  # so nodes are ordered as smallest ids are
    classes = save(ordered.select("label", "vec", "rep", "copies", F.size("vec").alias("dim"), F.monotonically_increasing_id().alias("node")))
    directions = principal_directions(classes, epsilon)
    k, id_type = directions.shape[1], vectors.schema[id_col].dataType

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = np.zeros((batch.num_rows, k))
            for n in set(dims := batch.column(4).to_pylist()):
                own = np.flatnonzero(np.array(dims) == n)
                vec = np.array(batch.column(1).take(pa.array(own)).to_pylist(), float)
                low[own] = _project(vec, directions)
            cells = np.floor(low / epsilon).astype(int) + (1 << 15)
            key = ["".join(f"{c:05x}" for c in r) for r in cells.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(low), pa.list_(pa.float64())), pa.array(key, pa.string())], [*batch.schema.names, "low", "key"])

    schema = T.StructType([*classes.schema.fields, T.StructField("low", T.ArrayType(T.DoubleType())), T.StructField("key", T.StringType())])
    ordered = classes.mapInArrow(located, schema).repartitionByRange("label", "dim", "key", "node")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, filled = None, TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            out = []
            for group in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if group != now or filled == INTERVAL:
                    now, number, filled = group, number + 1, 0
                filled += 1
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "interval"])

    sequence = save(
        ordered.sortWithinPartitions("label", "dim", "key", "node")
        .mapInArrow(numbered, T.StructType([*schema.fields, T.StructField("interval", T.LongType())])).drop("key")
    )
    box = [f(F.col("low")[i]).alias(f"{name}{i}") for i in range(k) for name, f in (("from", F.min), ("to", F.max))]
    boxes = save(sequence.groupBy("interval", "label", "dim").agg(*box))
    cell = lambda c, more: (F.floor(F.col(c) / epsilon) + more).cast("int")
    left = boxes.withColumn("cell", F.explode(F.sequence(cell("from0", 0), cell("to0", 0)))).alias("x")
    right = boxes.withColumn("cell", F.explode(F.sequence(cell("from0", -1), cell("to0", 1)))).alias("y")
    gaps = [F.greatest(F.lit(0.0), F.col(f"x.from{i}") - F.col(f"y.to{i}"), F.col(f"y.from{i}") - F.col(f"x.to{i}")) for i in range(k)]
    near = sum((g * g for g in gaps), F.lit(0.0)) <= (epsilon + SLACK) ** 2
    pairs = left.join(right, ["label", "dim", "cell"]).where(near)
    pairs = pairs.select(F.least("x.interval", "y.interval").alias("i"), F.greatest("x.interval", "y.interval").alias("j")).distinct()
    dealt = pairs.select(F.col("i").alias("interval"), "i", "j").unionByName(pairs.where("i != j").select(F.col("j").alias("interval"), "i", "j"))
    meetings = sequence.join(dealt, "interval").select("i", "j", (F.col("interval") != F.col("i")).cast("int").alias("side"), "node", "rep", "copies", "low", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(rows: list[tuple]) -> pa.RecordBatch:
            _, _, side, node, rep, copies, low, vec = zip(*rows, strict=True)
            found = _meet(np.array(side), list(zip(node, rep, strict=True)), np.array(copies), np.array(low), np.array(vec, float), epsilon, least_cosine)
            kind, whole = batch.schema.field("rep").type, pa.int64()
            columns = [[a[0] for a, _, _ in found], [a[1] for a, _, _ in found], [n for _, n, _ in found]]
            columns += [[b and b[k] for _, _, b in found] for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (whole, kind, whole, whole, kind), strict=True)], out.names)

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:2] != held[0][:2]:
                    yield work(held)
                    held = []
                held.append(row)
        if held:
            yield work(held)

    out = T.StructType([
        T.StructField("node", T.LongType()), T.StructField("rep", id_type), T.StructField("n", T.LongType()),
        T.StructField("root", T.LongType()), T.StructField("root_rep", id_type),
    ])
    linked = save(meetings.repartition("i", "j").sortWithinPartitions("i", "j", "side").mapInArrow(run, out))
    counts = linked.groupBy("node").agg(F.sum("n").alias("n"))
    edges = linked.where("root is not null").select(
        F.struct("node", "rep").alias("a"), F.struct(F.col("root").alias("node"), F.col("root_rep").alias("rep")).alias("b")
    )
    roots = components(edges).select(F.col("node.node").alias("node"), F.col("root.rep").alias("root"))
    known = classes.join(counts, "node", "left").join(roots, "node", "left").select(
        F.col("label").alias("l"), F.col("vec").alias("v"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "rep").alias("component"),
    )
    found = rows.join(known, good & (F.col("label") == F.col("l")) & (F.col("vec") == F.col("v")), "left")
    component = F.coalesce("component", "id")
    return found.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
