import math

import numpy as np

from reviewlake.llm import graph, gridjoin


def brute(rows, least=0.98):
    good = []
    for k, (_, vec, label) in enumerate(rows):
        fine = vec is not None and label is not None and all(x is not None and math.isfinite(x) for x in vec) and any(vec or [])
        good.append(fine)
    unit = [np.array(v, float) / np.linalg.norm(v) if g else None for (_, v, _), g in zip(rows, good, strict=True)]
    links = {k: {j for j in range(len(rows)) if j != k and good[k] and good[j] and rows[k][2] == rows[j][2] and len(unit[k]) == len(unit[j]) and unit[k] @ unit[j] >= least} for k in range(len(rows))}
    component = {k: rows[k][0] for k in links}
    while True:
        new = {k: min([component[k], *(component[j] for j in links[k])]) for k in links}
        if new == component:
            return {rows[k][0]: (len(links[k]), component[k], component[k] == rows[k][0]) for k in links}
        component = new


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(gridjoin, "INTERVAL", 24)
    monkeypatch.setattr(gridjoin, "LEAF", 4)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    vectors = [(centres[k % 12] + rng.normal(scale=0.12, size=16)).astype(np.float32).tolist() for k in range(300)]
    vectors += [vectors[0]] * 30 + [[2 * x for x in vectors[0]]] + [vectors[5][:8], [1.0], [1.0], [-1.0], [0.0] * 16, [], None, [None] * 16, [math.nan] * 16, [math.inf] * 16]
    rows = [(k, v, None if k % 41 == 40 else k % 3) for k, v in enumerate(vectors)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, rep string").repartition(4)
    found = gridjoin.near_vectors(table).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found} == brute(rows)


def test_recursion_skips_and_finds_all():
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(400, 5))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    low = unit[:, :3]
    order = np.lexsort(np.floor(low / 0.2).T[::-1])
    unit, low = unit[order], low[order]
    found = gridjoin.interval_links(low, unit, slice(0, 400), slice(0, 400), 0.2, 0.98)
    got = {(int(a), int(b)) for x, y in found for a, b in zip(x, y, strict=True)}
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(unit @ unit.T >= 0.98)), strict=True))


def test_no_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert gridjoin.near_vectors(empty).collect() == []


def test_components_of_long_paths_and_loops(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, 5), (None, 3), (7, 2), (2, 9), (7, 2)]
    found = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in found} == {**{k: 100 for k in range(100, 161)}, 2: 2, 7: 2, 9: 2}
    assert len(found) == 64


def test_null_and_repeated_ids_and_extreme_sizes(spark):
    a, b, c = [1.0, 0.0, 0.01], [0.0, 1.0, 0.0], [1.0, 0.05, 0.0]
    times = lambda v, x: [e * x for e in v]
    rows = [(None, a), (5, c), (3, times(a, 2)), (3, b), (8, times(b, 3)), (9, times(b, 1e200)), (10, times(b, 1e-200)), (None, [0.0, 0.0, 1.0]), (None, None), (4, [0.0, -1.0, 0.0]), (5, c)]
    table = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], "vec_id long, embedding array<double>, label int, node string").repartition(3)
    found = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in gridjoin.near_vectors(table).collect()), key=repr)
    want = [(None, 3, 3, False), (5, 3, 3, False), (5, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (8, 3, 3, False), (9, 3, 3, False), (10, 3, 3, False), (None, 0, None, False), (None, 0, None, False), (4, 0, 4, True)]
    assert found == sorted(want, key=repr)
