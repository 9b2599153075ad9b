"""Embedding near-duplicates and their graphs against brute force."""

import math

import numpy as np
import pytest

from pagemill.llm import vector_links
from pagemill.llm.hnsw import Graph

VECTORS = "vec_id long, embedding array<double>, label int"


def near(rng, base, n, noise):
    x = base + rng.normal(size=(n, len(base))) * noise / math.sqrt(len(base))
    return x * rng.uniform(0.1, 10, (n, 1))


def plain(rows):
    """(links, component) of each row, by comparing all."""
    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    scaled = [np.array(v) / max(map(abs, v)) if usable(v, label) else None for _, v, label in rows]
    units = [None if v is None else v / np.linalg.norm(v) for v in scaled]
    n, parent = len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            a, b = units[i], units[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= 0.93:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    low = {}
    for i, (ident, *_) in enumerate(rows):
        if ident is not None:
            low[root(i)] = min(ident, low.get(root(i), ident))
    return [(rows[i][0], links[i], low.get(root(i))) for i in range(n)]


def key(x):
    return tuple((v is not None, v) for v in x)


def sample(rng):
    rows = [rng.normal(size=16) for _ in range(300)]
    rows += list(near(rng, rng.normal(size=16), 60, 0.5))  # a crowd
    rows += list(near(rng, rng.normal(size=16), 50, 1.1))  # a loose crowd, some of it unlinked
    turn = np.linspace(0, 3, 40)
    rows += [np.concatenate([[math.cos(t), math.sin(t)], np.zeros(14)]) for t in turn]  # a chain
    rows += [rows[3], rows[3], -rows[3], rows[4] * 7]
    rows = [(i, x.tolist(), i % 97 % 2) for i, x in enumerate(rows)]
    rows += [(3, rows[3][1], 1), (None, rows[3][1], 1), (None, [9.0] * 16, 5), (None, [9.0] * 16, 5), (900, [1e300] * 16, 0), (901, [1e-300] * 16, 0), (902, [1.0] * 16, 0)]
    bad = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0] * 15, [1.0] * 15]
    rows += [(910 + i, x, 0) for i, x in enumerate(bad)] + [(930 + i, [1.0] * 16, None) for i in range(2)]
    return rows


@pytest.mark.parametrize("numbers", [1 << 20, 16 * 40])
def test_links_against_plain(spark, numbers):
    rows = sample(np.random.default_rng(1))
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "vec_id as node", "1 as h1", "label as n", "2 as component_id").repartition(5)
    found = vector_links.near_duplicate_vectors(frame, numbers=numbers).collect()
    assert sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in found], key=key) == sorted(plain(rows), key=key)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def test_links_of_nothing(spark):
    assert vector_links.near_duplicate_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    lone = vector_links.near_duplicate_vectors(spark.createDataFrame([(1, None, 0), (None, [0.0], 0)], VECTORS)).collect()
    assert sorted([tuple(r) for r in lone], key=key) == sorted([(1, 0, 1, True), (None, 0, None, True)], key=key)


def test_graph_recall():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph(len(x), 32)
    graph.add(x)
    assert all((links < graph.n).all() and (links >= -1).all() for links in graph.links)
    similar = x @ x.T
    np.fill_diagonal(similar, -3)
    nearest = similar.argmax(axis=1)
    found = {width: (graph.search(x, width)[0] == nearest[:, None]).any(axis=1).mean() for width in (32, 128)}
    assert found[32] > 0.75 and found[128] > 0.95
    nodes, near_ = graph.search(x[:50], 64)
    assert (nodes[:, 0] == np.arange(50)).all() and (np.diff(near_, axis=1) <= 0).all()
    assert all(len(set(row[row >= 0])) == (row >= 0).sum() for row in nodes)


def test_beams_widen_until_the_audit_passes():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24))
    x[700:] = x[:800] + rng.normal(size=(800, 24)) * 0.15  # pairs
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sides = []
    for part in (x[:700], x[700:]):
        graph, members, centres, radii = vector_links.grouped(part, 0.93)
        side = vector_links.Shard.__new__(vector_links.Shard)
        side.weights, side.vectors, side.centres, side.radii, side.graph = np.ones(len(part), np.int64), part, centres, radii, Graph.of(graph.state())
        side.first, side.members = np.concatenate([[0], np.cumsum([len(m) for m in members])]), np.concatenate(members)
        side.node_weights = np.diff(side.first)
        sides.append(side)
    exact = x[:700] @ x[700:].T >= 0.93
    counts, roots = vector_links.meet(*sides, beam=2)  # hopelessly narrow at first
    assert counts.sum() >= 0.98 * 2 * exact.sum() and exact.sum() > 500
    assert (counts[:700] <= exact.sum(axis=1)).all() and (counts[700:] <= exact.sum(axis=0)).all()
    assert (roots[counts == 0] == np.flatnonzero(counts == 0)).all()


def test_a_crowd_is_few_nodes():
    rng = np.random.default_rng(4)
    crowd = near(rng, rng.normal(size=64), 3000, 0.1)
    crowd /= np.linalg.norm(crowd, axis=1, keepdims=True)
    graph, members, _, radii = vector_links.grouped(crowd, 0.93)
    assert graph.n < 10 and sum(map(len, members)) == 3000 and radii.max() <= math.acos(0.93) / 2


def test_ids_sort_as_nodes(spark):
    ids = [None, -(1 << 63), -5, 0, 7, (1 << 63) - 1]
    rows = spark.createDataFrame([(i, [float(k + 1)], 0) for k, i in enumerate(ids)], VECTORS)
    nodes = vector_links.classes(vector_links.linkable(rows)).select("node", vector_links.smallest_id(vector_links.F.col("node")).alias("id")).orderBy("node").collect()
    assert [r["id"] for r in nodes] == [*ids[1:], None]
