"""Embedding near-duplicates: graphs of each shard, searched by every shard.

1. Rows of equal label and vector are one class, counted by a hash of 128 bits.  The classes of a label
   are dealt into shards of bounded size by that hash, so a hot label is many shards.
2. A shard is one task's work: a vector within the linking angle of a *centre* joins it, any other becomes
   a centre, found by a navigable small-world graph of centres (``hnsw``).  A centre then moves to the mean
   of its members; those further than half the linking angle from it leave and become centres themselves.
   A crowd of near copies is thus a few nodes of the graph, and its members' links among themselves are
   certain without comparing any two of them.
3. Shards of a label meet in pairs, each with itself too: the nodes of one search the graph of the other.
   A beam is widened until its last node is too far to be linked; all beams start wider until an audit, the
   exact scan for a spread sample of nodes, finds AUDIT_LINKS of the links and AUDIT_NEAREST of the nearest
   nodes.
4. By the triangle inequality two nodes' members are all linked, or none is, or they are compared one by
   one: cosines in double precision, in blocks of matrices.  A meeting gives out, for each class, how many
   vectors it has found linked and one node it is connected with: no pairs leave a task.
5. Counts are summed, and connected components are taken over what was given out.

Defined results: vectors that are null, empty or zero, or hold null, NaN or infinite components, and rows
without a label, link with nothing; so do vectors of different lengths.  Repeated rows, equal ids included,
are vectors of their own and are linked with each other.  A null vec_id is never a component's id while
another id is there; a component of null ids only has null, and its rows are kept.  Ties need no order.  An
empty table gives no rows.  Other columns are not read.

Every shard meets every other of its label, so a label's work grows with the square of its number of shards,
and with the logarithm of their size.  A meeting holds two shards; a shard has about SHARD_NUMBERS numbers.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import stored, table
from pagemill.llm.components import connected_components
from pagemill.llm.hnsw import Graph

COSINE = 0.93
#: Numbers of all vectors of a shard; a label of LEAST_SHARED classes or more has two shards at least.
SHARD_NUMBERS, LEAST_SHARED = 1 << 20, 256
#: Beams at first, nodes of an audit, and the shares of links and of nearest nodes that it must find.
BEAM, AUDITED, AUDIT_LINKS, AUDIT_NEAREST = 32, 512, 0.99, 0.9
#: Rows of a block of comparisons.
COMPARED = 1024
#: Angles closer than this to a bound are settled by comparing.
MARGIN = 1e-6
KEY_BYTES = 25


# --- classes


def _signed(number: Column) -> Column:
    """16 hexadecimal digits that sort as the number does."""
    return F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def _hashes() -> dict[str, Column]:
    whole = F.struct("label", "embedding")
    return {"h1": F.xxhash64(F.lit(1), whole), "h2": F.xxhash64(F.lit("second"), whole)}


def linkable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, embedding as doubles, h1, h2); the hashes are null for what links with nothing."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    able = F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.withColumns({name: F.when(able, h) for name, h in _hashes().items()})


def classes(rows: DataFrame) -> DataFrame:
    """(node, h1, h2, label, dims, weight, embedding) of linkable rows.  Nodes are bytes that sort by smallest id, nulls last."""
    whole = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    node = F.concat(F.when(F.col("low").isNull(), "01").otherwise("00"), _signed(F.coalesce("low", F.lit(0).cast("long"))), _signed(F.col("h1")), _signed(F.col("h2")))
    return whole.select(F.unhex(node).alias("node"), "h1", "h2", "label", F.size("embedding").alias("dims"), "weight", "embedding")


def smallest_id(node: Column) -> Column:
    """The id that a node begins with."""
    digits = F.hex(node)
    number = F.conv(F.substring(digits, 3, 16), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(F.substring(digits, 1, 2) == "00", number)


# --- shards


def _units(embeddings: pa.ChunkedArray, dims: int) -> np.ndarray:
    raw = embeddings.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def grouped(vectors: np.ndarray, cosine: float) -> tuple[Graph, list[np.ndarray], np.ndarray, np.ndarray]:
    """(graph of centres, members of each, centres, radii): every vector is a member of one centre."""
    graph, centre_of, leaders = Graph(2 * len(vectors), vectors.shape[1]), np.zeros(len(vectors), np.int64), []
    step = 128
    for at in range(0, len(vectors), step):
        part = vectors[at : at + step].astype(np.float32)
        chosen = np.full(len(part), -1)
        if graph.n:
            nodes, near = graph.search(part, 8)
            chosen = np.where(near[:, 0] >= cosine, nodes[:, 0], -1)
        left = np.flatnonzero(chosen < 0)
        close = part[left] @ part[left].T >= cosine
        fresh = []
        for i, row in zip(left, close, strict=True):
            if chosen[i] < 0:
                chosen[left[row & (chosen[left] < 0)]] = graph.n + len(fresh)
                chosen[i] = graph.n + len(fresh)
                fresh.append(i)
        leaders += [at + i for i in fresh]
        centre_of[at : at + step] = chosen
        graph.add(part[fresh])
    order = np.argsort(centre_of, kind="stable")
    members = np.split(order, np.searchsorted(centre_of[order], np.arange(1, graph.n)))
    centres, radii, alone = vectors[leaders], np.zeros(len(leaders)), []
    most = math.acos(cosine) / 2 - MARGIN
    for k, own in enumerate(members):
        if len(own) == 1:
            continue
        mean = vectors[own].mean(axis=0)
        centres[k] = mean / np.linalg.norm(mean)
        angles = _angle(vectors[own] @ centres[k])
        alone += own[angles > most].tolist()
        members[k], radii[k] = own[angles <= most], angles[angles <= most].max(initial=0)
        if len(members[k]) == 1:  # a node of one member stands where that is
            centres[k], radii[k] = vectors[members[k][0]], 0
    graph.data[: len(centres)] = centres
    graph.add(vectors[alone])
    return graph, members + [np.array([i]) for i in alone], np.concatenate([centres, vectors[alone]]), np.concatenate([radii, np.zeros(len(alone))])


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def shards(rows: DataFrame, cosine: float = COSINE, numbers: int = SHARD_NUMBERS) -> DataFrame:
    """(label, dims, shard, shards, graph): the classes of each shard with their graph, in bytes."""
    n, dims = F.col("n"), F.col("dims")
    sizes = rows.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("label", "dims", F.greatest(F.ceil(n * dims / numbers), F.when(n < LEAST_SHARED, 1).otherwise(2)).cast("int").alias("shards"))
    dealt = rows.join(sizes, ["label", "dims"]).withColumn("shard", F.pmod(F.col("h1"), F.col("shards")).cast("int"))

    def build(group: pa.Table) -> pa.Table:
        keys = group["node"].to_pylist()
        order = sorted(range(len(keys)), key=keys.__getitem__)
        group = group.take(pa.array(order))
        vectors = _units(group["embedding"], group["dims"][0].as_py())
        graph, members, centres, radii = grouped(vectors, cosine)
        state = {
            "keys": np.frombuffer(b"".join(keys[i] for i in order), np.dtype((np.void, KEY_BYTES))), "weights": group["weight"].to_numpy(), "vectors": vectors,
            "graph": graph.state(), "first": np.concatenate([[0], np.cumsum([len(m) for m in members])]), "members": np.concatenate(members), "centres": centres, "radii": radii,
        }
        return pa.table({c: group[c].slice(0, 1) for c in ("label", "dims", "shard", "shards")} | {"graph": pa.array([pickle.dumps(state, protocol=5)], pa.binary())})

    columns = dealt.select("label", "dims", "shard", "shards", "node", "weight", "embedding")
    return columns.groupBy("label", "dims", "shard").applyInArrow(lambda _, group: build(group), "label string, dims int, shard int, shards int, graph binary")


class Shard:
    """A shard's classes and nodes."""

    def __init__(self, raw: bytes) -> None:
        state = pickle.loads(raw)  # noqa: S301  written by shards()
        self.keys, self.weights, self.vectors, self.centres, self.radii = (state[x] for x in ("keys", "weights", "vectors", "centres", "radii"))
        self.graph, self.first, self.members = Graph.of(state["graph"]), state["first"], state["members"]
        self.node_weights = np.add.reduceat(np.append(self.weights[self.members], 0), self.first[:-1]) * (np.diff(self.first) > 0)

    def own(self, node: int) -> np.ndarray:
        return self.members[self.first[node] : self.first[node + 1]]


# --- meetings


def near_nodes(a: Shard, b: Shard, cosine: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(node of a, node of b) of all found whose members may be linked; beams widen until the audit passes."""
    theta = math.acos(cosine) + MARGIN
    queries = a.centres.astype(np.float32)
    low = (np.cos(np.minimum(math.pi, theta + a.radii + b.radii.max(initial=0))) - 1e-5).astype(np.float32)
    sample = np.unique(np.linspace(0, len(queries) - 1, AUDITED).astype(np.int64)) if len(queries) else np.zeros(0, np.int64)
    exact = queries[sample] @ b.graph.data.T
    linked = exact >= np.cos(np.minimum(math.pi, theta + a.radii[sample][:, None] + b.radii[None, :])) - 1e-5
    if a is b:
        exact[np.arange(len(sample)), sample] = -3
    nearest = exact.argmax(axis=1) if b.graph.n else None
    while True:
        found_a, found_b, open_, width = [], [], np.arange(len(queries)), min(beam, b.graph.n)
        seen_nearest = np.zeros(len(queries), bool)
        nearest_of = np.full(len(queries), -1)
        nearest_of[sample] = nearest
        while len(open_):
            if width >= b.graph.n:  # nothing is left to widen to: all nodes are compared
                parts = [queries[open_[at : at + COMPARED]] @ b.graph.data.T >= low[open_[at : at + COMPARED], None] for at in range(0, len(open_), COMPARED)]
                i, j = np.nonzero(np.concatenate(parts))
                found_a.append(open_[i]), found_b.append(j)
                seen_nearest[open_] = True
                break
            nodes, near = b.graph.search(queries[open_], width)
            seen_nearest[open_] |= (nodes == nearest_of[open_, None]).any(axis=1)
            wider = near[:, -1] >= low[open_]
            i, k = np.nonzero((near >= low[open_, None]) & ~wider[:, None])
            found_a.append(open_[i]), found_b.append(nodes[i, k])
            open_, width = open_[wider], min(2 * width, b.graph.n)
        i, j = np.concatenate(found_a), np.concatenate(found_b)
        met = np.zeros(linked.shape, bool)
        place = np.searchsorted(sample, i)
        audited = (place < len(sample)) & (sample[np.minimum(place, len(sample) - 1)] == i)
        met[place[audited], j[audited]] = True
        links = linked.sum()
        if beam >= b.graph.n or ((met & linked).sum() >= AUDIT_LINKS * links and seen_nearest[sample].mean() >= AUDIT_NEAREST):
            return i, j
        beam *= 2


class _Unions:
    """Smallest connected member by member."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        up = self.parent[x]
        while True:
            further = self.parent[up]
            if (further == up).all():
                return up
            up = further

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Connects x[i] with y[i]; each turn hooks every root on a smaller one it is linked with."""
        while len(x):
            x, y = self.roots(x), self.roots(y)
            apart = x != y
            x, y = np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart])
            np.minimum.at(self.parent, x, y)
            self.parent = self.roots(self.parent)


def meet(a: Shard, b: Shard, cosine: float = COSINE, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of the members of ``a`` and then of ``b``: linked vectors found, and the first member connected.

    Where ``a`` is ``b`` the members are listed once, and links within a class are not counted.
    """
    same, theta, shift = a is b, math.acos(cosine), 0 if a is b else len(a.weights)
    counts, unions = np.zeros(len(a.weights) + (0 if same else len(b.weights)), np.int64), _Unions(len(a.weights) + (0 if same else len(b.weights)))
    i, j = near_nodes(a, b, cosine, beam)
    if same:
        pairs = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1)[i != j], axis=0)
        i, j = pairs[:, 0], pairs[:, 1]
        owner = np.repeat(np.arange(len(a.radii)), np.diff(a.first))
        counts[a.members] += a.node_weights[owner] - a.weights[a.members]
        heads = a.members[np.minimum(a.first[:-1], len(a.members) - 1)]
        unions.join(a.members, heads[owner])
    filled = (a.node_weights[i] > 0) & (b.node_weights[j] > 0)
    i, j = i[filled], j[filled]
    cosines = np.concatenate([np.einsum("id,id->i", a.centres[i[at : at + COMPARED]], b.centres[j[at : at + COMPARED]]) for at in range(0, len(i), COMPARED)]) if len(i) else np.zeros(0)
    angle, spread = _angle(cosines), a.radii[i] + b.radii[j]
    single = (np.diff(a.first)[i] == 1) & (np.diff(b.first)[j] == 1)
    sure = ~single & (angle + spread <= theta - MARGIN)
    ones = single & (cosines >= cosine)
    for x, y in zip(i[sure], j[sure], strict=True):
        own, others = a.own(x), b.own(y) + shift
        counts[own] += b.node_weights[y]
        counts[others] += a.node_weights[x]
        unions.join(np.append(own[1:], others), np.full(len(own) + len(others) - 1, own[0]))
    own, others = a.members[a.first[i[ones]]], b.members[b.first[j[ones]]]
    np.add.at(counts, own, b.weights[others])
    np.add.at(counts, others + shift, a.weights[own])
    unions.join(own, others + shift)
    open_ = ~single & ~sure & (angle - spread <= theta + MARGIN)
    for x, y in zip(i[open_], j[open_], strict=True):
        others = b.own(y)
        for at in range(0, len(a.own(x)), COMPARED):
            own = a.own(x)[at : at + COMPARED]
            for to in range(0, len(others), COMPARED):
                them = others[to : to + COMPARED]
                hit = a.vectors[own] @ b.vectors[them].T >= cosine
                counts[own] += hit @ b.weights[them]
                counts[them + shift] += hit.T @ a.weights[own]
                r, c = np.nonzero(hit)
                unions.join(own[r], them[c] + shift)
    return counts, unions.roots(np.arange(len(counts)))


def meetings(sharded: DataFrame, cosine: float = COSINE, beam: int = BEAM) -> DataFrame:
    """(node, n, root): vectors that a meeting found linked with a class, and a class it is connected with."""
    met = sharded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    met = met.select("label", "dims", F.least("shard", "other").alias("low"), F.greatest("shard", "other").alias("high"), "shard", "graph")

    def run(group: pa.Table) -> pa.Table:
        both = sorted(zip(group["shard"].to_pylist(), range(group.num_rows), strict=True))
        sides = [Shard(group["graph"][at].as_py()) for _, at in both]
        if len(sides) == 1 and group["low"][0] != group["high"][0]:  # the other shard has no rows
            sides = []
        counts, roots = meet(sides[0], sides[-1], cosine, beam) if sides else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        keys = np.concatenate([s.keys for s in sides]) if sides else np.zeros(0, np.dtype((np.void, KEY_BYTES)))
        some = np.flatnonzero(counts)
        named = [pa.array([bytes(x) for x in keys[which]], pa.binary()) for which in (some, roots[some])]
        return pa.table({"node": named[0], "n": pa.array(counts[some]), "root": named[1]})

    return met.groupBy("label", "dims", "low", "high").applyInArrow(lambda _, group: run(group), "node binary, n long, root binary")


def near_duplicate_vectors(rows: DataFrame, cosine: float = COSINE, numbers: int = SHARD_NUMBERS, beam: int = BEAM) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = linkable(rows)
    whole = stored(classes(rows), "vector-classes")
    # a row is a whole shard, so row groups are looked at after each
    sharded = stored(shards(whole, cosine, numbers), "vector-shards", {"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"})
    found = stored(meetings(sharded, cosine, beam), "vector-links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    components = connected_components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    each = whole.select("node", "h1", "h2", "weight").join(counts, "node", "left").join(components, "node", "left")
    each = each.select("h1", "h2", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.struct(smallest_id(F.coalesce("component", "node")).alias("id")).alias("low"))
    out = rows.select("vec_id", "h1", "h2").join(each, ["h1", "h2"], "left")
    component = F.when(F.col("low").isNotNull(), F.col("low.id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op11_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
