"""Connected components of a link table, by alternating large and small stars.

Each round joins every node to the smallest node it knows of; the rounds stop when nothing moves,
after about the logarithm of a component's size.  Between rounds each task contracts the links it
holds.  Minima are combined on the map side and joined back,
so a node with very many links is no task's burden.  Each round's links are written to the shared
folder, which also ends their lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagemill.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """links: (a, b), of one type.  (node, component): every node of a link with its component's smallest node."""
    edges = stored(_contracted(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "links")
    state = _state(edges)
    while state[0]:
        edges = stored(_contracted(_small_star(_large_star(edges))), "links")
        new = _state(edges)
        if new == state:
            break
        state = new
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged_components(components: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` after further links: only the components that these join take part in the search."""
    label_a, label_b = (components.select(F.col("node").alias(x), F.col("component").alias(f"label_{x}")) for x in "ab")
    ends = links.join(label_a, "a", "left").join(label_b, "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    joined = connected_components(ends).select(F.col("node").alias("label"), F.col("component").alias("low"))
    old = components.join(joined, components["component"] == joined["label"], "left").select("node", F.coalesce("low", "component").alias("component"))
    new = joined.join(components.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("low").alias("component"))
    return stored(old.unionByName(new), "components")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _contracted(edges: DataFrame) -> DataFrame:
    """Within each task, links between the same nodes' components as stars around the smallest: no shuffle, fewer rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
                u, v = root(u), root(v)
                if u != v:
                    parent[max(u, v)] = min(u, v)
        found = [(x, root(x)) for x in parent]
        found = [(x, r) for x, r in found if x != r]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], kind), pa.array([r for _, r in found], kind)], names=["u", "v"])

    kind = to_arrow_type(edges.schema["u"].dataType)
    return edges.select("u", "v").mapInArrow(run, edges.select("u", "v").schema)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node sends its smaller neighbours and itself to the smallest of them; links run from large to small."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
