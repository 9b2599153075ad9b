"""Packing over blocks is packing line by line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.operators import packing


def plain(lengths, breaks, limit):
    parts, part, held = [], 0, 0
    for i, (n, may) in enumerate(zip(lengths, breaks, strict=True)):
        if i and (held + n + 1 > limit or (may and held > limit // 2)):
            part, held = part + 1, 0
        parts.append(part)
        held += n + 1
    return parts


def by_blocks(lengths, breaks, limit, cuts):
    """Parts of all lines, found block by block."""
    spans = list(zip([0, *cuts], [*cuts, len(lengths)], strict=True))
    names = [c.split()[0] for c in packing.TABLE.split(", ")]
    tables = [dict(zip(names, packing.block_table(lengths[a:b], breaks[a:b], limit), strict=True)) for a, b in spans]
    parts = []
    for (a, b), (held, base) in zip(spans, packing.walk(tables, limit), strict=True):
        begins = packing.part_begins(lengths[a:b], breaks[a:b], limit, held)
        parts += [base + sum(x <= i for x in begins) for i in range(b - a)]
    return parts


def test_blocks_against_plain():
    rng = np.random.default_rng(1)
    for turn in range(600):
        n = int(rng.integers(1, 40))
        lengths, breaks = rng.integers(0 if turn % 2 else 1, rng.choice([3, 12, 60]), n), rng.random(n) < rng.choice([0, 0.3, 1])
        cuts = sorted(set(rng.integers(1, n + 1, rng.integers(0, 6)).tolist()) - {n})
        limit = int(rng.choice([1, 7, 40, 41]))
        assert by_blocks(lengths, breaks, limit, cuts) == plain(lengths, breaks, limit), (lengths, breaks, limit, cuts)


def test_at_the_limit():
    no = np.zeros(2, bool)
    assert by_blocks(np.array([9, 10]), no, 20, [1]) == [0, 1]
    assert by_blocks(np.array([9, 9]), no, 20, [1]) == [0, 0]


@pytest.mark.parametrize("block", [5, 10**6])
def test_a_long_segment_is_packed_in_blocks(spark, block):
    rng = np.random.default_rng(2)
    lengths, breaks = rng.integers(0, 30, 3000), rng.random(3000) < 0.1
    rows = [("long", i // 3, i % 3, int(n), bool(b)) for i, (n, b) in enumerate(zip(lengths, breaks, strict=True))] + [("short", 1, 0, 5, True), ("short", 1, 1, 44, True)]
    df = spark.createDataFrame(rows, "s string, page int, line int, n int, b boolean").withColumn("block", F.floor(F.col("page") / block)).repartition(4)
    found = packing.with_parts(df, ["s"], ["page", "line"], F.col("n"), F.col("b"), 51)
    got = {(r["s"], r["page"], r["line"]): r["part"] for r in found.collect()}
    assert [got["long", i // 3, i % 3] for i in range(3000)] == plain(lengths, breaks, 51)
    assert got["short", 1, 0] == got["short", 1, 1] == 0 and len(got) == 3002


def test_a_million_lines_in_seconds():
    rng = np.random.default_rng(3)
    lengths, breaks = rng.integers(0, 80, 1_000_000), rng.random(1_000_000) < 0.05
    cuts = list(range(4096, 1_000_000, 4096))
    names = [c.split()[0] for c in packing.TABLE.split(", ")]
    spans = list(zip([0, *cuts], [*cuts, len(lengths)], strict=True))
    tables = [dict(zip(names, packing.block_table(lengths[a:b], breaks[a:b], 1500), strict=True)) for a, b in spans]
    assert max(len(t["bounds"]) for t in tables) < 1501
    (a, b), (held, base) = spans[-1], packing.walk(tables, 1500)[-1]
    begins = packing.part_begins(lengths[a:b], breaks[a:b], 1500, held)
    assert base + len(begins) == plain(lengths, breaks, 1500)[-1]
