"""Greedy packing of a segment's lines into parts, split over blocks of its lines.

A part that begins at a line ends at a line that follows from this one alone, so a block of lines can be
prepared without knowing what precedes it: for each line that may be the first to begin a part there, how far
the chain of parts goes that it starts, composed by doubling.  A segment's blocks are then walked with one
number, the length of the open part; and each block, told that number, finds its own parts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.sources.shared import written

#: after, parts: length of the open part after the block and parts begun, for a segment that begins here (first) and
#: for each line that may begin the first part here (a list); such a line begins one if the open part is over its bound.
TABLE = "total bigint, first_after bigint, first_parts bigint, bounds array<bigint>, after array<bigint>, parts array<bigint>"


def next_parts(lengths: np.ndarray, breaks: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(upto, next): characters before each line and in all; where the part after one that begins at a line begins.

    A line that would pass the limit with its line end begins a part, and so does one that may, past half of it.
    """
    n = len(lengths)
    upto = np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64) + 1)])
    full = np.maximum(np.searchsorted(upto, upto[:-1] + limit, side="right") - 1, np.arange(1, n + 1))
    may = np.append(np.flatnonzero(breaks), n)
    late = np.maximum(np.searchsorted(upto, upto[:-1] + limit // 2, side="right"), np.arange(1, n + 1))
    return upto, np.minimum(np.minimum(full, n), may[np.searchsorted(may, np.minimum(late, n))])


def chains(next_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last, parts): the last line of each line's chain of parts, and how many parts that has, by doubling."""
    n = len(next_)
    hop, last, parts = np.append(next_, n), np.arange(n + 1), np.append(np.ones(n, np.int64), 0)
    while (hop[:n] < n).any():
        there = hop < n
        last = np.where(there, last[hop], last)
        parts = parts + parts[hop]
        hop = hop[hop]
    return last[:n], parts[:n]


def block_table(lengths: np.ndarray, breaks: np.ndarray, limit: int) -> tuple:
    upto, next_ = next_parts(lengths, breaks, limit)
    last, parts = chains(next_)
    after = upto[-1] - upto[last]
    # a line begins the first part here if the open part is over its bound, and the lines before it don't
    bounds = np.minimum(limit - upto[1:], np.where(breaks, limit // 2 - upto[:-1], limit))
    lower = bounds < np.minimum.accumulate(np.append(limit + 1, bounds[:-1]))
    lower &= np.append(1, np.minimum.accumulate(bounds)[:-1]) > 0  # an open part has a character at least
    return int(upto[-1]), int(after[0]), int(parts[0]), bounds[lower], after[lower], parts[lower]


def walk(blocks: list[dict], limit: int) -> list[tuple[int, int]]:
    """(length of the open part, its number) at the begin of each block; the length is 0 at the segment's begin."""
    out, held, part = [], 0, 0
    for at, b in enumerate(blocks):
        out.append((held, part))
        if not at:
            held, part = b["first_after"], b["first_parts"] - 1
            continue
        hit = next((i for i, bound in enumerate(b["bounds"]) if held > bound), None)
        held, part = (held + b["total"], part) if hit is None else (b["after"][hit], part + b["parts"][hit])
    return out


def part_begins(lengths: np.ndarray, breaks: np.ndarray, limit: int, held: int) -> list[int]:
    """The lines of a block that begin a part, the segment's first line apart."""
    upto, next_ = next_parts(lengths, breaks, limit)
    if held:
        over = (held + upto[1:] > limit) | (np.asarray(breaks, bool) & (held + upto[:-1] > limit // 2))
        at = int(over.argmax()) if over.any() else len(next_)
    else:
        at = int(next_[0])
    out = []
    while at < len(next_):
        out.append(at)
        at = int(next_[at])
    return out


def with_parts(rows: DataFrame, keys: list[str], order: list[str], length: Column, may_break: Column, limit: int) -> DataFrame:
    """``rows`` (stored, with a block that rises with ``order``) with ``part``, from 0 in each group of ``keys``.

    A group that fits the limit is one part; a line longer than it is a part of its own.
    """
    groups = [*keys, "block"]
    large = rows.groupBy(*keys).agg(F.sum(length + 1).alias("__size")).where(F.col("__size") > limit).select(*keys)
    line = F.struct(*order, length.alias("length"), may_break.alias("breaks"))
    packed = rows.join(large, keys, "left_semi").groupBy(*groups).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    columns = [F.transform("lines", lambda x: x["length"]), F.transform("lines", lambda x: x["breaks"])]

    @F.pandas_udf(TABLE)
    def table(lengths: pd.Series, breaks: pd.Series) -> pd.DataFrame:
        made = [block_table(a, np.asarray(b, bool), limit) for a, b in zip(lengths, breaks, strict=True)]
        return pd.DataFrame(made, columns=[c.split()[0] for c in TABLE.split(", ")])

    @F.pandas_udf("array<struct<held:bigint,part:bigint>>")
    def walked(blocks: pd.Series) -> pd.Series:
        return pd.Series([[{"held": h, "part": p} for h, p in walk(list(b), limit)] for b in blocks])

    @F.pandas_udf("array<int>")
    def begins(lengths: pd.Series, breaks: pd.Series, held: pd.Series) -> pd.Series:
        return pd.Series([part_begins(a, np.asarray(b, bool), limit, int(h)) for a, b, h in zip(lengths, breaks, held, strict=True)])

    told = packed.select(*groups, table(*columns).alias("t")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block", "t"))).alias("blocks"))
    told = told.select(*keys, F.arrays_zip(F.transform("blocks", lambda x: x["block"]).alias("block"), walked(F.transform("blocks", lambda x: x["t"])).alias("at")).alias("z"))
    told = told.select(*keys, F.explode("z").alias("z")).select(*keys, "z.block", F.col("z.at.held").alias("held"), F.col("z.at.part").alias("base"))
    found = packed.join(told, groups).select(*groups, "base", "lines", begins(*columns, F.col("held")).alias("begins"))
    place = lambda x: F.struct(*[x[c].alias(c) for c in order])
    found = written(found.select(*groups, "base", F.transform("begins", lambda i: place(F.get("lines", i))).alias("begins")), "parts")
    joined = rows.join(found, groups, "left")
    own = F.struct(*order)
    part = F.coalesce(F.col("base") + F.size(F.filter("begins", lambda b: b <= own)), F.lit(0))
    return joined.withColumn("part", part.cast("long")).drop("base", "begins")
