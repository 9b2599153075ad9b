"""Running values over ordered groups that are longer than a task should be.

A group's rows are dealt into blocks of pages.  Each block is summarised in a row, the summaries are scanned in
order, and what a block inherits is joined back to its rows, which are scanned within the block.  Rows are
shuffled by (group, block), so a group is split over tasks, and no window sees more than a block's rows or a
group's blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Pages of a block.
BLOCK_PAGES = 64


def with_block(rows: DataFrame, page: str = "page") -> DataFrame:
    return rows.withColumn("block", F.floor(F.col(page) / BLOCK_PAGES).cast("long"))


def scan(rows: DataFrame, keys: list[str], order: list[str], wanted: dict[str, tuple[str, Column]]) -> DataFrame:
    """``rows``, which have a block that rises with ``order``, with running values of each group of ``keys``.

    wanted: name -> (kind, value).  sum: of the values up to the row; last: the last value up to the row that is
    not null; next: the first from the row on; before and after: the same without the row itself.
    """
    at, groups = F.struct(*order), [*keys, "block"]
    first_kinds = ("next", "after")

    def summary(kind: str, value: Column) -> Column:
        if kind == "sum":
            return F.sum(value)
        return (F.min_by if kind in first_kinds else F.max_by)(value, F.when(value.isNotNull(), at))

    def inherited(kind: str, name: str) -> Column:
        blocks = Window.partitionBy(*keys).orderBy(F.desc("block") if kind in first_kinds else "block").rowsBetween(Window.unboundedPreceding, -1)
        return F.sum(name).over(blocks) if kind == "sum" else F.last(name, ignorenulls=True).over(blocks)

    def within(kind: str, value: Column) -> Column:
        by = [F.desc(c) for c in order] if kind in first_kinds else order
        rows_ = Window.partitionBy(*groups).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1 if kind in ("before", "after") else 0)
        return F.sum(value).over(rows_) if kind == "sum" else F.last(value, ignorenulls=True).over(rows_)

    blocks = rows.groupBy(*groups).agg(*[summary(kind, value).alias(name) for name, (kind, value) in wanted.items()])
    carried = blocks.select(*groups, *[inherited(kind, name).alias(f"__{name}") for name, (kind, _) in wanted.items()])
    local = rows.join(carried, groups).withColumns({f"_{name}": within(kind, value) for name, (kind, value) in wanted.items()})
    both = {name: (F.coalesce(F.col(f"_{name}"), F.lit(0)) + F.coalesce(F.col(f"__{name}"), F.lit(0))) if kind == "sum" else F.coalesce(f"_{name}", f"__{name}") for name, (kind, _) in wanted.items()}
    return local.withColumns(both).drop(*[f"{bar}{name}" for name in wanted for bar in ("_", "__")])
