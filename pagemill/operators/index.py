"""Index maintenance: what to embed, reuse, replace and remove.

Texts are compared by id and 64-bit hash first, then as they are; vectors stay out of the comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.operators.sizes import if_few
from pagemill.sources.shared import written


def upsert(index: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of ``new`` replace those of the same id in place; others follow, in their own order."""
    columns = [c for c in index.columns if c not in ("pos", "id")]
    old = index.select("id", F.col("pos").alias("o_pos"), F.struct(*columns).alias("o"))
    fresh = new.select("id", F.col("pos").alias("n_pos"), F.struct(*columns).alias("n"))
    both = old.join(fresh, "id", "full").withColumn("e", F.coalesce("n", "o"))
    top = index.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("top"))  # one row
    pos = F.coalesce("o_pos", F.col("top") + 1 + F.col("n_pos"))
    return both.crossJoin(F.broadcast(top)).select(pos.alias("pos"), "id", "e.*").select(*index.columns)


def _same_text(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    other = right.select(F.col("id").alias("r_id"), F.xxhash64("text").alias("r_hash"), F.col("text").alias("r_text"))
    same = (left["id"] == F.col("r_id")) & (F.xxhash64(left["text"]) == F.col("r_hash")) & (left["text"] == F.col("r_text"))
    return left.join(other, same, how)


def reusable(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Index entries whose id and text a document has: their vectors hold."""
    return _same_text(index, docs, "left_semi")


def missing(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Documents that are new or changed."""
    return _same_text(docs, index, "left_anti")


def retain(index: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries with one of the ids, one row with the number removed)."""
    wanted = ids.select("id")
    return index.join(wanted, "id", "left_semi"), index.join(wanted, "id", "left_anti").agg(F.count(F.lit(1)).alias("removed"))


def refresh_plan(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(id, status): reused, new, changed or removed, by one join of ids and text hashes."""
    # a null text is the same as no other, in ``missing`` and here
    new = docs.select("id", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("n_hash"), F.lit(True).alias("n"))
    old = index.select("id", F.xxhash64("text").alias("o_hash"), F.lit(True).alias("o"))
    status = F.when(F.col("n").isNull(), "removed").when(F.col("o").isNull(), "new").when(F.col("n_hash") == F.col("o_hash"), "reused").otherwise("changed")
    return new.join(old, "id", "full").select("id", status.alias("status"))


def refresh_stats(plan: DataFrame) -> DataFrame:
    """One row: reused, embedded, removed."""
    return plan.agg(F.count_if(F.col("status") == "reused").alias("reused"), F.count_if(F.col("status").isin("new", "changed")).alias("embedded"), F.count_if(F.col("status") == "removed").alias("removed"))


def refresh_index(docs: DataFrame, index: DataFrame, embedder: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(index for exactly these documents, stats); only missing documents are embedded.

    An unchanged document keeps its whole old entry; a changed one its position.
    """
    kept, _ = retain(index, docs)
    fresh = embedder(missing(docs, kept))
    return upsert(kept, fresh), refresh_stats(refresh_plan(docs, index))


def index_stats(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("entries"), F.first(F.size("embedding"), ignorenulls=True).alias("dimensions"))


def definition_terms(chunks: DataFrame, section: str) -> DataFrame:
    """(pos, term): the distinct numbers of a section's chunks, at their first place."""
    found = chunks.where((F.col("section") == section) & F.col("number").isNotNull())
    return found.groupBy(F.col("number").alias("term")).agg(F.min("pos").alias("pos")).select("pos", "term")


def first_by_number(chunks: DataFrame, numbers: DataFrame) -> DataFrame:
    """For each wanted number its first chunk; a number without one has nulls."""
    wanted = numbers.select("number").distinct()
    first = chunks.join(if_few(wanted), "number", "left_semi").groupBy("number").agg(F.min_by(F.struct("pos", "id"), "pos").alias("c"))
    return wanted.join(first, "number", "left").select("number", "c.pos", "c.id")


def require_all(found: DataFrame) -> DataFrame:
    """Raises when a row without a chunk is read."""
    gone = F.raise_error(F.concat(F.lit("no chunk with number "), F.col("number"))).cast("boolean")
    return found.where(F.when(F.col("id").isNotNull(), True).otherwise(gone))


def with_positions(df: DataFrame, *order: str) -> DataFrame:
    """pos 0, 1, ... by ``order``.  Ranges are sorted in parallel; only their sizes meet.

    The ranges are written to the shared folder first: what part a row is in must not depend on
    how often, and with what coalescing, its shuffle is read.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    local = written(ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1), "positions")
    sizes = local.groupBy("__part").agg(F.count(F.lit(1)).alias("size"))
    base = sizes.select("__part", (F.sum("size").over(Window.orderBy("__part")) - F.col("size")).alias("base"))  # a row for each range
    placed = local.join(F.broadcast(base), "__part").withColumn("pos", F.col("base") + F.col("__n"))
    return placed.drop("__part", "__n", "base")
