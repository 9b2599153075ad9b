"""What several operators of this folder share: tables, shared storage, labelled rows."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.sources.shared import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there, and a lost
    executor costs no more than the tasks it ran."""
    path = new_path(df.sparkSession, name)
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but ``used`` under names that no operator gives, and what names and orders them as they were."""
    names = docs.columns
    held = {c: c if c in used else f"__aside_{i}" for i, c in enumerate(names)}
    return docs.select(*[F.col(f"`{c}`").alias(held[c]) for c in names]), lambda out: out.select(*[F.col(f"`{held[c]}`").alias(c) for c in names])


def summed_blobs(blobs: DataFrame, fan_in: int = 256) -> DataFrame:
    """(part, counts) of blobs (part, width, counts): sums, as 64-bit numbers, of the blobs of each part.

    A blob is a part of a task's array of counters, ``width`` bytes a number.  They are summed in two
    levels, so a group holds a ``fan_in``-th of the tasks' blobs of a part, and then ``fan_in`` sums.
    """

    def add(group: pa.Table) -> pa.Table:
        total = 0
        for raw, width in zip(group["counts"], group["width"].to_pylist(), strict=True):
            total = total + np.frombuffer(raw.as_buffer(), dtype=f"<u{width}").astype(np.uint64)
        return pa.table({"part": group["part"].slice(0, 1), "width": pa.array([8], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, width int, counts binary"
    near = blobs.withColumn("lane", F.spark_partition_id() % fan_in)
    level = near.groupBy("part", "lane").applyInArrow(lambda _, group: add(group), schema)
    return level.groupBy("part").applyInArrow(lambda _, group: add(group), schema).select("part", "counts")


def counter_blobs(counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """A task's counters as blobs, in the smallest type that holds them."""
    width = next(w for w in (1, 2, 4, 8) if counts.max(initial=0) < 1 << 8 * w)
    data = [p.tobytes() for p in np.split(counts.astype(f"<u{width}"), parts)]
    return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([width] * parts, pa.int32()), pa.array(data, pa.binary())], names=["part", "width", "counts"])


def give_back() -> None:
    """Memory that a task has freed goes back to the system, so that what runs next in the worker has it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def row_hash(*cols: str) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols])


def is_training(doc_id: str = "doc_id") -> Column:
    """Rows that labels may be learnt from: crc32 of the id's text, modulo 4, is not 2; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 != 2


def one_label(labels: DataFrame, label: Column) -> DataFrame:
    """(doc_id, label): one row for each id; of several labels the smallest counts, nulls are left out."""
    rows = labels.select("doc_id", label.cast("int").alias("label")).where("doc_id is not null and label is not null")
    return rows.groupBy("doc_id").agg(F.min("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, bound: int) -> tuple[DataFrame, int]:
    """(doc_id, text, label) of at most about ``bound`` labelled training rows, and how many ids were chosen.

    Ids are chosen by their hash, so the sample is the same in every run.  Only
    (id, label) pairs of the sample are broadcast: 12 bytes each, ``bound`` of
    them (the choice by hash may miss it by a few hundredths).  A document that
    occurs several times counts once, with its smallest text.
    """
    rows = one_label(labels, label).where(is_training())
    n = rows.count()
    if n > bound:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * bound / n))
    found = docs.select("doc_id", "text").where(is_training()).join(F.broadcast(rows), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), min(n, bound)
