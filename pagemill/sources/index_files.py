"""The vector index as JSON lines and as Parquet, and the guard on its model's name.

Index: (pos, id, text, metadata map<string,string>, embedding array<float>, model).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.operators.index import with_positions

LINE = "model string, dimensions int, count bigint, id string, text string, metadata map<string,string>, vector array<float>"


def write_index_jsonl(index: DataFrame, path: str, model: str) -> None:
    """``path``/header: one line with model, dimensions and count; ``path``/entries: a line for each entry."""
    header = index.agg(F.first(F.size("embedding"), ignorenulls=True).alias("dimensions"), F.count(F.lit(1)).alias("count"))
    header.select(F.to_json(F.struct(F.lit(model).alias("model"), F.coalesce("dimensions", F.lit(0)).alias("dimensions"), "count")).alias("value")).write.text(f"{path}/header")
    entries = index.select("pos", F.to_json(F.struct("id", "text", "metadata", F.col("embedding").alias("vector"))).alias("value"))
    entries.repartitionByRange("pos").sortWithinPartitions("pos").select("value").write.text(f"{path}/entries")


def read_index_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(index, model).  ``path`` is a folder as written above, or one file with the header in it.

    An id that occurs twice has its later entry, at the place of its first.  An empty file is an error.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    # file names rise with the position that they hold, and so do offsets within a file
    placed = raw.select(F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"), F.from_json("value", LINE).alias("e"))
    header = placed.where("e.model is not null and e.vector is null").select("e.model").first()
    if header is None:
        raise ValueError(f"no index in {path}")
    entries = placed.where("e.vector is not null")
    merged = entries.groupBy("e.id").agg(F.min("at").alias("at"), F.max_by("e", "at").alias("e"))
    placed_entries = with_positions(merged, "at")
    return placed_entries.select(F.col("pos").cast("long").alias("pos"), "id", "e.text", "e.metadata", F.col("e.vector").alias("embedding"), F.lit(header[0]).alias("model")), header[0]


def write_index(index: DataFrame, path: str) -> None:
    index.write.partitionBy("model").parquet(path)


def check_index_model(index: DataFrame, model: str, strict: bool) -> DataFrame:
    """strict: an entry of another model is an error when it is read; otherwise such an index counts as empty."""
    if strict:
        wrong = F.raise_error(F.concat(F.lit("the index was built with "), F.col("model"))).cast(T.BooleanType())
        return index.where(F.when(F.col("model") == model, True).otherwise(wrong))
    others = index.where(~F.col("model").eqNullSafe(model)).select(F.lit(1).alias("other")).limit(1)
    return index.join(F.broadcast(others), F.lit(True), "left_anti")
