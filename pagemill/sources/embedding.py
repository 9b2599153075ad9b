"""Vectors for texts from a caller's function of a batch of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.index import with_positions
from pagemill.sources.shared import freeing

VECTORS = "digest string, embedding array<float>"


def _checked(embedder: Callable[[list[str]], list], texts: list[str], dimensions: int | None) -> list:
    """A vector for each text, all of one length."""
    found = list(embedder(texts))
    if len(found) != len(texts) or any(len(v) != (dimensions or len(found[0])) for v in found):
        raise ValueError(f"{len(texts)} texts gave {len(found)} vectors, or vectors of different lengths")
    return found


def embed(df: DataFrame, text: str, embedder: Callable[[list[str]], list], batch_size: int = 32, dimensions: int | None = None) -> DataFrame:
    """``df`` with ``embedding``.  The function gets ``batch_size`` texts at most and returns a vector for each, in order."""
    names = [c for c in df.columns if c != "embedding"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list = []
            for at in range(0, len(frame), batch_size):
                vectors += _checked(embedder, frame[text].iloc[at : at + batch_size].tolist(), dimensions)
            yield frame.assign(embedding=pd.Series(vectors, index=frame.index, dtype=object))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)
    return df.select(*names).mapInPandas(run, f"{schema}, embedding array<float>")


def _known(spark: SparkSession, folder: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(VECTORS).parquet(folder) if there else spark.createDataFrame([], VECTORS)


def embed_durably(
    df: DataFrame, text: str, embedder: Callable[[list[str]], list], model: str, path: str,
    batch_size: int = 32, batches_per_task: int = 8, dimensions: int | None = None, key: str | None = None,
) -> DataFrame:
    """``df`` with ``embedding``; a text is given to the model once, however often and by whatever job it is asked for.

    ``path`` holds a table of vectors by model and SHA-256 of the text.  Texts that it lacks are numbered,
    so that batches are full but for the last one and tasks have equally many; a task's vectors are in the
    table as soon as it ends, whatever becomes of its job, so a job that is run again pays for no more than
    the tasks that were lost.  The embedding of a null text is null.

    key: a column without two equal values that ``df`` is dealt by.  Then texts are numbered and vectors joined by
    it, and a text leaves its place once, for its batch; without it, rows are dealt by digest too.
    """
    spark, folder = df.sparkSession, f"{path}/{hashlib.md5(model.encode()).hexdigest()}"
    names = [c for c in df.columns if c != "embedding"]
    keyed = df.select(*names).withColumn("__digest", F.sha2(F.col(text), 256))
    given = F.col(text if key is None else key).alias("text" if key is None else "__key")
    digests = keyed.select(F.col("__digest").alias("digest"), given).where("digest is not null")
    wanted = digests.dropDuplicates(["digest"]) if key is None else digests.groupBy("digest").agg(F.min("__key").alias("__key"))
    # numbered in a table of its own: which row stands for a text must not depend on how often this is run
    numbered = with_positions(wanted.join(_known(spark, folder), "digest", "left_anti"), "digest").withColumn("batch", F.floor(F.col("pos") / batch_size))
    n = numbered.agg(F.max("batch") + 1).first()[0] or 0

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [f for f in frames if f.num_rows]
        held = pa.Table.from_batches(rows).sort_by("pos") if rows else []
        for at in range(0, len(held), batch_size):
            batch = held.slice(at, batch_size)
            vectors = _checked(embedder, batch["text"].to_pylist(), dimensions)
            made = pa.table({"digest": batch["digest"], "embedding": pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32()))})
            yield from made.to_batches()

    if n:
        if key is not None:
            numbered = keyed.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(numbered, "__key")
        task = F.floor(F.col("batch") / batches_per_task).cast("int")
        dealt = numbered.select("pos", "digest", "text", task.alias("task")).repartitionById(-(-n // batches_per_task), "task").drop("task")
        # this way of committing keeps what ended tasks have written when their job fails
        with freeing(spark):
            dealt.mapInArrow(run, VECTORS).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(folder)
    mine = _known(spark, folder).join(digests.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
    if key is not None:
        vectors = mine.join(digests, "digest").select(F.col("__key").alias("__known"), "embedding")
        return keyed.join(vectors, F.col(key) == F.col("__known"), "left").drop("__digest", "__known")
    return keyed.join(mine.withColumnRenamed("digest", "__known"), F.col("__digest") == F.col("__known"), "left").drop("__digest", "__known")
