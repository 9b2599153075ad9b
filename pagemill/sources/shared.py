"""The folder that driver and executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which the shuffle files of an execution go when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A bucket holds so many bytes of the input files, or more where there would be more buckets than shuffle partitions.
BUCKET_BYTES = 128 << 10
#: Paths given out within ``passing``.
_PASSING: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("passing", default=None)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, made the checkpoint directory too.

    Where it isn't set, a local master gets a temporary folder; on a cluster that is an
    error, as executors would write to disks of their own.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or (found.get() if found.isDefined() else None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if not found.isDefined():
        sc.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _PASSING.get()) is not None:
        made.append(path)
    return path


def table_name(path: str) -> str:
    return path.rpartition("/")[2].replace("-", "_")


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is written to new paths within goes at its end; what is to stay is written to a path from before."""
    made: list[str] = []
    token = _PASSING.set(made)
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in made:
            spark.sql(f"DROP TABLE IF EXISTS {table_name(path)}")
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files behind; else they stay until the driver collects its garbage."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, for steps that would work it out again."""
    path = new_path(df.sparkSession, name)
    with freeing(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets(df: DataFrame) -> int:
    """How many buckets suit a table made of ``df``: as many as a bucketed table that it reads has, else so many
    that its files give each BUCKET_BYTES, but no more than a shuffle has partitions."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = [x for x in map(leaves.apply, range(leaves.size())) if x.getClass().getSimpleName() == "LogicalRelation"]
    for table in (x.catalogTable().get() for x in files if x.catalogTable().isDefined()):
        if table.bucketSpec().isDefined():
            return table.bucketSpec().get().numBuckets()
    read = sum(int(str(x.stats().sizeInBytes())) for x in files)
    return max(1, min(most, -(-read // BUCKET_BYTES))) if files else most


def bucketed(df: DataFrame, name: str, keys: list[str], n: int, deal: bool = True, path: str | None = None) -> DataFrame:
    """``df`` written once as a table of ``n`` buckets by ``keys``: what groups or joins by just these keys shuffles none of it.

    Without ``deal`` rows are written where they are, which suits rows that lie by ``keys`` already.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    table = table_name(path)
    with freeing(spark):
        rows = df.repartition(n, *keys) if deal else df
        rows.write.format("parquet").option("compression", "zstd").bucketBy(n, *keys).option("path", path).saveAsTable(table)
    return spark.table(table)
