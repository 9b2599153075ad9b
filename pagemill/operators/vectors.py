"""Top-k search by cosine similarity, for many queries at once: a grid of blocks of queries and blocks of the index.

Both sides are packed into blocks where they lie, without a shuffle.  A few query blocks, of checked size, are
broadcast to the index; more of them are a table of their own, dealt into rows of the grid, and each task
takes one part of the index and one row, so the index is read once for each row.  A task multiplies blocks and
keeps the best k of each query and filter; the tasks' lists are merged as a tree, so what is shuffled is k
rows for each query and task and never all pairs.  No vector passes through Python on the driver.

Filters are columns of the index.  Each entry carries them as bits of one number, and one pass serves all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.sources.shared import new_path

#: Similarities are rounded, so that equal vectors tie whatever the order of summation.
DIGITS = 12
#: Queries and entries of a block, and queries whose scores a task holds at once.
QUERY_BLOCK, ENTRY_BLOCK, SCORED_QUERIES = 2048, 4096, 256
#: Bytes of query vectors that are broadcast at most, and that a row of the grid has about.
BROADCAST_BYTES, GROUP_BYTES = 16 << 20, 128 << 20
#: Lists of a query that are merged before the last merge.
LANES = 64
#: Filters that fit the bits of a number.
MOST_FILTERS = 62


def with_query_prefix(queries: DataFrame, prefix: str, text: str = "question") -> DataFrame:
    """The text that is embedded for a query; documents have no prefix."""
    return queries.withColumn("query_text", F.concat(F.lit(prefix or ""), F.col(text)))


def search(queries: DataFrame, index: DataFrame, k: int, where: Column | None = None, vector: str = "q_vec", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(query_id, rank, pos, id, score): the k best entries of each query among those that ``where`` admits.

    Equal scores are in order of pos; vectors without length score 0; queries without a vector have
    no rows.  queries: (query_id, vector column).
    """
    entries = index.where(where) if where is not None else index
    return search_filters(queries, entries, k, {"": F.lit(True)}, vector, group_bytes).drop("filter_id")


def search_filters(queries: DataFrame, index: DataFrame, k: int, filters: dict[str, Column], vector: str = "q_vec", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(filter_id, query_id, rank, pos, id, score): the same query vectors searched under several filters, in one pass.

    A filter that is null for an entry does not admit it.
    """
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"{len(filters)} filters; 1 to {MOST_FILTERS} can be searched at once")
    names = list(filters)
    admitted = [F.coalesce(filters[name], F.lit(False)).cast("long") * (1 << bit) for bit, name in enumerate(names)]
    entries = index.select("pos", "id", "embedding", sum(admitted[1:], admitted[0]).alias("admits")).where("admits <> 0")
    given = queries.where(F.col(vector).isNotNull()).select("query_id", F.col(vector).cast("array<double>").alias("vec"))
    blocks = _packed(given, ["query_id"], "vec", QUERY_BLOCK, "query_id array<bigint>, queries binary").withColumn("block", F.monotonically_increasing_id())
    size = given.agg(F.sum(F.size("vec") * 8 + 16)).first()[0] or 0
    if size <= min(BROADCAST_BYTES, group_bytes):
        blocks = F.broadcast(blocks)
    else:
        path = new_path(blocks.sparkSession, "queries")
        blocks.write.parquet(path)
        blocks = blocks.sparkSession.read.parquet(path).repartition(-(-size // group_bytes))
    kind = index.schema["id"].dataType.simpleString()
    packed = _packed(entries.select("pos", "id", "admits", F.col("embedding").cast("array<double>").alias("embedding")), ["pos", "id", "admits"], "embedding", ENTRY_BLOCK, f"pos array<bigint>, id array<{kind}>, admits array<bigint>, entries binary")
    # every block of queries meets every block of the index: a stated set of queries against all rows
    best = _best_of_tasks(packed.crossJoin(blocks), k, len(names), kind)
    near = _ranked(best.withColumn("lane", F.spark_partition_id() % LANES), k, "filter", "query_id", "lane")
    found = _ranked(near, k, "filter", "query_id")
    named = F.element_at(F.array(*[F.lit(name) for name in names]), F.col("filter") + 1)
    return found.select(named.alias("filter_id"), "query_id", "rank", "pos", "id", "score")


def _ranked(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "pos"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1, norm)


def _packed(df: DataFrame, keys: list[str], vector: str, rows: int, schema: str) -> DataFrame:
    """Blocks of at most so many rows: an array of each key, and the unit vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                n, flat = batch.num_rows, batch[vector].flatten().to_numpy(zero_copy_only=False)
                if len(flat) % n or batch[vector].null_count or len(set(batch[vector].value_lengths().to_pylist())) > 1:
                    raise ValueError("vectors differ in length")
                lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch[c]) for c in keys]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([_unit(flat.reshape(n, -1)).tobytes()], pa.binary())], names=[*keys, "vectors"])

    return df.mapInArrow(run, schema)


def _top(score: np.ndarray, pos: np.ndarray, k: int) -> np.ndarray:
    """For each row of ``score`` the places of its k best, equal scores by pos; k at most its length."""
    if k < score.shape[1]:
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(score, near, axis=1).min(axis=1, keepdims=True)
        # where more than k reach the k-th score, those at that score are chosen by pos
        for row in np.flatnonzero((score >= least).sum(axis=1) > k):
            some = np.flatnonzero(score[row] >= least[row])
            near[row] = some[np.lexsort((pos[row, some], -score[row, some]))[:k]]
    else:
        near = np.broadcast_to(np.arange(score.shape[1]), score.shape)
    order = np.lexsort((np.take_along_axis(pos, near, axis=1), -np.take_along_axis(score, near, axis=1)), axis=1)
    return np.take_along_axis(near, order, axis=1)


def _merged(held: tuple | None, score: np.ndarray, places: np.ndarray, names: np.ndarray, k: int) -> tuple:
    """The k best of each row, of those held and of new ones; places and names are those of the columns."""
    places = np.broadcast_to(places, score.shape)
    top = _top(score, places, min(k, score.shape[1]))
    new = np.take_along_axis(score, top, axis=1), np.take_along_axis(places, top, axis=1), names[top]
    if held is None:
        return new
    both = [np.concatenate(x, axis=1) for x in zip(held, new, strict=True)]
    top = _top(both[0], both[1], min(k, both[0].shape[1]))
    return tuple(np.take_along_axis(x, top, axis=1) for x in both)


def _best_of_tasks(grid: DataFrame, k: int, filters: int, kind: str) -> DataFrame:
    """(filter, query_id, pos, id, score): a task's k best of each query and filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        owners: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                block, ids, pos, admits = batch["block"][i].as_py(), *(batch[c][i].values.to_numpy() for c in ("query_id", "pos", "admits"))
                names = np.empty(len(pos), dtype=object)
                names[:] = batch["id"][i].values.to_pylist()
                queries, unit = (np.frombuffer(batch[c][i].as_buffer()).reshape(n, -1) for c, n in (("queries", len(ids)), ("entries", len(pos))))
                if queries.shape[1] != unit.shape[1]:
                    raise ValueError("vectors differ in length")
                owners[block] = ids
                chosen = [(f, np.flatnonzero(admits >> f & 1)) for f in range(filters)]
                for at in range(0, len(ids), SCORED_QUERIES):
                    score = np.round(queries[at : at + SCORED_QUERIES] @ unit.T, DIGITS)
                    for f, some in chosen:
                        if len(some):
                            part = score if len(some) == len(pos) else score[:, some]
                            held[f, block, at] = _merged(held.get((f, block, at)), part, pos[some], names[some], k)
        for (f, block, at), (score, places, found) in held.items():
            ids = np.repeat(owners[block][at : at + SCORED_QUERIES], score.shape[1])
            columns = [pa.array(np.full(len(ids), f, np.int32)), pa.array(ids), pa.array(places.ravel()), pa.array(found.ravel().tolist()), pa.array(score.ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=["filter", "query_id", "pos", "id", "score"])

    return grid.mapInArrow(run, f"filter int, query_id long, pos long, id {kind}, score double")
