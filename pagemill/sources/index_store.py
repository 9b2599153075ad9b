"""The vector index as a table that changes cost what they change.

A store is a folder.  ``base`` and each ``delta`` are Parquet tables bucketed by id, all in as many buckets;
a delta holds the entries that one change wrote, and a row without content for each id that it removed.
Reading merges them: the last delta that names an id decides.  The merge joins ids only, against scans that
are bucketed already, so no text or vector is shuffled.  ``maintain`` merges deltas with each other when there
are many of them, and with the base when they have grown to a share of it; each task writes the buckets that
it has read, into a new table.

A manifest names the tables of each snapshot with the model, the dimensions and the number of entries.  It
is written last, under the snapshot's number, so a change is seen as a whole or not at all, one of two
writers of the same number fails, and a reader keeps its snapshot while others change the store.

Entries: (id, pos, text, embedding, any others); ids are unique in what is written.  Texts are compared by
SHA-256; a null text is the same as no other.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.index import refresh_stats
from pagemill.sources.shared import freeing, written

#: Buckets of a new store; one should hold some hundred MB.
BUCKETS = 32
#: So many deltas are merged into one, and into the base when their rows pass this share of it.
MOST_DELTAS, DELTA_SHARE = 8, 0.2
MANIFEST = "number int, model string, dimensions int, entries bigint, top bigint, buckets int, columns string, base string, deltas array<string>, changed bigint"


@dataclass(frozen=True)
class Snapshot:
    """What a manifest says.  ``top`` is the largest pos given out, ``changed`` the rows of the deltas."""

    number: int
    model: str
    dimensions: int
    entries: int
    top: int
    buckets: int
    columns: str
    base: str
    deltas: list[str]
    changed: int


def _digest() -> Column:
    return F.sha2(F.col("text"), 256)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


class IndexStore:
    """A store as of one snapshot; changes return the store as of the next."""

    def __init__(self, spark: SparkSession, path: str, snapshot: Snapshot) -> None:
        self.spark, self.path, self.snapshot = spark, path, snapshot

    # --- opening

    @classmethod
    def create(cls, index: DataFrame, path: str, model: str, buckets: int = BUCKETS, dealt: bool = False) -> IndexStore:
        """A store of ``index``, which must have pos, id, text and embedding; ``dealt``: its rows lie by id already."""
        rows = index.withColumns({"digest": _digest(), "live": F.lit(True)})
        self = cls(index.sparkSession, path, Snapshot(0, model, 0, 0, -1, buckets, _ddl(rows), "", [], 0))
        base = self._write(rows, "base", deal=not dealt)
        return self._next(base=base, deltas=[], changed=0, **self._measured(self._table(base)))

    @classmethod
    def open(cls, spark: SparkSession, path: str, model: str | None = None, strict: bool = True, number: int | None = None) -> IndexStore:
        """The last snapshot, or that of a number.

        An index of another model is an error before any entry is read, or, without ``strict``, counts as empty.
        """
        rows = spark.read.schema(MANIFEST).json(f"{path}/manifest/*")
        found = (rows if number is None else rows.where(F.col("number") == number)).orderBy(F.desc("number")).first()
        if found is None:
            raise ValueError(f"no index in {path}")
        self = cls(spark, path, Snapshot(**found.asDict()))
        if model is not None and model != self.snapshot.model:
            if strict:
                raise ValueError(f"the index was built with {self.snapshot.model}, not {model}")
            self.snapshot = replace(self.snapshot, model=model, base="", deltas=[], entries=0, dimensions=0, changed=0, top=-1)
        return self

    # --- tables

    def _name(self, table: str) -> str:
        return "index_" + hashlib.md5(f"{self.path}/{table}".encode()).hexdigest()

    def _table(self, table: str) -> DataFrame:
        if not table:
            return self.spark.createDataFrame([], self.snapshot.columns)
        name = self._name(table)
        if not self.spark.catalog.tableExists(name):
            layout = f"CLUSTERED BY (id) SORTED BY (id) INTO {self.snapshot.buckets} BUCKETS"
            self.spark.sql(f"CREATE TABLE {name} ({self.snapshot.columns}) USING parquet {layout} LOCATION '{self.path}/{table}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame, kind: str, deal: bool = True) -> str:
        table, n = f"{kind}/{uuid.uuid4().hex}", self.snapshot.buckets
        rows = rows.repartition(n, "id") if deal else rows
        with freeing(self.spark):
            rows.write.format("parquet").option("compression", "zstd").bucketBy(n, "id").sortBy("id").option("path", f"{self.path}/{table}").saveAsTable(self._name(table))
        return table

    def _measured(self, rows: DataFrame) -> dict:
        size = F.size("embedding")
        found = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("pos"), F.lit(-1)), F.coalesce(F.min(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
        if found[2] != found[3]:
            raise ValueError(f"vectors of {found[2]} and of {found[3]} numbers")
        return {"entries": found[0], "top": found[1], "dimensions": found[3]}

    def _next(self, **changes) -> IndexStore:
        new = replace(self.snapshot, number=self.snapshot.number + 1, **changes)
        row = self.spark.createDataFrame([tuple(asdict(new).values())], MANIFEST)
        row.coalesce(1).write.json(f"{self.path}/manifest/{new.number:08d}")
        return IndexStore(self.spark, self.path, new)

    # --- reading

    def _last(self, deltas: list[DataFrame]) -> DataFrame:
        """(id, last): the number of the last delta that names an id."""
        named = [d.select("id", F.lit(n).alias("last")) for n, d in enumerate(deltas)]
        return reduce(DataFrame.unionByName, named).groupBy("id").agg(F.max("last").alias("last"))

    def _merged(self, columns: list[str], with_base: bool = True, removed: bool = False) -> DataFrame:
        deltas = [self._table(d) for d in self.snapshot.deltas]
        parts = [self._table(self.snapshot.base)] if with_base else []
        if deltas:
            last = self._last(deltas)
            parts = [b.join(last, "id", "left_anti") for b in parts]
            kept = [d if removed else d.where("live") for d in deltas]
            parts += [d.join(last.where(F.col("last") == n), "id", "left_semi") for n, d in enumerate(kept)]
        return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])

    def _columns(self) -> list[str]:
        return self._table(self.snapshot.base or self.snapshot.deltas[0]).columns if self.snapshot.base or self.snapshot.deltas else self._table("").columns

    def read(self) -> DataFrame:
        """All entries."""
        return self._merged([c for c in self._columns() if c not in ("digest", "live")])

    def keys(self) -> DataFrame:
        """(id, pos, digest): neither texts nor vectors are read."""
        return self._merged(["id", "pos", "digest"])

    # --- changes

    def _changed(self, rows: DataFrame | None, removed: DataFrame | None, dealt: bool = False, **changes) -> IndexStore:
        parts, schema = [], self._table("").schema
        if rows is not None:
            given = F.size("embedding")
            wrong = F.raise_error(F.concat(F.lit(f"a vector of {self.snapshot.dimensions} numbers is wanted, not of "), given.cast("string"))).cast("boolean")
            if self.snapshot.dimensions:
                rows = rows.where(F.when(F.coalesce(given == self.snapshot.dimensions, F.lit(False)), True).otherwise(wrong))
            whole = rows.withColumns({"digest": _digest(), "live": F.lit(True)})
            parts.append(whole.select(*[F.col(f.name).cast(f.dataType) for f in schema]))
        if removed is not None:
            gone = removed.select("id").withColumn("live", F.lit(False))
            parts.append(gone.select(*[(F.col(f.name) if f.name in ("id", "live") else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]))
        delta = self._write(reduce(DataFrame.unionByName, parts), "delta", deal=not dealt)
        made = self._table(delta).agg(F.count(F.lit(1)), F.max("pos"), F.max(F.size("embedding"))).first()
        if not made[0]:
            return self
        top, dimensions = max(changes.pop("top", self.snapshot.top), -1 if made[1] is None else made[1]), self.snapshot.dimensions or made[2] or 0
        return self._next(deltas=[*self.snapshot.deltas, delta], changed=self.snapshot.changed + made[0], top=top, dimensions=dimensions, **changes)

    def upsert(self, new: DataFrame) -> IndexStore:
        """Entries of ``new`` replace those of the same id in place; others follow, in their own order."""
        old = self.keys().select("id", F.col("pos").alias("o_pos"))
        placed = new.join(old, "id", "left").withColumn("pos", F.coalesce("o_pos", F.lit(self.snapshot.top + 1) + F.col("pos"))).drop("o_pos")
        more = new.select("id").join(old, "id", "left_anti").count()
        return self._changed(placed, None, entries=self.snapshot.entries + more)

    def retain(self, ids: DataFrame) -> tuple[IndexStore, int]:
        """(store of the entries with one of the ids, the number removed)."""
        gone = written(self.keys().select("id").join(ids.select("id"), "id", "left_anti"), "removed")
        n = gone.count()
        return (self._changed(None, gone, entries=self.snapshot.entries - n) if n else self), n

    def plan(self, docs: DataFrame) -> DataFrame:
        """(id, status, pos, n_pos): what a refresh does with each id, written down; texts and vectors stay where they are."""
        new = docs.select("id", F.col("pos").alias("n_pos"), _digest().alias("n_digest"), F.lit(True).alias("n"))
        old = self.keys().withColumnsRenamed({"digest": "o_digest"}).withColumn("o", F.lit(True))
        status = F.when(F.col("n").isNull(), "removed").when(F.col("o").isNull(), "new").when(F.col("n_digest") == F.col("o_digest"), "reused").otherwise("changed")
        return written(new.join(old, "id", "full").select("id", status.alias("status"), "pos", "n_pos"), "plan")

    def refresh(self, docs: DataFrame, embedder: Callable[[DataFrame], DataFrame], dealt: bool = False) -> tuple[IndexStore, DataFrame]:
        """(store of exactly these documents, stats); only what is new or changed is embedded and written.

        An unchanged document keeps its entry as it is; a changed one its position; new ones follow.  ``dealt``:
        documents lie by id already, and the embedder leaves them there, so their texts are not dealt again.
        """
        plan = self.plan(docs)
        stats = refresh_stats(plan)
        top = plan.where("status <> 'removed'").agg(F.coalesce(F.max("pos"), F.lit(-1))).first()[0]
        counts = stats.first()
        if not counts["embedded"] and not counts["removed"]:
            return self, stats
        todo = plan.where("status in ('new', 'changed')").select("id", F.coalesce("pos", F.lit(top + 1) + F.col("n_pos")).alias("pos"))
        rows = embedder(docs.drop("pos").join(todo, "id"))
        store = self._changed(rows, plan.where("status = 'removed'"), dealt, entries=counts["reused"] + counts["embedded"], top=top)
        return store, stats

    def maintain(self) -> IndexStore:
        """Compacts what has become too much; to be called after changes, when nobody waits."""
        if self.snapshot.changed > DELTA_SHARE * max(self.snapshot.entries, 1):
            return self.compact()
        return self.compact(whole=False) if len(self.snapshot.deltas) > MOST_DELTAS else self

    def compact(self, whole: bool = True) -> IndexStore:
        """Deltas as one, or as part of a new base.  Each task writes the buckets it has read."""
        if not self.snapshot.deltas:
            return self
        columns = self._columns()
        if whole:
            base = self._write(self._merged(columns), "base", deal=False)
            return self._next(base=base, deltas=[], changed=0)
        delta = self._write(self._merged(columns, with_base=False, removed=True), "delta", deal=False)
        return self._next(deltas=[delta], changed=self._table(delta).count())

    def vacuum(self) -> None:
        """Deletes tables and manifests of earlier snapshots; nobody may be reading them."""
        jvm, wanted = self.spark._jvm, {self.snapshot.base, *self.snapshot.deltas, f"manifest/{self.snapshot.number:08d}"}
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        files = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for kind in ("base", "delta", "manifest"):
            folder = jvm.org.apache.hadoop.fs.Path(top, kind)
            for found in files.listStatus(folder) if files.exists(folder) else []:
                table = f"{kind}/{found.getPath().getName()}"
                if table not in wanted:
                    self.spark.sql(f"DROP TABLE IF EXISTS {self._name(table)}")
                    files.delete(found.getPath(), True)
