"""Filter interaction audit: what each of five filters removes in every order of application.

1. One pass over the texts gives each document a mask of the filters A to D that it fails, and a digest
   of its text; only these leave the task.
2. The smallest id of each digest, joined back where a digest has several ids, gives filter E; the labels
   are joined by id.  Both are equi-joins of small rows that Spark splits where a key is hot.
3. A document's mask indexes a table of 32 masks by 120 orders, which holds the step that removes it.  A
   task counts removals by (part, order, step) with ``np.bincount``, for all, good and toxic documents,
   and keeps one array of fixed size for each part.
4. The arrays are summed in two levels, and each part's sums become its 600 rows.

A: under 100 words.  B: 100 * distinct words < 80 * words.  C: 100 * A-Z characters > 10 * code points.
D: any of ``#$%&*|``.  E: the text of a smaller id, wherever that is in the table.  Words are maximal
``[^\\x20\\x09-\\x0D]+`` and case-sensitive.

Defined results: a null text is an empty one; a null lang is the part ''.  A null id has no smaller id and
is none, so such a row never fails E; rows of equal id and text don't fail E for each other, and every row
counts as a document.  A row has a label if any row of ``labels`` with its id says 1; a null id has none.
An empty table has no parts and no rows.  Columns of other names are not read.  Texts count whole; memory
is a multiple of the longest text.  Words are told apart by 64-bit hashes, texts by SHA-256.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import wordkit as wk
from pagemill.llm.common import stored, table

FILTERS = "ABCDE"
ORDERS = ["".join(order) for order in itertools.permutations(FILTERS)]
STEPS = len(FILTERS)
#: A task's arrays of so many parts are given out before it goes on.
PARTS_AT_ONCE = 2000
#: Documents of a batch that are counted at once; each takes some 120 numbers.
ROWS_AT_ONCE = 4096

_SIGN = np.isin(np.arange(256), list(b"#$%&*|"))
#: An array of a part: documents by mask, and removals by (all, good, toxic), order and step; a step more is for what stays.
_MASKS, _SHAPE = 1 << STEPS, (3, len(ORDERS), STEPS + 1)
_WIDTH = _MASKS + int(np.prod(_SHAPE))
_OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def first_failures() -> np.ndarray:
    """(32, 120): the step, 0 to 4, of an order that removes what fails a mask's filters; 5 where none does."""
    masks, found = np.arange(_MASKS), np.full((_MASKS, len(ORDERS)), STEPS)
    for column, order in enumerate(ORDERS):
        for step in reversed(range(STEPS)):
            found[masks >> FILTERS.index(order[step]) & 1 == 1, column] = step
    return found


def text_masks(texts: pa.Array) -> np.ndarray:
    """For each text the filters A to D that it fails, as bits 0 to 3."""
    out = np.zeros(len(texts), np.uint8)
    for lo, hi, buf, offsets in wk.slices(texts):
        words = wk.split_words(buf, offsets)
        n = words.counts
        _, owner = wk.ordered_unique(words.hashes(), words.text)
        distinct = np.bincount(owner, minlength=hi - lo)
        upper, points, signs = (wk.sums(x, offsets) for x in ((buf >= 65) & (buf <= 90), (buf & 0xC0) != 0x80, _SIGN[buf]))
        fails = (n < 100, 100 * distinct < 80 * n, 100 * upper > 10 * points, signs > 0)
        out[lo:hi] = sum(f.astype(np.uint8) << bit for bit, f in enumerate(fails))
    return out


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) of documents: filters A to D, and what tells equal texts."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = pa.array(text_masks(batch["text"]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["part"], masks, batch["digest"]], names=["doc_id", "part", "mask", "digest"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, part string, mask int, digest binary")


def with_copies(rows: DataFrame) -> DataFrame:
    """Filter E: its bit joins the mask of rows whose text a smaller id has."""
    copies = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("digest", "low")
    copied = F.coalesce(F.col("doc_id") > F.col("low"), F.lit(False)).cast("int") * (1 << FILTERS.index("E"))
    return rows.join(copies, "digest", "left").withColumn("mask", F.col("mask") + copied).drop("digest", "low")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic."""
    said = labels.groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    joined = rows.join(said.where("doc_id is not null and (good or toxic)"), "doc_id", "left")
    return joined.select("part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def removals(rows: DataFrame) -> DataFrame:
    """(part, counts) of (part, mask, good, toxic): a task's arrays, one for each part it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, order = first_failures(), np.arange(len(ORDERS))
        found: dict[str, np.ndarray] = {}

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["part", "counts"])
            found.clear()
            return out

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                parts = batch["part"].dictionary_encode()
                part, n = parts.indices.to_numpy(zero_copy_only=False), len(parts.dictionary)
                mask = batch["mask"].to_numpy(zero_copy_only=False)
                every = np.ones(len(mask), bool)
                counts = [np.bincount(part * _MASKS + mask, minlength=n * _MASKS).reshape(n, -1)]
                cell = (part[:, None] * len(ORDERS) + order) * (STEPS + 1) + steps[mask]
                for chosen in (every, *(batch[c].to_numpy(zero_copy_only=False) for c in ("good", "toxic"))):
                    counts.append(np.bincount(cell[chosen].ravel(), minlength=n * len(ORDERS) * (STEPS + 1)).reshape(n, -1))
                for name, array in zip(parts.dictionary.to_pylist(), np.concatenate(counts, axis=1), strict=True):
                    found[name] = found[name] + array if name in found else array
                if len(found) > PARTS_AT_ONCE:
                    yield given()
        if found:
            yield given()

    return rows.mapInArrow(run, "part string, counts binary")


def _total(arrays: pa.Table) -> np.ndarray:
    total = np.zeros(_WIDTH, np.int64)
    for raw in arrays["counts"]:
        total += np.frombuffer(raw.as_buffer(), np.int64)
    return total


def summed(arrays: DataFrame, fan_in: int = 256) -> DataFrame:
    """One array for each part."""

    def add(group: pa.Table) -> pa.Table:
        return pa.table({"part": group["part"].slice(0, 1), "counts": pa.array([_total(group).tobytes()], pa.binary())})

    lanes = arrays.withColumn("lane", F.spark_partition_id() % fan_in)
    return lanes.groupBy("part", "lane").applyInArrow(lambda _, group: add(group), "part string, counts binary").groupBy("part").applyInArrow(lambda _, group: add(group), "part string, counts binary")


def report(arrays: DataFrame) -> DataFrame:
    """The rows of each part's array."""

    def rows(array: np.ndarray) -> dict[str, np.ndarray]:
        by_mask, (all_, good, toxic) = array[:_MASKS], array[_MASKS:].reshape(_SHAPE)
        which = np.array([[FILTERS.index(letter) for letter in order] for order in ORDERS])
        masks = np.arange(_MASKS)
        fails = np.array([by_mask[masks >> f & 1 == 1].sum() for f in range(STEPS)])
        removed = all_[:, :STEPS]
        by_filter = np.zeros(STEPS, np.int64)
        np.add.at(by_filter, which, removed)
        return {
            "kept": by_mask.sum() - removed.cumsum(axis=1), "removed": removed, "redundant": fails[which] - removed, "unique_fails": by_mask[1 << which],
            "good_lost": good[:, :STEPS], "toxic_lost": toxic[:, :STEPS], "shapley": by_filter[which],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in zip(batch["part"].to_pylist(), batch["counts"], strict=True):
                n = len(ORDERS) * STEPS
                columns = {"part": pa.array([part] * n, pa.string()), "filter_order": pa.array(np.repeat(ORDERS, STEPS)), "step": pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS)))}
                columns |= {name: pa.array(x.ravel().astype(np.int64)) for name, x in rows(np.frombuffer(raw.as_buffer(), np.int64)).items()}
                yield pa.RecordBatch.from_pydict(columns)

    return arrays.mapInArrow(run, _OUT)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, and how many documents stay, go, were gone, fail this filter alone, and are good or toxic losses."""
    rows = stored(masked(docs), "filter-masks")
    return report(summed(removals(with_labels(with_copies(rows), labels))))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS mask
  FROM d LEFT JOIN l USING (doc_id)
), h AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, step, own, sum(n) FILTER (WHERE mask = translate(mask, before || own, '')) AS kept, sum(n) FILTER (WHERE contains(mask, own) AND mask = translate(mask, before, '')) AS removed,
    sum(n) FILTER (WHERE contains(mask, own) AND mask <> translate(mask, before, '')) AS redundant, sum(n) FILTER (WHERE mask = own) AS unique_fails,
    sum(good) FILTER (WHERE contains(mask, own) AND mask = translate(mask, before, '')) AS good_lost, sum(toxic) FILTER (WHERE contains(mask, own) AND mask = translate(mask, before, '')) AS toxic_lost
  FROM h, s GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley FROM r
"""
