"""Benchmark decontamination: one Aho-Corasick automaton over normalised test questions and answers.

Texts and items are lower-cased (A-Z) and cut into words of ASCII digits, letters and
non-ASCII characters.  Patterns are an item's windows of ``window`` consecutive words (a
shorter item is one window).  Every text is scanned once, and each hit is mapped back to words
and to character offsets of the original text.

The automaton is broadcast as its patterns, ``block_windows`` of them at most; a larger test
set is scanned in blocks, one pass over the texts for each, and what a pass found is stored before the
next one, so neither the driver nor a task holds more than a block.  There is no shuffle.

Defined results: null and wordless texts have no words and no hits; null or wordless items have
no windows; items that occur twice count once; an item with a null id marks words as hit but is
not among the items; an empty table gives no rows.  Columns named like an output are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import wordkit as wk
from pagemill.llm.common import give_back, set_aside, stored, table

WINDOW = 10
BLOCK_WINDOWS = 50_000
HITS = "array<struct<item_id:string,first_word:bigint,last_word:bigint,start:bigint,end:bigint>>"
_ARROW_HITS = pa.list_(pa.struct([("item_id", pa.string()), *((k, pa.int64()) for k in ("first_word", "last_word", "start", "end"))]))
_FOLD = bytes(wk.LOWER[b] if wk.ALNUM[wk.LOWER[b]] else 32 for b in range(256))


def normalised_words(text: str | None) -> list[bytes]:
    return re.findall(rb"[^ ]+", (text or "").encode().translate(_FOLD))


def windows(words: list[bytes], window: int) -> set[bytes]:
    """Patterns: the words with one space before, between and after."""
    if not words:
        return set()
    return {b" " + b" ".join(words[i : i + window]) + b" " for i in range(max(1, len(words) - window + 1))}


def blocks(items: DataFrame, window: int, block_windows: int) -> Iterator[dict[bytes, list[str | None]]]:
    """Pattern -> item ids, ``block_windows`` patterns a block at most, unless one item has more."""
    block: dict[bytes, list[str | None]] = {}
    for row in items.select(F.col("item_id").cast("string"), "text").where("text is not null").distinct().toLocalIterator():
        new = windows(normalised_words(row["text"]), window)
        if block and len(block) + len(new) > block_windows:
            yield block
            block = {}
        for pattern in new:
            owners = block.setdefault(pattern, [])
            if row["item_id"] not in owners:
                owners.append(row["item_id"])
    yield block


_automata: dict[str, tuple] = {}


def _automaton(key: str, block: dict[bytes, list[str | None]]) -> tuple:
    """The automaton of a broadcast block, built once in each worker."""
    if key not in _automata:
        import ahocorasick

        _automata.clear()
        made = ahocorasick.Automaton()
        for pattern, owners in block.items():
            made.add_word(pattern.decode("latin-1"), (pattern.count(b" ") - 1, owners))
        if len(made):
            made.make_automaton()
        _automata[key] = (made,)
    return _automata[key]


def _joined(words: wk.Words) -> tuple[str, np.ndarray]:
    """The slice's words with one space before, between and after, and where each word starts in it."""
    length = words.end - words.start
    place = np.concatenate([[0], np.cumsum(length + 1)]) + 1
    out = np.full(int(place[-1]), 32, dtype=np.uint8)
    inside = np.zeros(len(words.buf) + 1, dtype=np.int8)
    inside[words.start] += 1
    inside[words.end] -= 1  # no two words end at the same byte
    taken = words.buf[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    out[np.arange(len(taken)) + np.repeat(np.arange(len(length)) + 1, length)] = taken
    return out.tobytes().decode("latin-1"), place


def _merged(found: list[tuple]) -> list[tuple]:
    """Occurrences (item, first, last) as the item's maximal runs of overlapping occurrences."""
    out: list[tuple] = []
    for item, first, last in sorted(set(found), key=lambda x: (x[0] is not None, x[0] or "", x[1], x[2])):
        if out and out[-1][0] == item and first <= out[-1][2]:
            out[-1] = (item, out[-1][1], max(last, out[-1][2]))
        else:
            out.append((item, first, last))
    return out


def scan(docs: DataFrame, block: dict[bytes, list[str | None]], text: str = "text") -> DataFrame:
    """One pass: n_words, and ``hits`` extended by this block's."""
    if "hits" not in docs.columns:
        docs = docs.drop("n_words").withColumns({"n_words": F.lit(0).cast("long"), "hits": F.array().cast(HITS)})
    shared = docs.sparkSession.sparkContext.broadcast(block)
    key, names = uuid.uuid4().hex, docs.columns
    at, at_words, at_hits = names.index(text), names.index("n_words"), names.index("hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (automaton,) = _automaton(key, shared.value)
        for batch in batches:
            n_words, hits = np.zeros(batch.num_rows, np.int64), batch.column(at_hits).to_pylist()
            for lo, hi, buf, offsets in wk.slices(batch.column(at)):
                words = wk.split_words(wk.LOWER[buf], offsets, wk.ALNUM)
                n_words[lo:hi] = words.counts
                if not len(automaton) or not len(words.start):
                    continue
                joined, place = _joined(words)
                for i in range(hi - lo):
                    a, b = words.first[i], words.first[i + 1]
                    if a == b:
                        continue
                    base = int(place[a]) - 1
                    found = [(base + e, owners) for e, owners in automaton.iter(joined[base : int(place[b])])]
                    if not found:
                        continue
                    # a pattern ends at the space after its last word
                    last = np.searchsorted(place, np.array([e for e, _ in found])) - 1
                    spans = [(item, int(w) - k + 1 - int(a), int(w) - int(a)) for w, (_, (k, owners)) in zip(last, found, strict=True) for item in owners]
                    inner = np.concatenate([[0], np.cumsum((buf[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80)])
                    chars = lambda byte, o=int(offsets[i]), c=inner: int(c[byte - o])
                    hits[lo + i] = (hits[lo + i] or []) + [{"item_id": item, "first_word": f, "last_word": z, "start": chars(int(words.start[a + f])), "end": chars(int(words.end[a + z]))} for item, f, z in _merged(spans)]
            columns = list(batch.columns)
            columns[at_words], columns[at_hits] = pa.array(n_words), pa.array(hits, _ARROW_HITS)
            yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    return docs.mapInArrow(run, docs.schema)


def _covered(hits: Column) -> Column:
    """How many words the spans cover together."""
    spans = F.array_sort(F.transform(hits, lambda h: F.struct(h["first_word"].alias("f"), h["last_word"].alias("l"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("r"))
    return F.aggregate(
        spans,
        zero,
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["l"] - F.greatest(a["r"], s["f"] - 1))).alias("n"), F.greatest(a["r"], s["l"]).alias("r")),
        lambda a: a["n"],
    )


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with n_words, hits (item, words, characters), n_hit, item_ids and contaminated."""
    docs = docs.drop("hits", "n_hit", "item_ids", "contaminated")
    for number, block in enumerate(blocks(items, window, block_windows)):
        # one block at a time: what the last one found is stored before the next automaton is made
        docs = scan(stored(docs, "hits") if number else docs, block)
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("hits", lambda h: h["item_id"]), lambda x: x.isNotNull())))
    return docs.withColumns({"n_hit": _covered(F.col("hits")), "item_ids": ids}).withColumn("contaminated", F.col("n_hit") > 0)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a hit, columns as they were, whatever their names; ids are not looked at."""
    docs, back = set_aside(docs, "text")
    return back(find_contamination(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP5_SQL = rf"""
WITH dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS k, array_to_string(ws[i : i + least(len(ws), {WINDOW}) - 1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW} + 1, 1) + 1)) AS i FROM iw WHERE len(ws) > 0)
), pos AS (
  SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win) WHERE len(ws) >= k
), hit AS (
  SELECT p.doc_id, p.i, p.k, win.item_id FROM pos p JOIN win ON win.k = p.k AND win.w = array_to_string(p.ws[p.i : p.i + p.k - 1], ' ')
), hw AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY 1
), hi AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY 1
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
