"""Source divergence audit: how the sources of a language differ from one another, and by which terms.

A group is a (lang, source); its vector counts the language's kept terms, those of at least three of its
documents.  Shares are whole numbers, p = 1 + floor(10^9 * (count + 1) / (N + V)).  A group differs from
another by the sum of floor((p - q)^2 / q) over all kept terms, and from its language by its terms of p > q.

1. One pass over the texts counts terms by group within tasks; the counts are summed by (lang, source,
   term), and again by (lang, term) for the vocabulary.  Hot sources and frequent words are combined
   before the shuffle.
2. A language's terms are dealt into ranges of some ``RANGE_TERMS``, and its groups into blocks of
   BLOCK_GROUPS.  A seat, (lang, range, block), holds the compressed vectors of its groups in that range,
   so a seat's size is bounded whatever the corpus; the sums over terms add up over the ranges.
3. Seats stay where they are: partitioned once and persisted on disk; a lost one is read again from the
   written table.  In the home round each seat meets its range's vocabulary and ranks its groups' terms
   in heaps, and its groups meet each other.  Then vectors circulate in rounds of a round-robin tournament
   (the circle method): in each round every block meets one other, as a guest or a host by turns, and
   both directions are evaluated.  ROUNDS_AT_ONCE rounds are one job, so what is on its way is bounded.
4. A meeting evaluates the terms that any of its groups has; all other terms of the range have equal
   shares in a group and are counted, not visited.
5. Values are summed over ranges and ranked.

Defined results: null text, lang and source are ''.  Groups without terms take part, with p = 1 +
floor(10^9 / V).  A language without kept terms gives pairs of value 0; a group alone in its language gives
no pairs; an empty table gives no rows.  Repeated rows are documents each.  Ties are ranked by the item.
Other columns are not read.  Texts count whole; memory is a multiple of the longest text.  A task tells
terms apart by 64-bit hashes.  All arithmetic is exact while N + V is under 9 * 10^15.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm import wordkit as wk
from pagemill.llm.common import give_back, stored, table

LEAST_DOCS = 3
TOP_TERMS = 200
BLOCK_GROUPS = 8
RANGE_TERMS = 1 << 17
ROUNDS_AT_ONCE = 16
#: A task gives out its counts when it holds so many.
HELD_COUNTS = 1 << 20

#: Terms of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``.
LETTERS = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
SEAT = ["lang", "span", "block"]
_FOUND = "lang string, source string, part string, item string, value long"


# --- counts


class _Counts:
    """Counts of (group, term) that a task has met; terms by hash, their bytes one after the other."""

    def __init__(self) -> None:
        self.groups: dict[tuple, int] = {}
        self._empty()

    def _empty(self) -> None:
        self.known = np.zeros(0, np.uint64)
        #: For each known hash the number of its term, in the order of ``pool``: (bytes, lengths) as terms were met.
        self.number = np.zeros(0, np.int32)
        self.pool: list[tuple[np.ndarray, np.ndarray]] = []
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def numbers(self, keys: Iterator[tuple]) -> np.ndarray:
        if not self.size:
            self.groups = {}
        return np.array([self.groups.setdefault(x, len(self.groups)) for x in keys], np.int64)

    def add(self, group: np.ndarray, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        """Counts ``texts``; what no longer fits is given out after each slice, not only after a batch."""
        for lo, hi, raw, offsets in wk.slices(texts):
            buf = wk.LOWER[raw]
            words = wk.split_words(buf, offsets, LETTERS)
            if not len(words.start):
                continue
            hashes = words.hashes()
            distinct, first = np.unique(hashes, return_index=True)
            new = ~np.isin(distinct, self.known, assume_unique=True)
            self._learn(buf, distinct[new], words.start[first[new]], words.end[first[new]])
            # runs of a term in a text, and then in a group
            order = np.lexsort((hashes, words.text))
            h, t = hashes[order], words.text[order]
            at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])]))
            n = np.diff(np.concatenate([at, [len(h)]]))
            self._hold(group[lo:hi][t[at]], h[at], n, np.ones(len(at), np.int64))
            if self.size > HELD_COUNTS:
                self.combined()
            if self.size > HELD_COUNTS // 2 or len(self.known) > HELD_COUNTS // 2:
                yield from self.given()

    def _learn(self, buf: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        if len(hashes):
            length = end - start
            before = np.cumsum(length) - length
            self.pool.append((buf[np.repeat(start - before, length) + np.arange(int(length.sum()))], length.astype(np.int32)))
            number = np.arange(len(self.known), len(self.known) + len(hashes), dtype=np.int32)
            place = np.searchsorted(self.known, hashes)
            self.known, self.number = np.insert(self.known, place, hashes), np.insert(self.number, place, number)

    def _hold(self, *columns: np.ndarray) -> None:
        group, h, n, docs = columns
        order = np.lexsort((h, group))
        group, h = group[order], h[order]
        at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (group[1:] != group[:-1])]))
        self.held.append((group[at], h[at], np.add.reduceat(n[order], at), np.add.reduceat(docs[order], at)))
        self.size += len(at)

    def combined(self) -> None:
        if len(self.held) > 1:
            columns = [np.concatenate(x) for x in zip(*self.held, strict=True)]
            self.held, self.size = [], 0
            self._hold(*columns)

    def given(self) -> Iterator[pa.RecordBatch]:
        self.combined()
        if self.held:
            (group, h, n, docs), names = self.held[0], list(self.groups)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([x for _, x in self.pool]))]).astype(np.int64)
            data = pa.py_buffer(np.concatenate([x for x, _ in self.pool]))
            terms = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), data])
            lang, source = (pa.array([x[i] for x in names], pa.string()) for i in (0, 1))
            step = 1 << 16
            for at in range(0, len(h), step):
                part = slice(at, at + step)
                found = terms.take(pa.array(self.number[np.searchsorted(self.known, h[part])]))
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(group[part])), source.take(pa.array(group[part])), _text(found), pa.array(n[part]), pa.array(docs[part])], names=["lang", "source", "term", "n", "docs"])
        self._empty()


def _text(raw: pa.Array) -> pa.Array:
    try:
        return raw.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term, and documents with it."""
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            group = counts.numbers(zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True))
            yield from counts.add(group, batch["text"])
        yield from counts.given()
        give_back()

    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vocabulary(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total) of the terms that a language keeps."""
    return counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")


# --- seats


def _packed(x: object) -> bytes:
    return zlib.compress(pickle.dumps(x, protocol=5), 1)


def _unpacked(raw: bytes) -> object:
    return pickle.loads(zlib.decompress(raw))  # noqa: S301  written by _packed


def _smallest(x: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest type."""
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


def seats(entries: DataFrame) -> DataFrame:
    """(lang, span, block, vectors) of entries (…, source, total, id, n); a row of id -1 tells of a group, and its n is N.

    Vectors are a list of (source, N, ids, counts): ids ascend and are kept as differences.
    """

    def pack(group: pa.Table) -> pa.Table:
        codes = group["source"].combine_chunks().dictionary_encode()
        code, ids, n = codes.indices.to_numpy(), group["id"].to_numpy(), group["n"].to_numpy()
        order = np.lexsort((ids, code))
        ids, n = ids[order], n[order]
        borders = np.searchsorted(code[order], np.arange(len(codes.dictionary) + 1))
        vectors = [(name, int(n[a]), _smallest(np.diff(ids[a + 1 : b], prepend=0)), _smallest(n[a + 1 : b])) for name, a, b in zip(codes.dictionary.to_pylist(), borders[:-1], borders[1:], strict=True)]
        return pa.table({c: group[c].slice(0, 1) for c in SEAT} | {"vectors": pa.array([_packed(vectors)], pa.binary())})

    return entries.select(*SEAT, "source", "id", "n").groupBy(*SEAT).applyInArrow(lambda _, group: pack(group), "lang string, span int, block int, vectors binary")


class _Vectors:
    """The groups of a seat: shares of their terms, and the share of any term they lack."""

    def __init__(self, raw: bytes, size: int) -> None:
        found = _unpacked(raw)
        self.sources = [x[0] for x in found]
        self.ids = [np.cumsum(x[2], dtype=np.int64) for x in found]
        self.counts = [x[3].astype(np.int64) for x in found]
        self.shares = [share(c, x[1] + size) for c, x in zip(self.counts, found, strict=True)]
        self.absent = np.array([int(share(np.zeros(1, np.int64), x[1] + size)[0]) if size else 1 for x in found], np.int64)
        self.terms = np.unique(np.concatenate(self.ids)) if self.ids else np.zeros(0, np.int64)

    def over(self, terms: np.ndarray) -> np.ndarray:
        out = np.repeat(self.absent[:, None], len(terms), axis=1)
        for row, ids, shares in zip(out, self.ids, self.shares, strict=True):
            row[np.searchsorted(terms, ids)] = shares
        return out


def share(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / total), by long division in steps that fit 64 bits."""
    whole, rest = np.divmod(count + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def differences(a: _Vectors, b: _Vectors, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of each group of ``a`` (rows) against each of ``b``, and of those against these, over a range of so many terms."""
    met = np.union1d(a.terms, b.terms)
    p, q, rest = a.over(met), b.over(met), terms - len(met)
    there, back = (np.zeros((len(p), len(q)), np.int64) for _ in range(2))
    for i in range(len(p)):
        far, apart = (p[i] - q) ** 2, (a.absent[i] - b.absent) ** 2
        there[i] = (far // q).sum(axis=1) + rest * (apart // b.absent)
        back[i] = (far // p[i]).sum(axis=1) + rest * (apart // a.absent[i])
    return there, back


def top_terms(seat: _Vectors, words: list[str], totals: np.ndarray, total: int, top: int = TOP_TERMS) -> Iterator[tuple[str, str, int]]:
    """(source, term, value) of each group's highest terms of a range: a heap keeps ``top``."""
    of_lang = share(totals, total)
    for source, ids, p in zip(seat.sources, seat.ids, seat.shares, strict=True):
        q = of_lang[ids]
        value = np.where(p > q, (p - q) ** 2 // q, -1)
        few = len(value) > top and np.partition(value, -top)[-top]
        open_ = np.flatnonzero((value >= 0) & (value >= few))
        for low, i in heapq.nsmallest(top, zip((-value[open_]).tolist(), ids[open_].tolist(), strict=True)):
            yield source, words[i], -low


def _rows(lang: str, found: list[tuple]) -> pa.Table:
    source, part, item, value = zip(*found, strict=True) if found else ([], [], [], [])
    return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


# --- rounds


def _place(own: Column, turn: Column, blocks: Column) -> Column:
    """Whom a block meets in a round: with an even number of places, those whose sum is the round's, modulo one place less."""
    odd = blocks + blocks % 2 - 1
    other = F.pmod(turn - own, odd)
    with_last = F.pmod(turn * ((odd + 1) / 2).cast("int"), odd)
    return F.when(own == odd, with_last).when(other == own, odd).otherwise(other).cast("int")


def guests(seated: DataFrame, first: int, last: int) -> DataFrame:
    """Seats' vectors on their way to the blocks that they visit in the rounds from ``first`` to before ``last``."""
    turns = F.sequence(F.lit(first), F.least(F.lit(last), F.col("blocks") + F.col("blocks") % 2 - 1) - 1)
    sent = seated.where(F.col("blocks") + F.col("blocks") % 2 - 1 > first).withColumn("turn", F.explode(turns))
    sent = sent.withColumn("other", _place(F.col("block"), F.col("turn"), F.col("blocks"))).where("other < blocks")
    host = F.when((F.col("block") + F.col("other")) % 2 == 0, F.least("block", "other")).otherwise(F.greatest("block", "other"))
    return sent.withColumn("host", host).where("host = other").select("lang", "span", F.col("host").alias("block"), "vectors")


def _at_home(resident: pa.Table, words: pa.Table) -> pa.Table:
    own = resident.slice(0, 1).to_pylist()[0]
    seat, found = _Vectors(own["vectors"], own["size"]), []
    there, _ = differences(seat, seat, own["in_span"])
    for i, source in enumerate(seat.sources):
        found += [(source, "pair", other, int(there[i, j])) for j, other in enumerate(seat.sources) if i != j]
    if words.num_rows:
        terms, totals = _unpacked(words["words"][0].as_py())
        found += [(source, "term", term, value) for source, term, value in top_terms(seat, terms, totals, own["total"] + own["size"])]
    return _rows(own["lang"], found)


def _visited(resident: pa.Table, visitors: pa.Table) -> pa.Table:
    if not visitors.num_rows or not resident.num_rows:
        return _rows("", [])
    own, found = resident.slice(0, 1).to_pylist()[0], []
    seat = _Vectors(own["vectors"], own["size"])
    for raw in visitors["vectors"]:
        guest = _Vectors(raw.as_py(), own["size"])
        there, back = differences(seat, guest, own["in_span"])
        for i, source in enumerate(seat.sources):
            for j, other in enumerate(guest.sources):
                found += [(source, "pair", other, int(there[i, j])), (other, "pair", source, int(back[i, j]))]
    return _rows(own["lang"], found)


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, block_groups: int = BLOCK_GROUPS, range_terms: int = RANGE_TERMS, rounds_at_once: int = ROUNDS_AT_ONCE) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    counts = stored(term_counts(docs), "term-counts")
    kept = vocabulary(counts, least_docs)
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = stored(groups.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / block_groups).cast("int")), "groups")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.sum("total").alias("total"))
    langs = groups.groupBy("lang").agg((F.max("block") + 1).alias("blocks")).join(sizes, "lang", "left").fillna(0, ["size", "total"])
    langs = stored(langs.withColumn("spans", F.greatest(F.lit(1), F.ceil(F.col("size") / range_terms)).cast("int")), "languages")

    spans = kept.join(langs.select("lang", "spans"), "lang").withColumn("span", F.pmod(F.xxhash64("term"), F.col("spans")).cast("int")).drop("spans")
    words = stored(spans.withColumn("id", F.row_number().over(Window.partitionBy("lang", "span").orderBy("term")).cast("long") - 1), "vocabulary")
    entries = stored(counts.drop("docs").join(words.drop("total"), ["lang", "term"]).join(groups, ["lang", "source"]).select(*SEAT, "source", "id", "n"), "entries")

    whole = groups.join(entries.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").fillna(0, ["n"])
    in_span = words.groupBy("lang", "span").agg(F.count(F.lit(1)).alias("in_span"))
    heads = whole.join(langs, "lang").withColumn("span", F.explode(F.sequence(F.lit(0), F.col("spans") - 1))).select(*SEAT, "source", F.lit(-1).cast("long").alias("id"), "n")
    ranges = langs.withColumn("span", F.explode(F.sequence(F.lit(0), F.col("spans") - 1))).join(in_span, ["lang", "span"], "left").fillna(0, ["in_span"]).drop("spans")
    seated = stored(seats(entries.unionByName(heads)).join(ranges, ["lang", "span"]), "seats")
    residents = seated.repartition(*SEAT).persist(StorageLevel.DISK_ONLY)
    by_seat = residents.groupBy(*SEAT)

    def pack(group: pa.Table) -> pa.Table:
        order = np.argsort(group["id"].to_numpy())
        packed = _packed((group["term"].take(pa.array(order)).to_pylist(), group["total"].to_numpy()[order]))
        return pa.table({c: group[c].slice(0, 1) for c in ("lang", "span")} | {"words": pa.array([packed], pa.binary())})

    books = words.groupBy("lang", "span").applyInArrow(lambda _, group: pack(group), "lang string, span int, words binary")
    books = books.join(langs, "lang").select("lang", "span", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "words")
    found = [stored(by_seat.cogroup(books.groupBy(*SEAT)).applyInArrow(_at_home, _FOUND), "home")]
    blocks = langs.agg(F.max("blocks")).first()[0] or 0
    for first in range(0, blocks + blocks % 2 - 1, rounds_at_once):
        found.append(stored(by_seat.cogroup(guests(seated, first, first + rounds_at_once).groupBy(*SEAT)).applyInArrow(_visited, _FOUND), "round"))
    residents.unpersist()

    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = every.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    pairs, terms = (every.where(F.col("part") == part).withColumn("rank", rank) for part in ("pair", "term"))
    return pairs.unionByName(terms.where(F.col("rank") <= TOP_TERMS))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), w AS (SELECT lang, source, r, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS size, sum(total) AS total FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
n AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (
  SELECT n.lang, n.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (n.n + v.size) AS p, 1 + (1000000000::HUGEINT * (k.total + 1)) // (v.total + v.size) AS q
  FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v)
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
