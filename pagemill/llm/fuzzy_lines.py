"""Fuzzy line deduplication: SimHash, keys, edit similarity, one occurrence for each group.

A line is normalised to its lower-case words (ASCII digits all become 0) with one space between; lines
of fewer than ``min_words`` words are left alone.  Different normalised lines link when their edit
distance is at most a fifth of the longer one's length and they are candidates: features of a line are
its pairs of neighbouring words (the first one paired with the line's begin), candidates share one of
ten MinHash keys of these, and their SimHashes differ in at most BITS bits.  Of all occurrences of
a connected group of lines, the one with the smallest (doc_id, line number, text hash) stays.

Blocks of SimHash bits alone can't be the keys: similar lines differ in up to some 18 of 64 bits, and
blocks that all such pairs share would be three bits wide (figures in the README).

1. One pass over the texts emits a row of numbers for each line and, where a task meets a line
   first, its key, SimHash and normalised text.  Equal normalised lines are one class.
2. Classes meet by key range, in numpy blobs, inside a task: each class is paired with that near
   one that has most near ones itself, so there are few pairs whatever a group's size.  Counters tell keys
   that may have more than CROWD classes; these stay rows, and give stars.
3. Pairs are verified by edit distance: by bounds from common ends and aligned words first.
4. Verified pairs connect; then near classes of one key that are still in different components meet
   in a task with their texts, a row for each class and key, and are verified there, so no link between
   components is lost and no pair is a row.
5. Lines of classes that occur often or are in a component are compared by place, all others stay out
   of that; the removed line numbers are joined back to the documents.

A class is known by the 64-bit hash of its normalised line.  Defined results: null and empty texts have
no lines to remove and stay as they are; equal lines of one document count like those of two; rows with
equal id and equal text keep the same lines, while a null or repeated id with several texts is several
documents, told apart by a 64-bit hash of the whole text; texts and lines count whole; an empty table
gives no rows.  Columns named like an output are replaced.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import let
from pagemill.llm import simhash as sh
from pagemill.llm import wordkit as wk
from pagemill.llm.common import counter_blobs, give_back, stored, summed_blobs, table
from pagemill.llm.components import connected_components, merged_components
from pagemill.llm.setjoin import _bitmap

MIN_WORDS = 1
CROWD = 4096
FILTER_BITS = 24
#: 2 to this power is the most counters of keys, 32 MB in a task.  Past 16 keys a counter a key is taken
#: for crowded when its counter is, so a crowd is found up to 8 deviations of a counter late.
COUNTER_BITS = 22
#: Postings of a range, some 45 MB.
RANGE_ROWS = 2_000_000
#: Classes of a key that are compared in one task, and more than the most such blocks of a key.
BLOCK, PIECES = 1024, 64
_U = np.uint64
_FOLD = np.array([48 if 48 <= b <= 57 else wk.LOWER[b] for b in range(256)], dtype=np.uint8)
#: key: the low half of a key; the high half chose the range.  chars: length, 65,535 at most.
POSTING = np.dtype([("key", "<u4"), ("node", "<i8"), ("hash", "<u8"), ("chars", "<u2")])
LABELLED = np.dtype([*POSTING.descr, ("label", "<i8")])
KEYS = [f"keys{i}" for i in range(sh.BANDS // 2)]
CLASS = ["hash", "chars", *KEYS]


def lines_of(buf: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[wk.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For lines of enough words: (words, their hashes, first word, word after the last, text, line number, class)."""
    words, breaks = wk.split_words(_FOLD[buf], offsets, wk.ALNUM), np.flatnonzero(buf == 10)
    ends = np.searchsorted(breaks, offsets)  # breaks before each text
    first = ends + np.arange(len(offsets))  # a text has a line more than breaks
    border = np.sort(np.concatenate([breaks, offsets]))
    edge = np.searchsorted(words.start, border)
    low, high = edge[:-1], edge[1:]
    ok = np.flatnonzero(high - low >= min_words)
    low, high, text = low[ok], high[ok], np.searchsorted(first, ok, side="right") - 1
    number = ok - first[text]
    h = words.hashes()
    up, down = wk._power(len(h) + 2)
    run = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[: len(h)], out=run[1:])
    node = wk.mix((run[high] - run[low]) * down[low] + (high - low).astype(np.uint64)).view(np.int64)
    return words, h, low, high, text, number, node


def _gather(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers low[i]..high[i] one after the other, and where each run begins."""
    n = high - low
    first = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(low - first[:-1], n) + np.arange(int(first[-1])), first


def _normalised(words: wk.Words, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """The words low[i]..high[i] of each line with one space between, as binary."""
    inside = wk.ALNUM[words.buf]
    kept = inside.copy()
    kept[1:] |= inside[:-1]  # the byte after a word is the space
    kept = np.flatnonzero(kept)
    out = np.where(inside, words.buf, np.uint8(32))[kept]
    edges = np.searchsorted(kept, np.stack([words.start[low], words.end[high - 1]], axis=1).ravel()).astype(np.int32)  # lines and what is between them
    spans = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(out)])
    return spans.take(pa.array(np.arange(0, len(edges) - 1, 2)))


def _class_columns(words: wk.Words, h: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """hash, chars and KEYS of lines."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[low] = _U(1)
    taken, first = _gather(low, high)
    features = wk.mix(before[taken] * wk._PLACE[0] + h[taken] * wk._PLACE[1])
    lead = np.concatenate([[0], np.cumsum((words.buf & 0xC0) != 0x80)])
    run = np.concatenate([[0], np.cumsum(lead[words.end] - lead[words.start] + 1)])
    chars = np.minimum(run[high] - run[low] - 1, 65_535).astype(np.int32)
    keys = np.ascontiguousarray(sh.band_keys(features, first)).view(np.int64)
    return [sh.simhashes(features, first).view(np.int64), chars, *np.ascontiguousarray(keys.T)]


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text_hash, line, node, hash, chars, KEYS, norm): a row for each line of enough words; lines count from 0.

    hash, chars, KEYS and norm are null where the task has met the class before.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_hash", "line", "node", *CLASS, "norm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, buf, offsets in wk.slices(batch.column(2), wk.SLICE_BYTES // 2):  # small enough for memory that is used again
                words, h, low, high, text, number, node = lines_of(buf, offsets, min_words)
                if not len(node):
                    continue
                fresh = np.array([x not in seen and seen.add(x) is None for x in node.tolist()])
                at = pa.array(np.where(fresh, np.cumsum(fresh) - 1, 0), mask=~fresh)
                made = [pa.array(x) for x in _class_columns(words, h, low[fresh], high[fresh])] if fresh.any() else [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), *[pa.nulls(1, pa.int64())] * len(KEYS)]
                norm = _normalised(words, low[fresh], high[fresh]) if fresh.any() else pa.nulls(1, pa.binary())
                owner = [batch.column(i).slice(lo, hi - lo).take(pa.array(text)) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*owner, pa.array(number.astype(np.int32)), pa.array(node), *(x.take(at) for x in (*made, norm))], names=names)
        del seen
        give_back()

    schema = f"doc_id {kind}, text_hash long, line int, node long, hash long, chars int, {', '.join(f'{k} long' for k in KEYS)}, norm binary"
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def _keys(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """A row of 64-bit keys for each class; different bands have different ones."""
    packed = np.stack([batch[k].to_numpy() for k in KEYS], axis=1).view(np.uint32)
    return wk.mix(packed.astype(np.uint64) | np.arange(sh.BANDS, dtype=np.uint64) << _U(32))


def _crowded(classes: DataFrame, n: int, counters: int, parts: int = 16) -> np.ndarray:
    """Bits, for each counter whether keys that fall on it may have more than CROWD of the ``n`` classes."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(counters, dtype=np.int64), [], 0
        for batch in batches:
            held.append((_keys(batch).ravel() & _U(counters - 1)).astype(np.int64))
            size += len(held[-1])
            if size > counters:  # an array of all counters is made for so many keys, not for each batch
                counts, held, size = counts + np.bincount(np.concatenate(held), minlength=counters), [], 0
        yield counter_blobs(counts + np.bincount(np.concatenate([*held, np.zeros(0, np.int64)]), minlength=counters), parts)

    mean = n * sh.BANDS / counters
    most = mean + 8 * mean**0.5 + CROWD

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(np.frombuffer(x.as_buffer(), dtype=np.uint64) > most).tobytes() for x in batch["counts"]]
            yield pa.RecordBatch.from_arrays([batch["part"], pa.array(bits, pa.binary())], names=["part", "bits"])

    sums = summed_blobs(classes.select(*KEYS).mapInArrow(tally, "part int, width int, counts binary"))
    out = np.zeros((parts, counters // parts // 8), dtype=np.uint8)
    for row in sums.mapInArrow(pack, "part int, bits binary").collect():  # ``counters`` bits in all
        out[row["part"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out.ravel()


def _postings(classes: DataFrame, crowded: np.ndarray, ranges: int, labelled: bool = False) -> DataFrame:
    """(range, postings) of ordinary keys and (key, node, hash, chars) of crowded ones; ``labelled`` classes have a label too."""
    kind = LABELLED if labelled else POSTING
    shared = classes.sparkSession.sparkContext.broadcast(crowded)
    names = ["range", "postings", "key", "node", "hash", "chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            key = _keys(batch)
            width = key.shape[1]
            key = key.ravel()
            rows = np.empty(len(key), dtype=kind)
            rows["key"], rows["node"] = key & _U(0xFFFFFFFF), np.repeat(batch["node"].to_numpy(), width)
            rows["hash"], rows["chars"] = np.repeat(batch["hash"].to_numpy().view(np.uint64), width), np.repeat(batch["chars"].to_numpy(), width)
            if labelled:
                rows["label"] = np.repeat(batch["label"].to_numpy(), width)
            many = hot[(key & _U(len(hot) - 1)).astype(np.int64)]
            few = rows[~many]
            at = ((key[~many] >> _U(32)) * _U(ranges)) >> _U(32)
            order = np.argsort(at, kind="stable")
            few, at = few[order], at[order]
            if len(few):
                edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
                data = [few[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                k = len(data)
                yield pa.RecordBatch.from_arrays([pa.array(at[edge[:-1]].astype(np.int32)), pa.array(data, pa.binary()), *[pa.nulls(k, pa.int64())] * 3, pa.nulls(k, pa.int32())], names=names)
            if many.any():
                k, more = int(many.sum()), rows[many]
                columns = [key[many].view(np.int64), more["node"].copy(), more["hash"].copy().view(np.int64), more["chars"].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), *map(pa.array, columns)], names=names)

    return classes.select("node", *CLASS, *["label"] * labelled).mapInArrow(run, "range int, postings binary, key long, node long, hash long, chars int")


def _near_pairs(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (x, y) of near classes under one key; some megabytes at a time, whatever a group's size.  ``rows`` are sorted by key."""
    key, hashes, chars = rows["key"], np.ascontiguousarray(rows["hash"]), rows["chars"].astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(edge)

    def near(x: np.ndarray, y: np.ndarray | int) -> np.ndarray:
        close = np.bitwise_count(hashes[x] ^ hashes[y]) <= sh.BITS
        return close & (5 * np.abs(chars[x] - chars[y]) <= np.maximum(chars[x], chars[y]))

    for s in np.unique(size[(size > 1) & (size <= 64)]).tolist():
        begin = edge[:-1][size == s]
        i, j = np.triu_indices(s, 1)
        step = max(1, 1_000_000 // len(i))
        for k in range(0, len(begin), step):
            part = begin[k : k + step, None]
            x, y = (part + i).ravel(), (part + j).ravel()
            ok = near(x, y)
            yield x[ok], y[ok]
    for a, z in zip(edge[:-1][size > 64].tolist(), edge[1:][size > 64].tolist(), strict=True):
        for x in range(a, z - 1):
            y = np.flatnonzero(near(np.arange(x + 1, z), x)) + x + 1
            if len(y):
                yield np.full(len(y), x), y


def _pairs_of_ranges(postings: DataFrame) -> DataFrame:
    """(a, b) of near classes under a common ordinary key: each class with the one of most near ones that it meets."""

    def pairs(group: pa.Table) -> pa.Table:
        rows = _rows_of(group["postings"], POSTING)
        nodes, at = np.unique(rows["node"], return_inverse=True)
        degree = np.zeros(len(nodes), np.int64)
        for x, y in _near_pairs(rows):
            for ends in (x, y):
                np.add.at(degree, at[ends], 1)
        order = np.argsort(-degree, kind="stable")  # nodes with most near ones first
        nodes, at = nodes[order], np.argsort(order)[at]
        least = np.arange(len(nodes))
        beyond = np.full(len(nodes), len(nodes))  # the first near one after it
        for x, y in _near_pairs(rows):
            low, high = np.minimum(at[x], at[y]), np.maximum(at[x], at[y])
            np.minimum.at(least, high, low)
            np.minimum.at(beyond, low, high)
        moved = np.flatnonzero(least < np.arange(len(nodes)))
        centres = np.flatnonzero((least == np.arange(len(nodes))) & (beyond < len(nodes)))  # some are nobody's choice
        ends = np.concatenate([np.stack([least[moved], moved], axis=1), np.stack([centres, beyond[centres]], axis=1)])
        a, b = nodes[ends[:, 0]], nodes[ends[:, 1]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    rows = postings.where("range is not null").select("range", "postings")
    return rows.groupBy("range").applyInArrow(pairs, "a long, b long").distinct()


def _rows_of(postings: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    """The postings of keys of several classes, sorted by key and node, each once: several tasks may have met a class."""

    def met(key: np.ndarray) -> np.ndarray:
        same = key[1:] == key[:-1]
        return np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(key) else np.zeros(0, np.int64)

    rows = np.concatenate([np.frombuffer(b.as_buffer(), dtype=kind) for b in postings])
    key = np.ascontiguousarray(rows["key"])
    order = np.argsort(key)
    rows = rows[order[met(key[order])]]  # most keys are one class's: these aren't sorted by node
    rows = rows[np.lexsort((rows["node"], rows["key"]))]
    again = (rows["key"][1:] == rows["key"][:-1]) & (rows["node"][1:] == rows["node"][:-1])
    rows = rows[np.append(True, ~again)] if len(rows) else rows
    return rows[met(rows["key"])]


def _members(postings: DataFrame) -> DataFrame:
    """(range, piece, key, block, node, label): a row for each ordinary key of a class that has a near one with another label there.

    More than BLOCK classes of a key are dealt into blocks, and each two blocks are a piece of their own, so that no task compares all.
    """

    def apart(group: pa.Table) -> pa.Table:
        rows = _rows_of(group["postings"], LABELLED)
        wanted = np.zeros(len(rows), dtype=bool)
        for x, y in _near_pairs(rows):
            other = rows["label"][x] != rows["label"][y]
            wanted[x[other]] = wanted[y[other]] = True
        rows = rows[wanted]
        _, first, size = np.unique(rows["key"], return_index=True, return_counts=True)
        block = (np.arange(len(rows)) - np.repeat(first, size)) // BLOCK
        blocks = np.repeat(-(-size // BLOCK), size)
        taken, _ = _gather(np.zeros_like(blocks), blocks)
        index = np.repeat(np.arange(len(rows)), blocks)
        piece = np.minimum(block[index], taken) * PIECES + np.maximum(block[index], taken)
        rows = rows[index]
        columns = [np.full(len(rows), group["range"][0].as_py(), np.int32), piece, rows["key"].astype(np.int64), block[index], rows["node"].copy(), rows["label"].copy()]
        return pa.table(dict(zip(("range", "piece", "key", "block", "node", "label"), columns, strict=True)))

    rows = postings.where("range is not null").select("range", "postings")
    return rows.groupBy("range").applyInArrow(apart, "range int, piece long, key long, block long, node long, label long")


def _links_of_members(members: DataFrame, classes: DataFrame, crowded: np.ndarray) -> DataFrame:
    """(a, b) of near classes with different labels, within edit distance; each two are compared under the first ordinary key that they share."""
    shared = members.sparkSession.sparkContext.broadcast(crowded)

    def links(group: pa.Table) -> pa.Table:
        group = group.sort_by("key").combine_chunks()
        rows = np.zeros(len(group), dtype=LABELLED)
        for name in ("key", "node", "chars", "label"):
            rows[name] = group[name].to_numpy()
        rows["hash"] = group["hash"].to_numpy().view(np.uint64)
        hot = np.unpackbits(shared.value).astype(bool)
        keys, block, piece = _keys(group), group["block"].to_numpy(), group["piece"][0].as_py()
        ordinary, norm, found = ~hot[(keys & _U(len(hot) - 1)).astype(np.int64)], group["norm"].combine_chunks(), [np.zeros((0, 2), np.int64)]
        held, size = [], 0

        def verify() -> None:
            some = np.concatenate([np.zeros((0, 2), np.int64), *held])
            held.clear()
            for lo in range(0, len(some), SOME):
                x, y = some[lo : lo + SOME].T
                close = all_similar(*([t.decode("utf-8", "replace") for t in norm.take(pa.array(at)).to_pylist()] for at in (x, y)))
                found.append(np.sort(np.stack([rows["node"][x[close]], rows["node"][y[close]]], axis=1), axis=1))

        for x, y in _near_pairs(rows):
            ok = rows["label"][x] != rows["label"][y]
            ok &= np.minimum(block[x], block[y]) * PIECES + np.maximum(block[x], block[y]) == piece
            x, y = x[ok], y[ok]
            common = (keys[x] == keys[y]) & ordinary[x]
            own = common.any(axis=1) & ((keys[x, common.argmax(axis=1)] & _U(0xFFFFFFFF)) == rows["key"][x])
            held.append(np.stack([x[own], y[own]], axis=1))
            size += int(own.sum())
            if size >= SOME or len(held) >= SOME:
                verify()
                size = 0
        verify()
        ends = np.concatenate(found)
        return pa.table({"a": ends[:, 0].copy(), "b": ends[:, 1].copy()})

    rows = members.join(classes.select("node", *CLASS, "norm"), "node")
    return rows.groupBy("range", "piece").applyInArrow(links, "a long, b long")


def _among(rows: DataFrame, nodes: DataFrame, bits: int) -> DataFrame:
    """The rows of these nodes and of a few others; a filter of fixed size keeps most out before a shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(_bitmap(nodes, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(wanted[batch["node"].to_numpy() & ((1 << bits) - 1)]))

    return rows.mapInArrow(run, rows.schema)


def _classes_of(lines: DataFrame, nodes: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(node, CLASS, norm) of these classes and a few others."""
    found = lines.where("hash is not null").select("node", *CLASS, "norm")
    return _among(found, nodes, bits).dropDuplicates(["node"])


def edit_distance_within(a: str, b: str, most: int) -> int:
    """The edit distance of two strings, or some number over ``most`` if it is over it.

    Common ends don't count; for what is between, Myers' bit vectors, a column of the table in an integer.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    head = len(os.path.commonprefix((a, b)))
    a, b = a[head:], b[head:]
    tail = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b, strict=True):
        equal = places.get(c, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        rise, fall = down | (~(horizontal | up) & full), up & horizontal
        distance += 1 if rise & top else -1 if fall & top else 0
        if distance - left > most:
            return most + 1
        rise, fall = (rise << 1 | 1) & full, (fall << 1) & full
        up, down = fall | (~(vertical | rise) & full), rise & vertical
    return distance


def aligned_cost(a: list[str], b: list[str], most: int) -> int:
    """What it costs to change one list of words into the other by one of many ways: no less than the edit distance; over ``most``, some number over it."""
    i = j = cost = 0
    while i < len(a) and j < len(b) and cost <= most:
        if a[i] == b[j]:
            i, j = i + 1, j + 1
        elif i + 1 < len(a) and a[i + 1] == b[j] and not (j + 1 < len(b) and a[i + 1] == b[j + 1]):
            cost, i = cost + len(a[i]) + 1, i + 1
        elif j + 1 < len(b) and a[i] == b[j + 1] and not (i + 1 < len(a) and a[i + 1] == b[j + 1]):
            cost, j = cost + len(b[j]) + 1, j + 1
        else:
            cost, i, j = cost + max(len(a[i]), len(b[j])), i + 1, j + 1
    return cost + sum(len(x) + 1 for x in a[i:]) + sum(len(x) + 1 for x in b[j:])


def similar(a: str, b: str) -> bool:
    """Whether the edit distance is at most a fifth of the longer length."""
    most = max(len(a), len(b)) // 5
    if abs(len(a) - len(b)) > most:
        return False
    return aligned_cost(a.split(" "), b.split(" "), most) <= most or edit_distance_within(a, b, most) <= most


#: Pairs whose cells are worked out at once, and pairs of texts that these are chosen from.
AT_ONCE, SOME = 512, 4000
#: Lengths, common ends aside, from which a pair's distance is worked out alone, in bit vectors.
LONG = 4000


def _table_of(texts: list[np.ndarray], height: int, kind: type, reverse: bool) -> np.ndarray:
    """A column for each text, padded with 0, or 1 in front if they are to be reversed."""
    out = np.full((len(texts), height), int(reverse), dtype=kind)
    for row, text in zip(out, texts, strict=True):
        row[: len(text)] = text
    return np.ascontiguousarray(out[:, ::-1].T if reverse else out.T)


def _cells_within(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Whether pairs of texts, none empty, are within edit distances: the table's diagonals one after the other, a column of cells for each pair."""
    a, b = zip(*((x, y) if len(x) >= len(y) else (y, x) for x, y in zip(a, b, strict=True)), strict=True)
    sizes, flat = [len(x) for x in (*a, *b)], np.concatenate([*a, *b])
    if (top := int(flat.max())) >= 254:
        codes, flat = np.unique(flat, return_inverse=True)
        top = len(codes)
    kind = np.uint8 if top < 254 else np.uint16 if top < 65_000 else np.uint32
    pieces = np.split((flat + 2).astype(kind), np.cumsum(sizes)[:-1])
    high, wide = max(map(len, a)), max(map(len, b))
    down, across = _table_of(pieces[: len(a)], high, kind, False), _table_of(pieces[len(a) :], wide, kind, True)
    rows, total = np.array([len(x) for x in a]), np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])
    lengths, longer = set(total.tolist()), 2 * rows - total
    result, own = np.zeros(len(a), dtype=bool), np.arange(len(a))
    left, right = int((most - longer).max()) // 2, int((most + longer).max()) // 2  # a way off by more can't come back
    # cell (i, k - i) of diagonal k is at place i + 1; numbers from ``far`` on stand for all distances over ``most``, and around what is in the band
    cell, far = (np.uint8, 222) if most.max() < 200 else (np.uint16, 60_000)
    most = most.astype(cell)
    last, before, new, sums = (np.full((high + 2, len(a)), far, dtype=cell) for _ in range(4))
    steps = np.empty(new.shape, dtype=bool)
    last[1] = 0
    for k in range(1, int(total.max()) + 1):
        lo, hi = max(0, k - wide, (k - left + 1) // 2), min(high, k, (k + right) // 2)
        cells = new[lo + 1 : hi + 2]
        np.minimum(last[lo + 1 : hi + 2], last[lo : hi + 1], out=cells)
        cells += cell(1)
        i, j = max(lo, 1), min(hi, k - 1)
        if i <= j:
            step, diagonal, inner = steps[: j - i + 1], sums[: j - i + 1], new[i + 1 : j + 2]
            np.not_equal(down[i - 1 : j], across[wide - k + i : wide - k + j + 1], out=step)
            np.add(before[i : j + 1], step.view(np.uint8), out=diagonal)
            np.minimum(inner, diagonal, out=inner)
        new[lo] = far
        if hi + 2 < len(new):
            new[hi + 2] = far
        if k in lengths:
            at = np.flatnonzero(total == k)
            result[own[at]] = new[rows[at] + 1, at] <= most[at]
        before, last, new = last, new, before
        if k % 32 == 0:
            # every way crosses one of two neighbouring diagonals
            alive = (np.minimum(last[lo + 1 : hi + 2].min(axis=0), before[lo + 1 : hi + 2].min(axis=0)) <= most) & (total > k)
            if not alive.any():
                break
            if 4 * alive.sum() <= 3 * len(alive):
                down, across, last, before, new, sums, steps = (np.ascontiguousarray(x[:, alive]) for x in (down, across, last, before, new, sums, steps))
                rows, total, own, most = rows[alive], total[alive], own[alive], most[alive]
            for x in (last, before):  # no number passes the type's largest in 32 diagonals
                x[x > far] = far
    return result


def all_similar(a: list[str], b: list[str]) -> np.ndarray:
    """``similar`` of many pairs: those that aligned words don't settle are worked out together, by length."""
    result, open_ = np.zeros(len(a), dtype=bool), []
    for at, (x, y) in enumerate(zip(a, b, strict=True)):
        most = max(len(x), len(y)) // 5
        if abs(len(x) - len(y)) > most:
            continue
        if aligned_cost(x.split(" "), y.split(" "), most) <= most:
            result[at] = True
            continue
        u, v = (np.frombuffer(t.encode("utf-32-le"), dtype="<u4") for t in (x, y))
        n = min(len(u), len(v))
        differ = np.flatnonzero(u[:n] != v[:n])
        head = int(differ[0]) if len(differ) else n
        u, v, n = u[head:], v[head:], n - head
        differ = np.flatnonzero(u[len(u) - n :] != v[len(v) - n :])
        tail = n - 1 - int(differ[-1]) if len(differ) else n
        u, v = u[: len(u) - tail], v[: len(v) - tail]
        if max(len(u), len(v)) <= most:
            result[at] = True
        elif max(len(u), len(v)) > LONG:
            result[at] = edit_distance_within(x, y, most) <= most
        elif len(u) and len(v):
            open_.append((at, len(u) + len(v), u, v, most))
    open_.sort(key=lambda x: (x[-1], x[1]))
    while open_:
        # such as differ little in size, or the largest sets what all of them cost
        first = bisect.bisect_left(open_, open_[-1][-1] * 3 // 4, key=lambda x: x[-1])
        first = max(min(first, len(open_) - AT_ONCE // 8), len(open_) - AT_ONCE, 0)
        some = open_[first:]
        del open_[first:]
        at, _, u, v, most = zip(*some, strict=True)
        result[list(at)] = _cells_within(u, v, np.array(most))
    return result


def _verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) within edit distance."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SOME):
                part = batch.slice(lo, SOME)
                keep = all_similar(*([x.decode("utf-8", "replace") for x in part[c].to_pylist()] for c in ("norm_a", "norm_b")))
                yield part.select(["a", "b"]).filter(pa.array(keep))

    a, b = (classes.select(F.col("node").alias(x), F.col("norm").alias(f"norm_{x}")) for x in "ab")
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "norm_a", "norm_b").mapInArrow(close, "a long, b long")


def line_groups(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lines, components): lines (doc_id, text_hash, line, node, ...); components (node, component) of linked classes."""
    # no value of these columns repeats much
    lines = stored(line_table(docs, min_words), "lines", {f"parquet.enable.dictionary#{c}": "false" for c in ("node", "hash", *KEYS, "norm")})
    fresh = lines.where("hash is not null").select("node", *CLASS)
    n = fresh.count()
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * sh.BANDS // RANGE_ROWS + 1)
    # some sixteen keys a counter, up to a number that a task holds whatever the corpus
    counters = 1 << min(COUNTER_BITS, max(16, (n * sh.BANDS // 16).bit_length()))
    crowded = _crowded(fresh, n, counters)
    postings = _postings(fresh, crowded, ranges)
    pairs = stored(_pairs_of_ranges(postings), "line-pairs")
    wanted, hot = pairs.select(F.explode(F.array("a", "b")).alias("node")), None
    if crowded.any():
        hot = postings.where("key is not null").select("key", "node", "hash", "chars").distinct()
        hot = stored(hot.join(hot.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "key"), "line-crowd")
        wanted = wanted.union(hot.select("node"))
    classes = stored(_classes_of(lines, wanted), "line-classes")
    components = connected_components(stored(_verified(pairs, classes), "line-links"))
    label = classes.join(components.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    members = stored(_members(_postings(label, crowded, ranges, labelled=True)), "line-members")
    components = _merged(components, _links_of_members(members, classes, crowded))
    if hot is not None:
        components = _more(components, _crowd_pairs(hot, components, stars=True), classes)
        components = _more(components, _crowd_pairs(hot, components, stars=False), classes)
    return lines, components


def _crowd_pairs(hot: DataFrame, components: DataFrame, stars: bool) -> DataFrame:
    """(a, b) of near classes under a crowded key that are in different components: with one class of the key only, or all."""
    label = hot.join(components.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = label.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    rows = stored(label.join(mixed, "key"), "line-crowd")
    columns = ["node", "hash", "chars", "label"]
    if stars:
        hub = rows.groupBy("key").agg(F.min(F.struct(*columns)).alias("hub"))
        other = rows.join(hub, "key").select("*", *[F.col(f"hub.{c}").alias(f"{c}_") for c in columns])
    else:
        other = rows.join(rows.select("key", *[F.col(c).alias(f"{c}_") for c in columns]), "key").where(F.col("node") < F.col("node_"))
    near = F.bit_count(F.col("hash").bitwiseXOR(F.col("hash_"))) <= sh.BITS
    near &= 5 * F.abs(F.col("chars") - F.col("chars_")) <= F.greatest("chars", "chars_")
    apart = other.where((F.col("label") != F.col("label_")) & near)
    return apart.select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b")).distinct()


def _more(components: DataFrame, candidates: DataFrame, classes: DataFrame) -> DataFrame:
    return _merged(components, _verified(candidates, classes))


def _merged(components: DataFrame, links: DataFrame) -> DataFrame:
    links = stored(links, "line-links")
    return merged_components(components, links) if links.limit(1).count() else components


def removed_lines(lines: DataFrame, components: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, text_hash, removed): for documents that lose lines, the sorted numbers of those."""
    # most classes are one line and in no component: they take no part in what compares places
    often = lines.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    groups = often.join(components, "node", "full").select("node", F.coalesce("component", "node").alias("component"))
    groups = stored(groups, "line-groups")
    places = _among(lines.select("doc_id", "text_hash", "line", "node"), groups, bits)
    places = stored(places.join(groups, "node").drop("node"), "line-places")
    place = F.struct("doc_id", "line", "text_hash")
    kept = places.groupBy("component").agg(F.min(place).alias("kept"))
    gone = places.join(kept, "component").where(~place.eqNullSafe(F.col("kept")))
    return gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``removed`` (line numbers from 0) and ``deduped``, the text without those lines."""
    docs = docs.drop("removed", "deduped")
    gone = removed_lines(*line_groups(docs, min_words)).withColumnsRenamed({"doc_id": "__id", "text_hash": "__text"})
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__text"))
    joined = docs.join(gone.hint("shuffle_hash"), same, "left").drop("__id", "__text").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    # set operations and places, so that the work is in proportion to the lines
    kept = lambda own: F.array_except(F.sequence(F.lit(0), F.size(own) - 1), "removed")
    rest = let(F.split("text", "\n"), lambda own: F.array_join(F.transform(kept(own), lambda i: F.get(own, i)), "\n"))
    return joined.withColumn("deduped", F.when(F.size("removed") == 0, F.col("text")).otherwise(rest))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    return out.select("doc_id", n_lines.cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed", F.sha2("deduped", 256).alias("deduped_sha256"))
