"""N-gram Jaccard self-join with token-combination prefixes.

A document's tokens are its distinct shingles of ``width`` words.  Two documents link when their
Jaccard similarity is at least 4/5.  Documents with equal sets are one class and are joined once.

1. One pass over the texts gives each row's set fingerprint and counts tokens into a fixed array of
   counters, summed over all tasks.  A token whose counter stands out is *frequent*; all others are
   *rare*, and in no more classes than the counter says.
2. A second pass orders each class's tokens, rare before frequent and frequent by count, and takes the
   prefix extended by k - 1.  Linked classes share k tokens of their extended prefixes, so either a
   rare one or k frequent ones: rare tokens are indexed singly, frequent ones as k-combinations (k = 2).
   Sets of more than PLAIN tokens extend their prefixes by B, a number of buckets that grows with their
   level of size, and combine tokens of the same bucket only: linked classes share B + 1 tokens there,
   so two of them in one bucket.  A set has at most about one combination a token, however long it is.
3. Rare groups are small; their pairs pass size and position bounds inside the task that holds the
   group.  Classes with frequent tokens are first compared with the centres of a few groups only
   (stars): edits of a text bring rare tokens, so the member with the smallest share of them is the
   centre.  Combination groups whose members these links connect are left out before any row of theirs
   is dealt; of the others, pairs of different components are found inside tasks, each pair once a task.
4. Candidates are verified exactly, first by a bitmap bound that never errs, then by the sets, which a
   third pass makes for the candidates only.
5. Verified links give connected components.

Texts never move; what is shuffled are prefixes, in blobs of numpy arrays by token range, and the sets
of candidates.  The driver holds counters and a filter of fixed size.  A set is known by the 64-bit
fingerprint of its 64-bit shingle hashes.

Defined results: null and wordless texts have no tokens and link with nothing; a text of fewer words
than ``width`` has its whole sequence as one token; texts count whole; repeated rows, or ids with
several texts, each get a row; null ids are never a component's id unless there is no other; an empty
table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import wordkit as wk
from pagemill.llm.common import counter_blobs, give_back, set_aside, stored, summed_blobs, table
from pagemill.llm.components import connected_components, merged_components

WIDTH = 5
K = 2
COUNTERS = 1 << 21
FILTER_BITS = 24
#: Sets of up to so many tokens combine all tokens of their prefix; larger ones those of a bucket.
PLAIN = 64
#: Combinations of one set are emitted in rows of at most so many.
SLICE = 100_000
#: Signatures have 64 * FOLD bits at least, and are folded to so many to be compared in joins.
FOLD = 8
#: Groups in which a class with frequent tokens is compared with the centre.
STAR_KEYS = 6
#: Members of a combination's group that a task compares with one another; larger groups are cut into blocks that meet.
BLOCK = 4096
#: Members, of whatever groups, that a task holds.
MEMBERS = 250_000
_U = np.uint64


def token_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text of a column."""
    for lo, _, buf, offsets in wk.slices(column):
        words = wk.split_words(buf, offsets, wk.SPACED)
        grams, first = wk.ngrams(words.hashes(wk.LOWER), words.first, width, whole_if_short=True)
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            yield lo + i, np.unique(grams[a:b])


def fingerprint(tokens: np.ndarray) -> int:
    """A signed 64-bit number for a set."""
    m = wk.mix(tokens)
    total, other = int(m.sum()), int(np.bitwise_xor.reduce(wk.mix(m + _U(1)))) if len(m) else 0
    return int(wk.mix(np.array([(total * 0x9E3779B97F4A7C15 + other + len(tokens)) % (1 << 64)], dtype=np.uint64)).view(np.int64)[0])


def required(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | int:
    """The least intersection of linked sets of n and m tokens: 100 i >= 80 (n + m - i)."""
    return -(-80 * (n + m) // 180)


def levels(n: int) -> list[int]:
    """Levels of size at which a set of n tokens gives combinations.

    Level 0 ends at PLAIN tokens, level L at PLAIN * 2**L.  A pair meets at the level of its larger set,
    which has at most 5/4 of the smaller one's tokens.
    """
    return sorted({((size - 1) // PLAIN).bit_length() for size in (n, 5 * n // 4)})


def combinations(frequent: np.ndarray, n: int, n_rare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, p1, p2) of the combinations of a set of n tokens, ``n_rare`` of them rare.

    ``frequent``: its frequent tokens in order.  p1 and p2 are places in the whole order at level 0, and
    -1 above it, where the first combination that a pair shares need not hold its first common tokens.
    """
    base, found = n - (4 * n + 4) // 5 + 1, []
    for level in levels(n):
        buckets = PLAIN * 2**level // 8 if level else 1
        t = frequent[: max(0, min(n, base + (buckets if level else K - 1)) - n_rare)]
        if level == 0:
            i, j = np.triu_indices(len(t), 1)
            found.append((t[i], t[j], 0, i + n_rare, j + n_rare))
            continue
        bucket = (t >> _U(32)) & _U(buckets - 1)
        order = np.argsort(bucket, kind="stable")
        t, bucket = t[order], bucket[order]
        step = 1
        while len(i := np.flatnonzero(bucket[step:] == bucket[:-step])):  # no run is longer than the last one
            none = np.full(len(i), -1)
            found.append((t[i], t[i + step], level, none, none))
            step += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    key = np.concatenate([wk.mix(a * wk._PLACE[50] + b * wk._PLACE[51] + _U(level) * wk._PLACE[52:53]) for a, b, level, _, _ in found])
    return key.view(np.int64), *(np.concatenate([f[at] for f in found]).astype(np.int32) for at in (3, 4))


def signature(tokens: np.ndarray) -> bytes:
    """Parities of the tokens' bits, about one bit a token: sets differ by at least as many tokens as bits."""
    bits = max(64 * FOLD, 1 << (len(tokens) - 1).bit_length())
    flips = np.bincount((tokens & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def folded(sig: bytes) -> list[int]:
    """A signature as FOLD signed numbers."""
    x = np.frombuffer(sig, dtype=np.uint8)
    while len(x) > 8 * FOLD:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return np.ascontiguousarray(x).view(np.int64).tolist()


def signatures_differ(a: bytes, b: bytes) -> int:
    """A lower bound on the size of the symmetric difference."""
    x, y = (np.frombuffer(s, dtype=np.uint8) for s in sorted((a, b), key=len))
    while len(y) > len(x):  # parities of a shorter signature are sums of those of a longer one
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _fingerprints(docs: DataFrame, width: int, counters: int, parts: int = 16) -> DataFrame:
    """Rows (doc_id, n, node) and, in ``part``, ``width`` and ``counts``, each task's token counters."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(counters, dtype=np.uint32), set()
        names = ["doc_id", "n", "node", "part", "width", "counts"]
        ids = None
        for batch in batches:
            ids = batch.column(0)
            n, node, fresh = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int64), []
            for row, tokens in token_sets(batch.column(1), width):
                n[row], node[row] = len(tokens), fingerprint(tokens)
                if len(tokens) and int(node[row]) not in seen:  # copies count once a task
                    seen.add(int(node[row]))
                    fresh.append(tokens)
                    if len(fresh) >= 4096:
                        counts += np.bincount(np.concatenate(fresh) & _U(counters - 1), minlength=counters).astype(np.uint32)
                        fresh = []
            if fresh:
                counts += np.bincount((np.concatenate(fresh) & _U(counters - 1)).astype(np.int64), minlength=counters).astype(np.uint32)
            none = pa.nulls(len(ids), pa.int32())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(node), none, none, pa.nulls(len(ids), pa.binary())], names=names)
        if ids is not None:
            blobs = counter_blobs(counts, parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(parts, ids.type), pa.nulls(parts, pa.int32()), pa.nulls(parts, pa.int64()), *blobs.columns], names=names)
        del counts, seen
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, n int, node long, part int, width int, counts binary")


def _frequent(marked: DataFrame, counters: int) -> np.ndarray:
    """Counters, with those that don't stand out from the mean set to 0."""

    sums = summed_blobs(marked.where("part is not null").select("part", "width", "counts")).collect()  # ``counters`` numbers in all
    out = np.zeros(counters, dtype=np.uint64)
    for row in sums:
        found = np.frombuffer(row["counts"], dtype=np.uint64)
        out[row["part"] * len(found) : (row["part"] + 1) * len(found)] = found
    mean = float(out.sum()) / counters
    out[out <= mean + 8 * mean**0.5 + 16] = 0
    return np.minimum(out, (1 << 32) - 1).astype(np.uint32)


POSTING = np.dtype([("token", "<u4"), ("node", "<i8"), ("n", "<u4"), ("pos", "<u4")])
COMBINATION = "struct<c:bigint,p1:int,p2:int>"


def _prefixes(docs: DataFrame, frequent: np.ndarray, width: int, ranges: int) -> DataFrame:
    """Rows of two kinds: (range, postings) with rare tokens of prefixes, and (node, n, sig, fold, base, keys, combos) for each class a task meets."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    names = ["range", "postings", "node", "n", "sig", "fold", "base", "keys", "combos"]
    combo = pa.list_(pa.struct([("c", pa.int64()), ("p1", pa.int32()), ("p2", pa.int32())]))

    def blobs(found: list[tuple]) -> pa.RecordBatch:
        token = np.concatenate([f[0] for f in found])
        rows = np.empty(len(token), dtype=POSTING)
        rows["token"] = token & _U(0xFFFFFFFF)
        sizes = [len(f[0]) for f in found]
        rows["node"], rows["n"] = np.repeat([f[1] for f in found], sizes), np.repeat([f[2] for f in found], sizes)
        rows["pos"] = np.concatenate([f[3] for f in found])
        at = ((token >> _U(32)) * _U(ranges)) >> _U(32)
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
        data = [rows[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
        k = len(data)
        return pa.RecordBatch.from_arrays([pa.array(at[edge[:-1]].astype(np.int32)), pa.array(data, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.int32()), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, combo)], names=names)

    def lists(values: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
        """Arrays, or null, as a column of lists, from one buffer of numbers."""
        sizes = np.array([0 if v is None else len(v) for v in values])
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32(), mask=np.array([v is None for v in values] + [False]))
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([v for v in values if v is not None] or [np.zeros(0, np.int64)]), kind))

    def rows(found: list[tuple]) -> pa.RecordBatch:
        """Classes (node, n, sig, base, keys, (c, p1, p2))."""
        node, n, sig, base, keys, combos = zip(*found, strict=True)
        k = len(node)
        parts = [lists([None if c is None else c[i] for c in combos], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))]
        pairs = pa.StructArray.from_arrays([x.values for x in parts], names=["c", "p1", "p2"])
        sizes = np.array([0 if c is None else len(c[0]) for c in combos])
        edges = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32(), mask=np.array([c is None for c in combos] + [False]))
        return pa.RecordBatch.from_arrays([
            pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(sig, pa.binary()),
            pa.array([x and folded(x) for x in sig], pa.list_(pa.int64())), pa.array(base, pa.int32()), lists(list(keys), pa.int64()), pa.ListArray.from_arrays(edges, pairs),
        ], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, found, held, classes, large = shared.value, set(), [], 0, [], 0
        for batch in batches:
            for _, tokens in token_sets(batch.column(0), width):
                n, node = len(tokens), fingerprint(tokens)
                if n < 4 or node in seen:  # fewer tokens link with equal sets only
                    continue
                seen.add(node)
                weight = counts[(tokens & _U(len(counts) - 1)).astype(np.int64)]
                heavy = np.flatnonzero(weight)
                base = n - (4 * n + 4) // 5 + 1  # the first common token of linked sets is among so many of each
                rare = tokens[weight == 0] if len(heavy) else tokens
                single = rare[:base]
                if len(single):
                    found.append((single, node, n, np.arange(len(single))))
                    held += len(single)
                ordered = tokens[heavy[np.lexsort((tokens[heavy], weight[heavy]))]]
                combos = combinations(ordered, n, len(rare))
                keys = np.sort(wk.mix(ordered))[:STAR_KEYS].view(np.int64) if len(heavy) else None
                large += len(combos[0])
                classes.append((node, n, signature(tokens), len(rare), keys, tuple(c[:SLICE] for c in combos) if len(combos[0]) else None))
                for at in range(SLICE, len(combos[0]), SLICE):
                    classes.append((node, n, None, None, None, tuple(c[at : at + SLICE] for c in combos)))
                large += n // 8
                # some megabytes at a time
                if held >= 250_000:
                    yield blobs(found)
                    found, held = [], 0
                if large >= 250_000 or len(classes) >= 10_000:
                    yield rows(classes)
                    classes, large = [], 0
        if classes:
            yield rows(classes)
        if found:
            yield blobs(found)
        del seen, found, classes
        give_back()

    return docs.select("text").mapInArrow(run, f"range int, postings binary, node long, n int, sig binary, fold array<bigint>, base int, keys array<bigint>, combos array<{COMBINATION}>")


def _places(edge: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the two members of each pair of the groups edge[i]:edge[i+1], some megabytes at a time whatever a group's size."""
    size = np.diff(edge)
    for s in np.unique(size[(size > 1) & (size <= 256)]).tolist():
        begin = edge[:-1][size == s]
        i, j = np.triu_indices(s, 1)
        step = max(1, 500_000 // len(i))
        for k in range(0, len(begin), step):
            part = begin[k : k + step, None]
            yield (part + i).ravel(), (part + j).ravel()
    for a, z in zip(edge[:-1][size > 256].tolist(), edge[1:][size > 256].tolist(), strict=True):
        for at in range(a, z - 1):
            yield np.full(z - at - 1, at), np.arange(at + 1, z)


def _rare_pairs(prefixes: DataFrame) -> DataFrame:
    """(a, b, na, nb) of classes that share a rare token where size and position allow a link."""

    def pairs(group: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(b.as_buffer(), dtype=POSTING) for b in group["postings"]])
        order = np.argsort(rows["token"], kind="stable")
        token = rows["token"][order]
        edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        out = []

        for left, right in _places(edge):
            x, y = rows[order[left]], rows[order[right]]
            n, m = x["n"].astype(np.int64), y["n"].astype(np.int64)
            most = 1 + np.minimum(n - x["pos"] - 1, m - y["pos"] - 1)
            ok = (x["node"] != y["node"]) & (most >= required(n, m)) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))
            x, y = x[ok], y[ok]
            swap = x["node"] > y["node"]
            found = np.empty(len(x), dtype=[("a", "<i8"), ("b", "<i8"), ("na", "<i4"), ("nb", "<i4")])
            for f, p, q in (("a", "node", "node"), ("na", "n", "n")):
                found[f] = np.where(swap, y[p], x[q])
            for f, p in (("b", "node"), ("nb", "n")):
                found[f] = np.where(swap, x[p], y[p])
            out.append(np.unique(found))
        all_pairs = np.unique(np.concatenate(out)) if out else np.empty(0, dtype=[("a", "<i8"), ("b", "<i8"), ("na", "<i4"), ("nb", "<i4")])
        made = pa.table({f: np.ascontiguousarray(all_pairs[f]) for f in ("a", "b", "na", "nb")})
        del rows, out, order
        give_back()
        return made

    rows = prefixes.where("range is not null").select("range", "postings")
    return rows.groupBy("range").applyInArrow(pairs, "a long, b long, na int, nb int").distinct()


def _stars(classes: DataFrame) -> DataFrame:
    """(a, b, na, nb): each class with the centre of every key it has."""
    rows = classes.where("keys is not null").select("node", "n", (F.col("base") / F.col("n")).alias("rare"), F.explode("keys").alias("key"))
    hubs = rows.groupBy("key").agg(F.min(F.struct("rare", "node", "n")).alias("hub"))
    both = rows.join(hubs, "key").select("node", "n", F.col("hub.node").alias("other"), F.col("hub.n").alias("other_n")).where("node <> other")
    return both.where(F.least("n", "other_n") * 5 >= F.greatest("n", "other_n") * 4).select(*_ordered("node", "n", "other", "other_n")).distinct()


def _open(prefixes: DataFrame, components: DataFrame) -> DataFrame:
    """(c, size, node, n, p1, p2, label) of combinations that classes of several components have; above level 0, one of those with the same members.

    ``label`` is the class's component, itself if it has none.
    """
    # a class is met by many tasks; one of them counts, slice by slice, before any row of it is made
    slices = prefixes.where("combos is not null").select("node", "n", "combos", F.get("combos", F.lit(0))["c"].alias("first")).dropDuplicates(["node", "first"])
    labelled = slices.join(components.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = stored(labelled.select("node", "n", "label", F.explode("combos").alias("x")).select("x.c", "node", "n", "x.p1", "x.p2", "label"), "combinations")
    members = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"m{i}") for i in range(2)]
    ends = F.min("label").alias("low"), F.max("label").alias("high")
    groups = rows.groupBy("c").agg(F.count(F.lit(1)).alias("size"), F.max("p2").alias("p2"), *members, *ends).where("low < high")
    # copies of a long text share thousands of combinations; level 0 keeps all, as a pair's first one brings it
    once = groups.where("p2 < 0").groupBy("size", "m0", "m1").agg(F.min("c").alias("c")).select("c", "size")
    return rows.join(groups.where("p2 >= 0").select("c", "size").unionByName(once), "c")


def _ordered(a: str, na: str, b: str, nb: str) -> list:
    swap = F.col(a) > F.col(b)
    return [F.when(swap, F.col(b)).otherwise(F.col(a)).alias("a"), F.when(swap, F.col(a)).otherwise(F.col(b)).alias("b"), F.when(swap, F.col(nb)).otherwise(F.col(na)).alias("na"), F.when(swap, F.col(na)).otherwise(F.col(nb)).alias("nb")]


def _between_components(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, na, nb): pairs of a combination's group that no links connect yet, within size, position and bitmap bounds."""
    ranges = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // MEMBERS + 1)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("node", "c"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("cell", F.xxhash64("c", F.least("own", "other"), F.greatest("own", "other")))
    dealt = dealt.select(F.pmod("cell", F.lit(ranges)).cast("int").alias("range"), "cell", "node", "n", "p1", "p2", "label")
    folds = dealt.select("range", "node").distinct().join(classes.select("node", "fold"), "node").toDF("node_", "range_", "fold")

    def pairs(members: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known["node_"].to_numpy())
        nodes = known["node_"].to_numpy()[order]
        fold = known["fold"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, FOLD)[order]  # bits of unsigned numbers: those of a negative one are counted by its absolute value
        order = np.argsort(members["cell"].to_numpy(), kind="stable")
        cell, node, n, p1, p2, label = (members[c].to_numpy()[order] for c in ("cell", "node", "n", "p1", "p2", "label"))
        at, n = np.searchsorted(nodes, node), n.astype(np.int64)
        size_of = np.zeros(len(nodes), np.int64)
        size_of[at] = n
        edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        codes, found, held = [], [], 0

        def near() -> np.ndarray:
            code = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]))
            kept = [np.zeros(0, np.int64)]
            for part in np.array_split(code, len(code) // 500_000 + 1):
                x, y = np.divmod(part, len(nodes))
                differ = np.bitwise_count(fold[x] ^ fold[y]).sum(axis=1, dtype=np.int64)
                kept.append(part[(size_of[x] + size_of[y] - differ) // 2 >= required(size_of[x], size_of[y])])
            return np.concatenate(kept)

        for x, y in _places(edge):
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            # of all combinations of level 0 that two classes share, that of their first two common tokens has the widest bound
            most = np.minimum(np.minimum(n[x] - p2[x], n[y] - p2[y]) + 1, np.minimum(n[x] - p1[x], n[y] - p1[y]))
            ok = (5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y])) & (most >= required(n[x], n[y]))
            x, y = at[x[ok]], at[y[ok]]
            codes.append(np.unique(np.minimum(x, y) * len(nodes) + np.maximum(x, y)))
            held += len(codes[-1])
            if held > 4_000_000:
                found.append(near())
                codes, held = [], 0
        a, b = np.divmod(np.unique(np.concatenate([*found, near()])), max(1, len(nodes)))
        made = pa.table({"a": nodes[a], "b": nodes[b], "na": size_of[a].astype(np.int32), "nb": size_of[b].astype(np.int32)})
        give_back()
        return made

    return dealt.groupBy("range").cogroup(folds.groupBy("range_")).applyInArrow(pairs, "a long, b long, na int, nb int").distinct()


def _bitmap(nodes: DataFrame, bits: int) -> np.ndarray:
    """A fixed-size filter: True at each node's place."""
    slot = F.col("node").bitwiseAND((1 << bits) - 1)
    places = nodes.select(F.shiftright(slot, bits - 8).cast("int").alias("part"), slot.bitwiseAND((1 << (bits - 8)) - 1).cast("int").alias("at"))

    def fill(group: pa.Table) -> pa.Table:
        block = np.zeros(1 << (bits - 8), dtype=np.uint8)
        block[group["at"].to_numpy()] = 1
        return pa.table({"part": group["part"].slice(0, 1), "block": pa.array([np.packbits(block).tobytes()], pa.binary())})

    out = np.zeros((256, (1 << (bits - 8)) // 8), dtype=np.uint8)
    for row in places.groupBy("part").applyInArrow(fill, "part int, block binary").collect():  # 2**bits bits
        out[row["part"]] = np.frombuffer(row["block"], dtype=np.uint8)
    return out.ravel()


def _sets_of(docs: DataFrame, nodes: DataFrame, width: int, bits: int = FILTER_BITS) -> DataFrame:
    """(node, tokens) of the classes in ``nodes``; a filter keeps most other sets out before the join."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(nodes, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = np.unpackbits(shared.value).astype(bool), set()
        for batch in batches:
            found, sets = [], []
            for _, tokens in token_sets(batch.column(0), width):
                node = fingerprint(tokens)
                if wanted[node & ((1 << bits) - 1)] and node not in seen:
                    seen.add(node)
                    found.append(node)
                    sets.append(tokens.tobytes())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sets, pa.binary())], names=["node", "tokens"])

    return docs.select("text").mapInArrow(run, "node long, tokens binary").dropDuplicates(["node"])


def _near(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) that their signatures don't rule out."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch["na"].to_numpy().astype(np.int64), batch["nb"].to_numpy().astype(np.int64)
            differ = np.array([signatures_differ(x.as_py(), y.as_py()) for x, y in zip(batch["sig_a"], batch["sig_b"], strict=True)], dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((na + nb - differ) // 2 >= required(na, nb)))

    sig_a, sig_b = (signatures.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    return pairs.join(sig_a, "a").join(sig_b, "b").select("a", "b", "na", "nb", "sig_a", "sig_b").mapInArrow(near, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["tokens_a"], batch["tokens_b"], strict=True):
                p, q = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * common >= 80 * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    set_a, set_b = (sets.select(F.col("node").alias(x), F.col("tokens").alias(f"tokens_{x}")) for x in "ab")
    return pairs.join(set_a, "a").join(set_b, "b").select("a", "b", "tokens_a", "tokens_b").mapInArrow(linked, "a long, b long")


def jaccard_links(docs: DataFrame, width: int = WIDTH, counters: int = COUNTERS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, links, components): rows (doc_id, n, node), links (a, b) between nodes, components (node, component).

    ``links`` holds enough of the links to connect every component: within a combination's group, pairs
    that others already connect are not compared.
    """
    spark = docs.sparkSession
    marked = stored(_fingerprints(docs, width, counters), "fingerprints")
    rows = marked.where("part is null").select("doc_id", "n", "node")
    frequent = _frequent(marked, counters)
    # about a quarter of the tokens are posted; a range holds some million postings
    tokens = rows.agg(F.sum("n")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(tokens // 4_000_000) + 1)
    prefixes = stored(_prefixes(docs, frequent, width, ranges), "prefixes")
    classes = prefixes.where("sig is not null").select("node", "n", "sig", "fold", "base", "keys").dropDuplicates(["node"])
    close = stored(_near(_rare_pairs(prefixes).unionByName(_stars(classes)).distinct(), classes), "close")
    wanted = close.select(F.explode(F.array("a", "b")).alias("node")).union(prefixes.where("combos is not null").select("node")).distinct()
    sets = stored(_sets_of(docs, wanted, width).join(wanted, "node", "left_semi"), "sets")
    links = stored(_linked(close, sets), "links")
    components = connected_components(links)
    rest = stored(_open(prefixes, components), "open")
    if rest.limit(1).count():
        found = stored(_linked(_near(_between_components(rest, classes), classes), sets), "links")
        links, components = links.unionByName(found).distinct(), merged_components(components, found)
    return rows, links, components


def classes_with_components(rows: DataFrame, components: DataFrame) -> DataFrame:
    """(node, first_id, component, component_id): each class's smallest doc_id, its component's node and smallest doc_id."""
    classes = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    labelled = classes.join(components, "node", "left")
    least = labelled.where("component is not null").groupBy("component").agg(F.min("first_id").alias("component_id"))
    return labelled.join(least, "component", "left").select("node", "first_id", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "first_id").alias("component_id"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, components = jaccard_links(table(spark, sf_dir, "documents").select("doc_id", "text"))
    classes = classes_with_components(rows, components)
    out = rows.join(classes, "node", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def with_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with __set_size and __set_node, the size and fingerprint of each row's set."""
    docs = docs.drop("__set_size", "__set_node")
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for row, tokens in token_sets(batch.column(at), width):
                n[row], node[row] = len(tokens), fingerprint(tokens)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(node)], names=[*names, "__set_size", "__set_node"])
        give_back()

    return docs.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["__set_size int", "__set_node long"]))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest doc_id, null if there is no other; rows without words all stay.

    A component is known by its node: texts that don't link stay, whether their ids are null or the same.
    """
    docs, back = set_aside(docs, "doc_id", "text")
    names = docs.columns
    rows, _, components = jaccard_links(docs)
    classes = classes_with_components(rows, components)
    chosen = classes.where("first_id <=> component_id").groupBy("component").agg(F.min("node").alias("__set_node"), F.min("first_id").alias("__id")).select("__id", "__set_node")
    times = rows.where("n > 0").groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("__times")).select(F.col("doc_id").alias("__id2"), F.col("node").alias("__node2"), "__times")
    chosen = chosen.join(times, chosen["__id"].eqNullSafe(times["__id2"]) & (chosen["__set_node"] == times["__node2"])).select("__id", "__set_node", "__times")
    marked = with_sets(docs)
    found = marked.join(chosen, marked["doc_id"].eqNullSafe(F.col("__id")) & (marked["__set_node"] == chosen["__set_node"]), "left")
    kept = stored(found.where((F.col("__set_size") == 0) | F.col("__times").isNotNull()).select(*[marked[c] for c in names], marked["__set_node"].alias("__key"), F.when(F.col("__set_size") > 0, F.col("__times")).alias("__times")), "kept")
    once = kept.where("__times is null or __times = 1").select(*names)
    return back(once.unionByName(kept.where("__times > 1").dropDuplicates(["doc_id", "__key"]).select(*names)))
