"""Training-order materialisation: token sequences of fixed length in a keyed random order.

1. One map over the documents tokenises, ends every document with ``eos``, and cuts each task's
   token stream into sequences of ``seq_len``; only a task's last one is padded.  The rows are
   written once to the shared folder, with the task's number and the place in it, so the numbering
   can't change when a task runs again.
2. A sequence's index is its task's base, from the sequence counts of the tasks, plus its place.
3. A keyed Feistel network over the next power of four, walked until the value falls below the
   number of sequences, turns the index into a global slot: a permutation that needs no sort and
   no table.
4. Slots are dealt out by range, in one shuffle, sorted within; ``write_shards`` writes
   ``shard_rows`` records of the same byte length to each shard, so slot s is at record
   s mod shard_rows of shard s div shard_rows, and a reader resumes by seeking.

The driver holds one number for each task.  Defined results: null and empty texts are one ``eos``;
ids that the
layout's type can't hold are an error; repeated rows are tokenised each; an empty table gives no rows; a null doc_id is listed as null; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import wordkit as wk
from pagemill.llm.common import give_back, stored, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
EOS = 50256
SEQ_LEN = 2048
SHARD_ROWS = 4096
#: Shards that a task sorts at most, some 1 GB of the default layout.
SHARDS_AT_ONCE = 64
KEY = "order-1"


class Encoder:
    """Token ids of whole slices; each different piece of a slice is encoded once.

    Pieces start at a space before a character that surely isn't white space.  The
    pattern never joins across such a place, so the ids are those of the whole text.
    """

    #: Lead bytes of the UTF-8 forms of white space outside ASCII.
    _MAYBE_SPACE = np.array([b in b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \xc2\xe1\xe2\xe3" for b in range(256)])

    def __init__(self, ranks: bytes, pattern: str, most_cached: int = 500_000):
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.widths = np.zeros(max(merges.values()) + 1, dtype=np.int64)
        for token, rank in merges.items():
            self.widths[rank] = len(token)
        self.most = most_cached
        self._forget()

    def _forget(self) -> None:
        """What is learnt: hashes of pieces in order, and for each its ids, as length[i] numbers from flat[at[i]] on."""
        self.known, self.at, self.length, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _learn(self, hashes: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Encode pieces in one call: joined, those with a leading space keep their borders.  ``hashes`` are in order and not known."""
        raw = buf.tobytes()
        pieces = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        spaced = [i for i, p in enumerate(pieces) if p[:1] == b" " and p[1:2].strip()]
        try:
            ids = np.array(self.encoding.encode_ordinary(b"".join(pieces[i] for i in spaced).decode()), dtype=np.int32)
        except UnicodeDecodeError:
            spaced, ids = [], np.zeros(0, np.int32)
        ends = np.cumsum(self.widths[ids])
        borders = np.concatenate([[0], np.searchsorted(ends, np.cumsum([len(pieces[i]) for i in spaced])) + 1])
        at, length, flat, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int32), [self.flat, ids], len(self.flat) + len(ids)
        at[spaced], length[spaced] = len(self.flat) + borders[:-1], np.diff(borders)
        for i in sorted(set(range(len(pieces))).difference(spaced)):
            flat.append(np.array(self.encoding.encode_ordinary(pieces[i].decode("utf-8", "replace")), dtype=np.int32))
            at[i], length[i] = size, len(flat[-1])
            size += len(flat[-1])
        place = np.searchsorted(self.known, hashes)
        self.known, self.at, self.length = np.insert(self.known, place, hashes), np.insert(self.at, place, at), np.insert(self.length, place, length)
        self.flat = np.concatenate(flat)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """Where these stand among the known ones, -1 for others."""
        place = np.searchsorted(self.known, hashes)
        found = place < len(self.known)
        found[found] = self.known[place[found]] == hashes[found]
        return np.where(found, place, -1)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        n = len(buf)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
        cut = np.zeros(n + 1, dtype=bool)
        cut[: n - 1] = (buf[:-1] == 32) & ~self._MAYBE_SPACE[buf[1:]]
        border = np.zeros(n + 1, dtype=bool)
        border[offsets] = True
        cut[: n - 1] &= ~border[1:n]  # the space ends its text
        cut |= border
        start = np.flatnonzero(cut[:n])
        end = np.append(start[1:], n)
        hashes, which, inverse = np.unique(wk.span_hashes(buf, start, end), return_index=True, return_inverse=True)
        if len(self.known) > self.most or len(self.flat) > 8 * self.most:
            self._forget()
        missing = np.flatnonzero(self._places(hashes) < 0)
        if len(missing):
            self._learn(hashes[missing], buf, start[which[missing]], end[which[missing]])
        place = self._places(hashes)
        at, length = self.at[place], self.length[place].astype(np.int64)
        taken = length[inverse]
        before = np.cumsum(taken) - taken
        ids = self.flat[np.repeat(at[inverse] - before, taken) + np.arange(int(taken.sum()))]
        return ids, wk.sums(taken, np.searchsorted(start, offsets))


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(ranks: bytes, pattern: str) -> Encoder:
    """A worker builds an encoder once and keeps what it has learnt for its next tasks."""
    key = (hashlib.sha256(ranks).hexdigest(), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


@dataclass(frozen=True)
class Layout:
    """Records are seq_len ids of ``dtype``, little-endian, and a line feed."""

    seq_len: int = SEQ_LEN
    dtype: str = "<u2"
    shard_rows: int = SHARD_ROWS

    @property
    def stride(self) -> int:
        return self.seq_len * np.dtype(self.dtype).itemsize + 1


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The vocabulary file, from the driver's disk or any path that Spark reads."""
    if os.path.exists(path):
        with open(path, "rb") as file:
            return file.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def sequences(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN, eos: int = EOS, layout: Layout = Layout(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(part, pos, n_tokens, doc_ids, tokens): each task's stream in sequences; lazily, not yet stored."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(docs.sparkSession, tokenizer))
    size, dtype, widest = layout.seq_len, layout.dtype, np.iinfo(layout.dtype).max
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, done = None, 0
        tokens, owners, ends = np.zeros(0, dtype), None, np.zeros(0, np.int64)

        def rows(n: int, filled: int | None = None) -> pa.RecordBatch:
            edges = np.arange(n + 1) * size
            low = np.searchsorted(ends, edges[:-1], side="right")
            high = np.minimum(np.searchsorted(ends, edges[1:] - 1, side="right") + 1, len(ends))
            count = high - low
            index = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), owners.take(pa.array(index)))
            data = np.ascontiguousarray(tokens[: n * size]).tobytes()
            width = size * np.dtype(dtype).itemsize
            offsets = pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes())
            payload = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(data)])
            filled_rows = np.full(n, size, np.int32)
            if filled is not None:
                filled_rows[-1] = filled
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(done, done + n)), pa.array(filled_rows), lists, payload], names=["part", "pos", "n_tokens", "doc_ids", "tokens"])

        for batch in batches:
            encoder = encoder or _encoder(ranks.value, pattern)
            for lo, hi, buf, offsets in wk.slices(batch.column(0)):
                ids, counts = encoder.encode(buf, offsets)
                stop = np.cumsum(counts)
                ids = np.insert(ids, stop, eos)
                if ids.max(initial=0) > widest:
                    raise ValueError(f"token id {ids.max()} does not fit {dtype}")
                ends = np.concatenate([ends, len(tokens) + stop + np.arange(1, len(stop) + 1)])
                tokens = np.concatenate([tokens, ids.astype(dtype)])
                new = batch.column(1).slice(lo, hi - lo)
                owners = new if owners is None else pa.concat_arrays([owners, new])
                # a batch of some megabytes at a time
                while len(tokens) >= size:
                    n = min(len(tokens) // size, max(1, (8 << 20) // size))
                    yield rows(n)
                    done += n
                    tokens = tokens[n * size :]
                    gone = int(np.searchsorted(ends, n * size, side="right"))
                    owners, ends = owners.slice(gone), ends[gone:] - n * size
        if len(tokens):
            filled = len(tokens)
            tokens = np.concatenate([tokens, np.full(size - filled, eos, dtype)])
            yield rows(1, filled)
        del tokens, owners, ends
        give_back()

    return docs.select(text, doc_id).mapInArrow(run, f"part int, pos long, n_tokens int, doc_ids array<{kind}>, tokens binary")


class Permutation:
    """A keyed permutation of 0..n-1: six Feistel rounds on 2h bits, walked until below n."""

    def __init__(self, n: int, key: str, rounds: int = 6):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}|{i}".encode()).digest()[:8], "little")) for i in range(rounds)]

    def _once(self, x: np.ndarray) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for k in self.keys:
            left, right = right, left ^ (wk.mix(right ^ k) & mask)
        return (left << half) | right

    def __call__(self, index: np.ndarray) -> np.ndarray:
        out = self._once(index.astype(np.uint64))
        outside = np.flatnonzero(out >= self.n)
        while len(outside):
            out[outside] = self._once(out[outside])
            outside = outside[out[outside] >= self.n]
        return out.astype(np.int64)


def slot_column(counts: dict[int, int], key: str) -> Column:
    """The slot of (part, pos), given the number of sequences of each part."""
    parts = np.array(sorted(counts), dtype=np.int64)
    sizes = np.array([counts[p] for p in parts.tolist()], dtype=np.int64)
    total = int(sizes.sum())
    shared = SparkSession.getActiveSession().sparkContext.broadcast((parts, np.cumsum(sizes) - sizes))  # 16 bytes for each task

    @F.pandas_udf("long")
    def slot(part: pd.Series, pos: pd.Series) -> pd.Series:
        parts, bases = shared.value
        index = bases[np.searchsorted(parts, part.to_numpy())] + pos.to_numpy()
        return pd.Series(Permutation(total, key)(index))

    return slot("part", "pos")


def training_order(seqs: DataFrame, key: str = KEY, layout: Layout = Layout()) -> DataFrame:
    """``seqs`` (stored) with slot, shard and byte_offset, in partitions of consecutive shards, by slot."""
    counts = {r["part"]: r["n"] for r in seqs.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each task
    shards = max(1, -(-sum(counts.values()) // layout.shard_rows))
    # as many tasks as the session asks for, and more where one would sort more than SHARDS_AT_ONCE
    parts = max(1, min(shards, max(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards // SHARDS_AT_ONCE))))
    placed = seqs.withColumn("slot", slot_column(counts, key)).withColumn("shard", F.floor(F.col("slot") / layout.shard_rows))
    placed = placed.withColumn("byte_offset", (F.col("slot") % layout.shard_rows) * layout.stride)
    ordered = placed.repartitionById(parts, F.floor(F.col("shard") * parts / shards).cast("int")).sortWithinPartitions("shard", "slot")
    return ordered.select("slot", "shard", "byte_offset", "n_tokens", "doc_ids", "tokens")


def write_shards(ordered: DataFrame, path: str) -> None:
    """``path``/shard=N/part-*: the shard's records in slot order, one file each, to any path that Spark writes."""
    ordered.select("shard", F.col("tokens").cast("string").alias("value")).write.partitionBy("shard").text(path)


def read_records(file: str, first: int, count: int, layout: Layout = Layout()) -> np.ndarray:
    """Records first..first+count of a shard file (a local path), by one seek and one read."""
    with open(file, "rb") as f:
        f.seek(first * layout.stride)
        data = np.frombuffer(f.read(count * layout.stride), dtype=np.uint8).reshape(-1, layout.stride)
    return np.ascontiguousarray(data[:, :-1]).view(layout.dtype)


def materialise(docs: DataFrame, layout: Layout = Layout(), path: str | None = None) -> DataFrame:
    """Sequences in training order.

    With ``path`` the token table is written there, and a later run that finds it whole reads it
    instead of tokenising again, so that its order is the same whatever the split of its input.
    """
    seqs = sequences(docs, layout=layout)
    if path is None:
        return training_order(stored(seqs, "sequences"), layout=layout)
    spark = docs.sparkSession
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        seqs.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return training_order(spark.read.schema(seqs.schema).parquet(path), layout=layout)


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = materialise(table(spark, sf_dir, "documents"))
    return out.withColumn("tokens_sha256", F.sha2("tokens", 256))


def order_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the corpus as token sequences in training order.

    Only doc_id and text are read: null and empty texts are one ``eos``, null ids stay null in doc_ids, equal
    rows are tokenised each, ties of order don't occur, and an empty table gives no sequences.
    """
    return materialise(docs)
