"""Quality rules: surface counts, and a hashed n-gram log-likelihood ratio of trusted to raw text.

Words and word pairs are hashed to 2**bits bins.  Two multinomials over the bins are counted over
all documents: one of every document, one of the documents that the label table trusts, but for a
quarter of them, chosen by hash.  A text's score is the mean over its n-grams of
log p_trusted - log p_raw.  The threshold is the score that all but ``trusted_loss`` of that quarter
reach, which the counts haven't seen; it is found from a histogram of their scores.

Two or three maps over the texts and no shuffle of texts: tasks emit bin counts in a few blobs, and
the sums, 2**bits numbers for each multinomial, are what the driver reads.  Trusted ids are broadcast
up to ``broadcast_ids`` (8 bytes each); beyond that they are joined by shuffle.

Defined results: null, empty and wordless texts have no words and fail the base rules; repeated
rows are each counted and judged; without trusted documents every score is 0 and the threshold
lets it pass; an empty table gives no rows.  Input columns named like an output are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import wordkit as wk
from pagemill.llm.common import counter_blobs, is_training, one_label, summed_blobs, table

SIGNS = b"#*$%&|<>"
WINDOW = 8
_SIGN = np.zeros(256, dtype=bool)
_SIGN[list(SIGNS)] = True
_NOT_NEWLINE = wk._table(b"\n")
BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean"


def _repeated(keys: np.ndarray) -> np.ndarray:
    """For each key whether it occurs twice or more."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    return np.isin(keys, twice) if len(twice) else np.zeros(len(keys), dtype=bool)


def base_counts(buf: np.ndarray, offsets: np.ndarray) -> tuple[wk.Words, np.ndarray, dict[str, np.ndarray]]:
    """The words, their hashes and the base counts of each text of a slice."""
    words = wk.split_words(buf, offsets, wk.SPACED)
    h, text, n = words.hashes(), words.text, len(offsets) - 1
    lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    signs = np.concatenate([[0], np.cumsum(_SIGN[buf])])

    grams, first = wk.ngrams(h, words.first, WINDOW)
    owner = np.repeat(np.arange(n), np.diff(first))
    again = np.flatnonzero(_repeated(grams ^ wk.mix(owner.astype(np.uint64))))
    cover = np.zeros(len(h) + 1, dtype=np.int64)
    at = words.first[owner[again]] + again - first[owner[again]]
    cover[at] += 1
    np.subtract.at(cover, at + WINDOW, 1)
    covered = np.cumsum(cover[:-1]) > 0

    lines = wk.split_words(buf, offsets, _NOT_NEWLINE)
    with_word = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    start, end, line_text = lines.start[with_word], lines.end[with_word], lines.text[with_word]
    key = wk.span_hashes(buf, start, end) ^ wk.mix(line_text.astype(np.uint64))
    _, earliest = np.unique(key, return_index=True)
    distinct = np.bincount(line_text[earliest], minlength=n)
    return words, h, {
        "n_words": words.counts,
        "word_chars": np.bincount(text, weights=lead[words.end] - lead[words.start], minlength=n).astype(np.int64),
        "n_symbols": signs[offsets[1:]] - signs[offsets[:-1]],
        "n_dup_lines": np.bincount(line_text, minlength=n) - distinct,
        "n_repeat_words": np.bincount(text[covered], minlength=n),
    }


def _bins(h: np.ndarray, first: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, text) of the words and word pairs."""
    shift, text = np.uint64(64 - bits), np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs, pair_first = wk.ngrams(h, first, 2)
    return np.concatenate([wk.mix(h) >> shift, pairs >> shift]).astype(np.int64), np.concatenate([text, np.repeat(np.arange(len(first) - 1), np.diff(pair_first))])


@dataclass(frozen=True)
class RatioModel:
    """ratio: log p_trusted - log p_raw of each bin; kept texts score ``threshold`` or more."""

    ratio: np.ndarray
    threshold: float
    bits: int


def count_bins(marked: DataFrame, bits: int, parts: int = 16) -> np.ndarray:
    """counts[0]: of all texts, counts[1]: of the trusted.  ``marked`` has text and trusted."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << bits), dtype=np.int64)
        for batch in batches:
            trusted = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, buf, offsets in wk.slices(batch.column(0)):
                words = wk.split_words(buf, offsets, wk.SPACED)
                index, text = _bins(words.hashes(), words.first, bits)
                counts[0] += np.bincount(index, minlength=1 << bits)
                counts[1] += np.bincount(index[trusted[lo:hi][text]], minlength=1 << bits)
        yield counter_blobs(counts.T.ravel().astype(np.uint64), parts)

    sums = summed_blobs(marked.select("text", "trusted").mapInArrow(tally, "part int, width int, counts binary"))
    out = np.zeros((2, 1 << bits), dtype=np.int64)
    for row in sums.collect():  # 2 * 2**bits numbers in all
        width = (1 << bits) // parts
        out[:, row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["counts"], dtype=np.int64).reshape(width, 2).T
    return out


def fit_ratio(docs: DataFrame, trusted_ids: DataFrame, bits: int = 17, smoothing: float = 1.0, trusted_loss: float = 0.002, broadcast_ids: int = 1_000_000) -> RatioModel:
    """Learn ratio and threshold.  ``trusted_ids``: distinct doc_id of the trusted documents."""
    few = trusted_ids.count() <= broadcast_ids
    ids = trusted_ids.select("doc_id", (F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(4)) > 0).alias("trusted"))
    unseen = ids.where("not trusted")
    ids, unseen = (F.broadcast(ids), F.broadcast(unseen)) if few else (ids, unseen)
    rows = docs.select("doc_id", "text")
    counts = count_bins(rows.join(ids, "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted")), bits)
    if not counts[1].any():
        return RatioModel(np.zeros(1 << bits, np.float32), -math.inf, bits)
    log = [np.log((c + smoothing) / (c.sum() + smoothing * len(c))) for c in counts]
    model = RatioModel((log[1] - log[0]).astype(np.float32), -math.inf, bits)
    bins = judge(rows.join(unseen, "doc_id"), model).where("not base_failed").groupBy(F.floor(F.col("llr") * 1000).alias("bin")).count().collect()  # |llr| is under 50: at most 100,000 bins
    left = trusted_loss * sum(r["count"] for r in bins)
    threshold = -math.inf
    for row in sorted(bins, key=lambda r: r["bin"]):
        threshold = row["bin"] / 1000
        if row["count"] > left:
            break
        left -= row["count"]
    return RatioModel(model.ratio, threshold, bits)


def judge(docs: DataFrame, model: RatioModel, text: str = "text") -> DataFrame:
    """``docs`` with the base counts, base_failed, llr and kept."""
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
    shared = docs.sparkSession.sparkContext.broadcast(model.ratio)
    at, names, bits, threshold = docs.columns.index(text), docs.columns, model.bits, model.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {}
            for lo, hi, buf, offsets in wk.slices(batch.column(at)):
                words, h, counts = base_counts(buf, offsets)
                index, owner = _bins(h, words.first, bits)
                total = np.bincount(owner, weights=shared.value[index], minlength=hi - lo)
                counts["base_failed"] = (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])
                counts["llr"] = total / np.maximum(np.bincount(owner, minlength=hi - lo), 1)
                counts["kept"] = ~counts["base_failed"] & (counts["llr"] >= threshold)
                for k, v in counts.items():
                    found.setdefault(k, []).append(v)
            if found:
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.concatenate(v)) for v in found.values())], names=[*names, *found])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, {BASE}, llr double, kept boolean")


def trusted(labels: DataFrame, condition: Column) -> DataFrame:
    return one_label(labels, condition.cast("int")).where("label = 1").where(is_training()).select("doc_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_ratio(docs, trusted(table(spark, sf_dir, "labels"), F.col("quality") >= 1))
    return judge(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
