"""Sparse linear models on hashed text, learnt with FTRL-proximal steps.

Features are distinct hashed word n-grams and skip-grams of a text.  Each
training document makes one step on the coordinates it has: every coordinate
has its own learning rate, and the L1 term leaves most weights at exactly zero.
The loss enters only by its derivative to the linear score, so the logistic
model (op2) and the ordinal model (op10) share this module.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import wordkit as wk
from pagemill.llm.common import give_back

_U = np.uint64


@dataclass(frozen=True)
class Features:
    """How texts become features.

    bits: log2 of the number of weights.  orders: lengths of word n-grams.
    skips: gaps g, for pairs of words with g words between them.  shapes: also
    the share of words of each surface shape (letters, digits, signs, repeats).
    """

    bits: int = 20
    orders: tuple[int, ...] = (1, 2)
    skips: tuple[int, ...] = (1,)
    lower: bool = True
    alnum: bool = True
    shapes: bool = False

    def of_slice(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[wk.Words, list[tuple[np.ndarray, np.ndarray]]]:
        """The words, and for each kind of feature (index, text number), repeats included."""
        fold = wk.LOWER if self.lower else wk.SAME
        if self.alnum:
            words = wk.split_words(wk.LOWER[buf], offsets, wk.ALNUM)
        else:
            words = wk.split_words(buf, offsets, wk.SPACED)
        h, text, shift = words.hashes(fold), words.text, _U(64 - self.bits)
        out = []
        for n in self.orders:
            g, first = wk.ngrams(h, words.first, n)
            out.append(((wk.mix(g + _U(n)) >> shift).astype(np.int64), np.repeat(np.arange(len(first) - 1), np.diff(first))))
        for gap in self.skips:
            step = gap + 1
            same = text[step:] == text[:-step]
            g = wk.mix(h[:-step][same] * wk._PLACE[40] + h[step:][same] * wk._PLACE[41 + gap])
            out.append(((g >> shift).astype(np.int64), text[:-step][same]))
        return words, out

    def shape_shares(self, words: wk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, text number, value): the share of a text's words that have a shape, times 8."""
        shape = _shapes(words)
        again = np.zeros(len(shape), dtype=bool)
        if len(shape) > 1:
            h = words.hashes(wk.LOWER)
            again[1:] = (h[1:] == h[:-1]) & (words.text[1:] == words.text[:-1])
        shape = np.where(again, _U(12345), shape)
        index = (wk.mix(shape + _U(99)) >> _U(64 - self.bits)).astype(np.int64)
        key = words.text * np.int64(1 << self.bits) + index
        unique, count = np.unique(key, return_counts=True)
        text = unique >> self.bits
        return unique & ((1 << self.bits) - 1), text, 8.0 * count / np.maximum(words.counts, 1)[text]


#: Byte to kind: signs stand for themselves, letters for their case, digits for one digit.
_KIND = np.array([97 if b >= 0x80 or 97 <= b <= 122 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)], dtype=np.uint8)


def _shapes(words: wk.Words) -> np.ndarray:
    """A hash of each word's runs of kinds: ``THE!!`` and ``AND!`` have the same shape."""
    kind = _KIND[words.buf]
    new = np.ones(len(kind), dtype=bool)
    new[1:] = kind[1:] != kind[:-1]
    new[words.start] = True
    place = np.cumsum(new)
    up, down = wk._power(len(kind) + 2)
    run = np.zeros(len(kind) + 1, dtype=np.uint64)
    np.cumsum(np.where(new, wk._BYTE[kind] * up[place], _U(0)), out=run[1:])
    return wk.mix((run[words.end] - run[words.start]) * down[place[words.start]] if len(words.start) else np.zeros(0, np.uint64))


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 0.1
    epochs: int = 3


def documents(features: Features, column: pa.Array) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(indices, values, first): text i has indices[first[i]:first[i+1]], in small types; values are None where all are 1.

    A few large arrays instead of many small ones: a worker gives them back when it is done.
    """
    indices, values, firsts, done = [np.zeros(0, np.int32)], [np.zeros(0, np.float16)], [np.zeros(1, np.int64)], 0
    for _, _, buf, offsets in wk.slices(column):
        words, kinds = features.of_slice(buf, offsets)
        index, text = np.concatenate([k[0] for k in kinds]), np.concatenate([k[1] for k in kinds])
        key = np.unique(text * np.int64(1 << features.bits) + index)
        index, text = key & ((1 << features.bits) - 1), key >> features.bits
        if features.shapes:
            i, t, v = features.shape_shares(words)
            value = np.ones(len(index))
            order = np.argsort(np.concatenate([text, t]), kind="stable")
            index, value, text = np.concatenate([index, i])[order], np.concatenate([value, v])[order], np.concatenate([text, t])[order]
            values.append(value.astype(np.float16))
        indices.append(index.astype(np.int32))
        firsts.append(done + np.searchsorted(text, np.arange(1, len(offsets))))
        done += len(index)
    return np.concatenate(indices), np.concatenate(values) if features.shapes else None, np.concatenate(firsts)


def fit(features: Features, ftrl: Ftrl, column: pa.Array, labels: np.ndarray, slope: Callable[[float, int], float], start: float | None) -> tuple[np.ndarray, np.ndarray, float]:
    """(index, weight, bias) after ``epochs`` passes over one shard, in the given order.

    slope(score, label) is the loss's derivative to the score; it may learn
    parameters of its own.  The bias starts at ``start`` and is a coordinate
    without penalty; with None there is none.
    """
    size = 1 << features.bits
    z, n = np.zeros(size), np.zeros(size)
    bias, bias_n = start or 0.0, 1.0
    indices, values, first = documents(features, column)
    spans = list(zip(first[:-1].tolist(), first[1:].tolist(), labels.tolist(), strict=True))
    for _ in range(ftrl.epochs):
        for low, high, label in spans:
            index, value = indices[low:high], None if values is None else values[low:high]
            zi, root = z[index], np.sqrt(n[index])
            w = np.where(np.abs(zi) <= ftrl.l1, 0.0, (np.sign(zi) * ftrl.l1 - zi) / ((ftrl.beta + root) / ftrl.alpha + ftrl.l2))
            g = slope(bias + float(w.sum() if value is None else w @ value), label)
            step = g if value is None else g * value
            ni = n[index] + step * step
            z[index] = zi + step - (np.sqrt(ni) - root) / ftrl.alpha * w
            n[index] = ni
            bias_n += g * g
            bias -= 0.1 * g / bias_n**0.5 if start is not None else 0.0
    live = np.flatnonzero(np.abs(z) > ftrl.l1)
    weight = (np.sign(z[live]) * ftrl.l1 - z[live]) / ((ftrl.beta + np.sqrt(n[live])) / ftrl.alpha + ftrl.l2)
    return live, weight, bias


def linear_scores(features: Features, weights: np.ndarray, bias: float, column: pa.Array) -> np.ndarray:
    """The linear score of every text of a column."""
    out = np.full(len(column), bias)
    live = weights != 0
    for lo, hi, buf, offsets in wk.slices(column):
        words, kinds = features.of_slice(buf, offsets)
        found = []
        for index, text in kinds:
            hit = live[index]
            found.append(text[hit] * np.int64(1 << features.bits) + index[hit])
        key = np.unique(np.concatenate(found))
        total = np.bincount(key >> features.bits, weights=weights[key & ((1 << features.bits) - 1)], minlength=hi - lo)
        if features.shapes:
            i, t, v = features.shape_shares(words)
            total = total + np.bincount(t, weights=weights[i] * v, minlength=hi - lo)
        out[lo:hi] += total
    return out


#: An index that no feature or parameter has.
ANSWERED = -(1 << 60)


def fit_shards(sample: DataFrame, rows: int, per_shard: int, learn: Callable[[pa.Array, np.ndarray], dict[int, float]]) -> dict[int, float]:
    """Mean over the shards of what ``learn(texts, labels)`` gives for each index.

    ``sample`` has doc_id, text, label.  A shard is at most about ``per_shard`` rows,
    chosen by hash and learnt from in hash order, in one task; only non-zero
    weights, as many as the feature space has at most, come to the driver.
    """
    shards = max(1, -(-rows // per_shard))

    def one(group: pa.Table) -> pa.Table:
        order = np.lexsort((group["doc_id"].to_numpy(), group["at"].to_numpy()))
        group = group.take(order)
        texts, labels = group["text"].combine_chunks(), group["label"].to_numpy()
        del group
        found = learn(texts, labels) | {ANSWERED: 1.0}
        del texts
        give_back()
        return pa.table({"index": pa.array(list(found), pa.int64()), "weight": pa.array(list(found.values()), pa.float64())})

    at = sample.select("doc_id", "text", "label", F.xxhash64(F.lit("order"), "doc_id").alias("at"))
    parts = at.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards))).groupBy("shard").applyInArrow(one, "index long, weight double")
    sums = {r["index"]: r["weight"] for r in parts.groupBy("index").agg(F.sum("weight").alias("weight")).collect()}
    answered = sums.pop(ANSWERED, 0.0)  # a shard may have no row: its labelled ids may have no document
    return {index: weight / answered for index, weight in sums.items()}


def dense(found: dict[int, float], bits: int) -> np.ndarray:
    weights = np.zeros(1 << bits)
    index = np.array([i for i in found if i >= 0], dtype=np.int64)
    weights[index] = [found[i] for i in index.tolist()]
    return weights.astype(np.float32)


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
