"""Vectorised word work on Arrow string columns.

The operators that look at every word of every text run these functions inside
``mapInArrow`` tasks.  A column is handled as one byte buffer with offsets, in
slices of about a megabyte, so no Python object is made for a text or a word.
Nulls have no bytes and so no words.  One text is never cut: a slice holds at
least one whole text, and memory is a fixed multiple of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random 64-bit value for each byte value.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
#: Odd multipliers for the places of an n-gram.
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)


def _table(separators: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words of ``[^\x20\x09-\x0D]+``.
SPACED = _table(b" \t\n\x0b\x0c\r")
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z.
ALNUM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
SAME = np.arange(256, dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves about half of the output's."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if len(_powers.get("up", ())) < n:
        n = max(n, SLICE_BYTES + 1)
        up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up), np.cumprod(down)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of a slice: byte spans [start, end), and for text i the words first[i]..first[i+1]."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """For each word the number of its text in the slice."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, fold: np.ndarray = SAME) -> np.ndarray:
        """64-bit hashes of the words, bytes mapped by ``fold`` first."""
        return span_hashes(self.buf, self.start, self.end, fold)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """64-bit hashes of byte spans from one running polynomial over the buffer."""
    up, down = _power(len(buf) + 1)
    run = np.zeros(len(buf) + 1, dtype=np.uint64)
    values = _BYTE[fold][buf]
    values *= up[: len(buf)]
    np.cumsum(values, out=run[1:])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of slices of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, dtype=np.int64 if wide else np.int32, count=n + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def split_words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACED) -> Words:
    """Maximal runs of bytes that ``inside`` admits; no run crosses the border of two texts."""
    n = len(buf)
    mask = inside[buf]
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    outside = np.ones(n + 1, dtype=bool)
    np.logical_not(mask, out=outside[1:])
    start = np.flatnonzero(mask & (outside[:n] | border[:n]))
    outside[:n] = outside[1:]
    outside[n] = True
    # outside[i] now tells of byte i; a word ends where the next byte is outside or another text's
    end = np.flatnonzero(mask & (outside[1 : n + 1] | border[1 : n + 1])) + 1
    return Words(buf, offsets, start, end, np.searchsorted(start, offsets))


def ngrams(words: np.ndarray, first: np.ndarray, n: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the n-grams of each text's words; n-gram j of a text starts at its word j.

    With ``whole_if_short`` a text of fewer words, but not none, has its whole
    sequence as its only gram.
    """
    counts = np.diff(first)
    grams = np.maximum(counts - n + 1, 0)
    total = len(words)
    if total >= n:
        h = words[: total - n + 1] * _PLACE[0]
        for k in range(1, n):
            h += words[k : total - n + 1 + k] * _PLACE[k]
        h = mix(h)
    else:
        h = np.zeros(0, np.uint64)
    keep = np.ones(total, dtype=bool)
    texts = np.repeat(np.arange(len(counts)), counts)
    keep &= np.arange(total) - first[texts] < grams[texts]
    out = h[keep[: len(h)]] if len(h) else h
    if whole_if_short:
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            owner = np.concatenate([np.repeat(np.arange(len(counts)), grams), short])
            own = np.array([int(mix(np.array([sum(int(w) * int(_PLACE[k]) for k, w in enumerate(words[first[i] : first[i + 1]])) % (1 << 64) ^ int(counts[i])], dtype=np.uint64))[0]) for i in short], dtype=np.uint64)
            order = np.argsort(owner, kind="stable")
            out = np.concatenate([out, own])[order]
            grams = grams.copy()
            grams[short] = 1
    return out, np.concatenate([[0], np.cumsum(grams)])


def ordered_unique(hashes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs, by text and then by hash."""
    if not len(hashes):
        return hashes, texts
    order = np.lexsort((hashes, texts))
    h, t = hashes[order], texts[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[new], t[new]


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each text's values, where text i has values first[i]..first[i+1]."""
    run = np.concatenate([[0], np.cumsum(values)])
    return run[first[1:]] - run[first[:-1]]
