"""SimHash of hashed features, and MinHash keys under which similar texts meet."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: For each byte and half of it, its four bits in four 16-bit lanes.
_LANES = np.array([[sum(((b >> (4 * half + i)) & 1) << (16 * i) for i in range(4)) for b in range(256)] for half in range(2)], dtype=np.uint64)


def simhashes(features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For texts of features[first[i]:first[i+1]], none empty: bit b is 1 where most features' bits b are."""
    n = np.diff(first)
    out = np.zeros(len(n), dtype=np.uint64)
    if not len(n):
        return out
    # 16-bit lanes hold the sums of up to 65,535 features: longer texts are summed in pieces
    cut = np.unique(np.concatenate([first[:-1], np.arange(0, len(features), 32_768)]))
    owner = np.searchsorted(first, cut, side="right") - 1
    for byte in range(8):
        value = ((features >> _U(8 * byte)) & _U(255)).astype(np.intp)
        for half in range(2):
            lanes = np.add.reduceat(_LANES[half][value], cut)
            for i in range(4):
                ones = ((lanes >> _U(16 * i)) & _U(0xFFFF)).astype(np.int64)
                total = np.bincount(owner, weights=ones, minlength=len(n)) if len(cut) > len(n) else ones
                out |= (2 * total > n).astype(np.uint64) << _U(8 * byte + 4 * half + i)
    return out


#: MinHash bands and the minima of each.
BANDS, ROWS = 10, 3
#: SimHashes of one key are near if they differ in so many of 64 bits at most.
BITS = 18
_ODD = np.random.default_rng(64).integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * _U(2) + _U(1)


def band_keys(features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of BANDS 32-bit keys for each text of features[first[i]:first[i+1]], none empty.

    Texts that share a part s of their features have an equal key in some band with probability
    1 - (1 - s^ROWS)^BANDS.
    """
    out = np.zeros((len(first) - 1, BANDS), dtype=np.uint32)
    if len(out):
        for band in range(BANDS):
            key = np.zeros(len(out), dtype=np.uint64)
            for odd in _ODD[band]:
                low = np.minimum.reduceat(features * odd, first[:-1])
                key = (key ^ (low >> _U(29)) ^ low) * _U(0x9E3779B97F4A7C15)
            out[:, band] = key >> _U(32)
    return out
