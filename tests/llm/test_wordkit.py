import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import simhash as sh
from pagemill.llm import wordkit as wk

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n é中0Z.-\x1c", max_size=30)), max_size=12)


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_words_and_ngrams(texts):
    seen = {}
    for lo, hi, buf, offsets in wk.slices(pa.array(texts, pa.string()), 16):
        words = wk.split_words(buf, offsets, wk.SPACED)
        h = words.hashes()
        grams, first = wk.ngrams(h, words.first, 3, whole_if_short=True)
        for i in range(hi - lo):
            a, b = words.first[i], words.first[i + 1]
            got = [bytes(buf[s:e]).decode() for s, e in zip(words.start[a:b], words.end[a:b], strict=True)]
            assert got == re.findall(r"[^\x20\x09-\x0D]+", texts[lo + i] or "")
            for w, x in zip(got, h[a:b].tolist(), strict=True):
                assert seen.setdefault(w, x) == x
            want = [tuple(got[j : j + 3]) for j in range(len(got) - 2)] or ([tuple(got)] if got else [])
            for g, x in zip(want, grams[first[i] : first[i + 1]].tolist(), strict=True):
                assert seen.setdefault(g, x) == x
    assert len(set(seen.values())) == len(seen)


def test_slices_of_a_slice_and_long_texts():
    array = pa.array(["x", "aa bb", None, "c" * 100]).slice(1)
    got = [(lo, hi, buf.tobytes()) for lo, hi, buf, _ in wk.slices(array, 10)]
    assert got == [(0, 2, b"aa bb"), (2, 3, b"c" * 100)]
    assert list(wk.slices(pa.array([], pa.string()))) == []


def test_simhash_against_plain():
    rng = np.random.default_rng(2)
    sizes = [1, 3, 70, 5]
    words = rng.integers(0, 1 << 63, sum(sizes), dtype=np.uint64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    want = [sum(1 << b for b in range(64) if 2 * sum(int(w) >> b & 1 for w in words[a:z]) > z - a) for a, z in zip(first[:-1], first[1:], strict=True)]
    assert sh.simhashes(words, first).tolist() == want
    long = np.repeat(words[:1], 70_000)
    assert sh.simhashes(long, np.array([0, 70_000])).tolist() == words[:1].tolist()


def test_similar_texts_share_a_key():
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
        y = x.copy()
        y[:4] = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
        k = sh.band_keys(np.concatenate([x, y, x]), np.array([0, 40, 80, 120]))
        assert (k[0] == k[2]).all()
        met += bool((k[0] == k[1]).any())
    assert met >= 195
