"""Filter interaction and source divergence audits against plain versions, and their edge cases."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm import divergence, filter_audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
WORDS = ["Alpha", "beta", "GAMMA", "delta", "été", "x#y", "zeta"] + [f"w{i}" for i in range(120)]


def rows_of(rnd, n):
    rows = []
    for i in range(n):
        words = [rnd.choice(WORDS[: rnd.choice([3, 20, 127])]) for _ in range(rnd.choice([0, 1, 30, 99, 100, 140]))]
        text = rnd.choice([" ".join(words), "\u000b".join(words), "\n" + " ".join(words).upper(), " ".join(words)])
        rows.append((i, text, rnd.choice(["en", "de", None]), f"s{i % 5}", len(text)))
    rows += [(1000 + i, rows[i][1], "en", "s1", 0) for i in range(0, n, 7)]
    return [*rows, (None, rows[3][1], "de", None, None), (5, rows[5][1], "en", "s0", 1), (7, None, None, None, None), (8, "", "", "", 0)]


# --- filters


def plain_masks(rows):
    low = {}
    for ident, text, *_ in rows:
        if ident is not None:
            low[text or ""] = min(ident, low.get(text or "", ident))
    for ident, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": ident is not None and ident > low[text],
        }
        yield ident, lang or "", {f for f, x in fails.items() if x}


def plain_audit(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[at] == 1} for at in (0, 1))
    docs = list(plain_masks(rows))
    out, by_filter = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {p for _, p, _ in docs}:
            own = [(i, fails) for i, p, fails in docs if p == part]
            left = own
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                by_filter[part, letter] += len(gone)
                fails = sum(letter in f for _, f in own)
                out[part, order, step] = [len(left), len(gone), fails - len(gone), sum(f == {letter} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    return {key: (*x, by_filter[key[0], key[1][key[2] - 1]]) for key, x in out.items()}


def found_audit(found):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in found.collect()}


def test_filter_audit_against_plain(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "ROWS_AT_ONCE", 7)
    rows = rows_of(random.Random(3), 80)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60)] + [(3, 1, 1), (3, 0, None), (None, 1, 1), (5000, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "n_chars as part", "text as mask", "lang as digest", "1 as good", "2 as toxic", "source as low").repartition(5)
    found = found_audit(filter_audit.audit_filters(docs, spark.createDataFrame(labels, LABELS)))
    assert len(found) == 3 * 600 and found == plain_audit(rows, labels)
    shares = {(part, order[step - 1]): x[-1] for (part, order, step), x in found.items()}
    removed = sum(x[1] for (part, order, _), x in found.items() if part == "en")
    assert sum(x for (part, _), x in shares.items() if part == "en") == removed


def test_filter_audit_of_nothing_and_of_many_parts(spark, monkeypatch):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit_filters(spark.createDataFrame([], DOCS), labels).count() == 0
    monkeypatch.setattr(filter_audit, "PARTS_AT_ONCE", 3)
    rows = [(i, "one # two", f"l{i % 11}", "s", 9) for i in range(66)]
    found = filter_audit.audit_filters(spark.createDataFrame(rows, DOCS), labels)
    assert found.count() == 11 * 600
    assert found_audit(found) == plain_audit(rows, [])


def test_masks_of_long_texts():
    import pyarrow as pa

    long = " ".join(f"w{i}" for i in range(400_000))
    texts = ["", None, long, "A b", long + " w1" * 110_000, "é" * 2_000_000]
    assert filter_audit.text_masks(pa.array(texts, pa.string())).tolist() == [1, 1, 0, 5, 2, 1]


def test_first_failures():
    found = filter_audit.first_failures()
    assert found.shape == (32, 120) and (found[0] == 5).all()
    for mask, (column, order) in itertools.product(range(32), enumerate(filter_audit.ORDERS)):
        assert found[mask, column] == next((step for step, f in enumerate(order) if mask >> "ABCDE".index(f) & 1), 5)


# --- divergence


def plain_divergence(rows, top):
    counts, docs_with, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        langs[lang].add(source)
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded))
        counts[lang, source].update(terms)
        counts[lang].update(terms)
        docs_with[lang].update(terms.keys())
    out = {}
    for lang, sources in langs.items():
        kept = sorted((t for t, n in docs_with[lang].items() if n >= 3), key=lambda t: t.encode())
        share = {}
        for group in (lang, *((lang, s) for s in sources)):
            n = {t: counts[group][t] for t in kept}
            share[group] = {t: 1 + 10**9 * (c + 1) // (sum(n.values()) + len(kept)) for t, c in n.items()}
        for s in sources:
            p = share[lang, s]
            f = lambda t, q: (p[t] - q[t]) ** 2 // q[t]
            pairs = [(sum(f(t, share[lang, o]) for t in kept), o) for o in sources if o != s]
            terms = [(f(t, share[lang]), t) for t in kept if counts[lang, s][t] and p[t] > share[lang][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out[lang, s, part, item] = (value, rank)
    return out


@pytest.mark.parametrize(("block", "terms", "rounds"), [(1, 7, 2), (2, 1000, 1), (8, 1 << 17, 16)])
def test_divergence_against_plain(spark, block, terms, rounds, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_COUNTS", 60)
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(WORDS[: 10 + 12 * (i % 9)]) for _ in range(rnd.choice([0, 3, 60]))), ["en", "de", None][i % 17 % 3], f"s{i % 9}", 0) for i in range(150)]
    rows += [(200, None, "fr", "a", 0), (201, "", "fr", "b", 0), (202, "one two", "fr", None, 0), (203, "Zoë zoë ZOË Zoë", "it", "z", 0), (203, "zoë", "it", "z", 0), (203, "zoË zoë", "it", "z", 0), (None, "12 !?", "en", "none", 0)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "n_chars as n", "text as term", "lang as item", "1 as span", "2 as block", "source as part").repartition(4)
    found = divergence.source_divergence(docs, block_groups=block, range_terms=terms, rounds_at_once=rounds).collect()
    expected = plain_divergence(rows, 200)
    assert len(found) == len(expected)
    assert {(r["lang"], r["source"], r["part"], r["item"]): (r["value"], r["rank"]) for r in found} == expected


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_shares_and_heaps_are_exact():
    counts = np.array([0, 5, 10**9, 4 * 10**12], np.int64)
    total = 4 * 10**12 + 77
    assert divergence.share(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]
    seat = divergence._Vectors(divergence._packed([("a", 6, np.array([0, 1, 1]), np.array([2, 2, 2]))]), 4)
    found = list(divergence.top_terms(seat, ["a", "b", "c", "d"], np.array([2, 2, 2, 94]), 104, top=2))
    assert [t for _, t, _ in found] == ["a", "b"]


@pytest.mark.parametrize("blocks", [1, 2, 3, 6, 7])
def test_every_pair_of_blocks_meets_once(spark, blocks):
    seated = spark.range(blocks).selectExpr("'l' as lang", "0 as span", "cast(id as int) as block", f"{blocks} as blocks", "cast(id as string) as vectors")
    met = [(int(r["vectors"]), r["block"]) for lo in range(0, 8, 2) for r in divergence.guests(seated, lo, lo + 2).collect()]
    assert sorted(tuple(sorted(x)) for x in met) == list(itertools.combinations(range(blocks), 2))
    hosted = Counter(h for _, h in met)
    assert not met or max(hosted.values()) <= blocks // 2 + 1


def test_counts_are_given_out_within_a_batch(monkeypatch):
    monkeypatch.setattr(divergence, "HELD_COUNTS", 1 << 14)
    texts = [" ".join(f"{w}{c}" for c in ("é", "x", "Y")) for w in ("a" * (i + 1) for i in range(3))] + [" ".join("w" + "".join(chr(97 + int(d)) for d in str(k * 31 + i)) for k in range(100_000)) for i in range(3)]
    counts, held, found = divergence._Counts(), [], {}
    group = counts.numbers(zip(["en"] * len(texts), ["s"] * len(texts)))
    for batch in itertools.chain(counts.add(group, pa.array(texts)), counts.given()):
        held.append(batch.num_rows)
        for term, n in zip(batch["term"].to_pylist(), batch["n"].to_pylist(), strict=True):
            found[term] = found.get(term, 0) + n
    assert len(held) > 2 and counts.size == 0
    assert found == dict(Counter(w.lower() for t in texts for w in t.split()))
    assert divergence._text(pa.array([b"a\xff"], pa.large_binary())).to_pylist() == ["a�"]
