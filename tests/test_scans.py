"""Sections longer than a block: lines, terms, headings and parts are the same wherever the blocks end."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.operators import chunking, lines, scans

PLACED = "source string, section string, page int, text string, printed_page int"
KEYS = ["source", "section"]


def book(rnd, pages, source):
    """Pages of few lines, many of them broken words, terms, headings and markers; some are a single broken line."""
    out, rule = [], 1
    for page in range(1, pages + 1):
        text = []
        for _ in range(rnd.choice([0, 1, 1, 2, 5])):
            kind = rnd.random()
            if kind < 0.1:
                rule += rnd.random() < 0.3
                text.append(f"{rule}.{rnd.randint(1, 9)}{rnd.choice(['', 'a', 'b'])} Titel {page}")
            elif kind < 0.2:
                text.append("Zweck der Regel:")
            elif kind < 0.35:
                text.append(rnd.choice(["Abschlag", "Loser Stoff", "aus", "Bunker."]))
            else:
                text.append(rnd.choice(["ein Satz endet.", "Ein Wort", "wort-", "rück-", "legen", "(1) Punkt", "• noch ein langer Satz ohne Ende", "Netto-"]))
        body = rnd.choice(["\n", "\r\n"]).join(text) + rnd.choice(["", "\n"])
        out.append((source, "S", page, body, page - 2 if page % 2 else None))
    return out


def plain_lines(rows):
    """Lines of a section in order, words broken over pages joined."""
    out = []
    for source, section, page, text, printed in sorted(rows, key=lambda r: (r[0], r[2])):
        found = re.split(r"\r\n|\r|\n", text) if text else []
        if len(found) > 1 and found[-1] == "":
            found.pop()
        for i, t in enumerate(found):
            last = out[-1] if out and out[-1]["key"] == (source, section) else None
            if i == 0 and last and last["raw"].endswith("-") and last["raw"][-2:-1].isalpha() and t[:1].islower():
                last["text"], last["raw"] = last["text"][:-1] + t, t
            else:
                out.append({"key": (source, section), "page": page, "line_idx": i, "text": t, "printed_page": printed, "raw": t})
    return [(*x["key"], x["page"], x["line_idx"], x["text"], x["printed_page"]) for x in out]


@pytest.fixture(scope="module")
def placed(spark):
    rnd = random.Random(21)
    rows = book(rnd, 70, "a") + book(rnd, 9, "b") + [("c", "S", p, t, None) for p, t in enumerate(["zu-", "rück-", "", "le-", "gen", "Ende-"], 1)]
    return rows, spark.createDataFrame(rows, PLACED).repartition(3).persist()


def run(rows):
    return sorted(map(tuple, rows.collect()), key=str)


@pytest.mark.parametrize("pages", [1, 3])
def test_lines_against_plain(placed, pages, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK_PAGES", pages)
    rows, df = placed
    assert run(lines.to_lines(df)) == sorted(plain_lines(rows), key=str)


def test_segments_do_not_depend_on_blocks(placed, monkeypatch):
    rules = chunking.HeadingRules(titles={1: "Eins"})
    ways = {"terms": chunking.segments_by_terms, "headings": lambda x: chunking.segments_by_headings(x, rules)}
    found = {}
    for pages in (1000, 2):
        monkeypatch.setattr(scans, "BLOCK_PAGES", pages)
        rows = lines.to_lines(placed[1])
        found[pages] = {name: run(way(rows).select(*KEYS, "page", "line_idx", "text", "seg", "heading", "number")) for name, way in ways.items()}
        found[pages]["chunks"] = run(chunking.chunk_by_headings(rows, 60, rules)) + run(chunking.chunk_by_size(rows, 60))
    assert found[2] == found[1000] and all(len({r[5] for r in found[2][w]}) > 2 for w in ways)


@pytest.mark.parametrize("pages", [1, 4])
def test_scan_against_plain(spark, pages, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK_PAGES", pages)
    rnd = random.Random(22)
    rows = [(k, p, i, rnd.choice([None, None, rnd.randint(0, 99)])) for k in "xy" for p in range(30) for i in range(rnd.randint(0, 3))]
    df = scans.with_block(spark.createDataFrame(rows, "k string, page int, i int, v int").repartition(4))
    v = F.col("v")
    kinds = {"sum": ("sum", v), "last": ("last", v), "next": ("next", v), "before": ("before", v), "after": ("after", v)}
    got = {(r["k"], r["page"], r["i"]): tuple(r[c] for c in kinds) for r in scans.scan(df, ["k"], ["page", "i"], kinds).collect()}
    for at, (k, p, i, _) in enumerate(rows):
        upto, onward = ([r[3] for r in part if r[0] == k and r[3] is not None] for part in (rows[: at + 1], rows[at:]))
        earlier, later = ([r[3] for r in part if r[0] == k and r[3] is not None] for part in (rows[:at], rows[at + 1 :]))
        end = lambda x, n: x[n] if x else None
        assert got[k, p, i] == (sum(upto), end(upto, -1), end(onward, 0), end(earlier, -1), end(later, 0))
    assert len(got) == len(rows)
