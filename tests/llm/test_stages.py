"""The pipeline's stages: columns of any name and null ids pass them, and a plain version gives the same corpus."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import fuzzy_lines, mixing, toxicity, training_order

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]
CLASHES = ["n_words", "hits", "n_hit", "item_ids", "contaminated", "rate", "n_copies", "copy", "mix_key", "__set_node", "__set_size", "__times", "__id", "__key", "__mix", "score", "__toxicity", "node", "a.b", "__aside_0"]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """(folder, rows): ordinary, toxic, copied, nearly copied, contaminated and empty documents of uneven sources."""
    folder, rnd = tmp_path_factory.mktemp("corpus"), random.Random(8)
    texts = [prose(rnd, 70) + (" vile filthy scum" * 4 if i % 4 == 0 else "") for i in range(240)]
    base = texts[1].split()
    texts += [texts[1], texts[2], " ".join([*base[:-1], "changed"]), " ".join(["changed", *base]), texts[5] + " tail of some words"]
    leak = prose(rnd, 14)
    texts += [prose(rnd, 30) + " " + leak.upper() + "! " + prose(rnd, 5), prose(rnd, 20) + " short item", "", None, "one two"]
    rows = [(i, t, "en", f"s{i % 10 // 7 + i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, prose(rnd, 50), None, None, None), (None, prose(rnd, 50), None, None, None), (7, texts[7], "en", "s0", 1)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, "Short item"), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def test_columns_of_any_name_and_null_ids_pass(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.select("*", *[F.concat_ws("/", F.lit(c), F.col("text")).alias(c) for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, out = stage(spark, docs, folder), stage(spark, wide, folder)
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert Counter(r["text"] for r in rows) == Counter(r["text"] for r in plain.collect()), name
        assert all(r[c] == ("/".join([c, r["text"]]) if r["text"] is not None else c) for r in rows for c in CLASHES), name
        lost = Counter(r["text"] for r in rows if r["doc_id"] is None)
        assert len(lost) == 2 or name == "mixing", name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, wide, folder).count() == last(spark, docs, folder).count()


def near(a, b):
    """Whether two texts link: 5-word shingles, 4/5."""
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    x, y = shingles(a), shingles(b)
    return bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)


def plain_corpus(rows, kept_by_model, items):
    """The texts that training sees, with how often each is in the mixture."""
    left = [r for r in rows if (r[0], r[1]) in kept_by_model]
    group = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if near(left[i][1], left[j][1]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    best = {}
    for r, g in zip(left, group, strict=True):
        if g not in best or (r[0] is not None and (best[g][0] is None or r[0] < best[g][0])):
            best[g] = r
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())  # noqa: E731  the texts are ASCII
    windows = {tuple(w[i : i + 10]) for w in map(words, items) if w for i in range(max(1, len(w) - 9))}
    clean = [r for r in best.values() if not any(tuple(words(r[1])[i : i + len(w)]) == w for w in windows for i in range(len(words(r[1]))))]
    sizes = Counter()
    for r in clean:
        sizes[r[3]] += len((r[1] or "").encode()) + 1
    weights = {s: n**0.5 for s, n in sizes.items()}
    out = Counter()
    for r in clean:
        rate = weights[r[3]] / sum(weights.values()) * sum(sizes.values()) / sizes[r[3]]
        u = int(hashlib.md5(f"{mixing.SEED}|n|{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        total, n, p = math.exp(-rate), 0, math.exp(-rate)
        while total <= u:
            n += 1
            p *= rate / n
            total += p
        out[r[1]] += n
    return +out


def test_pipeline_against_plain(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    calm = {(r["doc_id"], r["text"]) for r in toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).collect()}
    assert sum(i is not None and i < 240 and i % 4 == 0 for i, _ in calm) < 6 and len(calm) > 170
    expected = plain_corpus(rows, calm, [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    assert sum(expected.values()) > 100
    out, layout = corpus_pipeline.run(spark, folder).collect(), training_order.Layout()
    assert [r["slot"] for r in sorted(out, key=lambda r: r["slot"])] == list(range(len(out)))
    tokens = np.concatenate([np.frombuffer(bytes(r["tokens"]), layout.dtype)[: r["n_tokens"]] for r in out])
    assert (tokens == training_order.EOS).sum() == sum(expected.values())
    fourth = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        fourth = stage(spark, fourth, folder)
    assert Counter(r["text"] for r in fourth.collect()) == expected


def test_lines_of_a_long_text_go_in_proportion(spark, monkeypatch):
    lines = [f"line {i}" for i in range(200_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[:50])), (3, None), (4, "")], "doc_id long, text string")
    gone = docs.select("doc_id", F.xxhash64("text").alias("text_hash")).where("doc_id < 3").withColumn("removed", F.expr("case when doc_id = 1 then transform(sequence(0, 99999), x -> 2 * x + 1) else sequence(0, 49) end"))
    monkeypatch.setattr(fuzzy_lines, "line_groups", lambda *_: (None, None))
    monkeypatch.setattr(fuzzy_lines, "removed_lines", lambda *_: gone)
    began = time.time()
    found = {r["doc_id"]: r["deduped"] for r in fuzzy_lines.dedup_lines(docs).collect()}
    assert time.time() - began < 30
    assert found == {1: "\n".join(lines[::2]), 2: "", 3: None, 4: ""}
