"""Each operator against a plain version or a planted case, and its edge cases."""

import gzip
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.llm import decontaminate, fuzzy_lines, mixing, ordinal, quality_rules, setjoin, toxicity, training_order, url_rules, warc
from pagemill.llm.components import connected_components, merged_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(300)]


def documents(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], DOCS)


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


# --- WARC

def test_warc_records(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<html><head><title>T &amp; x</title></head><body><p>A&lt;b&#228;</p><script>no()</script>c<br>d&bogus;</body>"), (2, None, None), (2, None, None)], "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))
    responses = warc.responses_from_pages(pages)
    rows = warc.derivatives(responses).collect()
    assert len(rows) == 6
    one = {r["record_type"]: r for r in rows if r["page_id"] == 1}
    assert one["conversion"]["block"] == "A<bä\nc\nd&bogus;"
    assert "html-title: T & x\r\n" in one["metadata"]["block"]
    response = responses.where("page_id = 1").first()
    for r in one.values():
        assert r["refers_to"] == response["record_id"] and r["source_block_digest"] == response["block_digest"] and r["payload_digest"] == response["payload_digest"]
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest() and r["content_length"] == len(r["block"].encode())
    assert {r["block"] for r in rows if r["page_id"] == 2 and r["record_type"] == "conversion"} == {""}
    assert warc.derivatives(responses.limit(0)).count() == 0


def test_warc_heads(spark):
    def response(block):
        return spark.createDataFrame([("<r>", "u", "d", bytearray(block), "b", "p")], "record_id string, target_uri string, date string, block binary, block_digest string, payload_digest string")

    latin = response("HTTP/1.1 404 X\r\ncontent-type: text/html; charset=ISO-8859-1\r\n\r\n<p>ä</p>".encode("latin-1"))
    got = {r["record_type"]: r["block"] for r in warc.derivatives(latin).collect()}
    assert got["conversion"] == "ä" and got["metadata"].startswith("http-status: 404\r\n")
    packed = response(b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nContent-Type: text/html\r\n\r\n\x1f\x8b\xff")
    got = {r["record_type"]: r["block"] for r in warc.derivatives(packed).collect()}
    assert got["conversion"] == "" and "http-encodings: gzip" in got["metadata"]
    assert {r["block"] for r in warc.derivatives(response(b"no head")).where("record_type = 'conversion'").collect()} == {""}


def test_warc_long_heads_and_pages(spark):
    head = "HTTP/1.1 200 OK\r\nSet-Cookie: " + "x" * 70_000 + "\r\nServer: ä\r\nContent-Type: text/html\r\n\r\n"
    page = "<!-- " * 300 + "<script>" * 300 + "<p>a &amp; b</p>\n" * 20_000 + "<p>ende</p>"
    kinds = "record_id string, target_uri string, date string, block binary, block_digest string, payload_digest string"
    df = spark.createDataFrame([("<r>", "u", "d", bytearray((head + page).encode()), "b", "p")], kinds)
    got = {r["record_type"]: r["block"] for r in warc.derivatives(df).collect()}
    lines = got["conversion"].split("\n")
    assert lines[-1] == "ende" and lines.count("a & b") >= 19_999
    assert "http-header: Set-Cookie: " + "x" * 70_000 + "\r\n" in got["metadata"]
    assert [x.split(":")[1].strip() for x in got["metadata"].split("\r\n") if x.startswith("http-header")] == ["Set-Cookie", "Server", "Content-Type"]


def test_warc_file(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>Hallo</p>")], "page_id long, url string, html string")
    warc.write_warc(warc.derivatives(warc.responses_from_pages(pages)), str(tmp_path / "w"))
    text = "".join(gzip.decompress(f.read_bytes()).decode() for f in (tmp_path / "w").glob("part-*"))
    assert text.count("WARC/1.1\r\n") == 2 and "WARC-Refers-To: <urn:uuid:" in text and text.endswith("\r\n\r\n")


# --- models

def labelled(spark, rnd, n):
    rows, labels = [], []
    for i in range(n):
        toxic, poor = rnd.random() < 0.3, rnd.random() < 0.3
        text = prose(rnd, 40) + (" rotten " + rnd.choice(["fool", "swine"]) if toxic else "") + " " + prose(rnd, 40)
        if poor:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append(text)
        labels.append((i, int(not poor), int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


EDGES = [(10_001, None), (10_002, ""), (10_003, " \n"), (10_004, "x " * 200_000), (10_004, "x " * 200_000), (None, "lost id")]


def with_edges(spark, docs):
    edges = spark.createDataFrame(EDGES, "doc_id long, text string")
    return docs.select("doc_id", "text").unionByName(edges)


def test_toxicity(spark):
    docs, labels = labelled(spark, random.Random(1), 1200)
    dirty = labels.unionByName(spark.createDataFrame([(3, None, None), (None, 1, 1)], labels.schema)).unionByName(labels.limit(5))
    model = toxicity.train(docs, dirty)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs.withColumn("score", F.lit("clash")), model).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum((got[r["doc_id"]] >= 0.3) == bool(r["toxic"]) for r in held) >= 0.97 * len(held)
    edges = toxicity.score(with_edges(spark, docs.limit(0)), model)
    assert edges.count() == len(EDGES) and edges.where("score between 0 and 1").count() == len(EDGES)
    assert toxicity.score(docs.limit(0), model).count() == 0
    blank = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs.limit(3), blank).collect()} == {0.5}
    assert toxicity.train(docs, dirty).bias == model.bias


def test_ordinal(spark):
    docs, labels = labelled(spark, random.Random(2), 1200)
    model = ordinal.train(docs, labels, ordinal.quality_grade(), 3)
    assert model.theta[0] < model.theta[1]
    got = {r["doc_id"]: r for r in ordinal.grade_documents(docs.withColumn("p_ge_1", F.lit("clash")), model).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum((got[r["doc_id"]]["p_ge_1"] >= 0.5) == bool(r["quality"]) for r in held) >= 0.97 * len(held)
    assert all(abs(r["expected_grade"] - r["p_ge_1"] - r["p_ge_2"]) < 1e-9 and r["p_ge_1"] >= r["p_ge_2"] for r in got.values())
    assert ordinal.grade_documents(with_edges(spark, docs.limit(0)), model).count() == len(EDGES)
    flat = ordinal.train(docs, labels.limit(0), ordinal.quality_grade(), 3)
    row = ordinal.grade_documents(docs.limit(1), flat).first()
    assert row["expected_grade"] == pytest.approx(1.0)


def plain_features(text):
    """Distinct hashed words, pairs of neighbours and of words with one between, by the library's hashes."""
    import pyarrow as pa

    from pagemill.llm import wordkit as wk

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    (_, _, buf, offsets), *_ = wk.slices(pa.array([" ".join(words)]))
    h = [int(x) for x in wk.split_words(buf, offsets, wk.ALNUM).hashes()]
    full = (1 << 64) - 1

    def mix(x):
        return int(wk.mix(np.array([x & full], dtype=np.uint64))[0])

    place = [int(x) for x in wk._PLACE]
    out = {mix(mix(x * place[0]) + 1) >> 44 for x in h}
    out |= {mix(mix(x * place[0] + y * place[1]) + 2) >> 44 for x, y in zip(h, h[1:])}
    return out | {mix(x * place[40] + y * place[42]) >> 44 for x, y in zip(h, h[2:])}


def plain_ftrl(ftrl, texts, labels, slope, start):
    """FTRL-proximal as it is written down, a dictionary for each coordinate."""
    z, n, bias, squares = {}, {}, start or 0.0, 1.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= ftrl.l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * ftrl.l1) / ((ftrl.beta + n[i] ** 0.5) / ftrl.alpha + ftrl.l2)

    for _ in range(ftrl.epochs):
        for text, label in zip(texts, labels, strict=True):
            w = {i: weight(i) for i in plain_features(text)}
            g = slope(bias + sum(w.values()), label)
            for i in w:
                old = n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - old**0.5) / ftrl.alpha * w[i]
            squares += g * g
            if start is not None:
                bias -= 0.1 * g / squares**0.5
    return {i: weight(i) for i in z if weight(i)}, bias


def test_ftrl_against_plain():
    import pyarrow as pa

    from pagemill.llm import linear

    rnd = random.Random(21)
    texts = [None, "", "x"] + [prose(rnd, 12) + (" rotten fool" if i % 3 else "") for i in range(200)]
    labels = [0, 0, 1] + [int(i % 3 > 0) for i in range(200)]
    ftrl = linear.Ftrl(alpha=1.0, l1=1.0, epochs=2)
    slope = lambda s, y: float(linear.sigmoid(s)) - y
    index, weight, bias = linear.fit(toxicity.FEATURES, ftrl, pa.array(texts), np.array(labels), slope, 0.1)
    want, want_bias = plain_ftrl(ftrl, texts, labels, slope, 0.1)
    assert bias == pytest.approx(want_bias) and set(index.tolist()) == set(want) and len(want) > 20
    assert dict(zip(index.tolist(), weight.tolist(), strict=True)) == pytest.approx(want)
    weights = linear.dense(dict(zip(index.tolist(), weight.tolist(), strict=True)), 20)
    scores = linear.linear_scores(toxicity.FEATURES, weights, bias, pa.array(texts))
    assert scores == pytest.approx([bias + sum(want.get(i, 0.0) for i in plain_features(t)) for t in texts], abs=1e-5)


def test_cumulative_link_against_plain():
    """Weights and thresholds together, against the same steps on dictionaries."""
    import pyarrow as pa

    from pagemill.llm import linear

    rnd = random.Random(22)
    labels = [rnd.randrange(3) for _ in range(200)]
    texts = [prose(rnd, 10) + " good" * y for y in labels]
    ftrl = linear.Ftrl(alpha=0.5, l1=1.0, epochs=2)
    one, two = (ordinal.CumulativeLink(np.array([-0.5, 0.5])) for _ in range(2))
    index, weight, _ = linear.fit(toxicity.FEATURES, ftrl, pa.array(texts), np.array(labels), one.slope, None)
    want, _ = plain_ftrl(ftrl, texts, labels, two.slope, None)
    assert dict(zip(index.tolist(), weight.tolist(), strict=True)) == pytest.approx(want) and len(want) > 5
    assert one.theta == pytest.approx(two.theta) and one.theta[0] < one.theta[1]


def test_null_id_is_not_held_out(spark):
    from pagemill.llm.common import is_training

    row = spark.createDataFrame([(None,)], "doc_id long").select((~is_training()).alias("held_out")).first()
    assert row["held_out"] is False


def test_empty_shards_do_not_shrink_weights(spark):
    from pagemill.llm.linear import fit_shards

    sample = spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, label int")
    assert fit_shards(sample, 100, 10, lambda texts, labels: {7: 3.0}) == {7: 3.0}


def test_ordinal_slopes():
    theta = np.array([-1.0, 0.5, 2.0])

    def loss(f, y):
        p = np.concatenate([[0], 1 / (1 + np.exp(-(theta - f))), [1]])
        return -np.log(p[y + 1] - p[y])

    for f in (-2.0, 0.1, 3.0):
        for y in range(4):
            link = ordinal.CumulativeLink(theta.copy(), rate=0.0)
            assert link.slope(f, y) == pytest.approx((loss(f + 1e-6, y) - loss(f - 1e-6, y)) / 2e-6, abs=1e-4)


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark):
    rnd = random.Random(4)
    good = [prose(rnd, rnd.randint(15, 120)) for _ in range(150)]
    bad = [" ".join(w + rnd.choice(["%%%", "***"]) for w in prose(rnd, 60).split()) for _ in range(60)]
    odd = [None, "", " \n ", "a b c d e f g h\na b c d e f g h\n\n\nü € |", "same " * 50, "x\r\nx\n x\nx"]
    docs = documents(spark, good + bad + odd)
    trusted = spark.createDataFrame([(i,) for i in range(120)], "doc_id long")
    model = quality_rules.fit_ratio(docs, trusted)
    rows = {r["doc_id"]: r for r in quality_rules.judge(docs.withColumn("llr", F.lit("clash")), model).collect()}
    for i, text in enumerate(good + bad + odd):
        r = rows[i]
        want = plain_base(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, text
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    fair = [rows[i]["kept"] for i in range(120, 150) if not rows[i]["base_failed"]]
    assert sum(fair) >= 0.8 * len(fair)
    assert not any(rows[i]["kept"] for i in range(150, 210))
    assert quality_rules.judge(docs.limit(0), model).count() == 0
    free = quality_rules.fit_ratio(docs, trusted.limit(0))
    assert all(r["kept"] != r["base_failed"] for r in quality_rules.judge(docs, free).collect())


def test_quality_ratio_against_plain(spark):
    """Counters over bins give the same ratios, and every text is on the right side of the threshold."""
    import pyarrow as pa
    from collections import Counter

    from pagemill.llm import wordkit as wk

    rnd = random.Random(14)
    texts = [prose(rnd, rnd.randint(1, 60)) for _ in range(80)] + [None, "", "one"]
    docs = documents(spark, texts)
    model = quality_rules.fit_ratio(docs, spark.createDataFrame([(i,) for i in range(0, 80, 2)], "doc_id long"), bits=12)
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(4)).alias("f")).collect()}

    def bins(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if not words:
            return []
        (_, _, buf, offsets), *_ = wk.slices(pa.array([" ".join(words)]))
        h = wk.split_words(buf, offsets, wk.SPACED).hashes()
        pairs = wk.mix(h[:-1] * wk._PLACE[0] + h[1:] * wk._PLACE[1])
        return [int(x) >> 52 for x in [*wk.mix(h.copy()), *pairs]]

    raw, trusted = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(bins(t))
        if i < 80 and i % 2 == 0 and fold[i] > 0:
            trusted.update(bins(t))
    ratio = [np.log((trusted[b] + 1) / (sum(trusted.values()) + 4096)) - np.log((raw[b] + 1) / (sum(raw.values()) + 4096)) for b in range(4096)]
    assert model.ratio == pytest.approx(ratio, abs=1e-5)
    for r in quality_rules.judge(docs, model).collect():
        found = bins(texts[r["doc_id"]])
        llr = sum(ratio[b] for b in found) / max(1, len(found))
        assert r["llr"] == pytest.approx(llr, abs=1e-5)
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= model.threshold)


def test_quality_counts_all(spark):
    docs = documents(spark, ["a b a", "b", None]).withColumn("trusted", F.col("doc_id") == 1)
    counts = quality_rules.count_bins(docs.repartition(3), 10)
    assert counts[0].sum() == 6 and counts[1].sum() == 1


# --- mixing

def test_mixing(spark):
    docs = documents(spark, ["x" * 9] * 300, "big").unionByName(documents(spark, ["y" * 9] * 20, "small")).unionByName(documents(spark, [None, ""], None)).withColumn("copy", F.lit("clash"))
    rates = mixing.source_rates(docs)
    r = {x["source"]: x for x in rates.collect()}
    assert r["big"]["size"] == 3000 and r[None]["size"] == 2
    assert sum(x["rate"] * x["size"] for x in r.values()) == pytest.approx(3202)
    one, two = mixing.replicate(docs, rates), mixing.replicate(docs, rates, broadcast_sources=0)
    pick = ("doc_id", "source", "copy", "mix_key")
    assert sorted(map(str, one.select(*pick).collect())) == sorted(map(str, two.select(*pick).collect()))
    assert one.where("copy >= n_copies").count() == 0
    fixed = mixing.source_rates(docs, spark.createDataFrame([("small", 1.0)], "source string, weight double"))
    assert {x["source"] for x in mixing.replicate(docs, fixed).collect()} == {"small"}
    assert mixing.replicate(docs.limit(0), mixing.source_rates(docs.limit(0))).count() == 0


def test_poisson_inverts(spark):
    for rate in (0.3, 4.0, 900.0):
        rows = spark.range(4000).select(mixing.uniform("t", F.col("id").cast("string")).alias("u"), mixing.poisson_table(F.lit(rate)).alias("t"))
        n = np.array([r[0] for r in rows.select(F.size(F.filter("t", lambda c: c <= F.col("u")))).collect()])
        assert abs(n.mean() - rate) < 5 * (rate / 4000) ** 0.5 and abs(n.var() / rate - 1) < 0.15


def test_poisson_of_large_rates(spark):
    """Counts against a plain sum of the distribution; tables grow with the root of the rate."""
    for rate in (3.5, 1030.0, 250_000.0):
        low, cdf = spark.range(1).select(mixing.lowest_count(F.lit(rate)), mixing.poisson_table(F.lit(rate))).first()
        low_plain = max(0, int(rate - 40 * rate**0.5) - 40)
        plain, total = {}, 0.0
        for k in range(low_plain, int(rate + 8 * rate**0.5) + 10):
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            plain[k] = total
        assert len(cdf) < 64 + 25 * rate**0.5 and (low == 0 or plain[low - 1] < 2**-52)
        assert all(abs(cdf[k - low] - c) < 1e-7 for k, c in plain.items() if k >= low)
        assert 1 - cdf[-1] < 1e-7


def test_mixing_keeps_columns_named_like_internals(spark):
    docs = documents(spark, ["a", "b", None], "s").withColumns({"u": F.lit(7), "low": F.lit(8), "cdf": F.lit(9), "r_source": F.lit("q"), "size": F.lit(1), "weight": F.lit(2)})
    out = mixing.replicate(docs, mixing.source_rates(docs))
    assert set(docs.columns) < set(out.columns)
    assert {(x["u"], x["low"], x["cdf"], x["r_source"]) for x in out.collect()} <= {(7, 8, 9, "q")}


# --- training order

def test_training_order_round_trip(spark, tmp_path):
    import tiktoken

    texts = [None, "", "a  b\n\n", "ünï code 中文 x", "hello world " * 300, "x", "x"]
    docs = documents(spark, texts).repartition(3)
    layout = training_order.Layout(16, "<u2", 8)
    out = training_order.materialise(docs, layout)
    rows = out.orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    assert all(r["shard"] == r["slot"] // 8 and r["byte_offset"] == r["slot"] % 8 * 33 for r in rows)
    training_order.write_shards(out, str(tmp_path / "o"))
    for r in rows:
        (file,) = (tmp_path / "o" / f"shard={r['shard']}").glob("part-*")
        assert training_order.read_records(str(file), r["slot"] % 8, 1, layout)[0].tobytes() == bytes(r["tokens"])
    ranks = training_order.read_ranks(spark, training_order.TOKENIZER)
    encoding = training_order.Encoder(ranks, training_order.PATTERN).encoding
    assert isinstance(encoding, tiktoken.Encoding)
    seqs = training_order.sequences(docs, layout=layout).orderBy("part", "pos").collect()
    stream = [t for r in seqs for t in np.frombuffer(bytes(r["tokens"]), "<u2")[: r["n_tokens"]].tolist()]
    back, held = [], []
    for t in stream:
        if t == training_order.EOS:
            back.append(encoding.decode(held))
            held = []
        else:
            held.append(t)
    assert sorted(back) == sorted(t or "" for t in texts)
    assert {d for r in seqs for d in r["doc_ids"]} == set(range(7))
    assert training_order.materialise(docs.limit(0), layout).count() == 0


def test_training_order_is_resumed(spark, tmp_path):
    docs = documents(spark, ["hello world " * 50, "b", "c"])
    layout = training_order.Layout(16, "<u2", 8)
    pick = lambda df: [(r["slot"], bytes(r["tokens"])) for r in df.orderBy("slot").collect()]
    one = pick(training_order.materialise(docs, layout, str(tmp_path / "t")))
    assert one == pick(training_order.materialise(docs.repartition(3), layout, str(tmp_path / "t")))
    with pytest.raises(Exception, match="does not fit"):
        training_order.materialise(docs, training_order.Layout(16, "<u1", 8)).collect()


def test_encoder_is_whole_text(spark):
    import pyarrow as pa

    from pagemill.llm import wordkit as wk

    e = training_order.Encoder(training_order.read_ranks(spark, training_order.TOKENIZER), training_order.PATTERN)
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["a", "b", " ", "  ", "\n", " ", "é", "1", "!", "'s", "　", "中", "\x85"]) for _ in range(rnd.randint(0, 50))) for _ in range(800)]
    for lo, hi, buf, offsets in wk.slices(pa.array(texts), 3000):
        ids, counts = e.encode(buf, offsets)
        ends = np.cumsum(counts)
        for i in range(hi - lo):
            assert ids[ends[i] - counts[i] : ends[i]].tolist() == e.encoding.encode_ordinary(texts[lo + i])


def test_encoder_holds_little(spark):
    import tracemalloc

    import pyarrow as pa

    from pagemill.llm import wordkit as wk

    ranks = training_order.read_ranks(spark, training_order.TOKENIZER)
    e = training_order.Encoder(ranks, training_order.PATTERN)
    texts = [" ".join(f"w{i}x{j}" for j in range(400)) for i in range(200)]
    tracemalloc.start()
    for _, _, buf, offsets in wk.slices(pa.array(texts)):
        e.encode(buf, offsets)
    del buf, offsets
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held - sum(x.nbytes for x in (wk._powers["up"], wk._powers["down"])) < 60 * 80_000  # 80,000 pieces of some five ids each
    few = training_order.Encoder(ranks, training_order.PATTERN, most_cached=1000)
    for text in texts:
        ids, _ = few.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == e.encoding.encode_ordinary(text) and len(few.known) <= 1400


def test_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        assert sorted(training_order.Permutation(n, "k")(np.arange(n)).tolist()) == list(range(n))
    assert training_order.Permutation(1000, "a")(np.arange(1000)).tolist() != training_order.Permutation(1000, "b")(np.arange(1000)).tolist()


# --- decontamination

def plain_hits(text, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    w, hit, ids = words(text), set(), set()
    for ident, item in items:
        v = words(item)
        for k in range(max(1, len(v) - 9)) if v else ():
            p = v[k : k + 10]
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit |= set(range(i, i + len(p)))
                    ids.add(ident)
    return len(w), len(hit), sorted(str(i) for i in ids if i is not None)


@pytest.mark.parametrize("block", [50_000, 3])
def test_decontamination(spark, block):
    rnd = random.Random(5)
    items = [(i, prose(rnd, n)) for i, n in enumerate([25, 10, 3, 1, 12])] + [(7, None), (8, " .. "), (1, prose(rnd, 11)), (None, "unknown id here"), (9, "Größe, ÄÖ!")]
    texts = [None, "", prose(rnd, 50)]
    for _, t in items:
        texts.append(prose(rnd, 30) + " -- " + (t or "").upper().replace(" ", ", ") + "\n" + prose(rnd, 20))
    texts += [items[0][1] + " " + items[0][1], "größe äÖ", "unknown id here", "aw1b"]
    docs = documents(spark, texts).withColumn("hits", F.lit("clash"))
    table = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find_contamination(docs, table, block_windows=block).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_hit"], list(r["item_ids"])) == plain_hits(t, items), t
        for h in r["hits"] or []:
            piece = t[h["start"] : h["end"]]
            assert len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", piece.lower())) == h["last_word"] - h["first_word"] + 1
    assert decontaminate.find_contamination(docs.limit(0), table).count() == 0
    assert decontaminate.find_contamination(docs, table.limit(0)).where("contaminated").count() == 0


# --- URL rules

def test_url_rules(spark):
    urls = [None, "no scheme", "http://", "HTTP://EXAMPLE.org/en/12?x", "https://a.Example.org/es/x", "http://example.org", "http://xexample.org/en/1", "ftp://b.com/fr/", "http://com/de/x#y", "http://b.com/de", "http://u@h.net:80/p", "http://example.org/en/1"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(3, urls[3])], "page_id long, url string").withColumn("rule", F.lit("clash"))
    rules = spark.createDataFrame([*url_rules.RULES, (None, "/", "block")], "host string, path string, verdict string")
    got = {}
    for bound in (100_000, 0):
        rows = url_rules.apply_rules(pages, rules, broadcast_rules=bound).collect()
        assert len(rows) == len(urls) + 1
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
        assert got[0] == got[1] == ("", "", None, "allow")
        assert got[3] == ("example.org", "/en/12", "example.org/en/1", "block")
        assert got[4][2:] == ("example.org/es/", "block") and got[5][2:] == (None, "allow") and got[6][2:] == ("org/", "allow")
        assert got[7][2:] == ("com/fr/", "allow") and got[8][2:] == ("com/de/", "block") and got[9][2:] == (None, "allow")
        assert got[10][:2] == ("u@h.net:80", "/p")
    assert url_rules.apply_rules(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_rules.apply_rules(pages, rules.limit(0), default="block").collect()} == {"block"}


# --- similarity

def plain_components(texts, width=5):
    def tokens(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets, low = [tokens(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and low[i] != low[j]:
                x, y = min(low[i], low[j]), max(low[i], low[j])
                low = [x if v == y else v for v in low]
    return [(len(s), c) for s, c in zip(sets, low, strict=True)]


def near_copies(rnd):
    texts = [None, "", " ", "one two", "ONE two", "a b c d e", "a b c d e f", "x " * 3000]
    shared = prose(rnd, 60)
    for _ in range(60):
        base = prose(rnd, rnd.randint(12, 120)).split()
        if rnd.random() < 0.5:
            base[5:5] = shared.split()
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 4)):
            for _ in range(rnd.randint(0, 2)):
                base[rnd.randrange(len(base))] = rnd.choice(WORDS)
            texts.append(" ".join(base))
    base = prose(rnd, 150).split()
    for _ in range(150):  # a crowd of near copies, so that its tokens are frequent
        copy = list(base)
        for _ in range(rnd.randint(0, 4)):
            copy[rnd.randrange(len(copy))] = rnd.choice(WORDS)
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("counters", [1 << 14, 1 << 20])
def test_jaccard_components(spark, counters):
    texts = near_copies(random.Random(7))
    docs = documents(spark, texts).repartition(5)
    rows, _, components = setjoin.jaccard_links(docs, counters=counters)
    classes = setjoin.classes_with_components(rows, components)
    out = rows.join(classes, "node", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("c"))
    got = {r["doc_id"]: (r["n"], r["c"]) for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == plain_components(texts)


def test_jaccard_long_copies(spark):
    """Crowds of long texts, linked and not, whose frequent tokens meet in buckets at several levels of size."""
    rnd = random.Random(17)
    texts = []
    for length in (520, 1100):
        base = prose(rnd, length).split()
        for i in range(60):
            copy = list(base[: len(base) - rnd.randint(0, length // 5)])
            for _ in range(rnd.randint(0, length // 40)):
                copy[rnd.randrange(len(copy))] = rnd.choice(WORDS)
            texts.append(" ".join(copy))
    rows, links, components = setjoin.jaccard_links(documents(spark, texts).repartition(4), counters=1 << 16)
    classes = setjoin.classes_with_components(rows, components)
    got = {r["doc_id"]: (r["n"], r["component_id"]) for r in rows.join(classes, "node").collect()}
    assert [got[i] for i in range(len(texts))] == plain_components(texts)


def test_combinations_meet_and_are_few():
    """Linked sets of any sizes share a combination; a large set has about one for each token."""
    rng = np.random.default_rng(19)
    for n in (400, 450, 512, 513, 640, 1025, 3000, 20_000):
        for m in (n, n + n // 9, 5 * n // 4):
            common = int(setjoin.required(n, m))
            if common > min(n, m):
                continue
            x = rng.integers(0, 1 << 63, n + m - common, dtype=np.uint64) * np.uint64(2)
            order = rng.permutation(len(x))  # the order of all tokens
            mine, other = np.sort(order[:n]), np.sort(order[n - common :])
            keys = [set(setjoin.combinations(x[s], len(s), 0)[0].tolist()) for s in (mine, other)]
            assert keys[0] & keys[1], (n, m)
        if n > 5 * setjoin.PLAIN // 4:
            assert len(keys[0]) <= 1.1 * n
    key, p1, p2 = setjoin.combinations(x[:0], 4, 4)
    assert len(key) == len(p1) == len(p2) == 0


def test_combinations_grow_with_a_text_and_not_its_square():
    """Texts of usual lengths too have fewer combinations than twice their tokens; 200 tokens gave 861 and 400 gave 3,321."""
    x = np.random.default_rng(20).integers(0, 1 << 63, 512, dtype=np.uint64) * np.uint64(2)
    for n in range(4, 513, 4):
        assert len(setjoin.combinations(x[:n], n, 0)[0]) <= 2 * n, n


def test_keep_one_of_each(spark):
    rnd = random.Random(8)
    a, b = prose(rnd, 100), prose(rnd, 100)
    texts = [(5, a), (3, a + " tail"), (3, a + " tail"), (9, b), (9, b), (7, None), (7, ""), (8, "x y"), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS)
    got = sorted((r["doc_id"], r["text"] or "") for r in setjoin.keep_one_of_each(spark, docs, "").collect())
    assert got == sorted([(3, a + " tail"), (9, b), (7, ""), (7, ""), (8, "x y")])
    assert setjoin.keep_one_of_each(spark, docs.limit(0), "").columns == docs.columns


def test_keep_one_of_each_component_node(spark):
    """Texts that don't link stay, though their ids are null or the same."""
    rnd = random.Random(18)
    a, b, c, d, e = (prose(rnd, 100) for _ in range(5))
    texts = [(None, a), (None, b), (None, b + " tail"), (4, c), (4, d), (4, d), (6, e), (6, e + " tail"), (None, e)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS)
    got = [(r["doc_id"], r["text"].removesuffix(" tail")) for r in setjoin.keep_one_of_each(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(None, a), (None, b), (4, c), (4, d), (6, e)], key=str)


def test_signatures_bound():
    rng = np.random.default_rng(9)
    for n, m, common in ((30, 40, 20), (600, 700, 500), (5, 5, 0)):
        x = rng.integers(0, 1 << 63, n + m - common, dtype=np.uint64)
        a, b = np.unique(x[:n]), np.unique(x[n - common :])
        assert setjoin.signatures_differ(setjoin.signature(a), setjoin.signature(b)) <= len(np.setxor1d(a, b))


def test_components(spark):
    rnd = random.Random(10)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 80)]
    low = {x: x for e in links for x in e}
    for _ in range(400):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(frame).collect()}
    assert got == {x: c for x, c in low.items() if x in got} and set(low) - set(got) <= {a for a, b in links if a == b}
    halves = merged_components(connected_components(frame.where("a % 2 = 0")), frame.where("a % 2 = 1"))
    assert {r["node"]: r["component"] for r in halves.collect()} == got
    assert connected_components(frame.limit(0)).count() == 0


# --- lines

def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rnd = random.Random(3)
    for _ in range(3000):
        a, b, most = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12))), "".join(rnd.choice("abcé") for _ in range(rnd.randint(0, 12))), rnd.randint(0, 12)
        want, got = plain_distance(a, b), fuzzy_lines.edit_distance_within(a, b, most)
        assert got == want if want <= most else got > most


def test_similar():
    rnd = random.Random(3)
    for _ in range(2000):
        a = [rnd.choice(["ab", "c", "dddd", "ef"]) for _ in range(rnd.randint(1, 12))]
        b = list(a)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randint(0, 1)] = [rnd.choice(["ab", "xyz"])] * rnd.randint(0, 1)
        x, y = " ".join(a), " ".join(b)
        distance = plain_distance(x, y)
        assert fuzzy_lines.similar(x, y) == (5 * distance <= max(len(x), len(y)) and distance <= max(len(x), len(y)) // 5)
        assert not y or fuzzy_lines.aligned_cost(a, b, 10_000) >= distance


def test_all_similar(monkeypatch):
    """Many pairs at once give what one after the other gives: of any length, long ones, far and near."""
    rnd, a, b = random.Random(4), [], []
    for n in [*range(60)] * 20 + [900, 1400, 2600]:
        x = "".join(rnd.choices("abc é\u4e2d", k=n))
        y = list(x)
        for _ in range(rnd.randint(0, n // 4 + 1)):
            at = rnd.randrange(len(y) + 1)
            y[at : at + rnd.randint(0, 1)] = rnd.choices("abcdé", k=rnd.randint(0, 1))
        a += [x, x]
        b += ["".join(y), "".join(rnd.choices("abc", k=n))]
    want = [fuzzy_lines.similar(x, y) for x, y in zip(a, b, strict=True)]
    assert fuzzy_lines.all_similar(a, b).tolist() == want and 100 < sum(want) < len(want) - 100
    monkeypatch.setattr(fuzzy_lines, "LONG", 30)
    assert fuzzy_lines.all_similar(a, b).tolist() == want
    assert fuzzy_lines.all_similar([], []).tolist() == []


@pytest.mark.parametrize("block", [7, 1024])
def test_near_lines_of_other_groups_are_not_rows_of_pairs(spark, monkeypatch, block):
    """40 lines near each other and in components of their own: a row for each of a line's keys and blocks, and all links are found."""
    monkeypatch.setattr(fuzzy_lines, "BLOCK", block)
    rnd, n = random.Random(6), 40
    texts = ["x" * 30 + "".join(rnd.choices("ab", k=rnd.choice([3, 9, 12]))) for _ in range(n)]
    rows = np.zeros(n, dtype=fuzzy_lines.LABELLED)
    rows["key"], rows["node"], rows["chars"], rows["label"] = 5, np.arange(n), [len(t) for t in texts], np.arange(n) // 2
    posted = spark.createDataFrame([(0, bytearray(rows[:25].tobytes())), (0, bytearray(rows[20:].tobytes()))], "range int, postings binary")
    members = fuzzy_lines._members(posted)
    blocks = -(-n // block)
    assert members.count() == n * blocks
    # every band's key is 0; the first one's 64-bit form ends in the key of the postings
    packed = np.zeros((1, 10), np.uint32)
    kept = [(i, 0, len(t), *packed.view(np.int64)[0].tolist(), t.encode()) for i, t in enumerate(texts)]
    classes = spark.createDataFrame([(a, b, c, *k, bytearray(z)) for a, b, c, *k, z in kept], "node long, hash long, chars int, " + ", ".join(f"{k} long" for k in fuzzy_lines.KEYS) + ", norm binary")
    own = fuzzy_lines.wk.mix(np.arange(10, dtype=np.uint64) << np.uint64(32))
    rows["key"] = own[0] & np.uint64(0xFFFFFFFF)
    posted = spark.createDataFrame([(0, bytearray(rows.tobytes()))], "range int, postings binary")
    found = [(r["a"], r["b"]) for r in fuzzy_lines._links_of_members(fuzzy_lines._members(posted), classes, np.zeros(1 << 10, np.uint8)).collect()]
    assert sorted(found) == [(i, j) for i in range(n) for j in range(i + 1, n) if i // 2 != j // 2 and fuzzy_lines.similar(texts[i], texts[j])]
    assert len(found) < n * (n - 2) // 2


def lines_with_copies(rnd):
    """Texts of lines of 6 to 40 words, half of them near copies of others, and short ones."""
    def word():
        return "".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 9)))

    base = [[word() for _ in range(rnd.randint(6, 40))] for _ in range(30)]
    texts = [None, "", "\n\n", "ab\nab", "Note", "note.", "two words", "Two Words", "one"]
    for _ in range(90):
        lines = []
        for _ in range(rnd.randint(1, 4)):
            words = list(rnd.choice(base)) if rnd.random() < 0.6 else [word() for _ in range(12)]
            for _ in range(rnd.randint(0, 2)):
                words[rnd.randrange(len(words))] = word()
            lines.append(" ".join(words).title() + rnd.choice(["", ".", " !"]))
        texts.append("\n".join(lines))
    return texts


def test_every_near_line_is_in_a_pair(spark):
    """A class whose near ones all choose others is compared too: later rounds see only classes that some pair has."""
    rng = np.random.default_rng(6)
    rows = np.zeros(60, dtype=fuzzy_lines.POSTING)
    rows["node"], rows["chars"] = [5 * k + v for k in range(12) for v in (0, 3, 2, 4, 1)], 100  # both that 2 is near have a smaller one than 2
    for i in range(60):  # a chain: each is near the one before it and the one after it
        flips = np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 12, replace=False).astype(np.uint64))
        rows["hash"][i] = rows["hash"][i - 1] ^ flips if i else flips
    postings = spark.createDataFrame([(0, bytearray(rows[:30].tobytes())), (0, bytearray(rows[20:].tobytes()))], "range int, postings binary")
    pairs = [(r["a"], r["b"]) for r in fuzzy_lines._pairs_of_ranges(postings).collect()]
    assert {x for pair in pairs for x in pair} == set(range(60)) and all(a < b for a, b in pairs) and len(pairs) <= 2 * 60


def test_postings_of_lone_classes_are_left_out():
    rows = np.zeros(7, dtype=fuzzy_lines.POSTING)
    rows["key"], rows["node"] = [5, 3, 5, 9, 3, 3, 9], [2, 1, 1, 4, 8, 1, 4]  # two tasks have met 1 under 3, and 4 under 9
    for kept in (rows, rows[:0], rows[:1]):
        found = fuzzy_lines._rows_of(pa.chunked_array([pa.array([x.tobytes() for x in np.array_split(kept, 2)], pa.binary())]), fuzzy_lines.POSTING)
        assert found[["key", "node"]].tolist() == ([(3, 1), (3, 8), (5, 1), (5, 2)] if len(kept) > 1 else [])


def test_places_of_lone_lines_are_not_compared(spark, monkeypatch):
    """Only lines of classes that occur often or are in a component are dealt by component; what is removed is as it was."""
    lines = spark.createDataFrame([(i, 0, 0, 1000 + i) for i in range(300)] + [(7, 0, 1, 5), (3, 0, 1, 5), (9, 0, 1, 6), (None, 1, 2, 6), (2, 0, 3, 8), (1, 0, 4, 9)], "doc_id long, text_hash long, line int, node long")
    components = spark.createDataFrame([(8, 8), (9, 8)], "node long, component long")
    dealt, plain = {}, fuzzy_lines.stored

    def kept(df, name, *options):
        dealt[name] = plain(df, name, *options)
        return dealt[name]

    monkeypatch.setattr(fuzzy_lines, "stored", kept)
    gone = {(r["doc_id"], r["text_hash"]): r["removed"] for r in fuzzy_lines.removed_lines(lines, components).collect()}
    assert gone == {(7, 0): [1], (9, 0): [1], (2, 0): [3]}
    assert dealt["line-places"].count() == 6


@pytest.mark.parametrize("crowd", [4096, -16])
def test_fuzzy_lines(spark, crowd, monkeypatch):
    """Against all pairs by edit similarity alone: nothing is linked that shouldn't be, and nine tenths of the pairs are."""
    monkeypatch.setattr(fuzzy_lines, "CROWD", crowd)
    texts = lines_with_copies(random.Random(11))
    docs = documents(spark, texts).repartition(4).withColumn("removed", F.lit("clash"))
    got = {r["doc_id"]: (list(r["removed"]), r["deduped"]) for r in fuzzy_lines.dedup_lines(docs).collect()}
    norm, places = {}, []
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            words = re.findall(r"[a-z0-9]+", re.sub("[0-9]", "0", line.lower()))
            if words:
                places.append((i, k, norm.setdefault(" ".join(words), len(norm))))
    keys, low = list(norm), list(range(len(norm)))
    pairs = [(i, j) for i in range(len(keys)) for j in range(i) if abs(len(keys[i]) - len(keys[j])) * 5 <= max(len(keys[i]), len(keys[j])) and fuzzy_lines.edit_distance_within(keys[i], keys[j], max(len(keys[i]), len(keys[j])) // 5) <= max(len(keys[i]), len(keys[j])) // 5]
    for i, j in pairs:
        x, y = sorted((low[i], low[j]))
        low = [x if v == y else v for v in low]
    first, of_class = {}, {}
    for i, k, c in places:
        first.setdefault(low[c], (i, k))
        of_class.setdefault(c, []).append((i, k))
    gone = {(i, k) for i in got for k in got[i][0]}
    # what goes is in a group with a smaller place, and every repeated line but the first goes
    for i, k, c in places:
        assert (i, k) not in gone or first[low[c]] < (i, k)
        assert (i, k) in gone or of_class[c][0] == (i, k)
    joined = [of_class[i][0] in gone or of_class[j][0] in gone for i, j in pairs]
    assert len(pairs) > 100 and sum(joined) >= 0.9 * len(pairs)
    for i, t in enumerate(texts):
        assert got[i][1] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone))
    assert [got[i][0] for i in range(3, 9)] == [[1], [], [0], [], [0], []]
    assert fuzzy_lines.dedup_lines(docs.limit(0)).count() == 0
    few = {r["doc_id"]: list(r["removed"]) for r in fuzzy_lines.dedup_lines(docs, min_words=3).collect()}
    assert few[3] == few[5] == few[7] == []


# --- pipeline

def test_fuzzy_lines_of_null_and_repeated_ids(spark):
    """Rows that share an id, or have none, but not a text don't lose each other's lines."""
    rnd = random.Random(12)
    a, b, c, d, e, f = (" ".join("".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(8)) for _ in range(6))
    texts = [(1, a), (None, f"{b}\n{a}"), (None, f"{c}\n{d}"), (5, f"{e}\n{a}"), (5, f"{f}\nx{c}x")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS)
    got = {(r["doc_id"], r["text"]): (list(r["removed"]), r["deduped"]) for r in fuzzy_lines.dedup_lines(docs).collect()}
    assert len(got) == len(texts)
    assert got[(None, f"{c}\n{d}")] == ([], f"{c}\n{d}") and got[(5, f"{f}\nx{c}x")] == ([], f"{f}\nx{c}x")
    assert got[(None, f"{b}\n{a}")] == ([], f"{b}\n{a}")  # null comes first: this occurrence stays
    assert got[(1, a)] == ([0], "") and got[(5, f"{e}\n{a}")] == ([1], e)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(12)
    docs, labels = labelled(spark, rnd, 500)
    leak = prose(rnd, 30)
    clean = prose(rnd, 90)
    extra = spark.createDataFrame([(900, clean, "en", "t", 1), (901, clean, "en", "t", 1), (902, prose(rnd, 40) + " " + leak, "en", "t", 1), (903, None, "en", None, 0)], DOCS)
    docs.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = str(tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = stages["toxicity"](spark, docs, d)
    ids = {r["doc_id"] for r in kept.collect()}
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    assert kept.columns == docs.columns and {900, 901, 902, 903} <= ids and len(ids & toxic) < 0.1 * len(toxic) and len(set(range(500)) - toxic - ids) < 8
    one = stages["near_duplicates"](spark, docs, d)
    ids = {r["doc_id"] for r in one.collect()}
    assert one.columns == docs.columns and 900 in ids and 901 not in ids and 903 in ids
    free = stages["decontamination"](spark, docs, d)
    assert free.columns == docs.columns and {900, 901} <= {r["doc_id"] for r in free.collect()} and free.where("doc_id = 902").count() == 0
    assert stages["mixing"](spark, docs, d).columns == docs.columns
    nothing = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, d).count() == 0, name
    lost = spark.createDataFrame([(None, prose(rnd, 60), None, None, None), (None, prose(rnd, 60), None, None, None)], DOCS).withColumn("__toxicity", F.lit(1))
    for name in ("toxicity", "near_duplicates", "decontamination"):
        assert stages[name](spark, lost, d).count() == 2 and stages[name](spark, lost, d).columns == lost.columns, name
    out = corpus_pipeline.run(spark, d).collect()
    assert [r["slot"] for r in sorted(out, key=lambda r: r["slot"])] == list(range(len(out)))
    assert not {901, 902} & {x for r in out for x in r["doc_ids"]}
    json.dumps([r["slot"] for r in out])


@pytest.mark.parametrize("block", [4096, 7])
def test_pairs_between_components_come_once(spark, monkeypatch, block):
    """Above level 0 a pair shares hundreds of combinations; it is one row of a task all the same, also when a group is cut into blocks."""
    monkeypatch.setattr(setjoin, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[:540], rng.integers(0, 1 << 63, 60, dtype=np.uint64)])) for _ in range(20)]
    rows = [(c, 20, node, 600, -1, -1, node) for c in range(300) for node in range(20)]
    rest = spark.createDataFrame(rows, "c long, size long, node long, n int, p1 int, p2 int, label long")
    classes = spark.createDataFrame([(i, setjoin.folded(setjoin.signature(s))) for i, s in enumerate(sets)], "node long, fold array<long>")
    found = setjoin._between_components(rest, classes)
    got = sorted((r["a"], r["b"], r["na"], r["nb"]) for r in found.collect())
    assert len(got) == len(set(got))
    linked = {(i, j) for i in range(20) for j in range(i + 1, 20) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert linked <= {(a, b) for a, b, _, _ in got} and all(n == (600, 600) for n in {(c, d) for _, _, c, d in got})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join [c" not in plan  # no join of a group's members with one another


def test_a_class_is_taken_apart_once(spark, monkeypatch):
    """Many tasks meet the same class; its combinations are made into rows once all the same, slice by slice."""
    made = []
    monkeypatch.setattr(setjoin, "stored", lambda df, name: made.append((name, df)) or df)
    sets = [(1, [11, 12]), (1, [13]), (2, [11, 13]), (3, [14])]
    rows = [(node, 10, [(c, 0, 1) for c in combos]) for node, combos in sets] * 5
    prefixes = spark.createDataFrame(rows, f"node long, n int, combos array<{setjoin.COMBINATION}>").repartition(4)
    found = setjoin._open(prefixes, spark.createDataFrame([], "node long, component long"))
    assert sorted((r["c"], r["node"], r["size"]) for r in found.collect()) == [(11, 1, 2), (11, 2, 2), (13, 1, 2), (13, 2, 2)]
    assert [(name, df.count()) for name, df in made] == [("combinations", 6)]
    plan = made[0][1]._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan[plan.index("Aggregate"):]  # classes are told apart below the explosion


def test_stars_go_to_the_centre(spark):
    """Edits bring rare tokens, so of a group's members the text without any is the centre, whatever the ids."""
    rows = [(i, 100, 0 if i == 7 else 10 + i, [1, 2]) for i in range(10)] + [(99, 100, 100, None)]
    found = setjoin._stars(spark.createDataFrame(rows, "node long, n int, base int, keys array<long>")).collect()
    assert sorted((r["a"], r["b"]) for r in found) == sorted((min(i, 7), max(i, 7)) for i in range(10) if i != 7)
