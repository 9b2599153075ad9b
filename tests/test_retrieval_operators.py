import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.functions.text import cosine
from pagemill.jobs import evaluate as job
from pagemill.operators import context, evaluation, fusion, index, vectors
from pagemill.sources.embedding import embed
from pagemill.sources.index_files import check_index_model, read_index_jsonl, write_index_jsonl

INDEX = "pos long, id string, text string, metadata map<string,string>, embedding array<float>, model string"


def entries(spark, rows, model="m"):
    return spark.createDataFrame([(i, d, t, {"k": d}, v, model) for i, (d, t, v) in enumerate(rows)], INDEX)


def small_index(spark):
    return entries(spark, [("bunker", "Sand", [1.0, 0.0, 0.0]), ("gruen", "Gras", [0.8, 0.6, 0.0]), ("schlaeger", "Holz", [0.0, 0.0, 1.0])])


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 3.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, -1.0, 0.0]
    with pytest.raises(Exception, match="length"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>").select(cosine(F.col("a"), F.col("b"))).collect()


def test_search_filters_and_ties(spark):
    q = spark.createDataFrame([(7, [1.0, 0.1, 0.0])], "query_id long, q_vec array<float>")
    assert [r["id"] for r in vectors.search(q, small_index(spark), 2).orderBy("rank").collect()] == ["bunker", "gruen"]
    assert [r["id"] for r in vectors.search(q, small_index(spark), 2, F.col("id") != "bunker").orderBy("rank").collect()] == ["gruen", "schlaeger"]
    same = entries(spark, [(f"d{i}", "t", [1.0, 0.0, 0.0]) for i in range(9)]).repartition(4)
    assert [r["id"] for r in vectors.search(q, same, 3).orderBy("rank").collect()] == ["d0", "d1", "d2"]
    assert vectors.search(q, same.limit(0), 3).count() == 0
    assert vectors.search(q.limit(0), same, 3).count() == 0


def test_search_against_plain(spark):
    rng = np.random.default_rng(5)
    rows, qs = rng.normal(size=(300, 8)), rng.normal(size=(11, 8))
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qs)], "query_id long, q_vec array<double>")
    ix = spark.createDataFrame([(i, str(i), v.tolist()) for i, v in enumerate(rows)], "pos long, id string, embedding array<double>").repartition(5)
    got = {}
    for r in vectors.search(q, ix, 6, group_bytes=600).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["pos"])
    sims = (qs / np.linalg.norm(qs, axis=1, keepdims=True)) @ (rows / np.linalg.norm(rows, axis=1, keepdims=True)).T
    assert got == {i: np.argsort(-s, kind="stable")[:6].tolist() for i, s in enumerate(sims)}


def test_search_grid_with_ties_and_filters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    monkeypatch.setattr(vectors, "ENTRY_BLOCK", 7)
    monkeypatch.setattr(vectors, "LANES", 2)
    rng = np.random.default_rng(6)
    rows, qs = rng.integers(-1, 2, size=(200, 3)).astype(float), rng.integers(-1, 2, size=(23, 3)).astype(float)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qs)] + [(99, None)], "query_id long, q_vec array<double>")
    spark.createDataFrame([(i, str(i), i % 3 if i % 5 else None, v.tolist()) for i, v in enumerate(rows)], "pos long, id string, kind int, embedding array<double>").repartition(6).write.parquet(str(tmp_path / "ix"))
    filters = {"all": F.lit(True), "kind 1": F.col("kind") == 1, "none": F.col("kind") == 9, "late": F.col("pos") >= 190}
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    sims = np.round(unit(qs) @ unit(rows).T, 12)
    admits = {"all": range(200), "kind 1": [i for i in range(200) if i % 5 and i % 3 == 1], "late": range(190, 200)}
    expected = {(f, i): sorted(some, key=lambda p, s=s: (-s[p], p))[:15] for f, some in admits.items() for i, s in enumerate(sims)}
    for group_bytes in (30, 1 << 20):  # over 16 rows of the grid, or one broadcast
        monkeypatch.setattr(vectors, "BROADCAST_BYTES", group_bytes)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = vectors.search_filters(q, spark.read.parquet(str(tmp_path / "ix")), 15, filters, group_bytes=group_bytes)
        got = {}
        for r in found.orderBy("filter_id", "query_id", "rank").collect():
            got.setdefault((r["filter_id"], r["query_id"]), []).append(r["pos"])
        assert got == expected
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count(f"{tmp_path}/ix") == 1 and ("CartesianProduct" in plan) == (group_bytes == 30)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError, match="filters"):
        vectors.search_filters(q, spark.read.parquet(str(tmp_path / "ix")), 1, {})
    with pytest.raises(Exception, match="length"):
        vectors.search(spark.createDataFrame([(1, [1.0])], "query_id long, q_vec array<double>"), spark.read.parquet(str(tmp_path / "ix")), 1).collect()


def test_variants_share_one_search(spark, tmp_path):
    rng = np.random.default_rng(7)
    spark.createDataFrame([(i, str(i), v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))], "pos long, id string, embedding array<double>").write.parquet(str(tmp_path / "ix"))
    ix = spark.read.parquet(str(tmp_path / "ix"))
    q = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(rng.normal(size=(5, 2, 4)))], "query_id long, q_vec array<double>, t_vec array<double>")
    key = ["query_id", "rank", "pos", "id", "score"]
    both = job.variant_hits(q, ix, 4, 9)
    for name, alone in {"original": vectors.search(q, ix, 4), "passage": vectors.search(q, ix, 4, vector="t_vec"), "fused": fusion.fusion_search(q, ix, 4, 9)}.items():
        assert sorted(both.where(F.col("variant") == name).select(*key).collect()) == sorted(alone.select(*key).collect())
    assert {r[0] for r in job.variant_hits(q, ix, 4, 9, ["fused", "passage"]).select("variant").distinct().collect()} == {"fused", "passage"}


def ranking(spark, *lists):
    return spark.createDataFrame([(1, n, r, x) for n, ids in enumerate(lists, 1) for r, x in enumerate(ids, 1)], "query_id long, list_no int, rank int, id string")


def test_rrf(spark):
    got = fusion.rrf(ranking(spark, ["a", "b"], ["c", "b"])).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["b", "a", "c"]
    assert math.isclose(got[0]["points"], 2 / 62) and math.isclose(got[1]["points"], 1 / 61)
    got = fusion.rrf(ranking(spark, ["a", "a", "b"])).orderBy("rank").collect()
    assert [(r["id"], round(r["points"], 9)) for r in got] == [("a", round(1 / 61, 9)), ("b", round(1 / 63, 9))]


def test_fusion_search_scores_by_text(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0, 1.0], [1.0, 0.0, 0.0])], "query_id long, q_vec array<float>, t_vec array<float>")
    got = fusion.fusion_search(q, small_index(spark), 5, candidates=1).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [("schlaeger", 0.0), ("bunker", 1.0)]
    hits = spark.createDataFrame([(1, 0.2), (1, float("nan")), (1, 0.8), (2, float("nan"))], "query_id long, score double")
    assert dict(map(tuple, fusion.best_score(hits).collect())) == {1: 0.8, 2: float("-inf")}


def test_search_filters(spark):
    q = spark.createDataFrame([(7, [1.0, 0.1, 0.0]), (8, None)], "query_id long, q_vec array<float>")
    got = vectors.search_filters(q, small_index(spark), 1, {"all": F.lit(True), "rest": F.col("id") != "bunker"}).collect()
    assert {(r["filter_id"], r["query_id"], r["id"]) for r in got} == {("all", 7, "bunker"), ("rest", 7, "gruen")}


def test_null_texts_are_changed(spark):
    docs = spark.createDataFrame([(0, "a", None), (1, "b", "x")], "pos long, id string, text string")
    old = docs.withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    assert dict(map(tuple, index.refresh_plan(docs, old).collect())) == {"a": "changed", "b": "reused"}
    assert [r["id"] for r in index.missing(docs, old).collect()] == ["a"]


def test_required_numbers(spark):
    chunks = spark.createDataFrame([(3, "c3", "1.1"), (1, "c1", "1.1")], "pos long, id string, number string")
    found = index.first_by_number(chunks, spark.createDataFrame([("1.1",), ("9",)], "number string"))
    assert {r["number"]: r["id"] for r in found.collect()} == {"1.1": "c1", "9": None}
    assert index.require_all(found.where("number = '1.1'")).count() == 1
    with pytest.raises(Exception, match="no chunk with number 9"):
        index.require_all(found).collect()


def test_index_refresh(spark):
    def embedder(df):
        return embed(df.withColumn("metadata", F.lit(None).cast("map<string,string>")).withColumn("model", F.lit("m")), "text", lambda ts: [[float(len(t)), 0.0, 0.0] for t in ts]).select("pos", "id", "text", "metadata", "embedding", "model")

    docs = spark.createDataFrame([(0, "a", "eins"), (1, "b", "zwei!"), (2, "c", "drei")], "pos long, id string, text string")
    old = entries(spark, [("x", "weg", [1.0, 0.0, 0.0]), ("a", "eins", [9.0, 0.0, 0.0]), ("b", "zwei", [1.0, 0.0, 0.0])])
    fresh, stats = index.refresh_index(docs, old, embedder)
    assert tuple(stats.first()) == (1, 2, 1)
    assert [(r["id"], r["embedding"][0]) for r in fresh.orderBy("pos").collect()] == [("a", 9.0), ("b", 5.0), ("c", 4.0)]
    kept, removed = index.retain(old, docs)
    assert kept.count() == 2 and removed.first()[0] == 1
    assert tuple(index.index_stats(old).first()) == (3, 3)


def test_positions(spark):
    df = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "k int").repartition(5)
    assert [(r["pos"], r["k"]) for r in index.with_positions(df, "k").orderBy("pos").collect()] == [(i, i) for i in range(50)]


def test_index_files(spark, tmp_path):
    write_index_jsonl(small_index(spark), str(tmp_path / "ix"), "m")
    back, model = read_index_jsonl(spark, str(tmp_path / "ix"))
    assert model == "m" and [(r["id"], list(r["embedding"])) for r in back.orderBy("pos").collect()][1] == ("gruen", [pytest.approx(0.8), pytest.approx(0.6), 0.0])
    one = tmp_path / "one.jsonl"
    one.write_text('{"model":"m2","dimensions":1,"count":3}\n{"id":"a","text":"t","metadata":{},"vector":[1]}\n{"id":"b","text":"t","metadata":{},"vector":[2]}\n{"id":"a","text":"u","metadata":{},"vector":[3]}\n')
    back, model = read_index_jsonl(spark, str(one))
    assert [(r["pos"], r["id"], r["text"]) for r in back.orderBy("pos").collect()] == [(0, "a", "u"), (1, "b", "t")]
    (tmp_path / "none.jsonl").write_text("")
    with pytest.raises(ValueError, match="no index"):
        read_index_jsonl(spark, str(tmp_path / "none.jsonl"))
    assert check_index_model(small_index(spark), "m", True).count() == 3
    assert check_index_model(small_index(spark), "other", False).count() == 0
    with pytest.raises(Exception, match="built with"):
        check_index_model(small_index(spark), "other", True).collect()


def test_embed_batches(spark):
    def embedder(ts):
        assert len(ts) <= 32
        return [[float(t)] for t in ts]

    df = spark.createDataFrame([(str(i),) for i in range(70)], "t string").coalesce(1)
    assert [r["embedding"][0] for r in embed(df, "t", embedder).collect()] == [float(i) for i in range(70)]
    with pytest.raises(Exception, match="vectors"):
        embed(df, "t", lambda ts: [[1.0]]).collect()


BOOK = ["19", "19.2a", "19.2b", "19.2c", "19.2c", "19.3a", "19.20", "Bunker"]


def siblings(spark, hits, **limits):
    book = spark.createDataFrame([(i, f"c{i}", "b", n, "x" * 10) for i, n in enumerate(BOOK)], "pos long, id string, source string, number string, text string")
    found = spark.createDataFrame([(1, r, h, 0.5) for r, h in enumerate(hits, 1)], "query_id long, rank int, id string, score double")
    return [(r["id"], r["is_hit"]) for r in context.expand_siblings(found, book, **limits).orderBy("n").collect()]


def test_siblings_of_large_subsections(spark):
    """Against a plain walk, and with no more members in the table than a walk can take or skip."""
    rnd = random.Random(3)
    sizes = [rnd.randint(1, 60) for _ in range(900)] + [None]
    book = [(i, f"c{i}", rnd.choice("ab"), rnd.choice(["1.1", "1.1a", "2.3", "2.3 x", None]), c if c is None else "y" * c) for i, c in enumerate(sizes)]
    chunks = spark.createDataFrame(book, "pos long, id string, source string, number string, text string")
    hits = [(q, r, f"c{i}", 1.0) for q in range(25) for r, i in enumerate(rnd.sample(range(900), 4))]
    got = {}
    for r in context.expand_siblings(spark.createDataFrame(hits, "query_id long, rank int, id string, score double"), chunks, 9, 150).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    by_id = {b[1]: b for b in book}
    for q in range(25):
        mine = [h[2] for h in hits if h[0] == q]
        taken, chars = list(mine), sum(len(by_id[m][4]) for m in mine)
        for m in mine:
            _, _, source, number, _ = by_id[m]
            if number not in ("1.1", "1.1a", "2.3"):
                continue
            for _, i, s, n, text in book:
                if s == source and n in (number[:3], number[:3] + "a") and text is not None and i not in taken and len(taken) < 9 and chars + len(text) <= 150:
                    taken.append(i)
                    chars += len(text)
        assert got[q] == set(taken)
    members = [r["members"] for r in context.sibling_table(chunks, 9, 150).collect()]
    assert len(members) == 4 and max(len(m) for m in members) < 80
    assert context.sibling_table(chunks.limit(0)).count() == 0


def test_siblings(spark):
    assert siblings(spark, ["c3", "c7"]) == [("c1", False), ("c2", False), ("c3", True), ("c4", False), ("c7", True)]
    assert siblings(spark, ["c3", "c7"], max_chunks=3) == [("c1", False), ("c3", True), ("c7", True)]
    assert siblings(spark, ["c3"], max_chars=25) == [("c1", False), ("c3", True)]
    assert siblings(spark, ["c7", "c0"]) == [("c0", True), ("c7", True)]
    assert siblings(spark, ["zz", "c7"]) == [("c7", True), ("zz", True)]


def test_prompt(spark):
    s = spark.createDataFrame([(1, 2, "Zwei", 5, None), (1, 1, "Eins", 41, 39), (1, 3, "Drei", None, None)], "query_id long, n int, text string, page int, printed_page int")
    q = spark.createDataFrame([(1, "Was gilt?"), (2, "Leer?")], "query_id long, question string")
    got = dict(map(tuple, context.build_prompt(s, q).collect()))
    assert got[1] == "Quellen:\n\n[1] Eins\n(Fundstelle: Seite 39)\n\n[2] Zwei\n(Fundstelle: Seite 5)\n\n[3] Drei\n\nFrage: Was gilt?"
    assert got[2] == "Quellen:\n\nFrage: Leer?"


def test_evaluation(spark):
    gold = spark.createDataFrame([(1, "rule", "a", ["19.2"]), (2, "rule", "b", ["16.1"]), (3, "off_topic", "c", [])], "query_id long, grp string, question string, expected array<string>")
    hits = spark.createDataFrame([("v", 1, 1, "3.1", 0.9), ("v", 1, 2, "19.2a", 0.8), ("v", 2, 1, "16.10", 0.7), ("v", 3, 1, "1.1", 0.6)], "variant string, query_id long, rank int, number string, score double")
    ranks = evaluation.first_correct_rank(hits, gold)
    assert {r["query_id"]: r["rank"] for r in ranks.collect()} == {1: 2, 2: 0}
    assert tuple(evaluation.hit_at(ranks).first()) == ("v", 2, 0, 1)
    rejected = spark.createDataFrame([("v", 1, "a", None), ("v", 3, "c", None), ("v", 2, "b", "s")], "variant string, query_id long, question string, search_text string")
    assert tuple(evaluation.rejections(rejected, gold).first())[:4] == ("v", 1, 0, 1)
    assert {r["query_id"]: r["search_text"] for r in evaluation.searched_text(rejected).collect()} == {1: "a", 2: "s", 3: "c"}
    row = evaluation.separation(hits, gold).first()
    assert (row["weakest_query"], row["strongest_query"], round(row["gap"], 6), row["blocked"]) == (2, 3, 0.1, 1)
    assert row["threshold"] == pytest.approx(0.64, abs=0.011)
