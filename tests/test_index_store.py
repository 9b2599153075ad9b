"""The bucketed index with deltas: what a change costs, and that reads are what plain operators give."""

import os

import pytest
from pyspark.sql import functions as F

from pagemill.operators import index
from pagemill.sources import index_store
from pagemill.sources.embedding import embed
from pagemill.sources.index_store import IndexStore

DOCS = "pos long, id string, text string"


def embedder(df):
    return embed(df, "text", lambda texts: [[float(len(t or "")), 1.0] for t in texts])


def docs(spark, texts):
    return spark.createDataFrame([(i, f"d{key}", t) for i, (key, t) in enumerate(texts.items())], DOCS)


def rows(df):
    return sorted(tuple(r) for r in df.select("pos", "id", "text", "embedding").collect())


def files(path):
    return {os.path.join(d, x): os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(path) for x in names if x.endswith(".parquet")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def under_exchange(plan, column):
    """Whether an exchange of the plan has the column below it, or passes it on."""
    lines, found = plan.split("\n"), False
    for at, line in enumerate(lines):
        if "Exchange hashpartitioning" in line or "BroadcastExchange" in line:
            depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
            for below in lines[at + 1 :]:
                if len(below) - len(below.lstrip(" :+-*()0123456789")) <= depth:
                    break
                found |= "FileScan" in below and f"{column}#" in below.split("Batched")[0]
    return found


def test_refresh_costs_what_changed(spark, tmp_path):
    long = {i: f"text {i} " * 40 for i in range(2000)}
    store = IndexStore.create(embedder(docs(spark, long)), str(tmp_path / "ix"), "m", buckets=4)
    before = files(tmp_path)
    changed = {i: t + ("!" if i % 200 == 0 else "") for i, t in long.items() if i % 400 != 1} | {5000: "new"}
    now = docs(spark, changed)
    asked = []
    fresh, stats = store.refresh(now, lambda d: asked.append(d.select("id").collect()) or embedder(d))
    assert tuple(stats.first()) == (1985, 11, 5) and {r[0] for r in asked[0]} == {*(f"d{i}" for i in range(0, 2000, 200)), "d5000"}
    written = sum(size for name, size in files(tmp_path).items() if name not in before)
    assert written < 0.15 * sum(before.values())
    assert fresh.snapshot.deltas and fresh.snapshot.base == store.snapshot.base
    assert fresh.snapshot.entries == fresh.read().count() == 1996
    expected, _ = index.refresh_index(now, store.read(), embedder)
    assert rows(fresh.read()) == rows(expected)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(fresh.read())
        assert "SortMergeJoin" in plan and "embedding" in plan
        assert not under_exchange(plan, "embedding") and not under_exchange(plan, "text")
        assert "embedding" not in plan_of(fresh.keys())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    again, stats = fresh.refresh(now, embedder)
    assert again is fresh and stats.first()["embedded"] == 0
    assert rows(store.read()) == rows(IndexStore.open(spark, str(tmp_path / "ix"), number=1).read()) != rows(fresh.read())


def test_changes_against_plain_dictionaries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_store, "MOST_DELTAS", 2)
    monkeypatch.setattr(index_store, "DELTA_SHARE", 0.8)
    texts = {i: f"t{i}" for i in range(12)}
    store = IndexStore.create(embedder(docs(spark, texts)), str(tmp_path / "ix"), "m", buckets=3)
    pos = {f"d{i}": i for i in texts}
    held = {f"d{i}": t for i, t in texts.items()}
    kinds = set()
    for turn in range(5):
        new = {i: f"turn {turn}" for i in (turn, 20 + turn)}
        top = max(pos.values(), default=-1)
        for n, i in enumerate(new):
            pos.setdefault(f"d{i}", top + 1 + n)
            held[f"d{i}"] = new[i]
        store = store.upsert(embedder(docs(spark, new)))
        gone = {f"d{turn + 6}", f"d{20 + turn - 1}"}
        store, n = store.retain(spark.createDataFrame([(i,) for i in held if i not in gone], "id string"))
        assert n == sum(held.pop(i, None) is not None for i in gone)
        store = store.maintain()
        pos = {i: p for i, p in pos.items() if i in held}
        got = store.read().collect()
        assert {r["id"]: (r["text"], r["pos"]) for r in got} == {i: (t, pos[i]) for i, t in held.items()} and len(got) == len(held)
        assert store.snapshot.entries == len(held)
        kinds.add(len(store.snapshot.deltas))
        pos["top"] = store.snapshot.top
        held["top"] = None
        del held["top"]
    assert max(kinds) <= 2
    before = rows(store.read())
    store = store.compact()
    assert not store.snapshot.deltas and rows(store.read()) == before
    store.vacuum()
    assert rows(IndexStore.open(spark, str(tmp_path / "ix")).read()) == before
    assert len(os.listdir(tmp_path / "ix" / "manifest")) == 1 and len(os.listdir(tmp_path / "ix" / "base")) == 1


def test_guard_dimensions_and_writers(spark, tmp_path):
    path = str(tmp_path / "ix")
    store = IndexStore.create(embedder(docs(spark, {1: "a", 2: None})), path, "m1", buckets=2)
    with pytest.raises(ValueError, match="built with m1"):
        IndexStore.open(spark, path, "m2")
    other = IndexStore.open(spark, path, "m2", strict=False)
    assert other.read().count() == 0 and other.snapshot.entries == 0
    assert IndexStore.open(spark, path, "m1").read().count() == 2
    with pytest.raises(ValueError, match="no index"):
        IndexStore.open(spark, path, number=77)
    with pytest.raises(Exception, match="2 numbers is wanted"):
        store.upsert(docs(spark, {3: "c"}).withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
    _, stats = store.refresh(docs(spark, {1: "a", 2: None}), embedder)  # a null text is the same as no other
    assert tuple(stats.first()) == (1, 1, 0)
    with pytest.raises(Exception, match="(?i)exist"):
        store.upsert(embedder(docs(spark, {9: "late"})))
    with pytest.raises(ValueError, match="numbers"):
        IndexStore.create(docs(spark, {1: "a", 2: "b"}).withColumn("embedding", F.when(F.col("id") == "d1", F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0)))), str(tmp_path / "iy"), "m")


def test_from_nothing_and_to_nothing(spark, tmp_path):
    store = IndexStore.create(embedder(docs(spark, {})), str(tmp_path / "ix"), "m", buckets=2)
    assert store.snapshot.dimensions == 0 and store.read().count() == 0
    store, stats = store.refresh(docs(spark, {1: "a", 2: "b"}), embedder)
    assert tuple(stats.first()) == (0, 2, 0) and store.snapshot.dimensions == 2
    assert rows(store.read()) == [(0, "d1", "a", [1.0, 1.0]), (1, "d2", "b", [1.0, 1.0])]
    store, stats = store.refresh(docs(spark, {}), embedder)
    assert tuple(stats.first()) == (0, 0, 2) and store.read().count() == 0
