"""Texts lie on disk once and are dealt once, however many steps run over them."""

import os
import random
from pathlib import Path

from pyspark.sql import functions as F

from pagemill.jobs import build_index
from pagemill.operators import chunking, lines
from pagemill.sources.embedding import embed_durably
from pagemill.sources.shared import bucketed, new_path, passing, written

SECTIONS = "section string, first_page int, last_page int, strategy string, section_no int"
RULES = chunking.HeadingRules(titles={1: "Eins"})


def on_disk(spark):
    """Bytes of shuffle files and of tables."""
    return sum(p.stat().st_size for p in Path(spark.conf.get("spark.local.dir")).rglob("*") if p.is_file())


def book(spark, n):
    rnd = random.Random(5)
    texts = ["\n".join([f"{i // 50 + 1}.{i % 50} Titel" if i % 9 == 0 else "Ein Satz.", *("".join(rnd.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=200)) for _ in range(20))]) for i in range(n)]
    pages = spark.createDataFrame([("a.pdf", i, f"a#{i}", t, None) for i, t in enumerate(texts, 1)], "source string, page int, id string, text string, printed_page int")
    return pages, sum(map(len, texts))


def test_chunks_take_little_disk(spark, tmp_path):
    pages, size = book(spark, 400)
    sections = spark.createDataFrame([("A", 1, 200, "size", 1), ("B", 201, 300, "terms", 2), ("C", 301, 400, "headings", 3)], SECTIONS)
    written(pages, "pages-given")
    before = on_disk(spark)
    build_index.chunks_of(pages, sections, 1500, RULES).write.parquet(str(tmp_path / "chunks"))
    assert on_disk(spark) - before < 1.5 * size
    assert spark.read.parquet(str(tmp_path / "chunks")).count() > 1000


def test_packed_lines_give_the_same_chunks(spark):
    pages, _ = book(spark, 140)
    placed = pages.withColumn("section", F.lit("S"))
    packed = lines.packed_lines(placed)
    plain = lines.to_lines(placed).where("line_idx <> 4").persist()
    thinned = packed.withColumn("lines", F.filter("lines", lambda x: x["line_idx"] != 4))
    for way in (lambda x: chunking.chunk_by_size(x, 900), lambda x: chunking.chunk_by_terms(x, 900), lambda x: chunking.chunk_by_headings(x, 9000, RULES)):
        assert sorted(map(str, way(thinned).collect())) == sorted(map(str, way(plain).collect()))


def test_what_is_written_leaves_no_shuffle_files(spark):
    def shuffled():
        return {x for _, _, names in os.walk(spark.conf.get("spark.local.dir")) for x in names if x.startswith("shuffle_")}

    before = shuffled()
    found = written(spark.range(1000).repartition(3, "id"), "dealt")
    assert not shuffled() - before and found.count() == 1000


def test_texts_dealt_by_a_key_stay_there(spark, tmp_path):
    table = bucketed(spark.createDataFrame([(f"k{i}", f"text {i % 50}" if i else None) for i in range(120)], "id string, text string"), "texts", ["id"], 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = embed_durably(table, "text", lambda texts: [[float(len(t))] for t in texts], "m", str(tmp_path / "vectors"), batch_size=8, key="id")
        assert {r["id"]: r["embedding"] for r in found.collect()} == {f"k{i}": [float(len(f"text {i % 50}"))] if i else None for i in range(120)}
        plan = found._jdf.queryExecution().executedPlan().toString()
        under = [x for x in plan.split("\n") if "Exchange hashpartitioning(id" in x]
        assert "SortMergeJoin" in plan and not under
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_passing_tables_go(spark):
    kept = new_path(spark, "kept")
    with passing(spark):
        gone = [written(spark.range(5), "step"), bucketed(spark.range(5), "bucket", ["id"], 2)]
        stays = bucketed(gone[0].join(gone[1], "id"), "kept", ["id"], 2, path=kept)
    assert stays.count() == 5
    names = os.listdir(os.path.dirname(kept))
    assert os.path.basename(kept) in names and not [x for x in names if x.startswith(("step-", "bucket-"))]
