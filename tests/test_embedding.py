"""Durable embedding: full batches, and each text paid for once."""

import time
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagemill.sources.embedding import embed_durably


def counting(folder, broken=""):
    """An embedder that notes the texts of each call; a call with the text ``broken`` fails while ``folder``/broken exists."""

    def embedder(texts):
        if broken in texts and Path(folder, "broken").exists():
            time.sleep(4)  # the others have ended
            raise RuntimeError("lost")
        Path(folder, uuid.uuid4().hex).write_text("\n".join(texts))
        return [[float(len(t)), 1.0] for t in texts]

    return embedder


def calls(folder):
    return sorted((p.read_text().split("\n") for p in Path(folder).iterdir() if p.name != "broken"), key=len)


def texts_of(found):
    return sorted(t for c in found for t in c)


def test_batches_are_full_over_several_frames(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    df = spark.createDataFrame([(i, f"text {i}") for i in range(70)], "i long, t string").repartition(7)
    found = embed_durably(df, "t", counting(notes), "m", str(tmp_path / "vectors"))
    assert [(r["i"], r["embedding"]) for r in found.orderBy("i").collect()] == [(i, [len(f"text {i}"), 1.0]) for i in range(70)]
    assert [len(c) for c in calls(notes)] == [6, 32, 32]
    assert found.count() == 70 and len(calls(notes)) == 3  # a second action asks for nothing


def test_each_text_is_paid_for_once(spark, tmp_path):
    notes, path = tmp_path / "notes", str(tmp_path / "vectors")
    notes.mkdir()
    rows = [(i, None if i == 3 else f"text {i % 40}") for i in range(60)]
    df = spark.createDataFrame(rows, "i long, t string").withColumn("embedding", F.lit("old")).withColumn("digest", F.lit("kept"))
    Path(notes, "broken").touch()
    with pytest.raises(Exception, match="lost"):
        embed_durably(df, "t", counting(notes, "text 7"), "m", path, batch_size=4, batches_per_task=1)
    paid = texts_of(calls(notes))
    assert 20 <= len(paid) < 40 and len(set(paid)) == len(paid)
    Path(notes, "broken").unlink()
    for _ in range(2):
        found = embed_durably(df, "t", counting(notes, "text 7"), "m", path, batch_size=4, batches_per_task=1)
        assert found.count() == 60 and {r["digest"] for r in found.collect()} == {"kept"} and [r["i"] for r in found.where("embedding is null").collect()] == [3]
    assert texts_of(calls(notes)) == sorted({t for _, t in rows if t})
    embed_durably(df.limit(5), "t", counting(notes), "another model", path).collect()
    assert len(texts_of(calls(notes))) > 40
    with pytest.raises(Exception, match="lengths"):
        embed_durably(df, "t", lambda ts: [[1.0]] * (len(ts) + 1), "third", path).collect()
