"""Toxicity: logistic regression on hashed word n-grams and skip-grams, by FTRL-proximal steps.

Learning: a sample of the labelled rows (at most about ``sample_rows``, by id hash) is
learnt in a few tasks of at most SHARD_ROWS rows; L1 keeps only the weights that matter, which are broadcast as
one vector of 2**bits floats.  Scoring: one map over all documents, without a shuffle.

Defined results: a null or empty text has no features and gets the bias's score; a text is
scored whole whatever its length; a row is scored as often as it occurs; an empty table gives
no rows; without any label the score is 0.5 everywhere.  Columns of the input that have the
name of an output column are replaced.  A null id is no one's label; it counts as an empty
text in ``held_out``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import give_back, is_training, labelled_sample, set_aside, table
from pagemill.llm.linear import Features, Ftrl, dense, fit, fit_shards, linear_scores, sigmoid

THRESHOLD = 0.3
FEATURES = Features(bits=20, orders=(1, 2), skips=(1,))
FTRL = Ftrl(alpha=1.0, beta=1.0, l1=4.0, l2=0.1, epochs=2)

#: Rows that one task learns from.
SHARD_ROWS = 16_000


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float
    features: Features = FEATURES


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 40_000, features: Features = FEATURES, ftrl: Ftrl = FTRL) -> ToxicityModel:
    """Learn ``labels.toxic`` from the training rows (crc32 of the id modulo 4 is not 2).

    sample_rows bounds the labelled rows learnt from; beyond it, a sample by id hash is used.
    """
    label = F.when(F.col("toxic") >= 1, 1).when(F.col("toxic").isNotNull(), 0)
    sample, n = labelled_sample(docs, labels, label, sample_rows)
    if not n:
        return ToxicityModel(np.zeros(1 << features.bits, np.float32), 0.0, features)

    def learn(texts: pa.Array, y: np.ndarray) -> dict[int, float]:
        rate = (y.sum() + 1) / (len(y) + 2)
        index, weight, bias = fit(features, ftrl, texts, y, lambda s, label: float(sigmoid(s)) - label, float(np.log(rate / (1 - rate))))
        return dict(zip(index.tolist(), weight.tolist(), strict=True)) | {-1: bias}

    found = fit_shards(sample, n, SHARD_ROWS, learn)
    return ToxicityModel(dense(found, features.bits), found.get(-1, 0.0), features)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column of probabilities; every other column passes unchanged."""
    return with_scores(docs, model.features, model.weights, text, {out: ("double", lambda s, bias=model.bias: sigmoid(s + bias))})


def with_scores(docs: DataFrame, features: Features, weights: np.ndarray, text: str, outputs: dict) -> DataFrame:
    """Adds columns {name: (type, function of the linear scores)}; the weights travel as one broadcast."""
    docs = docs.drop(*outputs)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = linear_scores(features, shared.value, 0.0, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(f(s), pa.float64()) for _, f in outputs.values())], names=[*names, *outputs])
        give_back()

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{k}` {kind}" for k, (kind, _) in outputs.items()])
    return docs.mapInArrow(run, schema)


def op2_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~is_training()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    """Pipeline stage: documents whose score is below the threshold, columns as they were; all of them where no label belongs to one."""
    model = train(docs, table(spark, sf_dir, "labels"))
    if not model.bias and not model.weights.any():  # nothing was learnt
        return docs
    docs, back = set_aside(docs, "doc_id", "text")
    return back(score(docs, model).where(F.col("score") < threshold))
