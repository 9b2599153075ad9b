"""Quality: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(theta_k - f(text)) with one shared f, a weight for each hashed word,
bigram and skip-gram and for the share of words of each surface shape, and ordered thresholds
theta.  Weights and thresholds are learnt together from a bounded sample of rated rows; every
document gets its expected grade and the probability of each tail.

Defined results: a null or empty text has f = 0; texts count whole; repeated rows are scored
each; an empty table gives no rows; without ratings all grades are equally likely.  Input columns
named like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import is_training, labelled_sample, table
from pagemill.llm.linear import Features, Ftrl, dense, fit, fit_shards, sigmoid
from pagemill.llm.toxicity import SHARD_ROWS, with_scores

FEATURES = Features(bits=20, orders=(1, 2), skips=(1,), lower=False, alnum=False, shapes=True)
FTRL = Ftrl(alpha=0.5, beta=1.0, l1=3.0, l2=0.1, epochs=2)


class CumulativeLink:
    """Loss slopes for grades 0..len(theta); ``slope`` also moves the thresholds."""

    def __init__(self, theta: np.ndarray, rate: float = 0.2, least_gap: float = 0.05):
        self.theta, self.rate, self.gap, self.n = theta.astype(float), rate, least_gap, np.ones(len(theta))

    def slope(self, f: float, grade: int) -> float:
        t, top = self.theta, len(self.theta)
        upper = 1.0 if grade == top else float(sigmoid(t[grade] - f))
        lower = 0.0 if grade == 0 else float(sigmoid(t[grade - 1] - f))
        mass = max(upper - lower, 1e-9)
        if grade < top:
            self._move(grade, -upper * (1 - upper) / mass)
        if grade > 0:
            self._move(grade - 1, lower * (1 - lower) / mass)
        return 1.0 - upper - lower

    def _move(self, k: int, g: float) -> None:
        self.n[k] += g * g
        value = self.theta[k] - self.rate * g / self.n[k] ** 0.5
        low = self.theta[k - 1] + self.gap if k else -np.inf
        high = self.theta[k + 1] - self.gap if k + 1 < len(self.theta) else np.inf
        self.theta[k] = min(max(value, low), high)


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    theta: np.ndarray
    features: Features = FEATURES


def train(docs: DataFrame, ratings: DataFrame, grade: Column, grades: int, sample_rows: int = 40_000, features: Features = FEATURES, ftrl: Ftrl = FTRL) -> OrdinalModel:
    """``grade``: a column expression on ``ratings`` (doc_id, ...) with values 0..grades-1; nulls and others are left out."""
    valid = F.when(grade.between(0, grades - 1), grade)
    sample, n = labelled_sample(docs, ratings, valid, sample_rows)
    start = np.log(np.arange(1, grades) / np.arange(grades - 1, 0, -1))
    if not n:
        return OrdinalModel(np.zeros(1 << features.bits, np.float32), start, features)

    def learn(texts: pa.Array, y: np.ndarray) -> dict[int, float]:
        share = (np.cumsum(np.bincount(y, minlength=grades)[:-1]) + np.arange(1, grades)) / (len(y) + grades)
        link = CumulativeLink(np.log(share / (1 - share)))
        index, weight, _ = fit(features, ftrl, texts, y, link.slope, None)
        return dict(zip(index.tolist(), weight.tolist(), strict=True)) | {-1 - k: float(t) for k, t in enumerate(link.theta)}

    found = fit_shards(sample, n, SHARD_ROWS, learn)
    return OrdinalModel(dense(found, features.bits), np.array([found[-1 - k] if -1 - k in found else start[k] for k in range(grades - 1)]), features)


def grade_documents(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """``docs`` with expected_grade and p_ge_1, p_ge_2, ...: the probability of that grade or a higher one."""
    tails = {f"p_ge_{k + 1}": ("double", lambda f, t=float(t): sigmoid(f - t)) for k, t in enumerate(model.theta)}
    expected = ("double", lambda f: sum(sigmoid(f - float(t)) for t in model.theta))
    return with_scores(docs, model.features, model.weights, text, {"expected_grade": expected} | tails)


def quality_grade() -> Column:
    """0 poor, 1 well-formed but toxic, 2 well-formed and clean."""
    clean = F.when(F.coalesce(F.col("toxic"), F.lit(0)) >= 1, 1).otherwise(2)
    return F.when(F.col("quality") >= 1, clean).when(F.col("quality").isNotNull(), 0)


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), quality_grade(), 3)
    graded = grade_documents(docs, model)
    return graded.select("doc_id", (~is_training()).alias("held_out"), "expected_grade", "p_ge_1", "p_ge_2", (F.col("p_ge_1") >= 0.5).alias("kept"))
