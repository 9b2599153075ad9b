"""Reciprocal rank fusion of rankings, and search by two vectors of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions.text import cosine
from pagemill.operators.vectors import DIGITS, search


def rrf(rankings: DataFrame, k: int = 60) -> DataFrame:
    """rankings: (query_id, list_no, rank, id) -> (query_id, rank, id, points).

    An id earns 1 / (k + its best rank) in each list; ties are in order of first appearance.
    """
    best = rankings.groupBy("query_id", "list_no", "id").agg(F.min("rank").alias("rank"))
    points = best.groupBy("query_id", "id").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("points"), F.min(F.struct("list_no", "rank")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("points", DIGITS)), "seen")
    return points.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "id", "points")


def two_lists(queries: DataFrame, index: DataFrame, candidates: int, where: Column | None = None) -> DataFrame:
    """(query_id, list_no, rank, pos, id, score): list 1 by q_vec and list 2 by t_vec, from one pass over the index.

    queries: (query_id integer, q_vec, t_vec).
    """
    # both vectors of a query travel as two queries of one search
    vector = F.explode(F.array(F.struct(F.lit(0).alias("no"), F.col("q_vec").alias("vec")), F.struct(F.lit(1).alias("no"), F.col("t_vec").alias("vec"))))
    single = queries.select("query_id", vector.alias("v")).select((F.col("query_id") * 2 + F.col("v.no")).alias("query_id"), F.col("v.vec").alias("vec"))
    found = search(single, index, candidates, where, "vec")
    return found.select(F.shiftright("query_id", 1).alias("query_id"), (F.col("query_id") % 2 + 1).cast("int").alias("list_no"), "rank", "pos", "id", "score")


def fused(found: DataFrame, queries: DataFrame, index: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """(query_id, rank, pos, id, score) of two lists: the order is by fused points, the score the similarity to the text vector."""
    by_text = F.max(F.when(F.col("list_no") == 2, F.col("score")))
    known = found.groupBy("query_id", "id").agg(F.first("pos").alias("pos"), by_text.alias("score"))
    top = rrf(found, rrf_k).where(F.col("rank") <= k).join(known, ["query_id", "id"])
    # the search by text has the scores of most; what only the other found is scored here
    vectors = index.select("id", "embedding").join(top.where("score is null").select("id").distinct(), "id", "left_semi")
    scored = top.join(vectors, "id", "left").join(queries.select("query_id", "t_vec"), "query_id")
    late = F.when(F.col("score").isNull(), F.round(cosine(F.col("embedding"), F.col("t_vec")), DIGITS))
    return scored.select("query_id", "rank", "pos", "id", F.coalesce("score", late).alias("score"))


def fusion_search(queries: DataFrame, index: DataFrame, k: int, candidates: int = 20, rrf_k: int = 60, where: Column | None = None) -> DataFrame:
    """(query_id, rank, pos, id, score): the best of two searches, by question and by text vector."""
    return fused(two_lists(queries, index, candidates, where), queries, index, k, rrf_k)


def best_score(hits: DataFrame) -> DataFrame:
    """(query_id, best): the largest score that is a number; minus infinity without one."""
    real = F.when(~F.isnan("score"), F.col("score"))
    return hits.groupBy("query_id").agg(F.coalesce(F.max(real), F.lit(float("-inf"))).alias("best"))
