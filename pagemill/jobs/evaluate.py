"""Job: retrieval quality of several ways to search, over the same vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators import evaluation, fusion
from pagemill.sources.shared import written

VARIANTS = ["original", "passage", "fused"]


def variant_hits(queries: DataFrame, index: DataFrame, k: int = 10, candidates: int = 20, variants: list[str] | None = None) -> DataFrame:
    """(variant, query_id, rank, pos, id, score) by question vector, by text vector, and by both.

    One search gives the two lists that all variants share; they are written down, as each variant reads them.
    """
    lists = written(fusion.two_lists(queries, index, max(k, candidates)), "lists")
    columns = ["query_id", "rank", "pos", "id", "score"]
    found = {name: lists.where((F.col("list_no") == no) & (F.col("rank") <= k)).select(*columns) for no, name in enumerate(VARIANTS[:2], 1)}
    found["fused"] = fusion.fused(lists.where(F.col("rank") <= candidates), queries, index, k)
    chosen = [found[name].withColumn("variant", F.lit(name)) for name in variants or VARIANTS]
    every = chosen[0]
    for more in chosen[1:]:
        every = every.unionByName(more)
    return every


def evaluate(queries: DataFrame, index: DataFrame, gold: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    hits = variant_hits(queries, index, k).join(index.select("id", "number"), "id")
    ranks = evaluation.first_correct_rank(hits, gold, k, VARIANTS)
    return {"ranks": ranks, "hit_at": evaluation.hit_at(ranks), "table": evaluation.rank_table(ranks, VARIANTS), "separation": evaluation.separation(hits, gold)}
