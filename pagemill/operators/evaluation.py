"""How well retrieval works: ranks of right chunks, hit rates, score separation, rejections.

Everything is keyed by ``variant``, so several ways to search are compared in one pass.
hits: (variant, query_id, rank, number, score); gold: (query_id, grp, question, expected).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import number_matches

OFF_TOPIC = "off_topic"


def first_correct_rank(hits: DataFrame, gold: DataFrame, k: int = 10, variants: list[str] | None = None) -> DataFrame:
    """(variant, query_id, rank): the first rank up to k whose number is expected, 0 if there is none.

    ``variants`` are the ways to search; without them those that have hits count.
    """
    wanted = gold.where(F.col("grp") != OFF_TOPIC)
    near = hits.where(F.col("rank") <= k).join(wanted.select("query_id", "expected"), "query_id")
    right = near.where(F.exists("expected", lambda e: number_matches(F.col("number"), e)))
    first = right.groupBy("variant", "query_id").agg(F.min("rank").alias("found"))
    if variants:
        every = wanted.select("query_id", F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant"))
    else:
        every = wanted.select("query_id").crossJoin(F.broadcast(hits.select("variant").distinct()))  # ways to search: a handful
    return every.join(first, ["variant", "query_id"], "left").select("variant", "query_id", F.coalesce("found", F.lit(0)).alias("rank"))


def hit_at(ranks: DataFrame, at: tuple[int, ...] = (1, 5)) -> DataFrame:
    """(variant, questions, hit_1, hit_5, ...)."""
    return ranks.groupBy("variant").agg(F.count(F.lit(1)).alias("questions"), *[F.count_if(F.col("rank").between(1, n)).alias(f"hit_{n}") for n in at])


def rank_table(ranks: DataFrame, variants: list[str]) -> DataFrame:
    """A row for each question and a column for each variant."""
    return ranks.groupBy("query_id").pivot("variant", variants).agg(F.first("rank"))


def separation(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """One row for each variant: weakest best score on the topic, strongest off it, gap, threshold, how many it blocks.

    The best score of a question is its first hit's.
    """
    best = hits.where(F.col("rank") == 1).select("variant", "query_id", "score").join(gold.select("query_id", "grp"), "query_id")
    on, off = F.col("grp") != OFF_TOPIC, F.col("grp") == OFF_TOPIC
    order = F.struct("score", "query_id")
    ends = best.groupBy("variant").agg(
        F.min(F.when(on, F.col("score"))).alias("weakest"), F.min_by("query_id", F.when(on, order)).alias("weakest_query"),
        F.max(F.when(off, F.col("score"))).alias("strongest"), F.max_by("query_id", F.when(off, F.struct("score", -F.col("query_id")))).alias("strongest_query"),
    )
    ends = ends.withColumns({"gap": F.col("weakest") - F.col("strongest"), "threshold": F.floor((F.col("weakest") - 0.05) * 100) / 100})
    blocked = best.where(off).join(F.broadcast(ends.select("variant", "threshold")), "variant").groupBy("variant").agg(F.count_if(F.col("score") < F.col("threshold")).alias("blocked"))
    return ends.join(blocked, "variant", "left").fillna(0, ["blocked"])


def rejections(queries: DataFrame, gold: DataFrame) -> DataFrame:
    """One row for each variant: off-topic questions recognised and let through, others rejected, with their ids.

    queries: (variant, query_id, search_text); a null search text is a rejection.
    """
    joined = queries.join(gold.select("query_id", "grp"), "query_id")
    off, rejected = F.col("grp") == OFF_TOPIC, F.col("search_text").isNull()

    def ids(condition):
        return F.sort_array(F.collect_list(F.when(condition, F.col("query_id"))))

    return joined.groupBy("variant").agg(
        F.count_if(off & rejected).alias("recognised"), F.count_if(off & ~rejected).alias("let_through"), F.count_if(~off & rejected).alias("falsely_rejected"),
        ids(off & ~rejected).alias("let_through_ids"), ids(~off & rejected).alias("falsely_rejected_ids"),
    )


def searched_text(queries: DataFrame) -> DataFrame:
    """A rejected question is still searched, with itself."""
    return queries.withColumn("search_text", F.coalesce("search_text", "question"))


def answer_summary(finals: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: answers, failures, corrected ones and their ids, problems left and the answers that have them.

    finals: (answer_id, text, problems, corrected), text null where the model failed; sources:
    (answer_id, text).  ``corrected`` counts answers that were asked for again, whatever they still hold.
    """
    given = source_sizes(sources)
    ids = F.sort_array(F.collect_list(F.when(F.col("corrected"), F.col("answer_id"))))
    left = F.size(F.coalesce("problems", F.array()))
    return finals.join(given, "answer_id", "left").agg(
        F.count(F.lit(1)).alias("answers"), F.count_if(F.col("text").isNull()).alias("failures"),
        F.count_if("corrected").alias("corrected"), ids.alias("corrected_ids"),
        F.count_if(left > 0).alias("with_problems"), F.coalesce(F.sum(left), F.lit(0)).alias("problems_left"),
        F.coalesce(F.sum("n_sources"), F.lit(0)).alias("sources"), F.coalesce(F.sum("source_chars"), F.lit(0)).alias("source_chars"),
    )


def source_sizes(sources: DataFrame) -> DataFrame:
    """(answer_id, n_sources, source_chars)."""
    return sources.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_sources"), F.sum(F.length("text")).alias("source_chars"))
