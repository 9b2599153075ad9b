"""Context for answers: siblings of hits, and prompts with numbered sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A hit's subsection, and what belongs to one.
HIT_NUMBER = r"\A(\d{1,2}\.\d{1,2})[a-z]?\z"
MEMBER_NUMBER = r"\A(\d{1,2}\.\d{1,2})(?:\p{L}.*)?\z"
#: The texts of the prompt.
SOURCES, PLACE, QUESTION = "Quellen:\n\n", "(Fundstelle: Seite ", "Frage: "


def sibling_table(chunks: DataFrame, max_chunks: int = 10, max_chars: int = 12_000) -> DataFrame:
    """(source, key, members): of each subsection the members that an expansion may take, by pos.

    A member that fits lets every earlier one of at most its length fit too, and those count as taken or
    as hits.  So it is never taken once ``max_chunks`` such members come before it: each length keeps its
    first ``max_chunks`` members, so an array has at most ``max_chunks * max_chars``, and a fold
    leaves out the rest.  A null text is no member; ids are taken to be unique.
    """
    members = chunks.select("pos", "id", "source", F.length("text").alias("chars"), F.regexp_extract("number", MEMBER_NUMBER, 1).alias("key"))
    turn = Window.partitionBy("source", "key", "chars").orderBy("pos", "id")
    first = members.where((F.col("key") != "") & (F.col("chars") <= max_chars)).withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= max_chunks)
    arrays = first.groupBy("source", "key").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "chars"))).alias("members"))
    kind = arrays.schema["members"].dataType.simpleString()
    start = F.struct(F.array().cast("array<int>").alias("least"), F.array().cast(kind).alias("kept"))

    def keep(state, m):
        """``least``: the ``max_chunks`` smallest lengths so far."""
        open_ = (F.size(state["least"]) < max_chunks) | (m["chars"] < F.array_max(state["least"]))
        least = F.slice(F.array_sort(F.array_append(state["least"], m["chars"])), 1, max_chunks)
        return F.struct(F.when(open_, least).otherwise(state["least"]).alias("least"), F.when(open_, F.array_append(state["kept"], m)).otherwise(state["kept"]).alias("kept"))

    return arrays.select("source", "key", F.aggregate("members", start, keep, lambda s: s["kept"]).alias("members"))


def expand_siblings(hits: DataFrame, chunks: DataFrame, max_chunks: int = 10, max_chars: int = 12_000) -> DataFrame:
    """(query_id, n, id, score, is_hit): hits and other chunks of their subsections, in book order.

    hits: (query_id, rank, id, score); chunks: (pos, id, source, number, text).  Siblings
    come by rank of their first hit and then by pos, while there are fewer than
    ``max_chunks`` and the next one fits ``max_chars``; hits always stay.
    """
    book = chunks.select("id", "pos", "source", F.length("text").alias("chars"), F.regexp_extract("number", HIT_NUMBER, 1).alias("key"))
    found = hits.join(book, "id", "left")
    wanted = found.where("key <> ''").groupBy("query_id", "source", "key").agg(F.min("rank").alias("rank"))
    # a chunk that once didn't fit never will, as the count of characters only grows: its first turn decides
    turns = wanted.join(sibling_table(chunks, max_chunks, max_chars), ["source", "key"]).select("query_id", F.transform("members", lambda m: F.struct("rank", m["pos"].alias("pos"), m["id"].alias("id"), m["chars"].alias("chars"))).alias("turns"))
    queue = turns.groupBy("query_id").agg(F.sort_array(F.flatten(F.collect_list("turns"))).alias("queue"))
    held = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"), F.coalesce(F.sum("chars"), F.lit(0)).alias("n_chars"), F.collect_set("id").alias("hit_ids"))
    start = F.struct(F.col("n_hits").alias("n"), F.col("n_chars").alias("chars"), F.array().cast("array<string>").alias("ids"))

    def take(state, s):
        fits = (state["n"] < max_chunks) & (state["chars"] + s["chars"] <= max_chars) & ~F.array_contains("hit_ids", s["id"]) & ~F.array_contains(state["ids"], s["id"])
        return F.struct((state["n"] + fits.cast("long")).alias("n"), (state["chars"] + F.when(fits, s["chars"]).otherwise(0)).alias("chars"), F.when(fits, F.array_append(state["ids"], s["id"])).otherwise(state["ids"]).alias("ids"))

    added = queue.join(held, "query_id").select("query_id", F.explode(F.aggregate("queue", start, take, lambda s: s["ids"])).alias("id"))
    rows = found.select("query_id", "id", "pos", "score", F.lit(True).alias("is_hit")).unionByName(added.join(book, "id").select("query_id", "id", "pos", F.lit(None).cast("double").alias("score"), F.lit(False).alias("is_hit")))
    listed = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.col("pos").isNull().alias("unknown"), "pos", "id", "score", "is_hit"))).alias("all"))
    return listed.select("query_id", F.posexplode("all").alias("n", "x")).select("query_id", (F.col("n") + 1).alias("n"), "x.id", "x.score", "x.is_hit")


def build_prompt(sources: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, prompt).  sources: (query_id, n, text, page, printed_page)."""
    page = F.coalesce(F.col("printed_page").cast("string"), F.col("page").cast("string"))
    block = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col("text"), F.lit("\n"), F.coalesce(F.concat(F.lit(PLACE), page, F.lit(")\n")), F.lit("")), F.lit("\n"))
    listed = sources.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", block.alias("block")))).alias("blocks"))
    text = F.array_join(F.transform("blocks", lambda b: b["block"]), "")
    return queries.join(listed, "query_id", "left").select("query_id", F.concat(F.lit(SOURCES), F.coalesce(text, F.lit("")), F.lit(QUESTION), F.col("question")).alias("prompt"))
