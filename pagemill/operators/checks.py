"""Gates before an answer and checks after it.

Replies of chat models are columns: (query_id, reply) or (answer_id, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions.text import strip
from pagemill.operators.fusion import best_score
from pagemill.operators.sizes import if_few

#: A rewriter's reply for a question that is off the topic, and what is ignored around it.
NOTHING, IGNORED = "keine", '.!"„“'
#: Marks around the terms of a reply.
TERM_ENDS = "\\A[\"„“'*-]+|[\"„“'*.]+\\z"
#: How unsupported citations are reported.
NOWHERE, NOT_THERE = "„%s“ steht in keiner der Quellen", "„%s“ steht nicht in der angegebenen Quelle"


def rewrite_gate(df: DataFrame, reply: str = "reply") -> DataFrame:
    """``search_text``: the reply, or null where it is empty or says that nothing fits."""
    answer = strip(F.coalesce(F.col(reply), F.lit("")))
    bare = strip(F.translate(answer, IGNORED, ""))
    return df.withColumn("search_text", F.when((answer != "") & (F.lower(bare) != NOTHING), answer))


def select_terms(replies: DataFrame, vocabulary: DataFrame, max_terms: int, broadcast_terms: int = 1_000_000) -> DataFrame:
    """(query_id, n, term): a reply's terms that the vocabulary has, each once, ``max_terms`` at most.

    vocabulary: (pos, term); of terms that differ in case alone the last counts.
    """
    terms = vocabulary.groupBy(F.lower("term").alias("key")).agg(F.max_by("term", "pos").alias("term"))
    terms = if_few(terms, broadcast_terms)
    parts = replies.select("query_id", F.posexplode(F.split("reply", "[,;\n]")).alias("i", "part"))
    parts = parts.withColumn("key", F.lower(strip(F.regexp_replace(strip(F.col("part")), TERM_ENDS, ""))))
    first = parts.join(terms, "key").groupBy("query_id", "term").agg(F.min("i").alias("i"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("i"))
    return first.withColumn("n", n).where(F.col("n") <= max_terms).select("query_id", "n", "term")


def expand_query(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """``search_text``: ``question (term, term)``, or the question alone."""
    listed = terms.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", "term"))).alias("terms"))
    names = F.array_join(F.transform("terms", lambda t: t["term"]), ", ")
    return queries.join(listed, "query_id", "left").withColumn("search_text", F.when(F.col("terms").isNull(), F.col("question")).otherwise(F.concat("question", F.lit(" ("), names, F.lit(")")))).drop("terms")


def answer_status(queries: DataFrame, hits: DataFrame, min_score: float) -> DataFrame:
    """(query_id, status, best, model_asked, search_text): off_topic, below_threshold or ask.

    queries: (query_id, question, search_text), search_text null where off the topic.
    """
    joined = queries.join(best_score(hits), "query_id", "left")
    status = F.when(F.col("search_text").isNull(), "off_topic").when(F.col("best").isNull() | (F.col("best") < min_score), "below_threshold").otherwise("ask")
    return joined.withColumn("status", status).select("query_id", "status", F.when(F.col("status") != "off_topic", F.col("best")).alias("best"), (F.col("status") == "ask").alias("model_asked"), F.coalesce("search_text", "question").alias("search_text"))


def extract_citations(answers: DataFrame, pattern: str) -> DataFrame:
    """(answer_id, cit_no, quote, reference, cited): matches of ``pattern`` (group 1: the number) with the ``[n]`` after them."""
    whole = rf"(?:{pattern})(?:\s*(?:\[\d+\])+)?"
    found = answers.select("answer_id", F.posexplode(F.regexp_extract_all("text", F.lit(whole), F.lit(0))).alias("cit_no", "quote"))
    numbers = F.regexp_extract_all(F.regexp_extract("quote", r"((?:\[\d+\])+)\z", 1), F.lit(r"\[(\d+)\]"), F.lit(1))
    cited = F.filter(F.transform(numbers, lambda n: n.try_cast("int")), lambda n: n.isNotNull())
    return found.select("answer_id", "cit_no", strip(F.col("quote")).alias("quote"), F.regexp_extract("quote", pattern, 1).alias("reference"), cited.alias("cited"), (F.size(numbers) > 0).alias("has_sources"))


def number_index(sources: DataFrame) -> DataFrame:
    """(answer_id, reference, held): for each whole number of an answer's sources the numbers of the sources that hold it.

    A whole number follows neither a digit nor a full stop, and no digit follows it: 17.1d holds 17, 17.1 and
    17.1d.  Each source is looked at once, whatever the number of citations.
    """
    numbers = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![\d.])\d[\d.]*(?:\p{L}(?!\d))?"), F.lit(0)))
    each = sources.select("answer_id", "source_no", F.explode(numbers).alias("whole"))
    ends = F.filter(F.sequence(F.lit(1), F.length("whole")), lambda i: ~F.substr("whole", i + 1, F.lit(1)).rlike(r"\d"))
    begins = each.select("answer_id", "source_no", F.explode(F.transform(ends, lambda i: F.substr("whole", F.lit(1), i))).alias("reference"))
    return begins.groupBy("answer_id", "reference").agg(F.collect_set("source_no").alias("held"))


def check_citations(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """``supported``: the number stands, as a whole number, in a cited source, or in any if none is cited.

    sources: (answer_id, source_no, text).  Numbers are looked up by an equi-join; a reference that is no number
    with at most a letter after it is searched for in the texts.
    """
    keys = ["answer_id", "cit_no", "quote", "reference", "cited", "has_sources"]
    is_number = F.coalesce(F.col("reference").rlike(r"\A\d[\d.]*\p{L}?\z"), F.lit(False))
    known = number_index(sources).join(citations.where(is_number).select("answer_id", "reference").distinct(), ["answer_id", "reference"], "left_semi")
    looked_up = citations.where(is_number).join(known, ["answer_id", "reference"], "left")
    supported = F.col("held").isNotNull() & (~F.col("has_sources") | F.arrays_overlap("cited", "held"))
    found = looked_up.select(*keys, F.coalesce(supported, F.lit(False)).alias("supported"))

    cited = ~F.col("has_sources") | F.array_contains("cited", F.col("source_no"))
    stands = F.regexp_like("s_text", F.concat(F.lit(r"(?<![\d.])\Q"), F.col("reference"), F.lit(r"\E(?!\d)")))
    s = sources.select("answer_id", "source_no", F.col("text").alias("s_text"))
    holds = cited & F.contains(F.col("s_text"), F.col("reference")) & stands
    others = citations.where(~is_number).join(s, "answer_id", "left").groupBy(*keys).agg(F.coalesce(F.bool_or(holds), F.lit(False)).alias("supported"))
    return found.unionByName(others)


def citation_report(checked: DataFrame) -> DataFrame:
    """(answer_id, supported, unsupported, checked)."""
    return checked.groupBy("answer_id").agg(F.count_if("supported").alias("supported"), F.count_if(~F.col("supported")).alias("unsupported"), F.count(F.lit(1)).alias("checked"))


def citation_problems(checked: DataFrame, nowhere: str = NOWHERE, not_there: str = NOT_THERE) -> DataFrame:
    """(answer_id, pos, problem) for every unsupported citation."""
    message = F.when(F.col("has_sources"), F.format_string(not_there, "quote")).otherwise(F.format_string(nowhere, "quote"))
    return checked.where(~F.col("supported")).select("answer_id", F.col("cit_no").alias("pos"), message.alias("problem"))


def forbidden_terms(answers: DataFrame, pattern: str, label: str) -> DataFrame:
    """(answer_id, pos, problem) for every match, whatever its case."""
    found = answers.select("answer_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?iu){pattern}"), F.lit(0))).alias("pos", "term"))
    return found.select("answer_id", "pos", F.concat(F.lit(f"{label}: „"), "term", F.lit("“")).alias("problem"))


def all_problems(answers: DataFrame, checks: list[DataFrame]) -> DataFrame:
    """(answer_id, problems): the problems of all checks, in order; an empty list where there are none."""
    numbered = [c.select("answer_id", F.lit(i).alias("check_no"), "pos", "problem") for i, c in enumerate(checks)]
    together = numbered[0]
    for other in numbered[1:]:
        together = together.unionByName(other)
    listed = together.groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct("check_no", "pos", "problem"))).alias("p"))
    problems = F.coalesce(F.transform("p", lambda x: x["problem"]), F.array().cast("array<string>"))
    return answers.select("answer_id").join(listed, "answer_id", "left").select("answer_id", problems.alias("problems"))


def correction_prompts(problems: DataFrame, template: str) -> DataFrame:
    """(answer_id, message) for answers with problems; ``%s`` in the template is their list."""
    listed = F.concat(F.lit("- "), F.array_join("problems", "\n- "))
    return problems.where(F.size("problems") > 0).select("answer_id", F.replace(F.lit(template), F.lit("%s"), listed).alias("message"))


def final_answers(first: DataFrame, first_problems: DataFrame, second: DataFrame, second_problems: DataFrame) -> DataFrame:
    """(answer_id, text, problems, first_attempt_problems, corrected, clean).

    The second answer counts wherever the first had problems and there is a second one.  ``corrected``
    says that an answer was asked for again, whatever it still holds; ``clean`` that no problem is left.
    """
    joined = first.join(first_problems.withColumnRenamed("problems", "p1"), "answer_id", "left")
    joined = joined.join(second.select("answer_id", F.col("text").alias("text2")), "answer_id", "left")
    joined = joined.join(second_problems.withColumnRenamed("problems", "p2"), "answer_id", "left")
    none = F.array().cast("array<string>")
    before, after = F.coalesce("p1", none), F.coalesce("p2", none)
    bad = F.size(before) > 0
    retried = bad & F.col("text2").isNotNull()
    problems = F.when(retried, after).otherwise(before)
    return joined.select(
        "answer_id", F.when(retried, F.col("text2")).otherwise(F.col("text")).alias("text"), problems.alias("problems"),
        before.alias("first_attempt_problems"), bad.alias("corrected"), (F.size(problems) == 0).alias("clean"),
    )
