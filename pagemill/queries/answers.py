"""Queries on replies, answers and their checks, from the conversations table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.jobs import answer as job
from pagemill.operators import checks, evaluation, fusion
from pagemill.queries.base import QUERY_SQL, table, vector_index, vector_queries
from pagemill.queries.retrieval import CANDIDATES, MIN_SCORE, _fused

REFERENCE = r"Regel (\d{1,2}(?:\.\d{1,2})?[a-z]?)"
FORBIDDEN, LABEL = r"\p{L}*ätz\p{L}*|the", "old term"
VOCABULARY = ["The", "Der", "La", "Thing", "Ereth", "Les", "Que"]


def _replies(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    nothing = F.when(F.col("conv_id") % 7 == 0, F.lit(" „Keine.“ ")).when(F.col("conv_id") % 11 == 0, F.lit("  ")).otherwise(F.col("text"))
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("question"), nothing.alias("reply"))


_REPLIES = "(SELECT conv_id * 100 + turn AS query_id, 'q' || conv_id AS question, CASE WHEN conv_id % 7 = 0 THEN ' „Keine.“ ' WHEN conv_id % 11 = 0 THEN '  ' ELSE text END AS reply FROM conversations WHERE role = 'user')"


def rewrite_gate(spark, sf_dir):
    return checks.rewrite_gate(_replies(spark, sf_dir)).select("query_id", "search_text")


def _terms(spark, sf_dir):
    replies = _replies(spark, sf_dir).withColumn("reply", F.translate(F.col("reply"), " ", ","))
    vocabulary = spark.createDataFrame(list(enumerate(VOCABULARY)), "pos int, term string")
    return checks.select_terms(replies, vocabulary, 3)


def select_terms(spark, sf_dir):
    return _terms(spark, sf_dir)


def expand_query(spark, sf_dir):
    return checks.expand_query(_replies(spark, sf_dir), _terms(spark, sf_dir)).select("query_id", "search_text")


def answer_status(spark, sf_dir):
    q = vector_queries(spark, sf_dir).select("query_id", F.concat(F.lit("question "), F.col("query_id").cast("string")).alias("question"), F.when(F.col("query_id") / 100 % 5 != 4, F.lit("searched")).alias("search_text"))
    hits = fusion.fusion_search(vector_queries(spark, sf_dir), vector_index(spark, sf_dir), 5, CANDIDATES)
    out = checks.answer_status(q, hits, MIN_SCORE)
    return out.select("query_id", "status", F.round("best", 6).alias("best"), "model_asked", "search_text")


def _made(spark, sf_dir, first: bool):
    """Assistants' texts with references put in; the second attempt cites what its sources hold."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("answer_id", F.col("conv_id") * 100 + F.col("turn"))
    a = F.format_string("Regel %s.%s", (F.col("answer_id") % 20).cast("string"), (F.col("answer_id") % 3 + 1).cast("string"))
    cites = F.when(F.col("answer_id") % 4 == 0, F.lit(" [1][2]")).when(F.col("answer_id") % 4 == 1, F.lit("")).when(F.col("answer_id") % 4 == 2, F.lit(" [9]")).otherwise(F.lit("[2]"))
    text = F.concat(F.lit("Siehe "), a, cites, F.lit(". "), "text", F.lit(" Regel 7 gilt."))
    return c.select("answer_id", (text if first else F.concat(F.lit("Siehe "), a, F.lit("."))).alias("text"))


def _sources(spark, sf_dir):
    a = _made(spark, sf_dir, True).where("answer_id % 5 <> 0").select("answer_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("source_no"))
    number = F.format_string("%s.%s", (F.col("answer_id") % 20).cast("string"), F.col("source_no").cast("string"))
    return a.withColumn("text", F.concat(number, F.when(F.col("source_no") == 1, F.lit("a")).otherwise(F.lit("")), F.lit(" Text zu 17 und 2.71.")))


_ANSWERS = "(SELECT conv_id * 100 + turn AS answer_id, 'Siehe Regel ' || (conv_id * 100 + turn) % 20 || '.' || ((conv_id * 100 + turn) % 3 + 1) || CASE (conv_id * 100 + turn) % 4 WHEN 0 THEN ' [1][2]' WHEN 1 THEN '' WHEN 2 THEN ' [9]' ELSE '[2]' END || '. ' || text || ' Regel 7 gilt.' AS text FROM conversations WHERE role = 'assistant')"
_SECOND = "(SELECT conv_id * 100 + turn AS answer_id, 'Siehe Regel ' || (conv_id * 100 + turn) % 20 || '.' || ((conv_id * 100 + turn) % 3 + 1) || '.' AS text FROM conversations WHERE role = 'assistant')"
_SOURCES = f"(SELECT answer_id, source_no, answer_id % 20 || '.' || source_no || CASE source_no WHEN 1 THEN 'a' ELSE '' END || ' Text zu 17 und 2.71.' AS text FROM (SELECT answer_id FROM {_ANSWERS} WHERE answer_id % 5 <> 0), (VALUES (1), (2)) AS n(source_no))"


def citations(spark, sf_dir):
    return checks.extract_citations(_made(spark, sf_dir, True), REFERENCE).drop("has_sources")


def citations_checked(spark, sf_dir):
    found = checks.extract_citations(_made(spark, sf_dir, True), REFERENCE)
    return checks.check_citations(found, _sources(spark, sf_dir)).select("answer_id", "cit_no", "supported")


def citation_report(spark, sf_dir):
    found = checks.extract_citations(_made(spark, sf_dir, True), REFERENCE)
    return checks.citation_report(checks.check_citations(found, _sources(spark, sf_dir)))


def forbidden_terms(spark, sf_dir):
    return checks.forbidden_terms(_made(spark, sf_dir, True), FORBIDDEN, LABEL)


def all_problems(spark, sf_dir):
    return job.problems_of(_made(spark, sf_dir, True), _sources(spark, sf_dir), REFERENCE, FORBIDDEN, LABEL)


def correction_prompts(spark, sf_dir):
    return checks.correction_prompts(all_problems(spark, sf_dir), "Please correct:\n%s\nThank you.")


def final_answers(spark, sf_dir):
    return job.correct(_made(spark, sf_dir, True), _made(spark, sf_dir, False).where("answer_id % 6 <> 0"), _sources(spark, sf_dir), REFERENCE, FORBIDDEN, LABEL)


def answer_summary(spark, sf_dir):
    """Every thirteenth answer failed: it has no text."""
    finals = final_answers(spark, sf_dir).withColumn("text", F.when(F.col("answer_id") % 13 != 0, F.col("text")))
    return evaluation.answer_summary(finals, _sources(spark, sf_dir))


def source_sizes(spark, sf_dir):
    return evaluation.source_sizes(_sources(spark, sf_dir))


QUERIES = {f.__name__: f for f in (rewrite_gate, select_terms, expand_query, answer_status, citations, citations_checked, citation_report, forbidden_terms, all_problems, correction_prompts, final_answers, answer_summary, source_sizes)}

_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_ANSWER = _STRIP.format(x="coalesce(reply, '')")
_TERM = _STRIP.format(x="regexp_replace(" + _STRIP.format(x="part") + r", '^[\"„“''*-]+|[\"„“''*.]+$', '', 'g')")
_SELECT = f"""
v AS (SELECT * FROM (VALUES {", ".join(f"('{t}')" for t in VOCABULARY)}) AS v(term)),
p AS (SELECT query_id, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM (SELECT query_id, regexp_split_to_array(translate(reply, ' ', ','), '[,;\\n]') AS parts FROM {_REPLIES})),
m AS (SELECT query_id, term, min(i) AS i FROM p JOIN v ON lower(v.term) = lower({_TERM}) GROUP BY ALL),
st AS (SELECT query_id, CAST(n AS INT) AS n, term FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS n FROM m) WHERE n <= 3)"""


def _cited(answers: str, name: str) -> str:
    """CTEs: citations of ``answers`` and whether each is supported."""
    return rf"""
{name}x AS (SELECT answer_id, unnest(q) AS quote, unnest(range(len(q))) AS cit_no FROM (SELECT answer_id, regexp_extract_all(text, 'Regel \d{{1,2}}(?:\.\d{{1,2}})?[a-z]?(?:\s*(?:\[\d+\])+)?') AS q FROM {answers})),
{name} AS (SELECT answer_id, CAST(cit_no AS INT) AS cit_no, quote, regexp_extract(quote, '{REFERENCE}', 1) AS reference, list_transform(regexp_extract_all(regexp_extract(quote, '((?:\[\d+\])+)$', 1), '\d+'), lambda x: CAST(x AS INT)) AS cited FROM {name}x),
{name}c AS (
  SELECT answer_id, cit_no, quote, len(cited) > 0 AS has, coalesce(bool_or((len(cited) = 0 OR list_contains(cited, source_no)) AND regexp_matches(s.text, '(^|[^0-9.])' || replace(reference, '.', '\.') || '($|[^0-9])')), false) AS supported
  FROM {name} LEFT JOIN {_SOURCES} s USING (answer_id) GROUP BY ALL
),
{name}p AS (
  SELECT answer_id, 0 AS k, cit_no AS pos, '„' || quote || CASE WHEN has THEN '“ steht nicht in der angegebenen Quelle' ELSE '“ steht in keiner der Quellen' END AS problem FROM {name}c WHERE NOT supported
  UNION ALL SELECT answer_id, 1, unnest(range(len(t))), '{LABEL}: „' || unnest(t) || '“' FROM (SELECT answer_id, regexp_extract_all(text, '(?i){FORBIDDEN}') AS t FROM {answers})
),
{name}l AS (SELECT answer_id, coalesce(list(problem ORDER BY k, pos) FILTER (WHERE problem IS NOT NULL), []) AS problems FROM {answers} LEFT JOIN {name}p USING (answer_id) GROUP BY 1)"""


_FIRST = f"WITH {_cited(_ANSWERS, 'a')}"
_FINAL = f"""{_FIRST}, {_cited(_SECOND, "b")}, fa AS (
  SELECT f.answer_id, CASE WHEN r THEN s.text ELSE f.text END AS text, CASE WHEN r THEN bl.problems ELSE al.problems END AS problems, al.problems AS first_attempt_problems,
         len(al.problems) > 0 AS corrected, len(CASE WHEN r THEN bl.problems ELSE al.problems END) = 0 AS clean
  FROM (SELECT answer_id, len(problems) > 0 AND answer_id % 6 <> 0 AS r FROM al) JOIN al USING (answer_id) JOIN {_ANSWERS} f USING (answer_id) JOIN {_SECOND} s USING (answer_id) JOIN bl USING (answer_id))"""

SQL = {
    "rewrite_gate": f"SELECT query_id, CASE WHEN {_ANSWER} <> '' AND lower({_STRIP.format(x='translate(' + _ANSWER + chr(44) + chr(32) + repr(checks.IGNORED) + ', ' + chr(39) * 2 + ')')}) <> 'keine' THEN {_ANSWER} END AS search_text FROM {_REPLIES}",
    "select_terms": f"WITH {_SELECT} SELECT * FROM st",
    "expand_query": f"WITH {_SELECT} SELECT query_id, CASE WHEN count(term) = 0 THEN question ELSE question || ' (' || string_agg(term, ', ' ORDER BY n) || ')' END AS search_text FROM {_REPLIES} LEFT JOIN st USING (query_id) GROUP BY query_id, question",
    "answer_status": f"""WITH {_fused(5)}, b AS (SELECT query_id, max(score) AS best FROM fs GROUP BY 1), q AS (SELECT query_id, query_id // 100 % 5 = 4 AS off FROM {QUERY_SQL})
SELECT query_id, CASE WHEN off THEN 'off_topic' WHEN best IS NULL OR best < {MIN_SCORE} THEN 'below_threshold' ELSE 'ask' END AS status, CASE WHEN NOT off THEN round(best, 6) END AS best,
       NOT off AND coalesce(best >= {MIN_SCORE}, false) AS model_asked, CASE WHEN NOT off THEN 'searched' ELSE 'question ' || query_id END AS search_text FROM q LEFT JOIN b USING (query_id)""",
    "citations": f"{_FIRST} SELECT * FROM a",
    "citations_checked": f"{_FIRST} SELECT answer_id, cit_no, supported FROM ac",
    "citation_report": f"{_FIRST} SELECT answer_id, count(*) FILTER (WHERE supported) AS supported, count(*) FILTER (WHERE NOT supported) AS unsupported, count(*) AS checked FROM ac GROUP BY 1",
    "forbidden_terms": f"{_FIRST} SELECT answer_id, CAST(pos AS INT) AS pos, problem FROM ap WHERE k = 1",
    "all_problems": f"{_FIRST} SELECT * FROM al",
    "correction_prompts": f"{_FIRST} SELECT answer_id, 'Please correct:' || chr(10) || '- ' || array_to_string(problems, chr(10) || '- ') || chr(10) || 'Thank you.' AS message FROM al WHERE len(problems) > 0",
    "final_answers": f"{_FINAL} SELECT * FROM fa",
    "answer_summary": f"""{_FINAL}, fb AS (SELECT * REPLACE (CASE WHEN answer_id % 13 <> 0 THEN text END AS text) FROM fa)
SELECT count(*) AS answers, count(*) - count(text) AS failures, count(*) FILTER (WHERE corrected) AS corrected, coalesce(list(answer_id ORDER BY answer_id) FILTER (WHERE corrected), []) AS corrected_ids,
       count(*) FILTER (WHERE len(problems) > 0) AS with_problems, CAST(coalesce(sum(len(problems)), 0) AS BIGINT) AS problems_left,
       (SELECT count(*) FROM {_SOURCES}) AS sources, (SELECT CAST(sum(length(text)) AS BIGINT) FROM {_SOURCES}) AS source_chars FROM fb""",
    "source_sizes": f"SELECT answer_id, count(*) AS n_sources, CAST(sum(length(text)) AS BIGINT) AS source_chars FROM {_SOURCES} GROUP BY 1",
}
