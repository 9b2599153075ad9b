"""The given tables as books, an index, questions and answers; each view in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.sources.pages import pages_from_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def book_table(spark: SparkSession, sf_dir: str, first: str = "text") -> DataFrame:
    """(source, page, text): a thousand consecutive ids hold a book of each source, so a book is bounded."""
    docs = table(spark, sf_dir, "documents")
    source = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 1000).cast("string"), F.lit(".pdf"))
    return docs.select(source.alias("source"), (F.col("doc_id") % 1000 + 1).cast("int").alias("page"), F.expr(first).alias("text"))


def pages(spark: SparkSession, sf_dir: str, text: str = "text") -> DataFrame:
    return pages_from_table(book_table(spark, sf_dir, text))


BOOKS = "(SELECT source || '-' || (doc_id // 1000) || '.pdf' AS source, CAST(doc_id % 1000 + 1 AS INT) AS page, {text} AS text FROM documents)"


def pages_sql(text: str = "text") -> str:
    """page rows as SQL; blank texts are left out."""
    return f"(SELECT source, page, replace(source, '.pdf', '') || '#seite-' || page AS id, text FROM {BOOKS.format(text=text)} WHERE regexp_matches(text, '\\S'))"


#: (section, first page, last page, strategy, number in order)
SECTIONS = [("Grundregeln", 1, 400, "size", 1), ("Begriffe", 301, 700, "terms", 2), ("Anhang A", 501, 1000, "headings", 3)]
SKIPPED = [7, 350]


def sections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SECTIONS, "section string, first_page int, last_page int, strategy string, section_no int")


SECTIONS_SQL = "(VALUES " + ", ".join(str(s) for s in SECTIONS) + ") AS sections(section, first_page, last_page, strategy, section_no)"


def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    letter = F.element_at(F.array(F.lit(""), F.lit("a"), F.lit("b")), (F.col("vec_id") % 3 + 1).cast("int"))
    number = F.concat((F.col("label") + 1).cast("string"), F.lit("."), (F.col("vec_id") % 5).cast("string"), letter)
    ident = F.concat(F.lit("e"), F.col("vec_id").cast("string"))
    return e.select(F.col("vec_id").alias("pos"), ident.alias("id"), number.alias("number"), "label", "embedding")


INDEX_SQL = (
    "(SELECT vec_id AS pos, 'e' || vec_id AS id, (label + 1) || '.' || (vec_id % 5) || ['', 'a', 'b'][vec_id % 3 + 1] AS number,"
    " label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
)


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100 is a question; the row after it holds its text vector."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec"), F.col("label").alias("q_label"))
    t = e.where("vec_id % 100 = 1").select((F.col("vec_id") - 1).alias("query_id"), F.col("embedding").alias("t_vec"))
    return q.join(t, "query_id")


QUERY_SQL = (
    "(SELECT q.vec_id AS query_id, CAST(q.embedding AS DOUBLE[]) AS q_vec, CAST(t.embedding AS DOUBLE[]) AS t_vec, q.label AS q_label"
    " FROM embeddings q JOIN embeddings t ON t.vec_id = q.vec_id + 1 WHERE q.vec_id % 100 = 0)"
)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.floor(F.col("query_id") / 100) % 5
    grp = F.when(turn < 3, "rule").when(turn < 4, "colloquial").otherwise("off_topic")
    question = F.concat(F.lit("question "), F.col("query_id").cast("string"))
    expected = F.array((F.col("q_label") + 1).cast("string"), F.lit("2.1"))
    return vector_queries(spark, sf_dir).select("query_id", grp.alias("grp"), question.alias("question"), expected.alias("expected"))


GOLD_SQL = f"""(SELECT query_id, CASE WHEN query_id // 100 % 5 < 3 THEN 'rule' WHEN query_id // 100 % 5 < 4 THEN 'colloquial' ELSE 'off_topic' END AS grp,
  [CAST(q_label + 1 AS VARCHAR), '2.1'] AS expected FROM {QUERY_SQL})"""


def doc_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(index of an earlier run, documents now): every id is in one of them at least; some are gone, new or changed."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    ident = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    old = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("pos"), ident.alias("id"), "text", F.array(F.length("text").cast("float")).alias("embedding"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    now = d.where("doc_id % 3 = 0 or doc_id % 5 <> 0").select(F.col("doc_id").alias("pos"), ident.alias("id"), changed.alias("text"))
    return old, now


OLD_SQL = "(SELECT doc_id AS pos, 'd' || doc_id AS id, text FROM documents WHERE doc_id % 3 <> 0 AND text IS NOT NULL)"
NOW_SQL = (
    "(SELECT doc_id AS pos, 'd' || doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text"
    " FROM documents WHERE (doc_id % 3 = 0 OR doc_id % 5 <> 0) AND text IS NOT NULL)"
)
