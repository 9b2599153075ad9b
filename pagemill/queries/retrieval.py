"""Queries on the index, search, fusion, context and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import cosine
from pagemill.jobs import answer
from pagemill.jobs import evaluate as job
from pagemill.operators import context, evaluation, fusion, index, vectors
from pagemill.queries.base import GOLD_SQL, INDEX_SQL, NOW_SQL, OLD_SQL, QUERY_SQL, doc_index, gold, table, vector_index, vector_queries
from pagemill.sources.embedding import embed
from pagemill.sources.index_files import check_index_model, read_index_jsonl, write_index, write_index_jsonl
from pagemill.sources.index_store import IndexStore
from pagemill.sources.shared import new_path

K, CANDIDATES, BUCKETS = 10, 20, 8
MIN_SCORE = 0.35
#: Second hits under this are rejections.
REJECT = 0.4


def fusion_search(spark, sf_dir):
    found = fusion.fusion_search(vector_queries(spark, sf_dir), vector_index(spark, sf_dir), K, CANDIDATES)
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def vector_topk(spark, sf_dir):
    found = vectors.search(vector_queries(spark, sf_dir), vector_index(spark, sf_dir), K)
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def vector_topk_filtered(spark, sf_dir):
    found = vectors.search(vector_queries(spark, sf_dir), vector_index(spark, sf_dir), K, F.col("number").rlike(r"\A[12]\."), "t_vec")
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def cosine_pairs(spark, sf_dir):
    """Each vector with the one whose id follows."""
    e = table(spark, sf_dir, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(other, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("next")), 6).alias("score"))


def rrf(spark, sf_dir):
    q, i = vector_queries(spark, sf_dir), vector_index(spark, sf_dir)
    return fusion.rrf(fusion.two_lists(q, i, CANDIDATES)).select("query_id", "rank", "id", F.round("points", 9).alias("points"))


def best_score(spark, sf_dir):
    found = fusion.fusion_search(vector_queries(spark, sf_dir), vector_index(spark, sf_dir), K, CANDIDATES)
    return fusion.best_score(found).select("query_id", F.round("best", 6).alias("best"))


def _store(spark, old, model="m1"):
    return IndexStore.create(old, new_path(spark, "index"), model, BUCKETS)


def index_upsert(spark, sf_dir):
    old, now = doc_index(spark, sf_dir)
    store = _store(spark, old).upsert(now.withColumn("embedding", F.array(F.length("text").cast("float"))))
    return store.read().select("pos", "id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def index_reusable(spark, sf_dir):
    old, now = doc_index(spark, sf_dir)
    return index.reusable(now, old).select("pos", "id")


def index_missing(spark, sf_dir):
    old, now = doc_index(spark, sf_dir)
    return index.missing(now, old).select("id")


def index_retain(spark, sf_dir):
    old, now = doc_index(spark, sf_dir)
    store, removed = _store(spark, old).retain(now)
    return store.keys().agg(F.count(F.lit(1)).alias("kept"), F.lit(removed).cast("long").alias("removed"))


def index_refresh(spark, sf_dir):
    old, now = doc_index(spark, sf_dir)
    fresh, _ = _store(spark, old).refresh(now, lambda d: embed(d, "text", lambda texts: [[float(len(t))] for t in texts]))
    return fresh.read().select("pos", "id", F.get("embedding", F.lit(0)).cast("double").alias("chars"))


def index_snapshots(spark, sf_dir):
    """A store after three changes, each a delta, and after they have been merged with the base."""
    old, now = doc_index(spark, sf_dir)
    new = now.withColumn("embedding", F.array(F.length("text").cast("float")))
    store, _ = _store(spark, old).upsert(new.where("pos % 2 = 0")).upsert(new.where("pos % 2 = 1")).retain(now)
    return store.compact().read().select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.get("embedding", F.lit(0)).cast("double").alias("chars"))


def index_refresh_stats(spark, sf_dir):
    old, now = doc_index(spark, sf_dir)
    return index.refresh_stats(index.refresh_plan(now, old))


def index_stats(spark, sf_dir):
    return index.index_stats(vector_index(spark, sf_dir))


def index_model_guard(spark, sf_dir):
    """Stores of two models, opened strictly and leniently, and an index of both models as a table."""
    i = vector_index(spark, sf_dir).withColumns({"model": F.concat(F.lit("m"), (F.col("label") % 2).cast("string")), "text": F.col("number")})
    paths = {model: _store(spark, i.where(F.col("model") == model), model).path for model in ("m0", "m1")}
    found = {"strict": IndexStore.open(spark, paths["m1"], "m1").read(), "mixed": check_index_model(i, "m1", strict=False)}
    found |= {"other": IndexStore.open(spark, paths["m1"], "m0", strict=False).read(), "same": IndexStore.open(spark, paths["m0"], "m0", strict=False).read()}
    parts = [df.select(F.lit(name).alias("guard"), "pos", "model") for name, df in found.items()]
    return reduce(DataFrame.unionByName, parts)


def index_files(spark, sf_dir):
    """The index written as JSON lines and read back; every fifth id is written twice, and its later entry counts."""
    i = vector_index(spark, sf_dir).withColumns({"text": F.col("number"), "metadata": F.create_map(F.lit("number"), "number")}).drop("label", "number")
    again = i.where("pos % 5 = 0").withColumns({"pos": F.col("pos") + 1_000_000_000, "text": F.concat("text", F.lit(" again"))})
    path = new_path(spark, "index")
    write_index_jsonl(i.unionByName(again), path, "m1")
    back, model = read_index_jsonl(spark, path)
    return back.select("pos", "id", "text", F.element_at("metadata", "number").alias("number"), F.size("embedding").alias("dimensions"), F.lit(model).alias("model"), F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"))


def index_parquet(spark, sf_dir):
    """The index written as Parquet, a folder for each model, and read back."""
    i = vector_index(spark, sf_dir).withColumn("model", F.concat(F.lit("m"), (F.col("label") % 2).cast("string")))
    path = new_path(spark, "index")
    write_index(i, path)
    return spark.read.parquet(path).select("pos", "id", "number", "model")


def definition_terms(spark, sf_dir):
    return index.definition_terms(vector_index(spark, sf_dir).withColumn("section", (F.col("label") % 2).cast("string")), "1")


def first_by_number(spark, sf_dir):
    i = vector_index(spark, sf_dir)
    wanted = i.select("number").unionByName(i.select(F.concat("number", F.lit("x")).alias("number")))
    return index.first_by_number(i, wanted)


def required_numbers(spark, sf_dir):
    """Numbers that all have a chunk."""
    i = vector_index(spark, sf_dir)
    return index.require_all(index.first_by_number(i, i.select("number")))


def _book(spark, sf_dir):
    """Index entries as chunks, each with the whole text of the document of its number."""
    pos = F.col("pos")
    source = F.concat(F.lit("book"), F.floor(pos / 100).cast("string"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("t"))
    printed = F.when(pos % 2 == 0, (pos % 90 - 2).cast("int"))
    entries = vector_index(spark, sf_dir).drop("embedding", "label").join(texts, "pos", "left")
    return entries.select("pos", "id", "number", source.alias("source"), F.coalesce("t", F.lit("")).alias("text"), (pos % 90).cast("int").alias("page"), printed.alias("printed_page"))


def _expanded(spark, sf_dir):
    hits = fusion.fusion_search(vector_queries(spark, sf_dir), vector_index(spark, sf_dir), 4, CANDIDATES)
    return context.expand_siblings(hits.select("query_id", "rank", "id", "score"), _book(spark, sf_dir), 10, 9000)


def expand_siblings(spark, sf_dir):
    return _expanded(spark, sf_dir).select("query_id", "n", "id", "is_hit", F.round("score", 6).alias("score"))


def build_prompt(spark, sf_dir):
    sources = _expanded(spark, sf_dir).join(_book(spark, sf_dir), "id")
    q = vector_queries(spark, sf_dir).select("query_id", F.concat(F.lit("question "), F.col("query_id").cast("string")).alias("question"))
    return context.build_prompt(sources, q)


def chained_expanders(spark, sf_dir):
    """Siblings, and after them the chunk that follows each one in its book."""
    book = _book(spark, sf_dir)

    def following(found):
        places = book.select("id", "source", "pos")
        after = places.select(F.col("id").alias("next_id"), "source", (F.col("pos") - 1).alias("pos"))
        more = found.join(places, "id").join(after, ["source", "pos"]).select("query_id", F.col("next_id").alias("id"), F.lit(False).alias("is_hit"))
        return found.select("query_id", "id", "is_hit").unionByName(more).groupBy("query_id", "id").agg(F.bool_or("is_hit").alias("is_hit"))

    hits = fusion.fusion_search(vector_queries(spark, sf_dir), vector_index(spark, sf_dir), 4, CANDIDATES).select("query_id", "rank", "id", "score")
    return hits.transform(lambda h: context.expand_siblings(h, book, 10, 9000)).transform(following)


def search_filters(spark, sf_dir):
    """The same query vectors under three filters."""
    number = F.col("number")
    filters = {"chapter 1": number.startswith("1."), "letters": number.rlike("[ab]$"), "all": F.lit(True)}
    found = vectors.search_filters(vector_queries(spark, sf_dir), vector_index(spark, sf_dir), K, filters)
    return found.select("filter_id", "query_id", "rank", "id", F.round("score", 6).alias("score"))


def answer_job(spark, sf_dir):
    """Questions to prompts in one job; every fifth question is off the topic."""
    q = vector_queries(spark, sf_dir)
    reply = F.when(F.col("query_id") / 100 % 5 == 4, F.lit("Keine.")).otherwise(F.lit("searched"))
    q = q.withColumns({"question": F.concat(F.lit("question "), F.col("query_id").cast("string")), "reply": reply})
    status, _, prompts = answer.prompts(q, vector_index(spark, sf_dir), _book(spark, sf_dir), k=4, min_score=MIN_SCORE, candidates=CANDIDATES, max_chars=9000)
    return status.join(prompts, "query_id", "left").select("query_id", "status", "prompt")


def query_prefix(spark, sf_dir):
    """The prefix before every user's turn."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    return vectors.with_query_prefix(turns, "Frage zum Regelbuch: ").select("conv_id", "turn", "query_text")


def _hits(spark, sf_dir):
    i = vector_index(spark, sf_dir)
    return job.variant_hits(vector_queries(spark, sf_dir), i, K, CANDIDATES).join(i.select("id", "number"), "id")


def eval_ranks(spark, sf_dir):
    return evaluation.first_correct_rank(_hits(spark, sf_dir), gold(spark, sf_dir), K, job.VARIANTS)


def eval_hit_at(spark, sf_dir):
    return evaluation.hit_at(eval_ranks(spark, sf_dir))


def eval_rank_table(spark, sf_dir):
    return evaluation.rank_table(eval_ranks(spark, sf_dir), job.VARIANTS)


def eval_separation(spark, sf_dir):
    out = evaluation.separation(_hits(spark, sf_dir), gold(spark, sf_dir))
    return out.select("variant", "weakest_query", "strongest_query", "threshold", "blocked", *[F.round(c, 6).alias(c) for c in ("weakest", "strongest", "gap")])


def _rejected(spark, sf_dir):
    """A question counts as rejected in a variant whose second hit is under REJECT."""
    second = _hits(spark, sf_dir).where("rank = 2").select("variant", "query_id", F.when(F.col("score") >= REJECT, F.lit("searched")).alias("search_text"))
    return second.join(gold(spark, sf_dir).select("query_id", "question"), "query_id")


def eval_rejections(spark, sf_dir):
    return evaluation.rejections(_rejected(spark, sf_dir), gold(spark, sf_dir))


def searched_text(spark, sf_dir):
    return evaluation.searched_text(_rejected(spark, sf_dir)).select("variant", "query_id", "search_text")


QUERIES = {
    f.__name__: f
    for f in (
        fusion_search, vector_topk, vector_topk_filtered, search_filters, cosine_pairs, rrf, best_score, index_upsert, index_reusable, index_missing,
        index_retain, index_refresh, index_snapshots, index_refresh_stats, index_stats, index_model_guard, index_files, index_parquet, definition_terms, first_by_number,
        required_numbers, expand_siblings, chained_expanders, build_prompt, answer_job, query_prefix, eval_ranks, eval_hit_at, eval_rank_table,
        eval_separation, eval_rejections, searched_text,
    )
}


def _top(vector: str, k: int, where: str = "true") -> str:
    return f"(SELECT * FROM (SELECT query_id, pos, id, number, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, pos) AS rank FROM (SELECT query_id, pos, id, number, round(list_cosine_similarity({vector}, v), 12) AS s FROM {QUERY_SQL}, {INDEX_SQL} WHERE {where})) WHERE rank <= {k})"


def _fused(k: int) -> str:
    """CTEs up to ``fs``: the fused search."""
    return f"""
l AS (SELECT 1 AS list_no, * FROM {_top("q_vec", CANDIDATES)} UNION ALL SELECT 2, * FROM {_top("t_vec", CANDIDATES)}),
pt AS (SELECT query_id, id, sum(1 / (60.0 + rank)) AS points, min((list_no, rank)) AS seen FROM (SELECT query_id, list_no, id, min(rank) AS rank FROM l GROUP BY ALL) GROUP BY ALL),
rk AS (SELECT query_id, id, points, row_number() OVER (PARTITION BY query_id ORDER BY round(points, 12) DESC, seen) AS rank FROM pt),
fs AS (SELECT query_id, rank, pos, id, number, round(list_cosine_similarity(t_vec, v), 12) AS score FROM rk JOIN {QUERY_SQL} USING (query_id) JOIN {INDEX_SQL} USING (id) WHERE rank <= {k})"""


_BOOK = f"(SELECT pos, id, number, 'book' || (pos // 100) AS source, coalesce(d.text, '') AS text, pos % 90 AS page, CASE WHEN pos % 2 = 0 THEN pos % 90 - 2 END AS printed_page FROM {INDEX_SQL} LEFT JOIN documents d ON d.doc_id = pos)"
_HIT, _MEMBER = r"'^(\d{1,2}\.\d{1,2})[a-z]?$'", r"'^(\d{1,2}\.\d{1,2})(\p{L}.*)?$'"
_ASKED = f"(SELECT query_id FROM fs WHERE query_id // 100 % 5 <> 4 GROUP BY 1 HAVING max(score) >= {MIN_SCORE})"


def _expanded_sql(asked: str = "true") -> str:
    """CTEs up to ``ex``: hits of the questions that ``asked`` admits, with their siblings."""
    return f"""
WITH RECURSIVE {_fused(4)}, bk AS (SELECT *, length(text) AS chars, regexp_extract(number, {_HIT}, 1) AS hk, regexp_extract(number, {_MEMBER}, 1) AS mk FROM {_BOOK}),
ht AS (SELECT query_id, rank, fs.score, bk.* FROM fs JOIN bk USING (id) WHERE {asked}),
sb AS (SELECT h.query_id, m.id, m.chars, row_number() OVER (PARTITION BY h.query_id ORDER BY min((h.rank, m.pos))) AS i FROM ht h JOIN bk m ON m.source = h.source AND m.mk = h.hk AND h.hk <> ''
       WHERE NOT EXISTS (SELECT 1 FROM ht x WHERE x.query_id = h.query_id AND x.id = m.id) GROUP BY h.query_id, m.id, m.chars),
tk AS (
  SELECT query_id, 0::BIGINT AS i, CAST(NULL AS VARCHAR) AS id, count(*) AS n, CAST(sum(chars) AS BIGINT) AS c, false AS took FROM ht GROUP BY query_id
  UNION ALL
  SELECT t.query_id, s.i, s.id, t.n + CAST(t.n < 10 AND t.c + s.chars <= 9000 AS INT), t.c + CASE WHEN t.n < 10 AND t.c + s.chars <= 9000 THEN s.chars ELSE 0 END, t.n < 10 AND t.c + s.chars <= 9000
  FROM tk t JOIN sb s ON s.query_id = t.query_id AND s.i = t.i + 1
), al AS (SELECT query_id, id, pos, score, true AS is_hit FROM ht UNION ALL SELECT query_id, tk.id, pos, NULL, false FROM tk JOIN bk ON bk.id = tk.id WHERE took),
ex AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INT) AS n, id, is_hit, score FROM al)"""


_EXPANDED = _expanded_sql()
_PROMPT = (
    "'Quellen:' || chr(10) || chr(10) || string_agg('[' || n || '] ' || text || chr(10) || '(Fundstelle: Seite ' || coalesce(printed_page, page) || ')'"
    " || chr(10) || chr(10), '' ORDER BY n) || 'Frage: question ' || query_id"
)
_EVAL = f"""
WITH {_fused(K)}, h AS (SELECT 'original' AS variant, query_id, rank, number, score FROM {_top("q_vec", K)} UNION ALL SELECT 'passage', query_id, rank, number, score FROM {_top("t_vec", K)} UNION ALL SELECT 'fused', query_id, rank, number, score FROM fs),
g AS {GOLD_SQL},
r AS (
  SELECT v.variant, g.query_id, coalesce(min(h.rank) FILTER (WHERE len(list_filter(expected, lambda e: number = e OR (starts_with(number, e) AND regexp_matches(substr(number, length(e) + 1, 1), '[.\\p{{L}}]')))) > 0), 0) AS rank
  FROM (SELECT DISTINCT variant FROM h) v CROSS JOIN g LEFT JOIN h ON h.variant = v.variant AND h.query_id = g.query_id WHERE grp <> 'off_topic' GROUP BY 1, 2
)"""
_UPSERT = f"SELECT CASE WHEN o.pos IS NOT NULL THEN o.pos ELSE (SELECT max(pos) FROM {OLD_SQL}) + 1 + n.pos END AS pos, id"

SQL = {
    "fusion_search": f"WITH {_fused(K)} SELECT query_id, rank, id, round(score, 6) AS score FROM fs",
    "vector_topk": f"SELECT query_id, rank, id, round(score, 6) AS score FROM {_top('q_vec', K)}",
    "vector_topk_filtered": "SELECT query_id, rank, id, round(score, 6) AS score FROM " + _top("t_vec", K, "regexp_matches(number, '^[12]\\.')"),
    "cosine_pairs": "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "rrf": f"WITH {_fused(K)} SELECT query_id, rank, id, round(points, 9) AS points FROM rk",
    "best_score": f"WITH {_fused(K)} SELECT query_id, round(max(score), 6) AS best FROM fs GROUP BY 1",
    "index_upsert": f"{_UPSERT}, md5(coalesce(n.text, o.text)) AS text_md5 FROM {OLD_SQL} o FULL JOIN {NOW_SQL} n USING (id)",
    "index_reusable": f"SELECT o.pos, o.id FROM {OLD_SQL} o JOIN {NOW_SQL} n USING (id, text)",
    "index_missing": f"SELECT id FROM {NOW_SQL} n ANTI JOIN {OLD_SQL} o USING (id, text)",
    "index_retain": f"SELECT count(n.id) AS kept, count(*) - count(n.id) AS removed FROM {OLD_SQL} o LEFT JOIN {NOW_SQL} n USING (id)",
    "index_refresh": f"WITH o AS (SELECT * FROM {OLD_SQL} WHERE id IN (SELECT id FROM {NOW_SQL})) SELECT CASE WHEN o.pos IS NOT NULL THEN o.pos ELSE (SELECT max(pos) FROM o) + 1 + n.pos END AS pos, id, CAST(length(n.text) AS DOUBLE) AS chars FROM {NOW_SQL} n LEFT JOIN o USING (id)",
    "index_snapshots": f"SELECT id, md5(n.text) AS text_md5, CAST(length(n.text) AS DOUBLE) AS chars FROM {NOW_SQL} n",
    "index_refresh_stats": f"SELECT count(*) FILTER (WHERE o.text = n.text) AS reused, count(n.id) - count(*) FILTER (WHERE o.text = n.text) AS embedded, count(*) FILTER (WHERE n.id IS NULL) AS removed FROM {OLD_SQL} o FULL JOIN {NOW_SQL} n ON o.id = n.id",
    "index_stats": "SELECT count(*) AS entries, max(len(embedding)) AS dimensions FROM embeddings",
    "index_model_guard": "SELECT guard, vec_id AS pos, 'm' || label % 2 AS model FROM embeddings, (VALUES ('strict', 1), ('same', 0)) AS g(guard, of) WHERE label % 2 = of",
    "index_files": f"""SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, id, number || CASE WHEN pos % 5 = 0 THEN ' again' ELSE '' END AS text, number, len(v) AS dimensions, 'm1' AS model, round(v[1], 5) AS first FROM {INDEX_SQL}""",
    "index_parquet": f"SELECT pos, id, number, 'm' || label % 2 AS model FROM {INDEX_SQL}",
    "definition_terms": f"SELECT min(pos) AS pos, number AS term FROM {INDEX_SQL} WHERE label % 2 = 1 GROUP BY number",
    "first_by_number": f"WITH f AS (SELECT number, min(pos) AS pos, arg_min(id, pos) AS id FROM {INDEX_SQL} GROUP BY 1) SELECT * FROM f UNION ALL SELECT number || 'x', NULL, NULL FROM f",
    "required_numbers": f"SELECT number, min(pos) AS pos, arg_min(id, pos) AS id FROM {INDEX_SQL} GROUP BY 1",
    "expand_siblings": f"{_EXPANDED} SELECT query_id, n, id, is_hit, round(score, 6) AS score FROM ex",
    "build_prompt": f"{_EXPANDED} SELECT query_id, {_PROMPT} AS prompt FROM ex JOIN bk USING (id) GROUP BY query_id",
    "answer_job": f"""{_expanded_sql(f"query_id IN {_ASKED}")}, pr AS (SELECT query_id, {_PROMPT} AS prompt FROM ex JOIN bk USING (id) GROUP BY query_id)
SELECT query_id, CASE WHEN query_id // 100 % 5 = 4 THEN 'off_topic' WHEN query_id IN {_ASKED} THEN 'ask' ELSE 'below_threshold' END AS status, prompt FROM {QUERY_SQL} LEFT JOIN pr USING (query_id)""",
    "chained_expanders": f"""{_EXPANDED}, fo AS (SELECT query_id, id, is_hit FROM ex UNION ALL SELECT query_id, m.id, false FROM ex JOIN bk b USING (id) JOIN bk m ON m.source = b.source AND m.pos = b.pos + 1)
SELECT query_id, id, bool_or(is_hit) AS is_hit FROM fo GROUP BY 1, 2""",
    "search_filters": " UNION ALL ".join(f"SELECT '{name}' AS filter_id, query_id, rank, id, round(score, 6) AS score FROM {_top('q_vec', K, where)}" for name, where in (("chapter 1", "starts_with(number, '1.')"), ("letters", "regexp_matches(number, '[ab]$')"), ("all", "true"))),
    "query_prefix": "SELECT conv_id, turn, 'Frage zum Regelbuch: ' || text AS query_text FROM conversations WHERE role = 'user'",
    "eval_ranks": f"{_EVAL} SELECT * FROM r",
    "eval_hit_at": f"{_EVAL} SELECT variant, count(*) AS questions, count(*) FILTER (WHERE rank = 1) AS hit_1, count(*) FILTER (WHERE rank BETWEEN 1 AND 5) AS hit_5 FROM r GROUP BY 1",
    "eval_rank_table": f"{_EVAL} SELECT query_id, " + ", ".join(f"max(rank) FILTER (WHERE variant = '{v}') AS {v}" for v in job.VARIANTS) + " FROM r GROUP BY 1",
    "eval_separation": f"""{_EVAL}, b AS (SELECT h.variant, h.query_id, score, grp FROM h JOIN g USING (query_id) WHERE rank = 1),
e AS (SELECT variant, min(score) FILTER (WHERE grp <> 'off_topic') AS weakest, arg_min(query_id, (score, query_id)) FILTER (WHERE grp <> 'off_topic') AS weakest_query,
      max(score) FILTER (WHERE grp = 'off_topic') AS strongest, arg_max(query_id, (score, -query_id)) FILTER (WHERE grp = 'off_topic') AS strongest_query FROM b GROUP BY 1)
SELECT variant, weakest_query, strongest_query, floor((weakest - 0.05) * 100) / 100 AS threshold, (SELECT count(*) FROM b WHERE b.variant = e.variant AND grp = 'off_topic' AND score < floor((weakest - 0.05) * 100) / 100) AS blocked,
       round(weakest, 6) AS weakest, round(strongest, 6) AS strongest, round(weakest - strongest, 6) AS gap FROM e""",
    "eval_rejections": f"""{_EVAL}, q AS (SELECT variant, query_id, score < {REJECT} AS rejected, grp = 'off_topic' AS off FROM h JOIN g USING (query_id) WHERE rank = 2)
SELECT variant, count(*) FILTER (WHERE off AND rejected) AS recognised, count(*) FILTER (WHERE off AND NOT rejected) AS let_through, count(*) FILTER (WHERE NOT off AND rejected) AS falsely_rejected,
       coalesce(list(query_id ORDER BY query_id) FILTER (WHERE off AND NOT rejected), []) AS let_through_ids, coalesce(list(query_id ORDER BY query_id) FILTER (WHERE NOT off AND rejected), []) AS falsely_rejected_ids FROM q GROUP BY 1""",
    "searched_text": f"{_EVAL} SELECT variant, query_id, CASE WHEN score >= {REJECT} THEN 'searched' ELSE 'question ' || query_id END AS search_text FROM h WHERE rank = 2",
}
