"""Queries on pages, lines and chunks."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from pagemill.functions import text as ft
from pagemill.jobs import build_index
from pagemill.operators import chunking, cleaning, index, lines
from pagemill.queries.base import SECTIONS_SQL, SKIPPED, book_table, pages, pages_sql, sections, table
from pagemill.sources.embedding import embed_durably
from pagemill.sources.index_store import IndexStore
from pagemill.sources.pages import chunk_block, page_block, pages_from_table
from pagemill.sources.shared import new_path

PLACE = ["source", "page"]
#: Chunks are this long at most.
MAX_CHARS = 1500

#: Texts with something to clean, made from the given ones: (Spark SQL, DuckDB SQL).
SPACED = (
    "concat('  ', replace(replace(replace(text, 'the ', concat('the', char(9), char(9), ' ')), 'and ', concat(char(160), 'and', char(160), '\\r', char(160))), '\\n', ' \\n\\n\\n\\n '), ' ')",
    "'  ' || replace(replace(replace(text, 'the ', 'the' || chr(9) || chr(9) || ' '), 'and ', chr(160) || 'and' || chr(160) || chr(13) || chr(160)), chr(10), ' ' || chr(10) || chr(10) || chr(10) || chr(10) || ' ') || ' '",
)
BROKEN = ("replace(replace(text, 'er ', concat('er-', '\\n')), 'th ', concat('th- ', '\\n', ' und '))", "replace(replace(text, 'er ', 'er-' || chr(10)), 'th ', 'th- ' || chr(10) || ' und ')")
_NUMBER = "cast(doc_id % 1000 + 3 as {string})"
NUMBERED = (
    f"case doc_id % 3 when 0 then concat({_NUMBER.format(string='string')}, '\\n', text) when 1 then concat('x\\ny\\nz\\n ', {_NUMBER.format(string='string')}, ' \\n', text, '\\nx\\ny\\nz') else text end",
    f"CASE doc_id % 3 WHEN 0 THEN {_NUMBER.format(string='varchar')} || chr(10) || text WHEN 1 THEN 'x' || chr(10) || 'y' || chr(10) || 'z' || chr(10) || ' ' || {_NUMBER.format(string='varchar')} || ' ' || chr(10) || text || chr(10) || 'x' || chr(10) || 'y' || chr(10) || 'z' ELSE text END",
)
PAGE_BREAKS = ("case doc_id % 3 when 0 then concat(text, 'zu-') when 1 then concat(lower(left(text, 1)), substring(text, 2)) else text end", "CASE doc_id % 3 WHEN 0 THEN text || 'zu-' WHEN 1 THEN lower(left(text, 1)) || substr(text, 2) ELSE text END")
PATTERNS = [r"\p{L}+\.", r"\p{Lu}\p{L}+ \p{L}+\."]


def pages_read(spark, sf_dir):
    return pages_from_table(book_table(spark, sf_dir)).select(*PLACE, "id", "text")


def clean_whitespace(spark, sf_dir):
    return cleaning.clean_whitespace(pages(spark, sf_dir, SPACED[0])).select(*PLACE, "text")


def clean_line_patterns(spark, sf_dir):
    return cleaning.clean_line_patterns(pages(spark, sf_dir), PATTERNS).select(*PLACE, "text")


def clean_hyphenation(spark, sf_dir):
    return cleaning.clean_hyphenation(pages(spark, sf_dir, BROKEN[0])).select(*PLACE, "text")


def printed_page(spark, sf_dir):
    return cleaning.extract_printed_page(pages(spark, sf_dir, NUMBERED[0]), 2).select(*PLACE, "printed_page", "text")


CLEANERS = [partial(cleaning.extract_printed_page, offset=2), partial(cleaning.clean_line_patterns, patterns=PATTERNS), cleaning.clean_hyphenation, cleaning.clean_whitespace]


def clean_composite(spark, sf_dir):
    return cleaning.clean(pages(spark, sf_dir, NUMBERED[0]), CLEANERS).select(*PLACE, "printed_page", "text")


def page_counts(spark, sf_dir):
    raw = pages(spark, sf_dir, NUMBERED[0])
    return chunking.page_counts(raw, cleaning.clean(raw, CLEANERS))


def assign_sections(spark, sf_dir):
    placed = lines.assign_sections(pages(spark, sf_dir), sections(spark), SKIPPED)
    return placed.select(*PLACE, "section")


def _placed(spark, sf_dir, text="text"):
    return lines.assign_sections(pages(spark, sf_dir, text), sections(spark), SKIPPED)


def page_lines(spark, sf_dir):
    return lines.to_lines(_placed(spark, sf_dir, PAGE_BREAKS[0])).select("source", "section", "page", "line_idx", "text")


def chunk_size(spark, sf_dir):
    return chunking.chunk_by_size(lines.packed_lines(_placed(spark, sf_dir)), MAX_CHARS).drop("printed_page")


def chunk_terms(spark, sf_dir):
    return chunking.chunk_by_terms(lines.packed_lines(_placed(spark, sf_dir)), MAX_CHARS).drop("printed_page")


#: Headings before every fourth page, some out of order, and markers: (Spark SQL, DuckDB SQL).
_HEADED = "case when doc_id % 4 = 0 then concat(cast(doc_id % 1000 {div} 100 + 1 as {string}), '.', cast(doc_id % 100 as {string}), case when doc_id % 8 = 0 then 'b' else '' end, ' Kapitel', {n}, text) when doc_id % 12 = 3 then concat('Zweck der Regel:', {n}, text) else text end"
HEADED = (_HEADED.format(div="div", string="string", n="'\\n'"), _HEADED.format(div="//", string="varchar", n="chr(10)"))
RULES = chunking.HeadingRules(titles={1: "Das Spiel", 2: "Der Platz"})


def chunk_headings(spark, sf_dir):
    return chunking.chunk_by_headings(lines.packed_lines(_placed(spark, sf_dir, HEADED[0])), MAX_CHARS, RULES).drop("printed_page")


def chunk_process(spark, sf_dir):
    """Each section by its own strategy."""
    rows = lines.packed_lines(_placed(spark, sf_dir, HEADED[0]))
    return chunking.process(rows, sections(spark), MAX_CHARS, RULES).drop("printed_page")


def _job_chunks(spark, sf_dir):
    return build_index.chunks_of(pages(spark, sf_dir, HEADED[0]), sections(spark), MAX_CHARS, RULES, 2, PATTERNS, SKIPPED)


def chunk_job(spark, sf_dir):
    """Pages to chunks in one job."""
    return _job_chunks(spark, sf_dir).select("source", "section", "n", "pos", "id", "number", "page", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def index_job(spark, sf_dir):
    """Chunks to an index refreshed from one that lacks a section and has other texts in another."""
    # chunks lie by id, as the store's tables do, so positions and vectors come to them and texts stay where they are
    table = build_index.chunk_table(spark, lambda: _job_chunks(spark, sf_dir).select("source", "section", "id", "text"), multiple=8)
    placed = index.with_positions(table.select("source", "section", "id"), "source", "section", "id")
    chunks = table.join(placed.select("id", "pos"), "id")
    old = chunks.where("section <> 'Begriffe'").withColumns({"text": F.when(F.col("section") == "Anhang A", F.concat("text", F.lit("!"))).otherwise(F.col("text")), "embedding": F.array(F.lit(-1.0).cast("float"))})
    store = IndexStore.create(old, new_path(spark, "index"), "chars", buckets=8, dealt=True)
    embedder = lambda d: embed_durably(d, "text", lambda texts: [[float(len(t))] for t in texts], "chars", new_path(spark, "vectors"), key="id")
    fresh, _ = build_index.build(chunks, store, embedder, dealt=True)
    return fresh.read().select("pos", "id", F.get("embedding", F.lit(0)).cast("double").alias("chars"))


def chunk_stats(spark, sf_dir):
    return chunking.chunk_stats(chunk_size(spark, sf_dir), MAX_CHARS)


def section_counts(spark, sf_dir):
    return chunking.section_counts(chunk_size(spark, sf_dir), sections(spark))


def page_dump(spark, sf_dir):
    p = pages(spark, sf_dir)
    return p.select(*PLACE, page_block(p).alias("block"))


def chunk_dump(spark, sf_dir):
    c = chunk_size(spark, sf_dir)
    return c.select("id", F.md5(chunk_block(c).cast("binary")).alias("block_md5"))


def slugs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", ft.slug(F.col("text")).alias("slug"))


def snippet(spark, sf_dir):
    c = chunk_size(spark, sf_dir)
    return c.select("id", ft.snippet(F.col("text")).alias("snippet"))


def term_count_vector(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    v = ft.term_count_vector(F.col("text"), ["the", "der", "la "])
    return d.select("doc_id", *[F.get(v, F.lit(i)).cast("double").alias(f"v{i}") for i in range(3)])


QUERIES = {f.__name__: f for f in (chunk_size, pages_read, clean_whitespace, clean_line_patterns, clean_hyphenation, printed_page, clean_composite, assign_sections, page_lines, chunk_terms, chunk_headings, chunk_process, chunk_job, index_job, chunk_stats, section_counts, page_counts, page_dump, chunk_dump, slugs, snippet, term_count_vector)}

_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_WHITE = r"regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(replace(replace({t}, chr(9), ' '), chr(160), ' '), ' {2,}', ' ', 'g'), '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_PATTERN = "^(?:" + "|".join(f"(?:{p})" for p in PATTERNS) + ")$"
_LINES = "array_to_string(list_filter(string_split({t}, chr(10)), lambda x: NOT regexp_matches(" + _STRIP.format(x="x") + f", '{_PATTERN}')), chr(10))"
_HYPHEN = r"regexp_replace(regexp_replace(regexp_replace({t}, '(\p{L})-[ \t]*\n[ \t]*(und|oder)\b', '\1- \2', 'g'), '(\p{L})-[ \t]*\n[ \t]*(\p{Ll})', '\1\2', 'g'), '(\p{L})-[ \t]*\n[ \t]*(\p{L})', '\1-\2', 'g')"
_FILLED = r"regexp_matches(text, '\S')"



def _printed_sql(text: str) -> str:
    return rf"""
SELECT source, page, CASE WHEN spot IS NOT NULL THEN CAST(page + 2 AS INT) END AS printed_page,
       CASE WHEN spot IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, i: i <> spot), chr(10)) END AS text
FROM (
  SELECT *, coalesce(list_filter(places, lambda i: i <= 3 OR i > len(ls) - 3)[1], places[1]) AS spot
  FROM (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: {_STRIP.format(x="ls[i]")} = CAST(page + 2 AS VARCHAR)) AS places FROM (SELECT *, string_split(text, chr(10)) AS ls FROM {pages_sql(text)})))
"""


_PRINTED = _printed_sql(NUMBERED[1])


def _cleaned(text: str) -> str:
    """Pages through all cleaners."""
    cleaned = _WHITE.replace("{t}", _HYPHEN.replace("{t}", _LINES.replace("{t}", "text")))
    return f"(SELECT * FROM (SELECT source, page, printed_page, {cleaned} AS text FROM ({_printed_sql(text)})) WHERE {_FILLED})"



def _lines_sql(source: str) -> str:
    """CTEs up to ``ln``: joined lines of the sections of the pages ``source``."""
    return rf"""
pl AS (
  SELECT source, section, page, unnest(range(0, len(ls))) AS line_idx, unnest(ls) AS text
  FROM (SELECT source, section, page, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS ls
        FROM {source} JOIN {SECTIONS_SQL} ON page BETWEEN first_page AND last_page WHERE page NOT IN {tuple(SKIPPED)})
), jl AS (
  SELECT *, coalesce(line_idx = 0 AND regexp_matches(text, '^\p{{Ll}}') AND regexp_matches(lag(text) OVER w, '\p{{L}}-$'), false) AS joins FROM pl WINDOW w AS (PARTITION BY source, section ORDER BY page, line_idx)
), gl AS (
  SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY source, section ORDER BY page, line_idx) AS line,
         coalesce(lead(joins) OVER (PARTITION BY source, section ORDER BY page, line_idx), false) AS continues FROM jl
), ln AS (
  SELECT source, section, min(page) AS page, arg_min(line_idx, (page, line_idx)) AS line_idx, string_agg(CASE WHEN continues THEN regexp_replace(text, '-$', '') ELSE text END, '' ORDER BY page, line_idx) AS text, line
  FROM gl GROUP BY source, section, line
)"""


_BREAK = r"^(?:(\(\d+\)|•|»|Ausnahme|Strafe für).*)$"


def _chunk_sql(segments: str, source: str = pages_sql()) -> str:
    """CTEs up to ``ch``, from a CTE ``sg`` of lines with seg, heading, number."""
    return rf"""
WITH RECURSIVE {_lines_sql(source)}, {segments}, fl AS (
  SELECT *, row_number() OVER (PARTITION BY source, section, seg ORDER BY page, line_idx) AS i, sum(length(text) + 1) OVER (PARTITION BY source, section, seg) AS total,
         length(text) AS n, regexp_matches(text, '{_BREAK}') AS may FROM sg WHERE regexp_matches(text, '\S')
), pk AS (
  SELECT source, section, seg, i, 0 AS part, n + 1 AS held FROM fl WHERE i = 1
  UNION ALL
  SELECT f.source, f.section, f.seg, f.i,
         CASE WHEN f.total > {MAX_CHARS} AND (p.held + f.n + 1 > {MAX_CHARS} OR (f.may AND p.held > {MAX_CHARS // 2})) THEN p.part + 1 ELSE p.part END,
         CASE WHEN f.total > {MAX_CHARS} AND (p.held + f.n + 1 > {MAX_CHARS} OR (f.may AND p.held > {MAX_CHARS // 2})) THEN f.n + 1 ELSE p.held + f.n + 1 END
  FROM pk p JOIN fl f ON f.source = p.source AND f.section = p.section AND f.seg = p.seg AND f.i = p.i + 1
), pt AS (
  SELECT f.source, f.section, f.seg, part, any_value(heading) AS heading, any_value(number) AS number, arg_min(page, f.i) AS page, string_agg(text, chr(10) ORDER BY f.i) AS body
  FROM fl f JOIN pk USING (source, section, seg, i) GROUP BY f.source, f.section, f.seg, part
), ch AS (
  SELECT source, section, CAST(row_number() OVER w AS INT) AS n, replace(source, '.pdf', '') || '#' || replace(lower(section), ' ', '-') || '-' || row_number() OVER w AS id,
         heading || chr(10) || chr(10) || body AS text, heading, number, page FROM pt WINDOW w AS (PARTITION BY source, section ORDER BY seg, part)
)"""


_SIZE = "sg AS (SELECT *, 0 AS seg, section AS heading, CAST(NULL AS VARCHAR) AS number FROM ln)"
_CAP = r"^[\p{Lu}„]"
_TERMS = rf"""tm AS (
  SELECT *, coalesce(length(text) <= 45 AND len(string_split(regexp_replace(text, ' +$', ''), ' ')) <= 6 AND regexp_matches(text, '{_CAP}') AND NOT regexp_matches(text, '[.,:;]$')
    AND (lag(text) OVER w IS NULL OR regexp_matches(lag(text) OVER w, '[.)“”!?]$')) AND regexp_matches(lead(text) OVER w, '{_CAP}'), false) AS is_term
  FROM ln WINDOW w AS (PARTITION BY source, section ORDER BY page, line_idx)
), ts AS (
  SELECT *, sum(CAST(is_term AS INT)) OVER w AS seg, last_value(CASE WHEN is_term THEN text END IGNORE NULLS) OVER w AS number FROM tm WINDOW w AS (PARTITION BY source, section ORDER BY page, line_idx)
), sg AS (SELECT source, section, page, line_idx, text, seg, number, CASE WHEN number IS NULL THEN section ELSE section || ' › ' || number END AS heading FROM ts WHERE NOT is_term)"""


def _chain(chapter: str, sub: str, part: str) -> str:
    title = "".join(f" WHEN {k} THEN ' – {v}'" for k, v in RULES.titles.items())
    return f"CASE WHEN {chapter} = 0 THEN section ELSE '{RULES.label} ' || {chapter} || CASE {chapter}{title} ELSE '' END || coalesce(' › ' || {sub}, '') || coalesce(' › ' || {part}, '') END"


_INTRO = f"'{RULES.marker.rstrip(':')}'"
#: CTEs up to ``sg`` from ``ln``: the fold over headings and markers, a row for each event that counts.
_HEADINGS = rf"""ev AS (
  SELECT *, row_number() OVER (PARTITION BY source, section ORDER BY page, line_idx) AS i FROM (
    SELECT source, section, page, line_idx, text, text = '{RULES.marker}' AND line_idx < {RULES.marker_max_line} AS marker, regexp_extract(text, '{{HEAD}}', 3) AS letter,
           try_cast(regexp_extract(text, '{{HEAD}}', 1) AS INT) AS major, try_cast(regexp_extract(text, '{{HEAD}}', 2) AS INT) AS minor FROM ln
  ) WHERE marker OR major IS NOT NULL
), fo AS (
  SELECT DISTINCT source, section, 0::BIGINT AS i, 0 AS page, 0::BIGINT AS line_idx, false AS ok, false AS marker, 0 AS chapter, -1 AS last_key, false AS intro, NULL::VARCHAR AS sub, NULL::VARCHAR AS sub_no,
         NULL::VARCHAR AS part, NULL::VARCHAR AS number, -1 AS heading_page, NULL::VARCHAR AS closed, NULL::VARCHAR AS closed_no FROM ln
  UNION ALL
  SELECT source, section, i, page, line_idx, ok, marker, CASE WHEN ok AND NOT marker THEN major ELSE chapter END, CASE WHEN ok AND NOT marker THEN k ELSE last_key END,
         CASE WHEN ok THEN marker ELSE intro END, CASE WHEN NOT ok THEN sub WHEN marker THEN NULL WHEN letter = '' THEN text WHEN this = sub_no THEN sub END, CASE WHEN NOT ok THEN sub_no WHEN marker THEN NULL ELSE this END,
         CASE WHEN NOT ok THEN part WHEN marker OR letter = '' THEN NULL ELSE text END, CASE WHEN ok AND NOT marker THEN this || letter ELSE number END, CASE WHEN ok AND NOT marker THEN page ELSE heading_page END,
         CASE WHEN NOT marker AND intro THEN {_chain("major", _INTRO, "NULL")} ELSE {_chain("chapter", "sub", "part")} END, CASE WHEN NOT marker AND intro THEN CAST(major AS VARCHAR) ELSE number END
  FROM (SELECT *, CASE WHEN marker THEN heading_page <> page ELSE k > last_key AND (chapter = 0 OR major = chapter OR major = chapter + 1) END AS ok FROM (
    SELECT f.source, f.section, e.i, e.page, e.line_idx, e.text, e.marker, e.letter, e.major, e.major * 10000 + e.minor * 100 + CASE WHEN e.letter = '' THEN 0 ELSE ascii(e.letter) - 96 END AS k, e.major || '.' || e.minor AS this,
           f.chapter, f.last_key, f.intro, f.sub, f.sub_no, f.part, f.number, f.heading_page FROM fo f JOIN ev e ON e.source = f.source AND e.section = f.section AND e.i = f.i + 1))
), ac AS (
  SELECT *, row_number() OVER (PARTITION BY source, section ORDER BY i) - 1 AS seg, CASE WHEN intro THEN {_chain("(chapter + 1)", _INTRO, "NULL")} ELSE {_chain("chapter", "sub", "part")} END AS opened,
         CASE WHEN intro THEN CAST(chapter + 1 AS VARCHAR) ELSE number END AS opened_no FROM fo WHERE ok OR i = 0
), sl AS (
  SELECT l.*, (SELECT max(a.seg) FROM ac a WHERE a.source = l.source AND a.section = l.section AND (a.page, a.line_idx) <= (l.page, l.line_idx)) AS seg FROM ln l
), {{NAME}} AS (
  SELECT l.source, l.section, l.page, l.line_idx, l.text, l.seg, CASE WHEN n.seg IS NULL THEN a.opened_no ELSE n.closed_no END AS number, coalesce(n.closed, a.opened) AS heading
  FROM sl l JOIN ac a ON a.source = l.source AND a.section = l.section AND a.seg = l.seg LEFT JOIN ac n ON n.source = l.source AND n.section = l.section AND n.seg = l.seg + 1
  WHERE NOT (a.page = l.page AND a.line_idx = l.line_idx AND a.i > 0) AND NOT coalesce(n.marker AND n.page = l.page, false)
)""".replace("{HEAD}", r"^(\d{1,2})\.(\d{1,2})([a-z])?\s+[\p{Lu}„].*$")
_HEADED_CHUNKS = _chunk_sql(_HEADINGS.replace("{NAME}", "sg"), pages_sql(HEADED[1]))


def _process_sql(source: str) -> str:
    """``pc``: chunks of all sections, each by its strategy, with pos."""
    parts = f"{_HEADINGS.replace('{NAME}', 'sh')}, {_TERMS.replace('sg AS', 'st AS')}"
    columns = "source, section, page, line_idx, text, seg, number, heading"
    both = f"""{parts}, sg AS (SELECT source, section, page, line_idx, text, 0 AS seg, CAST(NULL AS VARCHAR) AS number, section AS heading FROM ln WHERE section = 'Grundregeln'
  UNION ALL SELECT {columns} FROM st WHERE section = 'Begriffe' UNION ALL SELECT {columns} FROM sh WHERE section = 'Anhang A')"""
    return f"{_chunk_sql(both, source)}, pc AS (SELECT ch.*, row_number() OVER (PARTITION BY source ORDER BY section_no, n) - 1 AS pos FROM ch JOIN {SECTIONS_SQL} USING (section))"


_COLUMNS = "SELECT source, section, n, id, text, heading, number, page FROM ch"
_SIZE_CHUNKS = _chunk_sql(_SIZE)
_JOB = _process_sql(_cleaned(HEADED[1]))
_SNIP = "CASE WHEN strpos(text, chr(10) || chr(10)) > 0 THEN substr(text, strpos(text, chr(10) || chr(10)) + 2) ELSE text END"

SQL = {
    "chunk_size": f"{_SIZE_CHUNKS} {_COLUMNS}",
    "pages_read": f"SELECT * FROM {pages_sql()}",
    "clean_whitespace": f"SELECT source, page, {_WHITE.replace('{t}', 'text')} AS text FROM {pages_sql(SPACED[1])} WHERE {_FILLED}",
    "clean_line_patterns": f"SELECT * FROM (SELECT source, page, {_LINES.replace('{t}', 'text')} AS text FROM {pages_sql()}) WHERE {_FILLED}",
    "clean_hyphenation": f"SELECT source, page, {_HYPHEN.replace('{t}', 'text')} AS text FROM {pages_sql(BROKEN[1])}",
    "printed_page": f"SELECT * FROM ({_PRINTED}) WHERE {_FILLED}",
    "clean_composite": f"SELECT * FROM {_cleaned(NUMBERED[1])}",
    "page_counts": f"SELECT source, count(*) AS raw_pages, count(c.page) AS clean_pages FROM {pages_sql(NUMBERED[1])} LEFT JOIN {_cleaned(NUMBERED[1])} c USING (source, page) GROUP BY 1",
    "chunk_headings": f"{_HEADED_CHUNKS} {_COLUMNS}",
    "chunk_process": f"{_process_sql(pages_sql(HEADED[1]))} {_COLUMNS.replace('FROM ch', ', pos FROM pc')}",
    "chunk_job": f"{_JOB} SELECT source, section, n, pos, id, number, page, md5(text) AS text_md5 FROM pc",
    "index_job": f"""{_JOB}, cp AS (SELECT *, row_number() OVER (ORDER BY source, section, id) - 1 AS p FROM pc), tp AS (SELECT max(p) AS top FROM cp WHERE section <> 'Begriffe')
SELECT CASE WHEN section = 'Begriffe' THEN top + 1 + p ELSE p END AS pos, id, CASE WHEN section = 'Grundregeln' THEN -1.0 ELSE CAST(length(text) AS DOUBLE) END AS chars FROM cp, tp""",
    "assign_sections": f"SELECT source, page, section FROM {pages_sql()} JOIN {SECTIONS_SQL} ON page BETWEEN first_page AND last_page WHERE page NOT IN {tuple(SKIPPED)}",
    "page_lines": f"WITH {_lines_sql(pages_sql(PAGE_BREAKS[1]))} SELECT source, section, page, CAST(line_idx AS INT) AS line_idx, text FROM ln",
    "chunk_terms": f"{_chunk_sql(_TERMS)} {_COLUMNS}",
    "chunk_stats": f"{_SIZE_CHUNKS}, l AS (SELECT length(text) AS n, row_number() OVER (ORDER BY length(text)) AS i, count(*) OVER () AS c FROM ch) SELECT count(*) AS chunks, min(n) AS shortest, min(n) FILTER (WHERE i = c // 2 + 1) AS median, max(n) AS longest, count(*) FILTER (WHERE n > {MAX_CHARS}) AS over_limit FROM l",
    "section_counts": f"{_SIZE_CHUNKS} SELECT s.section, count(ch.id) AS chunks FROM {SECTIONS_SQL.replace('AS sections(', 'AS s(')} LEFT JOIN ch ON ch.section = s.section GROUP BY 1",
    "page_dump": f"SELECT source, page, '===== ' || page || ' (-) =====' || chr(10) || text AS block FROM {pages_sql()}",
    "chunk_dump": f"{_SIZE_CHUNKS} SELECT id, md5('===== ' || id || ' | ' || page || ' | ' || length(text) || ' =====' || chr(10) || text) AS block_md5 FROM ch",
    "slugs": "SELECT doc_id, regexp_replace(regexp_replace(replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents",
    "snippet": f"{_SIZE_CHUNKS} SELECT id, CASE WHEN length(b) <= 160 THEN b ELSE substr(b, 1, 160) || ' …' END AS snippet FROM (SELECT id, replace({_SNIP}, chr(10), ' ') AS b FROM ch)",
    "term_count_vector": "SELECT doc_id, " + ", ".join(f"CAST((length(text) - length(replace(text, '{w}', ''))) / {len(w)} AS DOUBLE) AS v{i}" for i, w in enumerate(["the", "der", "la "])) + " FROM documents WHERE text IS NOT NULL",
}
