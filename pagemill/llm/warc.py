"""WARC derivatives: a metadata and a plain-text conversion record for every response record.

Both derivatives name the response in WARC-Refers-To, carry its target URI, date and digests, and
have a digest of their own block.  The work is one projection per response, in built-in
functions, without a shuffle.

Response records: record_id, target_uri, date, block (binary: the HTTP head, an empty line, the
body), block_digest, payload_digest.

Defined results: a null block counts as an empty one and gives both derivatives, the conversion with
an empty block; a block without an empty line is all head, whatever its length; every header line of
the head is listed in the metadata; null URIs stay null; bytes that aren't valid in the declared charset
(UTF-8 or Latin-1; others are read as UTF-8) become U+FFFD; unclosed tags stay text; a body with a content or
transfer encoding is not decoded here: its conversion block is empty and the metadata names the
encoding; repeated responses give repeated derivatives; other columns of the input pass through,
except those named like an output, which are replaced.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import let
from pagemill.llm.common import table

#: Named character references that are decoded: those of HTML 4, and ``apos``.
ENTITIES = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"}
#: Elements that begin and end a line.
BLOCKS = "p|div|h[1-6]|li|ul|ol|dl|dt|dd|tr|td|th|table|article|section|nav|header|footer|aside|main|blockquote|pre|form|body|html|br|hr"

#: All begin with the same character, so a pattern tries its branches only there.
UNSEEN = r"(?is)<(?:!--.*?-->|script(?:\s[^>]*)?>.*?</script\s*>|style(?:\s[^>]*)?>.*?</style\s*>|head(?:\s[^>]*)?>.*?</head\s*>)"
BREAK = rf"(?i)</?(?:{BLOCKS})(?:[\s/][^>]*)?>"
TAG = r"</?[A-Za-z!?][^>]*>"
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"
BLANK = "[ \t\r\f\u000b\u00a0]+"
LINES = r" ?\n[ \n]*"
HEAD_END = "\r\n\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _character(code: Column) -> Column:
    """The character of a code point; U+FFFD if there is none."""
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("�"))


def decode_references(text: Column) -> Column:
    """Character references decoded once: ``&amp;lt;`` becomes ``&lt;``."""
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    # each piece with its reference first, so that the pattern runs once a piece
    pieces = F.transform(F.split(text, "&"), lambda x: F.struct(x.alias("x"), F.regexp_extract(x, REFERENCE, 1).alias("ref")))

    def number(p: Column) -> Column:
        return F.when(p["ref"].rlike("^#[xX]"), F.conv(F.substring(p["ref"], F.lit(3), F.length(p["ref"])), 16, 10)).when(p["ref"].startswith("#"), F.substring(p["ref"], F.lit(2), F.length(p["ref"]))).cast("bigint")

    coded = F.transform(pieces, lambda p: F.struct(p["x"].alias("x"), p["ref"].alias("ref"), F.when(p["ref"] != "", number(p)).alias("code")))
    decoded = F.transform(coded, lambda p: F.struct(p["x"].alias("x"), p["ref"].alias("ref"), F.when(p["code"].isNotNull(), _character(p["code"])).when(p["ref"] != "", F.try_element_at(names, p["ref"])).alias("char")))

    def joined(p: Column, i: Column) -> Column:
        rest = F.substring(p["x"], F.length(p["ref"]) + 2, F.length(p["x"]))
        return F.when(i == 0, p["x"]).when(p["char"].isNotNull(), F.concat(p["char"], rest)).otherwise(F.concat(F.lit("&"), p["x"]))

    return F.array_join(F.transform(decoded, joined), "")


def html_to_text(html: Column) -> Column:
    """Visible text, a line for each block element, blanks collapsed."""
    text = F.regexp_replace(html, UNSEEN, " ")
    text = F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" ")), BREAK, "\n")
    text = _decoded(F.regexp_replace(text, TAG, ""))
    text = F.regexp_replace(F.regexp_replace(text, BLANK, " "), LINES, "\n")
    return F.btrim(text, F.lit(" \n"))


def _decoded(text: Column) -> Column:
    """References decoded where there may be one."""
    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), decode_references(t)).otherwise(t))


def html_title(html: Column) -> Column:
    title = F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1)
    return F.trim(F.regexp_replace(F.replace(_decoded(title), F.lit("\n"), F.lit(" ")), BLANK, " "))


def sha256(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def record_id(kind: str, of: Column) -> Column:
    """A urn:uuid that depends on the kind of record and on what it is made of alone."""
    h = F.md5(F.concat(F.lit(f"{kind}\n"), of).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def responses_from_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table (page_id, url, html); the other columns pass."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    block = F.concat(F.lit(HTTP_HEAD).cast("binary"), body)
    made = {
        "record_id": record_id("response", F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("url", F.lit("")))),
        "target_uri": F.col("url"), "date": F.lit(date), "block": block, "block_digest": sha256(block), "payload_digest": sha256(body),
    }
    return pages.withColumns(made).drop("url", "html")


def _header(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"(?i)\n{name}[ \t]*:[ \t]*([^\r\n]*)", 1)


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows for each response: record_type ``metadata`` and ``conversion``.

    Columns: what passes of the input, record_type, record_id, refers_to, target_uri,
    refers_to_date, source_block_digest, payload_digest, content_type, block, content_length,
    block_digest.
    """
    keep = [c for c in responses.columns if c not in {"record_id", "target_uri", "date", "block", "block_digest", "payload_digest", "record_type", "refers_to", "refers_to_date", "source_block_digest", "content_type", "content_length"}]
    whole = F.coalesce("block", F.lit("").cast("binary"))
    # found by bytes: no decoding, and a head of any length
    head = F.substring_index(whole.cast("string"), HEAD_END, 1).cast("binary")
    r = responses.select(*keep, "record_id", "target_uri", "date", "block_digest", "payload_digest", whole.alias("whole"), head.alias("head_bytes"))
    size = F.octet_length("head_bytes")
    body = F.when(size < F.octet_length("whole"), F.substring(F.col("whole"), size + len(HEAD_END) + 1, F.octet_length("whole"))).otherwise(F.lit("").cast("binary"))
    r = r.withColumns({"head": F.decode("head_bytes", "ISO-8859-1"), "body": body})
    names = F.array(_header(F.col("head"), "content-encoding"), _header(F.col("head"), "transfer-encoding"))
    encodings = F.concat_ws(" ", F.array_compact(F.transform(names, lambda x: F.when(~F.lower(x).isin("", "identity"), x))))
    r = r.withColumns({"http_type": _header(F.col("head"), "content-type"), "encodings": encodings})
    latin_1 = F.lower(F.col("http_type")).rlike("charset=[\"']?(iso-8859-1|latin-?1|windows-1252)")
    page = F.when(latin_1, F.decode("body", "ISO-8859-1")).otherwise(F.make_valid_utf8(F.col("body").cast("string")))
    r = r.withColumn("page", F.when(F.col("encodings") == "", page).otherwise(""))
    kind = F.lower("http_type")
    html = kind.rlike("^(text/html|application/xhtml)") | (kind == "")
    text = F.when(html, html_to_text(F.col("page"))).when(kind.startswith("text/"), F.col("page")).otherwise("")
    r = r.withColumns({"text": text, "title": html_title(F.col("page"))})
    status = F.regexp_extract("head", r"^HTTP/[0-9.]+ +([0-9]{3})", 1)
    fields = [
        ("http-status", status), ("http-content-type", F.col("http_type")), ("http-encodings", F.col("encodings")), ("html-title", F.col("title")),
        ("source-block-digest", F.col("block_digest")), ("source-payload-digest", F.col("payload_digest")),
        ("source-body-bytes", F.octet_length("body").cast("string")), ("text-characters", F.length("text").cast("string")),
    ]
    # every header line of the response as it came, in order
    lines = F.filter(F.split("head", "\r\n"), lambda line, i: (i > 0) & (line != ""))
    headers = F.array_join(F.transform(lines, lambda line: F.concat(F.lit("http-header: "), line, F.lit("\r\n"))), "")
    known = F.array_compact(F.array(*[F.when(v != "", F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))) for k, v in fields]))
    metadata = F.concat(F.array_join(known, ""), headers)
    made = F.array(
        F.struct(F.lit("metadata").alias("record_type"), record_id("metadata", F.col("record_id")).alias("id"), F.lit("application/warc-fields").alias("content_type"), metadata.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), record_id("conversion", F.col("record_id")).alias("id"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    out = r.select(*keep, "record_id", "target_uri", "date", "block_digest", "payload_digest", F.explode(made).alias("d"))
    return out.select(
        *keep, "d.record_type", F.col("d.id").alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", F.col("date").alias("refers_to_date"),
        F.col("block_digest").alias("source_block_digest"), "payload_digest", "d.content_type", "d.block",
        F.octet_length("d.block").cast("long").alias("content_length"), sha256(F.col("d.block").cast("binary")).alias("block_digest"),
    )


def record_text(d: DataFrame) -> Column:
    """A derivative as a WARC 1.1 record, without the two line ends that close it."""
    fields = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "refers_to_date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "refers_to_date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    lines = [F.concat(F.lit(f"{k}: "), d[c].cast("string"), F.lit("\r\n")) for k, c in fields]
    return F.concat(F.lit("WARC/1.1\r\n"), F.array_join(F.array_compact(F.array(*lines)), ""), F.lit("\r\n"), d["block"])


def write_warc(d: DataFrame, path: str) -> None:
    """Derivatives as gzipped WARC files, one for each partition, to any path that Spark writes."""
    d.select(record_text(d).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses_from_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def _sql_decode(text: str) -> str:
    names = "MAP {" + ", ".join(f"'{k}': '{v}'" if v != "'" else f"'{k}': ''''" for k, v in ENTITIES.items()) + "}"
    ref = f"regexp_extract(x, '{REFERENCE}', 1)"
    code = f"CASE WHEN {ref} LIKE '#x%' OR {ref} LIKE '#X%' THEN CAST('0x' || substr({ref}, 3) AS BIGINT) WHEN {ref} LIKE '#%' THEN CAST(substr({ref}, 2) AS BIGINT) END"
    char = f"CASE WHEN {ref} LIKE '#%' THEN CASE WHEN ({code}) BETWEEN 1 AND 55295 OR ({code}) BETWEEN 57344 AND 1114111 THEN chr(CAST({code} AS INT)) ELSE chr(65533) END ELSE ({names})[{ref}] END"
    return f"array_to_string(list_transform(string_split({text}, '&'), lambda x, i: CASE WHEN i = 1 THEN x WHEN {ref} <> '' AND {char} IS NOT NULL THEN {char} || substr(x, length({ref}) + 2) ELSE '&' || x END), '')"


def _sql_text(html: str) -> str:
    body = f"regexp_replace(translate(regexp_replace({html}, '{UNSEEN}', ' ', 'g'), chr(10), ' '), '{BREAK}', chr(10), 'g')"
    text = _sql_decode(f"regexp_replace({body}, '{TAG}', '', 'g')")
    return f"regexp_replace(regexp_replace(regexp_replace({text}, '{BLANK}', ' ', 'g'), '{LINES}', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"


def _sql_title(html: str) -> str:
    title = _sql_decode(f"regexp_extract({html}, '(?is)<title(?:\\s[^>]*)?>(.*?)</title\\s*>', 1)")
    return f"trim(regexp_replace(replace({title}, chr(10), ' '), '{BLANK}', ' ', 'g'), ' ')"


_SQL_ID = "'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12) || '>'"
_CRLF = "chr(13) || chr(10)"
OP1_SQL = f"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, 'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || {_CRLF} || coalesce(html, '') AS response,
         md5('response' || chr(10) || coalesce(CAST(page_id AS VARCHAR), '') || chr(10) || coalesce(url, '')) AS h FROM pages
), r AS (
  SELECT page_id, url, html, {_SQL_ID.format(h="h")} AS refers_to, 'sha256:' || sha256(response) AS source_block_digest, 'sha256:' || sha256(html) AS payload_digest,
         {_sql_text("html")} AS text, {_sql_title("html")} AS title FROM p
), d AS (
  SELECT *, 'conversion' AS record_type, 'text/plain; charset=utf-8' AS content_type, text AS block FROM r
  UNION ALL
  SELECT *, 'metadata', 'application/warc-fields', 'http-status: 200' || {_CRLF} || 'http-content-type: text/html; charset=utf-8' || {_CRLF} || CASE WHEN title <> '' THEN 'html-title: ' || title || {_CRLF} ELSE '' END
    || 'source-block-digest: ' || source_block_digest || {_CRLF} || 'source-payload-digest: ' || payload_digest || {_CRLF}
    || 'source-body-bytes: ' || octet_length(encode(html)) || {_CRLF} || 'text-characters: ' || length(text) || {_CRLF} || 'http-header: Content-Type: text/html; charset=utf-8' || {_CRLF} FROM r
), i AS (SELECT *, md5(record_type || chr(10) || refers_to) AS h FROM d)
SELECT page_id, record_type, {_SQL_ID.format(h="h")} AS record_id, refers_to, url AS target_uri, '2024-01-01T00:00:00Z' AS refers_to_date, source_block_digest, payload_digest, content_type, block,
       octet_length(encode(block)) AS content_length, 'sha256:' || sha256(block) AS block_digest FROM i
"""
