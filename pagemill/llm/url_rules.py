"""URL filter lists: host-suffix and path-prefix expressions, matched by short hash prefixes.

Each URL becomes expressions ``host suffix + path prefix``: every suffix of whole labels, with
path prefixes of the lengths that occur among the rules.  Expressions meet the rules in an
equi-join on the first four bytes of their SHA-256; the full digest then confirms a match, so a
shared hash prefix decides nothing.  Of several matching rules the longest expression wins, then
the longer host, then block before allow.

The rules are broadcast if there are at most ``broadcast_rules`` of them (one row is a few hundred
bytes); larger lists are joined by shuffle, and equal URLs are matched once.

Defined results: null URLs and URLs without ``://`` have an empty host and path and match nothing;
a URL that no rule matches gets the default verdict and a null rule; equal rows are all returned;
rules with a null host or path are left out; an empty table gives no rows.  Columns of the input
named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import table

#: The contract's rules: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """Distinct structs (suffix, prefix) of a URL, for path prefixes of these lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    usable = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    made = F.flatten(F.transform(suffixes, lambda s: F.transform(usable, lambda n: F.struct(s.alias("suffix"), F.substring(path, F.lit(1), n).alias("prefix")))))
    return F.when(host != "", F.array_distinct(made))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def short(hexdigest: Column) -> Column:
    return F.substring(hexdigest, 1, 8)


def apply_rules(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", broadcast_rules: int = 100_000) -> DataFrame:
    """``pages`` with host, path, rule (``host + path`` of the rule that decides, else null) and verdict.

    rules: (host, path, verdict), verdict ``allow`` or ``block``.
    """
    rules = rules.where("host is not null and path is not null").select(F.lower("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    rules = rules.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))  # block wins over allow
    shape = rules.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.length("r_path")).alias("lengths")).first()
    hashed = rules.withColumn("r_digest", digest(F.col("r_host"), F.col("r_path"))).withColumn("short", short(F.col("r_digest")))
    if shape["n"] <= broadcast_rules:
        hashed = F.broadcast(hashed)

    rows = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    distinct = rows.select("host", "path").distinct()
    spread = distinct.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), sorted(shape["lengths"]))).alias("e"))
    spread = spread.select("host", "path", digest(F.col("e.suffix"), F.col("e.prefix")).alias("digest")).withColumn("short", short(F.col("digest")))
    matched = spread.join(hashed, "short").where(F.col("digest") == F.col("r_digest"))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("a"), F.length("r_host").alias("b"), F.col("r_verdict").alias("c"), F.concat("r_host", "r_path").alias("rule"))
    best = matched.groupBy("host", "path").agg(F.max(rank).alias("best"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("best.rule").alias("rule"), F.coalesce(F.col("best.c"), F.lit(default)).alias("verdict"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    judged = apply_rules(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = rf"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
p AS (
  SELECT page_id, row_number() OVER () AS k,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), m AS (
  SELECT k, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY k ORDER BY length(r_host) + length(r_path) DESC, length(r_host) DESC, r_verdict DESC) AS rn
  FROM p JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE rn = 1) USING (k)
"""
