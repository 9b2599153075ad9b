"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is target share * total size / own size.  Each document draws its
number of copies by inverting the Poisson distribution with that mean at a uniform number hashed
from the seed and its id; it is exploded into as many rows, and the copies are shuffled globally by
a hashed key.  Drawing needs no random state: a task that runs again draws the same.

Per-source sums are combined on the map side.  With at most ``broadcast_sources`` sources (a row
holds the name and the distribution's table) they are broadcast to the documents; with more, the
join is a shuffle whose hot sources Spark splits.

Size of a document: its bytes plus one.  Defined results: null sources form a source of their own;
null and empty texts have size one and are drawn like the others; a null id hashes as an empty one; equal ids
draw equal counts; an empty table gives no rows; a source without a target weight gets no copies.
Columns of the input named like an output are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import set_aside, table

SEED = "mix-1"


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) with 52 hashed bits."""
    key = F.concat_ws("|", F.lit(seed), *parts)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def lowest_count(rate: Column) -> Column:
    """A count that a draw misses downwards with a chance below 2**-52; 0 for rates up to 1024."""
    return F.when(rate > 1024, F.floor(rate - 12 * F.sqrt(rate) - 30)).otherwise(F.lit(0)).cast("int")


def poisson_table(rate: Column) -> Column:
    """P(X <= low), P(X <= low + 1), ... far past the mean, from low = lowest_count(rate).

    A table has some 24 times the root of the rate as entries.  Logarithms keep large means from vanishing.
    """
    low, top = lowest_count(rate), F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    k = low.cast("double")
    # the logarithm of k! by Stirling's series: exact in a double, as k is above 600
    tail = F.ln(2 * math.pi * k) / 2 + 1 / (12 * k) - 1 / (360 * k * k * k)
    first = F.when(low > 0, k * F.ln(rate / k) + k - rate - tail).otherwise(-rate)
    start = F.struct(first.alias("l"), F.exp(first).alias("c"), F.array(F.exp(first)).alias("t"))

    def step(a: Column, k: Column) -> Column:
        log = a["l"] + F.ln(rate) - F.ln(k.cast("double"))
        total = a["c"] + F.exp(log)
        return F.struct(log.alias("l"), total.alias("c"), F.concat(a["t"], F.array(total)).alias("t"))

    return F.when(rate > 0, F.aggregate(F.sequence(low + 1, top), start, step, lambda a: a["t"])).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, exponent: float = 0.5, epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """(source, size, rate) from sums over all documents.

    weights: (source, weight), any positive scale; by default a source weighs its
    size to the power ``exponent``, which raises small sources.  The mixture has
    ``epochs`` times the corpus's size in the mean.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(exponent)))
    else:
        w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight"))
        sizes = sizes.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source").fillna(0.0, ["weight"])
    total = sizes.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    all_size, all_weight = float(total["size"] or 0), float(total["weight"] or 0)
    share = F.col("weight") / F.lit(all_weight if all_weight > 0 else 1.0)
    return sizes.select("source", "size", (share * F.lit(epochs * all_size) / F.col("size")).alias("rate"))


def replicate(docs: DataFrame, rates: DataFrame, seed: str = SEED, source: str = "source", doc_id: str = "doc_id", broadcast_sources: int = 50_000) -> DataFrame:
    """Each document as often as it draws: adds rate, n_copies, copy (from 0), mix_key; rows in shuffled order."""
    docs = docs.drop("rate", "n_copies", "copy", "mix_key")
    table_of = F.struct("rate", lowest_count(F.col("rate")).alias("low"), poisson_table(F.col("rate")).alias("cdf"))
    rows = rates.select(F.col("source").alias("__mix_source"), table_of.alias("__mix"))
    bound = rates.agg(F.count(F.lit(1)).alias("n"), F.max("rate").alias("rate"), F.sum(F.octet_length("source")).alias("names")).first()
    # a row is its name and 8 bytes for each entry of a table
    entries = bound["n"] * (62 + 24 * (bound["rate"] or 0) ** 0.5)
    if bound["n"] <= broadcast_sources and entries <= 100 * broadcast_sources and (bound["names"] or 0) <= 64 << 20:
        rows = F.broadcast(rows)
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    u = uniform(seed, F.lit("n"), ident)
    n_copies = F.col("__mix.low") + F.size(F.filter("__mix.cdf", lambda c: c <= F.col("__mix_u")))
    drawn = docs.join(rows, docs[source].eqNullSafe(F.col("__mix_source"))).withColumn("__mix_u", u)
    drawn = drawn.withColumns({"rate": F.col("__mix.rate"), "n_copies": n_copies}).drop("__mix", "__mix_u", "__mix_source")
    copies = drawn.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("o"), ident, F.col("copy").cast("string")).cast("binary")))
    return keyed.repartition(F.col("mix_key")).sortWithinPartitions("mix_key")


def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = replicate(docs, source_rates(docs))
    return out.select("doc_id", "text", "lang", "source", "n_chars", "n_copies", "copy", "mix_key")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixture, with the columns of the input as they were, whatever their names.

    Null ids, texts and sources, repeats and an empty table are as for ``replicate``.
    """
    docs, back = set_aside(docs, "doc_id", "text", "source")
    return back(replicate(docs, source_rates(docs)))


OP3_SQL = f"""
WITH s AS (SELECT source, sum(coalesce(octet_length(encode(text)), 0) + 1) AS size FROM documents GROUP BY 1),
w AS (SELECT *, pow(CAST(size AS DOUBLE), 0.5) AS weight FROM s),
r AS (SELECT source, weight / (SELECT sum(weight) FROM w) * (SELECT CAST(sum(size) AS DOUBLE) FROM w) / size AS rate FROM w),
steps AS (
  SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM r)
), d AS (
  SELECT *, CAST('0x' || substr(md5('{SEED}|n|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u, row_number() OVER () AS row FROM documents
), n AS (
  SELECT d.row, count(*) FILTER (WHERE steps.cdf <= d.u) AS n_copies FROM d JOIN steps ON steps.source IS NOT DISTINCT FROM d.source GROUP BY 1
)
SELECT doc_id, text, lang, source, n_chars, CAST(n_copies AS INT) AS n_copies, CAST(copy AS INT) AS copy, md5('{SEED}|o|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy) AS mix_key
FROM (SELECT *, unnest(range(0, n_copies)) AS copy FROM d JOIN n USING (row))
"""
