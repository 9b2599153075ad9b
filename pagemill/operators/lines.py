"""Sections of a book and the lines of their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import is_blank, let, split_lines, whole_lines
from pagemill.operators.scans import scan, with_block
from pagemill.operators.sizes import if_few
from pagemill.sources.shared import bucketed, buckets, written

KEYS = ["source", "section"]
#: What pages and lines are dealt by.
GROUPS = [*KEYS, "block"]
#: Pages of a block in the join with many sections.
BLOCK = 64


def assign_sections(pages: DataFrame, sections: DataFrame, skipped: list[int] | None = None, broadcast_sections: int = 100_000) -> DataFrame:
    """A row for each section that a page lies in; pages in ``skipped`` lie in none.

    sections: (section, first_page, last_page, ...), broadcast if they are few.  A larger table
    meets the pages by blocks of BLOCK pages, of which a section covers a few, in an equi-join.
    """
    kept = pages.where(~F.col("page").isin(skipped)) if skipped else pages
    inside = F.col("page").between(F.col("first_page"), F.col("last_page"))
    few = if_few(sections, broadcast_sections)
    if few is not sections:
        return kept.join(few, inside)
    block = F.floor(F.col("page") / BLOCK)
    blocks = F.sequence(F.floor(F.col("first_page") / BLOCK), F.floor(F.col("last_page") / BLOCK))
    spread = sections.where("first_page <= last_page").withColumn("__block", F.explode(blocks))
    return kept.withColumn("__block", block).join(spread, "__block").where(inside).drop("__block")


def _broken_pages(pages: DataFrame, n: int) -> DataFrame:
    """(source, section, block, cut, tails): what a block of pages needs to know of lines broken over the ends of pages.

    pages: bucketed.  cut: pages whose first line belongs to an earlier one; tails: page -> what its last line goes on with.
    Only the first and last lines of pages are looked at, and a text is kept only where it may go on an earlier line.
    """
    lined = whole_lines(F.col("text"))
    edges = pages.where(F.col("text") != "").select(*GROUPS, "page", lined.alias("t"))
    first, end = F.substring_index("t", "\n", 1), F.substring_index("t", "\n", -1)
    edges = edges.select(*GROUPS, "page", F.when(first.rlike(r"\A\p{Ll}"), first).alias("first"), (F.endswith(end, F.lit("-")) & end.rlike(r"\p{L}-\z")).alias("broken"), (~F.contains("t", F.lit("\n"))).alias("single"))
    # written down, as each scan reads its input twice
    edges = bucketed(edges, "edges", GROUPS, n, deal=False)
    # what ends a joined line is the end of its last raw line, so raw lines decide
    edges = scan(edges, KEYS, ["page"], {"before": ("before", F.col("broken"))})
    edges = edges.withColumn("joins", F.col("first").isNotNull() & F.coalesce("before", F.lit(False)))
    # a page of one line that is cut hands its end on to the page before
    begins = F.when(~(F.col("joins") & F.col("single")), F.col("page"))
    owned = scan(edges, KEYS, ["page"], {"owner": ("before", begins)}).where("joins")
    tails = owned.groupBy(*KEYS, "owner").agg(F.sort_array(F.collect_list(F.struct("page", "first"))).alias("parts"), F.collect_list("page").alias("cut"))
    inner = F.transform(F.slice("parts", 1, F.size("parts") - 1), lambda p: F.regexp_replace(p["first"], r"-\z", ""))
    tail = F.concat(F.array_join(inner, ""), F.element_at("parts", -1)["first"])
    owners = with_block(tails.select(*KEYS, F.col("owner").alias("page"), tail.alias("tail"), F.lit(False).alias("cut")))
    cut = with_block(tails.select(*KEYS, F.explode("cut").alias("page"), F.lit(None).cast("string").alias("tail"), F.lit(True).alias("cut")))
    told = owners.unionByName(cut).groupBy(*GROUPS).agg(F.collect_list(F.struct("page", "tail", "cut")).alias("told"))
    chosen = lambda cut: F.filter("told", lambda x: x["cut"] == cut)
    tails_of = F.map_from_entries(F.transform(chosen(False), lambda x: F.struct(x["page"], x["tail"])))
    return told.select(*GROUPS, F.transform(chosen(True), lambda x: x["page"]).alias("cut"), tails_of.alias("tails"))


def packed_lines(pages: DataFrame) -> DataFrame:
    """(source, section, block, page, printed_page, lines): a row for each page, its lines as (line_idx, text) in order.

    Pages are dealt by section and block of pages once and written as a table of such buckets, so whatever meets
    lines by section and block leaves their texts where they are.  A word broken over a page's end is one line, on
    the earlier page; pages meet only what their block is told of broken lines.
    """
    n = buckets(pages)
    dealt = bucketed(with_block(pages.select(*KEYS, "page", "printed_page", "text")), "pages", GROUPS, n)
    told = dealt.join(written(_broken_pages(dealt, n), "broken"), GROUPS, "left")
    told = told.withColumns({"cut": F.coalesce(F.array_contains("cut", F.col("page")), F.lit(False)), "tail": F.try_element_at("tails", F.col("page"))})

    def mended(found: Column) -> Column:
        ends = lambda i: F.col("tail").isNotNull() & (i == F.size(found) - 1)
        every = F.transform(found, lambda t, i: F.struct(i.alias("line_idx"), F.when(ends(i), F.concat(F.regexp_replace(t, r"-\z", ""), "tail")).otherwise(t).alias("text")))
        return F.when(F.col("cut"), F.slice(every, 2, F.greatest(F.size(found), F.lit(1)))).otherwise(every)

    return told.select(*GROUPS, "page", "printed_page", let(split_lines(F.col("text")), mended).alias("lines"))


def to_lines(pages: DataFrame) -> DataFrame:
    """(source, section, page, line_idx, text, printed_page), by page and line; see ``packed_lines``."""
    return packed_lines(pages).select(*KEYS, "page", F.inline("lines"), "printed_page")


def drop_blank_lines(lines: DataFrame) -> DataFrame:
    return lines.where(~is_blank(F.col("text")))
