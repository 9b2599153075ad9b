"""Page cleaning.  Each cleaner is a projection and drops the pages that it leaves blank.

Pages: (source, page, id, text, printed_page); other columns pass through.  With ``drop_blank=False`` a
cleaner leaves blank pages in, so that a chain of them tests for blanks once, at its end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import is_blank, let, matches, split_lines, strip

#: cleaner(pages, drop_blank=False)
Cleaner = Callable[..., DataFrame]
NO_BREAK_SPACE = "\u00a0"
#: Printed page numbers stand in the first or last lines of a page.
EDGE_LINES = 3


def _replace(pages: DataFrame, text: Column, drop_blank: bool) -> DataFrame:
    if drop_blank:
        # a filter would be pushed below the projection and evaluate the whole chain of expressions again
        text = F.explode(F.filter(F.array(text), lambda t: ~is_blank(t)))
    return pages.withColumn("text", text)


def drop_blank_pages(pages: DataFrame) -> DataFrame:
    return _replace(pages, F.col("text"), True)


def clean_whitespace(pages: DataFrame, drop_blank: bool = True) -> DataFrame:
    """Tabs and no-break spaces become spaces, runs one space, lines are stripped, two empty lines become one."""
    # ``translate`` looks up every character; two replacements only search
    spaced = F.replace(F.replace("text", F.lit("\t"), F.lit(" ")), F.lit(NO_BREAK_SPACE), F.lit(" "))
    # a plain search tells which texts a pattern has to run over
    text = let(spaced, lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t))
    text = let(text, lambda t: F.array_join(F.transform(split_lines(t), strip), "\n"))
    text = let(text, lambda t: F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, "\n{3,}", "\n\n")).otherwise(t))
    return _replace(pages, strip(text), drop_blank)


def clean_line_patterns(pages: DataFrame, patterns: list[str], drop_blank: bool = True) -> DataFrame:
    """Lines that match one of the patterns as a whole, without white space around them, go; line ends become \\n."""
    whole = "|".join(f"(?:{p})" for p in patterns) or r"(?!)"
    text = let(F.col("text"), lambda t: F.array_join(F.filter(split_lines(t), lambda line: ~matches(strip(line), whole)), "\n"))
    return _replace(pages, text, drop_blank)


def clean_hyphenation(pages: DataFrame, conjunctions: tuple[str, ...] = ("und", "oder"), drop_blank: bool = True) -> DataFrame:
    """Words broken at a line's end are joined; a hyphen before a capital or a conjunction stays."""
    end = r"-[ \t]*\n[ \t]*"
    before_word = rf"(\p{{L}}){end}((?:{'|'.join(conjunctions)})(?![A-Za-z0-9_]))"
    text = F.regexp_replace("text", before_word, "$1- $2")
    text = F.regexp_replace(text, rf"(\p{{L}}){end}(\p{{Ll}})", "$1$2")
    joined = F.regexp_replace(text, rf"(\p{{L}}){end}(\p{{L}})", "$1-$2")
    # the patterns try every letter, so they run over texts with a broken line only
    return _replace(pages, F.when(F.contains("text", F.lit("-")) & F.col("text").rlike(r"-[ \t]*\n"), joined).otherwise(F.col("text")), drop_blank)


def extract_printed_page(pages: DataFrame, offset: int, drop_blank: bool = True) -> DataFrame:
    """The line that is page + offset goes to ``printed_page``: one near the page's edges, else the first anywhere."""
    expected = (F.col("page") + offset).cast("string")
    # steps of their own, so that a text is split once; texts without the number aren't split at all
    staged = pages.withColumn("__lines", F.when(F.contains("text", expected), F.split("text", "\n")))
    numbered = F.transform("__lines", lambda line, i: F.when(strip(line) == expected, i))
    staged = staged.withColumn("__places", F.filter(numbered, lambda i: i.isNotNull()))
    edge = F.filter("__places", lambda i: (i < EDGE_LINES) | (i >= F.size("__lines") - EDGE_LINES))
    staged = staged.withColumn("__place", F.coalesce(F.get(edge, F.lit(0)), F.get("__places", F.lit(0))))
    rest = F.array_join(F.filter("__lines", lambda _, i: i != F.col("__place")), "\n")
    known = F.col("printed_page") if "printed_page" in pages.columns else F.lit(None).cast("int")
    found = F.col("__place").isNotNull()
    marked = staged.withColumn("printed_page", F.when(found, expected.cast("int")).otherwise(known))
    return _replace(marked, F.when(found, rest).otherwise(F.col("text")), drop_blank).drop("__lines", "__places", "__place")


def clean(pages: DataFrame, cleaners: list[Cleaner]) -> DataFrame:
    """The cleaners in order.  A blank page stays blank in all of them, so blank pages go once, at the end."""
    for cleaner in cleaners:
        pages = cleaner(pages, drop_blank=False)
    return drop_blank_pages(pages)
