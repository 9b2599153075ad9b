"""Page documents from a table of extracted page text, and text dumps of pages and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import is_blank


def pages_from_table(df: DataFrame, source: str = "source", page: str = "page", text: str = "text", first: int = 1, last: int | None = None) -> DataFrame:
    """(source, page, id, text, printed_page): pages first..last of each source, blank ones left out."""
    if first < 1 or (last is not None and last < first):
        raise ValueError(f"not a page range: {first} to {last}")
    inside = F.col(page) >= first if last is None else F.col(page).between(first, last)
    base = F.regexp_replace(F.col(source), r"(?i)\.pdf\z", "")
    return df.where(inside & ~is_blank(F.col(text))).select(
        F.col(source).alias("source"), F.col(page).cast("int").alias("page"), F.concat(base, F.lit("#seite-"), F.col(page).cast("string")).alias("id"), F.col(text).alias("text"), F.lit(None).cast("int").alias("printed_page")
    )


def page_block(pages: DataFrame) -> Column:
    """A page with a line above it that names its page and printed page."""
    printed = F.coalesce(pages["printed_page"].cast("string"), F.lit("-"))
    return F.concat(F.lit("===== "), pages["page"].cast("string"), F.lit(" ("), printed, F.lit(") =====\n"), pages["text"])


def chunk_block(chunks: DataFrame) -> Column:
    """A chunk with a line above it that names its id, page and length."""
    return F.concat(F.lit("===== "), chunks["id"], F.lit(" | "), chunks["page"].cast("string"), F.lit(" | "), F.length(chunks["text"]).cast("string"), F.lit(" =====\n"), chunks["text"])


def dump(df: DataFrame, block: Column, path: str) -> None:
    """One text block for each row."""
    df.select(block.alias("value")).write.text(path)
