"""Job: pages to chunks to a refreshed vector index."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from pagemill.operators import chunking, cleaning, lines
from pagemill.sources.index_store import IndexStore
from pagemill.sources.shared import bucketed, buckets, new_path, passing


def chunks_of(
    pages: DataFrame, sections: DataFrame, max_chars: int, rules: chunking.HeadingRules,
    page_offset: int = 0, line_patterns: list[str] | None = None, skipped: list[int] | None = None,
) -> DataFrame:
    """Pages (source, page, id, text, printed_page) cleaned, cut into sections and chunked.

    sections: (section, first_page, last_page, strategy, section_no).
    """
    cleaned = cleaning.clean(pages, [
        partial(cleaning.extract_printed_page, offset=page_offset),
        partial(cleaning.clean_line_patterns, patterns=line_patterns or []),
        cleaning.clean_hyphenation,
        cleaning.clean_whitespace,
    ])
    rows = lines.packed_lines(lines.assign_sections(cleaned, sections, skipped))
    return chunking.process(rows, sections, max_chars, rules)


def chunk_table(spark: SparkSession, make: Callable[[], DataFrame], multiple: int = 1) -> DataFrame:
    """The chunks that ``make`` gives as a table of buckets by id, in a multiple of so many; what else ``make`` has written goes."""
    path = new_path(spark, "chunks")
    with passing(spark):
        chunks = make()
        return bucketed(chunks, "chunks", ["id"], -(-buckets(chunks) // multiple) * multiple, path=path)


def build(chunks: DataFrame, store: IndexStore, embedder: Callable[[DataFrame], DataFrame], dealt: bool = False) -> tuple[IndexStore, DataFrame]:
    """(store of exactly these chunks, stats).  ``chunks`` need pos; only what is new or changed is embedded and written."""
    return store.refresh(chunks, embedder, dealt)
