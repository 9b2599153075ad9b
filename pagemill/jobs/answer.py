"""Job: a batch of questions to prompts, and replies to checked answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators import checks, context, fusion


def prompts(
    queries: DataFrame, index: DataFrame, chunks: DataFrame,
    k: int = 5, min_score: float = 0.45, candidates: int = 20, max_chunks: int = 10, max_chars: int = 12_000,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(status, sources, prompts).  queries: (query_id, question, reply, q_vec, t_vec)."""
    gated = checks.rewrite_gate(queries)
    hits = fusion.fusion_search(gated.where("search_text is not null"), index, k, candidates).select("query_id", "rank", "id", "score")
    status = checks.answer_status(gated, hits, min_score)
    asked = status.where("status = 'ask'").select("query_id")
    found = context.expand_siblings(hits.join(asked, "query_id", "left_semi"), chunks, max_chunks, max_chars)
    sources = found.join(chunks.select("id", "text", "page", "printed_page"), "id")
    return status, sources, context.build_prompt(sources, gated.join(asked, "query_id", "left_semi"))


def problems_of(answers: DataFrame, sources: DataFrame, reference: str, forbidden: str, label: str) -> DataFrame:
    """answers: (answer_id, text); sources: (answer_id, source_no, text)."""
    checked = checks.check_citations(checks.extract_citations(answers, reference), sources)
    return checks.all_problems(answers, [checks.citation_problems(checked), checks.forbidden_terms(answers, forbidden, label)])


def correct(first: DataFrame, second: DataFrame, sources: DataFrame, reference: str, forbidden: str, label: str) -> DataFrame:
    """Final answers: the second reply wherever the first had problems and there is one."""
    p1 = problems_of(first, sources, reference, forbidden, label)
    p2 = problems_of(second, sources, reference, forbidden, label)
    return checks.final_answers(first, p1, second.where(F.col("text").isNotNull()), p2)
