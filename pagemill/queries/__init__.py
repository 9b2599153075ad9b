"""Registered queries: operators applied to the given tables, with SQL that says the same."""

from __future__ import annotations

from pagemill.queries import answers, retrieval, text


def queries() -> dict:
    return text.QUERIES | retrieval.QUERIES | answers.QUERIES


def oracle_sql() -> dict[str, str]:
    return text.SQL | retrieval.SQL | answers.SQL
