"""All queries of this folder, and their SQL where SQL can say the same."""

from __future__ import annotations

import importlib

#: Module and query function of each operator, and the name of its SQL, if any.
_QUERIES = {
    "op1_warc_derivatives": ("warc", "OP1_SQL"),
    "op2_toxicity_ftrl": ("toxicity", None),
    "op3_poisson_mixing": ("mixing", "OP3_SQL"),
    "op4_training_order": ("training_order", None),
    "op5_benchmark_decontamination": ("decontaminate", "OP5_SQL"),
    "op6_fuzzy_lines": ("fuzzy_lines", None),
    "op7_ngram_jaccard_join": ("setjoin", None),
    "op8_quality_rules": ("quality_rules", None),
    "op9_url_rules": ("url_rules", "OP9_SQL"),
    "op10_ordinal_quality": ("ordinal", None),
    "op11_vector_links": ("vector_links", None),
    "op12_filter_audit": ("filter_audit", "OP12_SQL"),
    "op13_source_divergence": ("divergence", "OP13_SQL"),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"pagemill.llm.{module}"), name) for name, (module, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"pagemill.llm.{module}"), sql) for name, (module, sql) in _QUERIES.items() if sql}
