"""Queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from pagelane.llm import (op1_exact_dedup, op2_exact_topk, op3_line_dedup, op4_mixing, op5_ngram_join, op6_toxicity, op7_language_id,
                          op8_warc, op9_url_filters, op10_packing, op11_vector_codes,
                          op12_filter_audit, op13_personal_data)

_MODULES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_exact_topk": op2_exact_topk,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_ngram_join": op5_ngram_join,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_warc": op8_warc,
    "op9_url_filters": op9_url_filters,
    "op10_packing": op10_packing,
    "op11_vector_codes": op11_vector_codes,
    "op12_filter_audit": op12_filter_audit,
    "op13_personal_data": op13_personal_data,
}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES.items() if module.SQL}
