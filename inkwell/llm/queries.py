"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module that holds it; a module may also hold its SQL as ``ORACLE_SQL``.
MODULES = {
    "op1_best_fit_packing": "packing",
    "op2_token_files": "token_store",
    "op3_exact_top_k": "topk",
    "op4_url_filter": "url_filter",
    "op5_ngram_jaccard_join": "setjoin",
    "op6_html_text": "html_text",
    "op7_fingerprints": "fingerprints",
    "op8_lm_scores": "lm",
    "op9_language_id": "langid",
    "op10_mix_sources": "mixing",
    "op11_chat_formatting": "chat",
    "op12_source_divergence": "divergence",
    "op13_fill_in_middle": "fim",
}


def queries() -> dict:
    found = {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}
    pipeline = import_module("corpus_pipeline") if "pipeline" in PIPELINES else None
    return found | ({"pipeline": pipeline.run} if pipeline else {})


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in MODULES.items():
        sql = getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found


PIPELINES: tuple[str, ...] = ("pipeline",)
