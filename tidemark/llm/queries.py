"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("simhash", "language_id", "token_blocks", "exact_dedup", "sentence_pieces", "line_dedup", "norm_search", "toxicity", "secret_scan", "packing", "pipeline")


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= import_module(f"tidemark.llm.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= getattr(import_module(f"tidemark.llm.{name}"), "ORACLE", {})
    return out
