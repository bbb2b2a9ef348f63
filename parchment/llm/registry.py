"""The queries of the training-data operators by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from parchment.llm import bpe, licenses, line_dedup, mixing, quality, simhash, suffix_tree, topk, toxicity, wrappers

MODULES = (line_dedup, bpe, suffix_tree, toxicity, mixing, simhash, topk, licenses, wrappers, quality)


def queries() -> dict[str, Callable]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
