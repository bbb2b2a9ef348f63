"""All queries of the engine by name."""

from __future__ import annotations

from collections.abc import Callable

from parchment.plans import block_queries, fragment_queries, highlight_queries, layout_queries, page_queries, ready_queries, registry_queries, report_queries, retrieval_queries, source_queries, stream_queries, table_queries, text_queries, vector_queries, visual_queries

MODULES = (text_queries, page_queries, block_queries, table_queries, vector_queries, registry_queries, retrieval_queries, layout_queries, stream_queries, source_queries, ready_queries, highlight_queries, visual_queries, report_queries, fragment_queries)
FLAGSHIP = "semantic_top5"


def queries() -> dict[str, Callable]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
