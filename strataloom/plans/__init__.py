"""Query suites over the driver's tables, one module for each family of operators."""

from __future__ import annotations


def suites() -> list:
    from strataloom.plans import code_queries, graph_queries, kb_queries, name_queries, relation_queries, source_queries, text_queries, tree_queries

    return [text_queries, relation_queries, graph_queries, source_queries, kb_queries, code_queries, tree_queries, name_queries]
