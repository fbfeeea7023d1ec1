"""Every registered query outside the llm subpackage, with its SQL where there is one."""

from __future__ import annotations


def modules() -> list:
    from ..functions import queries as functions
    from ..operators import analytics, catalog, extract, faq, items, match, message_queries, plugins
    from ..sources import queries as sources
    from ..streaming import queries as streaming

    return [functions, message_queries, analytics, catalog, extract, faq, match, items, plugins, sources, streaming]


def queries() -> dict:
    return {name: f for m in modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in modules() for name, sql in m.SQL.items()}
