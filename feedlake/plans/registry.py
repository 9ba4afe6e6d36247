"""Names every registered query of the library and its SQL twin."""

from __future__ import annotations

from . import article_queries, event_queries, report_queries, source_queries

MODULES = (source_queries, article_queries, event_queries, report_queries)


def flagship(spark, sf_dir):
    """The first page of the recommended feed."""
    return event_queries.feed_recommended(spark, sf_dir)


def queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
