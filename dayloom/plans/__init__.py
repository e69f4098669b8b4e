"""Composite plans and the query catalogue."""

from __future__ import annotations


def load_queries():
    """(queries, sql) after all catalogue modules are imported."""
    from dayloom.plans import catalog, queries_clustering, queries_features, queries_forecast, queries_panel, queries_tables  # noqa: F401

    return catalog.QUERIES, catalog.SQL
