"""Registered queries over the test tables, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from gradloom.catalog import arrays, files, preparation, sampling, scoring, training
from gradloom.catalog.registry import Query

QUERIES: dict[str, Query] = {}
for module in (preparation, arrays, sampling, files, scoring, training):
    QUERIES.update(module.REGISTRY.queries)
