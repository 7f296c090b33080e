"""All queries of the library by name, with the DuckDB SQL that returns the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ["operators.bm25", "operators.chunking", "operators.graph", "operators.retrieval", "operators.tables", "operators.facts", "operators.observe", "operators.relational", "operators.quality", "operators.records", "operators.surface", "streaming.events", "plans.planner", "functions.languages", "sources.pdf", "operators.report"]


def _all() -> dict:
    return {name: q for m in MODULES for name, q in import_module(f"docloom.{m}").QUERIES.items()}


def queries() -> dict:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
