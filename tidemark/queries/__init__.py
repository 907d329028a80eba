"""Named queries over the test tables, and the SQL that gives the same results."""

from __future__ import annotations

import importlib

MODULES = ["quality", "signals", "features", "records", "detect", "learned", "more"]


def _modules():
    return [importlib.import_module(f"tidemark.queries.{name}") for name in MODULES]


def all_queries() -> dict:
    return {name: f for module in _modules() for name, f in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.SQL.items()}


def flagship(spark, sf_dir: str):
    return importlib.import_module("tidemark.queries.features").flagship(spark, sf_dir)
