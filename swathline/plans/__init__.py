"""Registered queries by theme, each with SQL for the comparison where SQL can express it."""

from __future__ import annotations

import importlib

THEMES = ("scalars", "aggregates", "windows", "joins", "searches", "scores", "documents", "objectives", "routes", "polygons", "files", "partitions", "flights")


def _themes():
    return [importlib.import_module(f"{__name__}.{t}") for t in THEMES]


def all_queries() -> dict:
    return {k: f for t in _themes() for k, f in t.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {k: sql for t in _themes() for k, sql in t.ORACLE.items()}
