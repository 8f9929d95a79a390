"""The registered queries of the library and the SQL they are held against."""

from __future__ import annotations

import importlib
import pkgutil


def gather(package: str) -> tuple[dict, dict]:
    """QUERIES and SQL of all modules of a package."""
    queries, sql = {}, {}
    for info in pkgutil.iter_modules(importlib.import_module(package).__path__):
        module = importlib.import_module(f"{package}.{info.name}")
        queries |= getattr(module, "QUERIES", {})
        sql |= getattr(module, "SQL", {})
    return queries, sql
