"""All queries by name, and the SQL that checks them."""

from __future__ import annotations

import importlib
import pkgutil

from . import operators, plans, streaming


def _modules():
    for package in (operators, plans, streaming):
        for found in pkgutil.iter_modules(package.__path__, package.__name__ + "."):
            yield importlib.import_module(found.name)


def all_queries() -> dict:
    return {name: query for module in _modules() for name, (query, _) in getattr(module, "QUERIES", {}).items()}


def all_sql() -> dict:
    return {name: sql for module in _modules() for name, (_, sql) in getattr(module, "QUERIES", {}).items() if sql}
