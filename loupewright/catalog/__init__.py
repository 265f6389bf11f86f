"""Queries on the driver's tables, each with an independent DuckDB statement."""

from __future__ import annotations

import importlib

_MODULES = (
    "basics", "joining", "summing", "changing", "metering", "orders", "materials", "quality", "upkeep",
)


def _load():
    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.registry")


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
