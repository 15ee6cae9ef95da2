"""Binding of the operators to the driver tables, with an independent DuckDB query for each."""

from __future__ import annotations

import importlib

from workload import common

_MODULES = ("text", "skills", "classify", "dedup", "profiles", "scoring", "ranking", "web", "ingest")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"workload.{name}")


def registered_queries():
    _load()
    return dict(common.QUERIES)


def registered_oracles():
    _load()
    return dict(common.ORACLES)
