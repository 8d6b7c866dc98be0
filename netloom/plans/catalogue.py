"""All queries of the library by name, with the SQL that they are checked against."""

from __future__ import annotations

import importlib

from netloom.plans.registry import ORACLE, QUERIES

AREAS = ("hyper", "graphs", "space", "clocks", "nets", "series", "columns", "partitions", "streams", "files", "structure", "signals", "solvers")


def load() -> tuple[dict, dict]:
    for area in AREAS:
        importlib.import_module(f"netloom.plans.{area}")
    return dict(QUERIES), dict(ORACLE)
