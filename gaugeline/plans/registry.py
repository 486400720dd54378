"""Every query by name, with its oracle where SQL expresses it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("evaluation", "summaries", "fusing", "merging", "texts", "checks", "formats", "validation", "auditing", "labels", "roundtrips", "shapes", "scans")
_queries: dict[str, Callable] = {}
_oracles: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def keep(f):
        _queries[f.__name__] = f
        if oracle:
            _oracles[f.__name__] = oracle
        return f

    return keep


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"gaugeline.plans.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
