"""Registry of named queries and their DuckDB oracle SQL."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from comparo.session import ship_package

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}

_MODULES = ("q_clean", "q_baseline", "q_features", "q_split", "q_encode", "q_metrics",
            "q_audit", "q_diagnose", "q_model", "q_search", "q_sinks")


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` (oracle optional)."""
    def deco(fn):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn
    return deco


def _load():
    for m in _MODULES:
        try:
            importlib.import_module(f"comparo.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"comparo.plans.{m}":
                raise


def all_queries() -> dict[str, Callable]:
    _load()
    return {name: _shipped(fn) for name, fn in _QUERIES.items()}


def _shipped(fn: Callable) -> Callable:
    """The query, with the package sent to the workers first."""
    @functools.wraps(fn)
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)
    return run


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
