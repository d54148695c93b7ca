"""All queries of the library and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = tuple(f"tickloom.plans.{m}" for m in ("market", "results_queries", "trading_queries", "stats_queries", "selection_queries", "text_queries", "live_queries", "more_queries", "surface_queries", "models_queries", "stream_queries", "report_queries"))


def queries() -> dict:
    """Name to function of (spark, sf_dir)."""
    return {k: v for m in MODULES for k, v in import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return {k: v for m in MODULES for k, v in import_module(m).ORACLE.items()}
