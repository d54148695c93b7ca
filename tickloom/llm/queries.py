"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("suffix_dedup", "topk_index", "decontamination", "ngram_join", "line_dedup", "language_id", "warc", "mixing", "token_scan", "chat", "url_rules", "prefix_trie", "filter_audit")


def queries() -> dict:
    """Name to function of (spark, sf_dir), for every operator here."""
    return {k: v for m in MODULES for k, v in import_module(f".{m}", __package__).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL, for the queries that SQL can express."""
    return {k: v for m in MODULES for k, v in getattr(import_module(f".{m}", __package__), "ORACLE", {}).items()}
