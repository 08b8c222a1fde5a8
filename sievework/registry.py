"""All registered queries of the library, and the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ["metric_queries", "text_queries", "data_queries", "io_queries", "scoring_queries", "build_queries", "training_queries"]


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        each = getattr(import_module(f"sievework.plans.{m}"), name)
        if twice := sorted(set(out) & set(each)):
            raise ValueError(f"registered twice: {', '.join(twice)}")
        out |= each
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
