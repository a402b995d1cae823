"""Registered queries, each with the SQL that checks it where SQL can."""

from __future__ import annotations

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` under ``name``."""
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return run
    return add


def load() -> None:
    from dossier.plans.catalog import (  # noqa: F401
        activity, classify, pairs, profiles, roundtrip, spans, stored, text)
