"""Query registry shared by the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
SURVEY_IDS: dict[str, str] = {}


def register(name: str, ids: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``ids`` lists the survey operator ids it covers."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        SURVEY_IDS[name] = ids
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every plan module so their queries register."""
    from panelkit.plans import (  # noqa: F401
        curves,
        encoding,
        equation_fits,
        importances,
        io,
        mixed_models,
        modeling,
        results,
        scoring,
        screening,
        splits,
        stats,
    )
