"""Registered queries: each pairs a Spark plan with the ANSI SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, views: str = "", oracle: str | None = None):
    """Register ``fn(views) -> DataFrame`` and, when SQL can say it, its oracle."""

    def register(fn: Callable[[Views], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if oracle is not None:
            ORACLES[key] = with_views(views, oracle)
        return fn

    return register


def load_all() -> None:
    from . import (  # noqa: F401
        answer_queries, check_queries, evidence_queries, feature_queries, file_queries, grid_queries, scoring_queries,
        selection_queries, source_queries, stream_queries, telemetry_queries,
    )
