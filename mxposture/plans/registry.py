"""Registry of runnable queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mxposture.plans.adapters import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query; ``sql`` (over tables and adapter views) is its check."""

    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def load_all() -> None:
    # Later modules read adapter views of earlier ones.
    from mxposture.plans import (  # noqa: F401, I001
        flow_queries,
        finding_queries,
        handshake_queries,
        session_queries,
        certificate_queries,
        rule_queries,
        detector_queries,
        report_queries,
        text_queries,
        stream_queries,
    )
