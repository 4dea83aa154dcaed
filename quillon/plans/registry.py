"""All queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) under its name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = Query(f, sql)
        return f

    return add


# the modules register their queries
from . import case_queries, evaluation_queries, evidence_queries, interval_queries, ranking_queries, series_queries, source_queries, streaming_queries, text_queries  # noqa: E402, F401
