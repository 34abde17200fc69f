"""All registered queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelake.plans import (
    frontier_queries,
    media_queries,
    page_queries,
    record_queries,
    stat_queries,
    text_queries,
)

_MODULES = [
    page_queries,
    text_queries,
    frontier_queries,
    media_queries,
    record_queries,
    stat_queries,
]

Query = Callable[[SparkSession, str], DataFrame]


def _in_utc(query: Query) -> Query:
    """The test tables hold times without a zone; both engines read them as UTC."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf)

    return run


def queries() -> dict[str, Query]:
    return {name: _in_utc(q) for m in _MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
