"""All registered queries of the core engine and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .catalog import content, crawl, queues, search, streams, urls

_PARTS = [urls, content, crawl, queues, search, streams]

QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
SQL = {k: q for part in _PARTS for k, q in part.SQL.items()}


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship query."""
    return QUERIES["bm25_single_field"](spark, sf)
