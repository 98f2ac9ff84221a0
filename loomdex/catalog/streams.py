"""Streaming queries, run over the tables as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import language
from ..session import table
from ..streaming import frontier


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """STR-4, STR-7, SRC-9: the URLs that a first-wins stream lets through."""
    return frontier.run_available(frontier.unseen(frontier.table_stream(spark, sf, "crawl_jobs")).select("normalized"))


def stream_token_bucket(spark: SparkSession, sf: str) -> DataFrame:
    """STR-1: requests of each event type that a bucket of two tokens, one each half hour, lets through."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    events = frontier.table_stream(spark, sf, "events").withColumn("at_ms", ms)
    passed = frontier.run_available(frontier.token_bucket(events, "event_type", "at_ms", 1 / 1800, 2.0))
    return passed.groupBy(F.col("key").alias("event_type")).agg(F.count(F.lit(1)).alias("requests"), F.sum(F.col("passed").cast("int")).alias("passed"))


def stream_domain_gap(spark: SparkSession, sf: str) -> DataFrame:
    """STR-2: start times of a user's requests, at least a minute apart."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    events = frontier.table_stream(spark, sf, "events").withColumn("at_ms", ms)
    return frontier.run_available(frontier.spaced(events, "user_id", "at_ms", 60_000))


def stream_retry_timers(spark: SparkSession, sf: str) -> DataFrame:
    """STR-5, STR-12: retries released when their time has come."""
    return frontier.run_available(frontier.released_retries(frontier.table_stream(spark, sf, "retry_jobs")))


def language_detect(spark: SparkSession, sf: str) -> DataFrame:
    """FN-H5: language of each document by its first characters, in both code systems."""
    code = language.detect(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", code.alias("iso3"), language.iso1(code).alias("iso1"))


QUERIES = {f.__name__: f for f in (stream_dedup, stream_token_bucket, stream_domain_gap, stream_retry_timers, language_detect)}

from .urls import _NORMAL, _parts  # noqa: E402

SQL = {
    "stream_dedup": f"WITH {_parts('crawl_jobs', 'job_id')} SELECT DISTINCT {_NORMAL} AS normalized FROM c WHERE {_NORMAL} IS NOT NULL",
    "stream_domain_gap": """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) // 1000 AS "at", row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000) AS i FROM events)
        SELECT key, "at", i * 60000 + max("at" - i * 60000) OVER (PARTITION BY key ORDER BY i) AS start FROM r""",
    "stream_retry_timers": """WITH w AS (SELECT max(enqueued_at) - 3600000 AS t FROM retry_jobs), d AS (SELECT url, max(due_at) AS due_at FROM retry_jobs GROUP BY url) SELECT url, due_at FROM d, w WHERE due_at <= t""",
}
