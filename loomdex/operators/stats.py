"""Statistics of the index and the queues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP_DOMAINS = 20
TOP_TYPES = 10
SPEED_PAGES = 1000
RECENT_PAGES = 10


def terms(index: DataFrame, field: str, size: int) -> DataFrame:
    """The ``size`` most frequent values of a field, ties by value; nulls do not count."""
    return index.where(F.col(field).isNotNull()).groupBy(field).agg(F.count(F.lit(1)).alias("doc_count")).orderBy(F.desc("doc_count"), field).limit(size)


def crawl_speed(index: DataFrame, size: int = SPEED_PAGES) -> DataFrame:
    """Pages a minute and an hour over the ``size`` oldest pages; 0 for fewer than two or no time between them."""
    old = index.where("last_indexed IS NOT NULL").orderBy("last_indexed", "url").limit(size)
    ms = lambda c: F.unix_micros(c.cast("timestamp")) / 1000
    a = old.agg(F.count(F.lit(1)).alias("pages"), F.min(ms(F.col("last_indexed"))).alias("a"), F.max(ms(F.col("last_indexed"))).alias("b"))
    minutes = (F.col("b") - F.col("a")) / 60_000

    def rate(unit: float) -> Column:
        return F.when((F.col("pages") < 2) | (minutes <= 0) | minutes.isNull(), F.lit(0.0)).otherwise(F.round(F.col("pages") / (minutes / unit), 2))

    return a.select("pages", rate(1.0).alias("per_minute"), rate(60.0).alias("per_hour"))


def recent(index: DataFrame, size: int = RECENT_PAGES) -> DataFrame:
    """The latest pages: title cut to 50 and URL to 60 characters, ISO time."""
    top = index.orderBy(F.desc("last_indexed"), "url").limit(size)
    return top.select(F.substring("title", 1, 50).alias("title"), F.substring("url", 1, 60).alias("url"), F.date_format("last_indexed", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"))


def queue_lengths(queues: dict[str, DataFrame]) -> DataFrame:
    """Rows of each queue table."""
    out = None
    for name, df in queues.items():
        one = df.agg(F.count(F.lit(1)).alias("length")).select(F.lit(name).alias("queue"), "length")
        out = one if out is None else out.unionByName(one)
    return out


def index_size(index: DataFrame) -> DataFrame:
    """Pages and bytes of their text, in MB and GB."""
    n = F.coalesce(F.sum(F.octet_length("content.full_text")), F.lit(0))
    return index.agg(F.count(F.lit(1)).alias("pages"), n.alias("bytes")).withColumns(
        {"mb": F.round(F.col("bytes") / 1048576.0, 2), "gb": F.round(F.col("bytes") / 1073741824.0, 2)}
    )


def stats(name: str, index: DataFrame, queues: dict[str, DataFrame]) -> DataFrame:
    """One statistic by name: indexed, queues, domains, recent, speed, content-type, size."""
    known: dict[str, Callable[[], DataFrame]] = {
        "indexed": lambda: index.agg(F.count(F.lit(1)).alias("pages")),
        "queues": lambda: queue_lengths(queues),
        "domains": lambda: terms(index, "domain", TOP_DOMAINS),
        "recent": lambda: recent(index),
        "speed": lambda: crawl_speed(index),
        "content-type": lambda: terms(index, "content_type", TOP_TYPES),
        "size": lambda: index_size(index),
    }
    if name not in known:
        raise ValueError(f"unknown statistic {name!r}; known: {', '.join(known)}")
    return known[name]()
