"""Queues of the crawler as tables: recency, domain slots, front and render queue, reindex queue, sitemaps, processing list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import robots

HOUR_MS = 3_600_000


def recently_visited(jobs: DataFrame, visited: DataFrame, now_ms: Column, hours: int | None = None) -> DataFrame:
    """``jobs`` (normalized) with ``skip``: whether the URL was visited (url, last_indexed in ms) less than ``hours`` ago.

    Never visited URLs and null times are not skipped. The visited table may hold a URL more than once; the latest time counts.
    """
    hours = CONFIG.reindex_after_hours if hours is None else hours
    last = visited.groupBy(F.col("url").alias("_u")).agg(F.max("last_indexed").alias("_t"))
    fresh = F.coalesce(now_ms - F.col("_t") < F.lit(hours * HOUR_MS), F.lit(False))
    return jobs.join(last, jobs["normalized"] == F.col("_u"), "left").withColumn("skip", fresh).drop("_u", "_t")


def unmark_visited(visited: DataFrame, urls: DataFrame) -> DataFrame:
    """``visited`` without the listed URLs, so that they may be crawled again."""
    return visited.join(urls.select("url").distinct(), "url", "left_anti")


def index_full(index: DataFrame, capacity: int | None = None) -> DataFrame:
    """One row (pages, full): whether the index holds ``capacity`` pages or more."""
    capacity = CONFIG.max_indexed_urls if capacity is None else capacity
    return index.agg(F.count(F.lit(1)).alias("pages")).withColumn("full", F.col("pages") >= capacity)


def domain_slots(jobs: DataFrame, at_ms: str, key: str, slots: int | None = None, ttl_ms: int = 30_000) -> DataFrame:
    """``jobs`` (domain) with ``admitted``: at most ``slots`` jobs of a domain within each ``ttl_ms``, the earliest first.

    A slot is held until its window ends. Jobs without a slot stay in the queue; none is lost. Windows keep a large
    domain from being one task.
    """
    slots = CONFIG.domain_concurrency if slots is None else slots
    window = F.floor(F.col(at_ms) / ttl_ms)
    rank = F.row_number().over(W.partitionBy("domain", "_w").orderBy(at_ms, key))
    return jobs.withColumn("_w", window).withColumn("admitted", rank <= slots).drop("_w")


def lookup(index: DataFrame, urls: DataFrame) -> DataFrame:
    """Each URL asked for with the page that has it (``page``, a struct), null if there is none."""
    page = index.select(F.col("url").alias("_u"), F.struct(*index.columns).alias("page"))
    return urls.join(page, urls["url"] == F.col("_u"), "left").drop("_u")


def touch_missing(index: DataFrame, urls: DataFrame) -> DataFrame:
    """URLs to be touched that the index does not hold: errors of a touch."""
    return urls.select("url").distinct().join(index.select("url"), "url", "left_anti")


def with_front(queue: DataFrame, front: DataFrame, order: str) -> DataFrame:
    """``queue`` and ``front`` (same columns) with the place ``seq``: jobs put to the front come before all others, the
    last one put there first, whatever the capacity."""
    return queue.withColumn("seq", F.col(order)).unionByName(front.withColumn("seq", -F.col(order) - 1))


def reindex_enqueue(queue: DataFrame, urls: DataFrame, score: Column) -> DataFrame:
    """``queue`` (url, score) with the URLs that it does not hold yet; queued ones keep their score."""
    new = urls.select("url").distinct().join(queue.select("url"), "url", "left_anti").withColumn("score", score)
    return queue.select("url", "score").unionByName(new)


def reindex_until(queue: DataFrame, cutoff: Column) -> DataFrame:
    """Entries with a score from 0 to the cutoff."""
    return queue.where(F.col("score").between(F.lit(0), cutoff))


def reindex_pop(queue: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """The ``count`` entries of the lowest scores, ties by URL, and the queue without them."""
    popped = queue.orderBy("score", "url").limit(count)
    return popped, queue.join(popped.select("url"), "url", "left_anti")


def undiscovered(jobs: DataFrame, discovered: DataFrame) -> DataFrame:
    """Domains of jobs whose sitemaps were not looked for yet: once per domain."""
    return jobs.select("domain").where("domain IS NOT NULL").distinct().join(discovered.select("domain"), "domain", "left_anti")


def sitemap_jobs(locations: DataFrame, now_ms: Column, seeded: bool = False) -> DataFrame:
    """Jobs of sitemap locations (domain, url): depth 1 and source ``link``, or depth 0 and ``seed`` from the seed loader."""
    depth, source = (0, "seed") if seeded else (1, "link")
    return locations.select("domain", "url", F.lit(depth).alias("depth"), F.lit(source).alias("source"), now_ms.cast("long").alias("enqueued_at"))


def sitemap_waves(children: DataFrame, start: DataFrame, depth: int | None = None, width: int | None = None, pending: int | None = None) -> DataFrame:
    """(domain, sitemap, wave): sitemaps fetched per domain, following child sitemaps (sitemap, child) of those fetched.

    ``start`` has domain and sitemap. Each wave takes the first ``width`` pending sitemaps of a domain by name; their
    children that were neither fetched nor are pending join the pending ones, ``pending`` at most. ``depth`` waves. A
    site's list is bounded by ``pending``, so windows over a domain are small.
    """
    depth = CONFIG.sitemap_max_depth if depth is None else depth
    width = CONFIG.sitemap_max_concurrent if width is None else width
    pending = CONFIG.sitemap_max_pending if pending is None else pending

    def ranked(x: DataFrame) -> DataFrame:
        return x.withColumn("_r", F.row_number().over(W.partitionBy("domain").orderBy("sitemap")))

    waiting = ranked(start.select("domain", "sitemap").distinct()).where(F.col("_r") <= pending).drop("_r")
    done = None
    for wave in range(depth):
        order = ranked(waiting)
        now = order.where(F.col("_r") <= width).select("domain", "sitemap", F.lit(wave).alias("wave"))
        done = now if done is None else done.unionByName(now)
        rest = order.where(F.col("_r") > width).select("domain", "sitemap")
        found = now.join(children, "sitemap").select("domain", F.col("child").alias("sitemap")).distinct()
        found = found.join(done.select("domain", "sitemap"), ["domain", "sitemap"], "left_anti")
        waiting = ranked(rest.unionByName(found).distinct()).where(F.col("_r") <= pending).drop("_r")
    return done


def to_processing(queue: DataFrame, order: str, count: int) -> tuple[DataFrame, DataFrame]:
    """(taken, left): the first ``count`` jobs move to the processing list, from which :func:`recover` brings back what
    a lost worker held."""
    taken = queue.orderBy(order).limit(count)
    return taken, queue.join(taken.select(order), order, "left_anti")


def recover(queue: DataFrame, processing: DataFrame, finished: DataFrame, order: str) -> DataFrame:
    """``queue`` with the jobs of the processing list that were not finished."""
    return queue.unionByName(processing.join(finished.select(order), order, "left_anti"))


def truncated(queues: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every queue without rows, with its schema."""
    return {name: df.where(F.lit(False)) for name, df in queues.items()}


def worker_snapshots(jobs: DataFrame, at_ms: str, every_ms: int = 30_000) -> DataFrame:
    """(window_ms, processed, domains, deepest): what the workers did in each span of ``every_ms``."""
    window = (F.floor(F.col(at_ms) / every_ms) * every_ms).cast("long")
    return jobs.groupBy(window.alias("window_ms")).agg(F.count(F.lit(1)).alias("processed"), F.count_distinct("domain").alias("domains"), F.max("depth").alias("deepest"))


def robots_sitemaps(bodies: DataFrame) -> DataFrame:
    """(domain, sitemap) of the ``Sitemap:`` lines of robots.txt bodies (domain, body)."""
    return bodies.select("domain", F.explode(robots.sitemaps_of(F.col("body"))).alias("sitemap")).distinct()
