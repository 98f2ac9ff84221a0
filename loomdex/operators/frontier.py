"""The crawl frontier as set operations: visited check, capacity, depth, links, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import schedule, url

#: rows ranked by one task when the first n of a queue are taken
QUEUE_BLOCK = 65_536
#: span in which a domain's requests are ordered by one task
HOUR_MS = 3_600_000


def usable_jobs(jobs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Jobs with a normalized, safe URL and a depth within the limit; ``normalized`` and ``domain`` added."""
    n = jobs.withColumn("normalized", url.normalize(F.col("url"))).where("normalized IS NOT NULL")
    n = n.withColumn("domain", url.domain_of(F.col("normalized"))).where(url.is_safe(F.col("normalized")) & (F.col("domain") != ""))
    return n if max_depth is None else n.where(F.col("depth") <= max_depth)


def first_seen(jobs: DataFrame, order: str) -> DataFrame:
    """The first job of each normalized URL by ``order``; struct minimum, so hot URLs combine map-side."""
    rest = [c for c in jobs.columns if c not in ("normalized", order)]
    best = jobs.groupBy("normalized").agg(F.min(F.struct(order, *rest)).alias("_r"))
    return best.select("normalized", *[F.col(f"_r.{c}").alias(c) for c in (order, *rest)])


def not_visited(jobs: DataFrame, visited: DataFrame) -> DataFrame:
    """Jobs whose normalized URL is not in ``visited`` (url)."""
    return jobs.join(visited.select(F.col("url").alias("normalized")), "normalized", "left_anti")


def mark_visited(visited: DataFrame, jobs: DataFrame, now_ms: Column) -> DataFrame:
    """``visited`` (url, last_indexed) with the jobs' URLs added or renewed."""
    fresh = jobs.select(F.col("normalized").alias("url"), now_ms.cast("long").alias("last_indexed"))
    return visited.select("url", "last_indexed").unionByName(fresh).groupBy("url").agg(F.max("last_indexed").alias("last_indexed"))


def accept(jobs: DataFrame, order: str, queued: int, capacity: int | None = None) -> DataFrame:
    """``jobs`` with ``accepted``: the first ``capacity - queued`` by ``order`` (a unique BIGINT) fit in the queue.

    Blocks of consecutive order values are counted first and summed over the small block table, so only the block in
    which the queue fills up is ranked; no global sort. ``queued`` beyond the capacity accepts nothing.
    """
    room = max(0, (CONFIG.max_queue_size if capacity is None else capacity) - queued)
    block = F.floor(F.col(order) / QUEUE_BLOCK)
    blocks = jobs.groupBy(block.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    # blocks are summed over blocks of blocks, so that each window is as short as one block's rows
    span = F.floor(F.col("_b") / QUEUE_BLOCK)
    spans = blocks.groupBy(span.alias("_s")).agg(F.sum("_n").alias("_sn"))
    earlier = spans.select("_s", F.coalesce(F.sum("_sn").over(W.orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_sb"))
    within = F.coalesce(F.sum("_n").over(W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("_s", span).withColumn("_w", within).join(earlier, "_s").select("_b", (F.col("_sb") + F.col("_w")).alias("_before"))
    ranked = jobs.withColumn("_b", block).join(starts, "_b").withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy(order)))
    return ranked.withColumn("accepted", F.col("_before") + F.col("_r") <= room).drop("_b", "_before", "_r")


def link_jobs(pages: DataFrame, now_ms: Column, max_depth: int | None = None, most: int | None = None) -> DataFrame:
    """Jobs of the links of crawled pages (url, depth, links): depth + 1, source ``link``; at most ``most`` a page."""
    deep = CONFIG.max_depth if max_depth is None else max_depth
    most = CONFIG.max_links_per_page if most is None else most
    return (
        pages.where((F.col("depth") < deep) & (F.size("links") > 0))
        .select((F.col("depth") + 1).alias("depth"), F.explode(F.slice("links", 1, most)).alias("url"))
        .select("url", "depth", F.lit("link").alias("source"), now_ms.cast("long").alias("enqueued_at"))
    )


def page_links(hrefs: Column, base: Column, most: int | None = None) -> Column:
    """Links of a page in crawl order from its href values.

    Resolved, valid, not blocked, normalized and distinct (first wins); links of the page's own host come first, in
    reverse document order, then the others in document order; at most ``most``.
    """
    most = CONFIG.max_links_per_page if most is None else most
    resolved = F.transform(hrefs, lambda h: url.resolve(base, h))
    good = F.filter(resolved, lambda u: u.isNotNull() & ~url.is_blocked_link(u))
    normal = F.array_distinct(F.filter(F.transform(good, url.normalize), lambda u: u.isNotNull() & ~url.is_blocked_link(u)))
    sited = F.transform(normal, lambda u: F.struct(u.alias("u"), url.domain_of(u).alias("d")))

    def ordered(x: Column) -> Column:
        links, home = x["links"], x["home"]
        own = F.reverse(F.filter(links, lambda y: y["d"] == home))
        return F.slice(F.transform(F.concat(own, F.filter(links, lambda y: y["d"] != home)), lambda y: y["u"]), 1, most)

    return url.let(F.struct(sited.alias("links"), url.domain_of(base).alias("home")), ordered)


def due_retries(retries: DataFrame, now_ms: Column) -> DataFrame:
    """Retry jobs that are due, as crawl jobs of depth 0; popped once (the caller keeps the rest)."""
    return retries.where(F.col("due_at") <= now_ms).select(
        "retry_id", "url", F.lit(0).alias("depth"), F.lit("retry").alias("source"), now_ms.cast("long").alias("enqueued_at"), "attempt", "max_attempts"
    )


def schedule_retries(jobs: DataFrame, now_ms: Column, zero_based: bool = False) -> DataFrame:
    """Failed jobs (url, attempt, max_attempts) with the time at which they are due."""
    return jobs.withColumn("due_at", now_ms + schedule.retry_delay_ms(F.col("attempt"), zero_based=zero_based))


def rate_gaps(requests: DataFrame, domain: str, at_ms: str, delay_ms: int | None = None) -> DataFrame:
    """Each request with the gap to its domain's previous one and the wait that the minimum gap asks for."""
    delay = CONFIG.domain_delay_ms if delay_ms is None else delay_ms
    # within an hour of a domain by window; the first request of an hour looks at the last one of the domain's
    # earlier hours, so that no task holds all of a large domain
    hours = requests.groupBy(F.col(domain).alias("_d"), F.floor(F.col(at_ms) / HOUR_MS).alias("_h")).agg(F.max(at_ms).alias("_last"))
    before = hours.select("_d", "_h", F.lag("_last").over(W.partitionBy("_d").orderBy("_h")).alias("_before"))
    requests = requests.withColumn("_hour", F.floor(F.col(at_ms) / HOUR_MS)).join(before, F.col(domain).eqNullSafe(F.col("_d")) & (F.col("_hour") == F.col("_h")))
    last = F.coalesce(F.lag(at_ms).over(W.partitionBy(domain, "_hour").orderBy(at_ms)), F.col("_before"))
    requests = requests.withColumn("_gap", F.col(at_ms) - last)
    gap = F.col("_gap")
    return requests.withColumn("gap_ms", gap).withColumn("wait_ms", F.greatest(F.lit(0), F.lit(delay) - F.coalesce(gap, F.lit(delay))).cast("long")).drop("_gap", "_hour", "_h", "_d", "_before")
