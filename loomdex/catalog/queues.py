"""Queue, sitemap and lookup queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frontier, queues
from ..session import table
from ..sources import readers
from .content import _index
from .crawl import _J, _P, NOW_MS, _jobs

_DAY = 86_400_000


def _visited(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.floor(F.unix_micros(F.col("last_indexed").cast("timestamp")) / 1000).cast("long")
    return _index(spark, sf).select("url", ms.alias("last_indexed"))


def recency_skip(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-18: jobs and whether their URL was visited less than 2,000 hours before."""
    got = queues.recently_visited(_jobs(spark, sf), _visited(spark, sf), F.lit(NOW_MS), 2000)
    return got.select("job_id", "normalized", "skip")


def visited_removed(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-11: the visited table without the URLs of retried jobs."""
    return queues.unmark_visited(_visited(spark, sf), table(spark, sf, "retry_jobs").select("url"))


def index_capacity(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-21: whether the index is full, at 5,000,000 pages."""
    return queues.index_full(_index(spark, sf))


def domain_concurrency(spark: SparkSession, sf: str) -> DataFrame:
    """STR-3: jobs that get one of two slots of their domain within 30 seconds (here: an hour, as the log is sparse)."""
    return queues.domain_slots(_jobs(spark, sf), "enqueued_at", "job_id", ttl_ms=3_600_000).select("job_id", "domain", "admitted")


def page_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-8: the page of each search hit's URL by key, null if it is not indexed."""
    hits = table(spark, sf, "search_hits").select("hit_id", "url").where("hit_id IS NOT NULL").distinct()
    return queues.lookup(_index(spark, sf).select("url", "page_id", "title"), hits).select("hit_id", "page.page_id", "page.title")


def touch_errors(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-3: URLs of hits that cannot be touched, as the index does not hold them."""
    return queues.touch_missing(_index(spark, sf), table(spark, sf, "search_hits").where("url IS NOT NULL"))


def front_queue(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-6, ORD-12: the queue after all due retries were put to its front."""
    queue = table(spark, sf, "crawl_jobs").distinct().select(F.col("job_id").alias("id"), "url")
    front = table(spark, sf, "retry_jobs").where(F.col("due_at") <= NOW_MS).select(F.col("retry_id").alias("id"), "url").distinct()
    return queues.with_front(queue, front, "id")


def render_queue(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-10: JavaScript pages that fit into a render queue of 5,000 places that holds 4,900 jobs."""
    pages = _index(spark, sf).where("content_type = 'javascript'").select("page_id", "url")
    return frontier.accept(pages, "page_id", 4_900, 5_000).select("page_id", "accepted")


def reindex_queue(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-9, JOIN-5: the reindex queue after pages older than 100 days join it; queued URLs keep their score."""
    queue = table(spark, sf, "retry_jobs").where("url IS NOT NULL").groupBy("url").agg(F.min("due_at").alias("score"))
    old = _visited(spark, sf).where(F.col("last_indexed") <= NOW_MS - 100 * _DAY)
    return queues.reindex_enqueue(queue, old, F.lit(NOW_MS).cast("long"))


def reindex_range(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-3: visited URLs with a time up to 100 days ago."""
    return queues.reindex_until(_visited(spark, sf).withColumnRenamed("last_indexed", "score"), F.lit(NOW_MS - 100 * _DAY))


def reindex_popped(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-12: the 50 entries of the lowest score."""
    return queues.reindex_pop(_visited(spark, sf).withColumnRenamed("last_indexed", "score"), 50)[0]


def sitemap_discovery(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-4, STR-13: domains of jobs whose sitemaps were not looked for yet; sites with robots rules were."""
    return queues.undiscovered(_jobs(spark, sf), table(spark, sf, "robots_rules").select("domain").distinct())


def sitemap_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-5, SET-2, FN-R3: sitemaps to try for each site: one named in its robots.txt and the common places."""
    r = table(spark, sf, "robots_rules").select("domain").distinct()
    body = F.concat(F.lit("User-agent: *\nSitemap: https://"), F.col("domain"), F.lit("/Maps/Main.xml\nsitemap: https://elsewhere.test/s.xml"))
    return readers.candidate_sitemaps(r, r.withColumn("body", body))


def _sitemaps(spark: SparkSession, sf: str) -> DataFrame:
    """Sitemap bodies of a site, each of the pages of one block of ids, so that none grows with the site."""
    pages = _index(spark, sf).select("domain", "url", F.shiftright("page_id", 10).alias("block"))
    return pages.groupBy("domain", "block").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(F.concat(F.lit("<url><loc> "), F.col("url"), F.lit(" </loc></url>"))), ""), F.lit("</urlset>")).alias("xml"))


def sitemap_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-8, ORD-11: jobs of the locations in each site's sitemaps, 20 a site."""
    return queues.sitemap_jobs(readers.sitemap_urls(_sitemaps(spark, sf), 20), F.lit(NOW_MS))


def sitemap_waves(spark: SparkSession, sf: str) -> DataFrame:
    """SET-4, ORD-11: sitemaps fetched in three waves of three; a sitemap n of a site names 2n and 2n + 1 (made up)."""
    sites = table(spark, sf, "robots_rules").select("domain").distinct()
    name = lambda n: F.concat(F.lit("https://"), F.col("domain"), F.lit("/sitemap-"), F.format_string("%03d", n), F.lit(".xml"))
    tree = sites.select("domain", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("n"))
    children = tree.select(name(F.col("n")).alias("sitemap"), F.explode(F.array(name(F.col("n") * 2), name(F.col("n") * 2 + 1))).alias("child"))
    return queues.sitemap_waves(children, sites.select("domain", name(F.lit(1)).alias("sitemap")))


def processing_recovered(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-13, SNK-12: the queue after 100 jobs were taken and those with an even id not finished."""
    jobs = table(spark, sf, "crawl_jobs").distinct().select("job_id", "url")
    taken, left = queues.to_processing(jobs, "job_id", 100)
    return queues.recover(left, taken, taken.where("job_id % 2 = 1"), "job_id")


def queues_truncated(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-13: lengths of all queues after truncation."""
    from ..operators.stats import queue_lengths

    every = {name: table(spark, sf, name) for name in ("crawl_jobs", "retry_jobs", "robots_rules")}
    return queue_lengths(queues.truncated(every))


def seed_domains(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-9: distinct domains of the seeds."""
    return _jobs(spark, sf).where("source = 'seed'").select("domain").distinct()


def worker_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-13: jobs, domains and depth of each half hour."""
    return queues.worker_snapshots(_jobs(spark, sf), "enqueued_at", 1_800_000)


QUERIES = {
    f.__name__: f
    for f in (
        recency_skip, visited_removed, index_capacity, domain_concurrency, page_lookup, touch_errors, front_queue, render_queue, reindex_queue, reindex_range, reindex_popped,
        sitemap_discovery, sitemap_candidates, sitemap_jobs, sitemap_waves, processing_recovered, queues_truncated, seed_domains, worker_snapshots,
    )
}

_V = f"(SELECT url, epoch_us(last_indexed) // 1000 AS t FROM {_P})"
_OLD = NOW_MS - 100 * _DAY

SQL = {
    "recency_skip": _J + f", v AS (SELECT url, max(t) AS t FROM {_V} GROUP BY url) SELECT job_id, normalized, coalesce({NOW_MS} - t < 7200000000, false) AS skip FROM j LEFT JOIN v ON v.url = normalized",
    "visited_removed": f"SELECT url, t AS last_indexed FROM {_V} WHERE url NOT IN (SELECT url FROM retry_jobs WHERE url IS NOT NULL)",
    "index_capacity": f"SELECT count(*) AS pages, count(*) >= 5000000 AS full FROM {_P}",
    "domain_concurrency": _J + " SELECT job_id, h AS domain, row_number() OVER (PARTITION BY h, enqueued_at // 3600000 ORDER BY enqueued_at, job_id) <= 2 AS admitted FROM j",
    "page_lookup": f"SELECT hit_id, page_id, p.title FROM (SELECT DISTINCT hit_id, url FROM search_hits WHERE hit_id IS NOT NULL) AS h LEFT JOIN {_P} AS p USING (url)",
    "touch_errors": f"SELECT DISTINCT url FROM search_hits WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM {_P})",
    "front_queue": f"SELECT DISTINCT job_id AS id, url, job_id AS seq FROM crawl_jobs UNION ALL SELECT DISTINCT retry_id, url, -retry_id - 1 FROM retry_jobs WHERE due_at <= {NOW_MS}",
    "render_queue": f"SELECT page_id, row_number() OVER (ORDER BY page_id) <= 100 AS accepted FROM {_P} WHERE content_type = 'javascript'",
    "reindex_queue": f"WITH q AS (SELECT url, min(due_at) AS score FROM retry_jobs WHERE url IS NOT NULL GROUP BY url) SELECT * FROM q UNION ALL SELECT DISTINCT url, {NOW_MS} FROM {_V} WHERE t <= {_OLD} AND url NOT IN (SELECT url FROM q)",
    "reindex_range": f"SELECT url, t AS score FROM {_V} WHERE t BETWEEN 0 AND {_OLD}",
    "reindex_popped": f"SELECT url, t AS score FROM {_V} ORDER BY t NULLS FIRST, url LIMIT 50",
    "sitemap_discovery": _J + " SELECT DISTINCT h AS domain FROM j WHERE h NOT IN (SELECT domain FROM robots_rules)",
    "sitemap_candidates": """SELECT DISTINCT domain, 'https://' || domain || p AS sitemap FROM robots_rules,
        unnest(['/Maps/Main.xml', '/sitemap.xml', '/sitemap-index.xml', '/sitemap-news.xml', '/sitemap-products.xml', '/sitemap-images.xml', '/sitemap-video.xml']) AS x(p)""",
    "sitemap_jobs": f"""WITH r AS (SELECT domain, url, row_number() OVER (PARTITION BY domain ORDER BY url) AS n FROM (SELECT DISTINCT domain, url FROM {_P}) WHERE NOT regexp_matches(url, '(?i)/sitemap[\\w-]*\\.\\w+(\\.gz)?$'))
        SELECT domain, url, 1 AS depth, 'link' AS source, {NOW_MS} AS enqueued_at FROM r WHERE n <= 20""",
    "sitemap_waves": """SELECT DISTINCT domain, 'https://' || domain || '/sitemap-' || lpad(CAST(n AS VARCHAR), 3, '0') || '.xml' AS sitemap, wave
        FROM robots_rules, (VALUES (1, 0), (2, 1), (3, 1), (4, 2), (5, 2), (6, 2)) AS w(n, wave)""",
    "processing_recovered": """WITH j AS (SELECT DISTINCT * FROM crawl_jobs), r AS (SELECT job_id, url, row_number() OVER (ORDER BY job_id) AS n FROM j) SELECT job_id, url FROM r WHERE n > 100 OR job_id % 2 = 0""",
    "queues_truncated": "SELECT q AS queue, 0 AS length FROM (VALUES ('crawl_jobs'), ('retry_jobs'), ('robots_rules')) AS x(q)",
    "seed_domains": _J + " SELECT DISTINCT h AS domain FROM j WHERE source = 'seed'",
    "worker_snapshots": _J + " SELECT enqueued_at // 1800000 * 1800000 AS window_ms, count(*) AS processed, count(DISTINCT h) AS domains, max(depth) AS deepest FROM j GROUP BY 1",
}
