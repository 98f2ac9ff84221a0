"""Readers of what the crawler brings in: fetched pages, seed lists, robots and sitemap bodies."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import robots, url
from ..schema import FETCHED


def fetched_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages (url, html, status, headers, content_type): HTML responses that are no rate limit."""
    d = spark.read.schema(FETCHED).parquet(path)
    html = F.coalesce(F.lower("content_type").contains("text/html"), F.lit(True))
    return d.where(html & (F.coalesce("status", F.lit(200)) != 429) & F.col("html").isNotNull())


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed URLs of a text file as jobs of depth 0: trimmed, blank and ``#`` lines dropped, distinct."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' AND line NOT LIKE '#%'").distinct()
    return lines.select(F.col("line").alias("url"), F.lit(0).alias("depth"), F.lit("seed").alias("source"))


def seeds_changed(spark: SparkSession, path: str, last_hash: str | None) -> tuple[bool, str]:
    """Whether a seed file differs from the last one loaded, and its hash."""
    # order does not matter, repeats do: number of lines and two sums of their hashes, all of fixed size
    lines = spark.read.text(path).select(F.xxhash64("value").cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(1), F.col("value")).cast("decimal(38,0)").alias("b"))
    row = lines.agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    h = "-".join(str(x) for x in row)
    return h != last_hash, h


def submitted(spark: SparkSession, address: str, depth: int = 0, now_ms: int | None = None) -> DataFrame:
    """One URL given by hand, as a job for the front of the queue."""
    now_ms = int(time.time() * 1000) if now_ms is None else now_ms
    return spark.createDataFrame([(address, depth, "manual", now_ms)], "url string, depth int, source string, enqueued_at long").where(url.is_safe(F.col("url")))


def robots_rules(bodies: DataFrame, now_ms: int) -> DataFrame:
    """Rules of robots.txt bodies (domain, body); sites without body have no row."""
    p = bodies.where("body IS NOT NULL").select("domain", robots.parse(F.col("body")).alias("p"))
    return p.select("domain", F.col("p.disallow").alias("rules"), F.col("p.allow").alias("allow_rules"), F.col("p.crawl_delay_ms").alias("crawl_delay"), F.lit(now_ms).alias("fetched_at"))


def sitemap_urls(sitemaps: DataFrame, per_domain: int = 5000) -> DataFrame:
    """(domain, url) of sitemap bodies (domain, xml): page locations, at most ``per_domain`` a site by URL."""
    from pyspark.sql import Window as W

    loc = sitemaps.select("domain", F.explode(robots.sitemap_locations(F.col("xml"))).alias("url")).where(~robots.is_sitemap(F.col("url"))).distinct()
    return loc.withColumn("_n", F.row_number().over(W.partitionBy("domain").orderBy("url"))).where(F.col("_n") <= per_domain).drop("_n")


def candidate_sitemaps(domains: DataFrame, bodies: DataFrame) -> DataFrame:
    """(domain, sitemap) to try: those of robots.txt and the common places, distinct."""
    # Common places of sitemaps.
    common = ("/sitemap.xml", "/sitemap-index.xml", "/sitemap-news.xml", "/sitemap-products.xml", "/sitemap-images.xml", "/sitemap-video.xml")
    named = F.coalesce(robots.sitemaps_of(F.col("body")), F.array().cast("array<string>"))
    places = F.array(*[F.concat(F.lit("https://"), F.col("domain"), F.lit(x)) for x in common])
    own = F.filter(named, lambda u: url.domain_of(u) == F.lower("domain"))
    return domains.join(bodies, "domain", "left").select("domain", F.explode(F.array_union(own, places)).alias("sitemap"))
