"""Whole-pipeline plans: one crawl round and the search entry point."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import html, language, robots, text, url
from ..operators import frontier, index_dml, paging, search
from ..session import materialize


def extract_pages(fetched: DataFrame) -> DataFrame:
    """Page rows (without times) and their links from fetched pages (url, html, depth)."""
    e = fetched.withColumn("e", html.extract(F.col("html")))
    content = F.struct(*[F.col(f"e.{k}").alias(k) for k in ("h1", "h2", "h3", "h4", "h5", "h6", "paragraphs")])
    d = e.withColumn("content", content).withColumn("full", text.full_text(F.col("content")))
    return d.select(
        url.normalize(F.col("url")).alias("url"), url.domain_of(F.col("url")).alias("domain"), F.col("e.title").alias("title"), F.col("e.title").alias("title_autocomplete"),
        F.col("content").withField("full_text", F.col("full")).alias("content"), "e.meta_description", "e.meta_keywords", "e.og_title", "e.og_description", "e.og_image", "depth",
        F.when(html.needs_rendering(F.col("html")), "javascript").otherwise("static").alias("content_type"), text.word_count(F.col("full")).alias("word_count"),
        language.detect(F.col("full")).alias("language"), text.content_hash(F.col("full")).alias("content_hash"),
        frontier.page_links(F.col("e.hrefs"), F.col("url")).alias("links"),
    )


@dataclass
class Round:
    """What a crawl round leaves behind."""

    index: DataFrame
    visited: DataFrame
    queue: DataFrame
    changes: DataFrame


def crawl_round(jobs: DataFrame, fetched: DataFrame, index: DataFrame, visited: DataFrame, rules: DataFrame, now: Column, now_ms: Column) -> Round:
    """One breadth-first round as a plan.

    Jobs are normalized, checked for safety, depth and robots rules, deduplicated and stripped of visited URLs; the
    fetched pages (url, html) of the rest are extracted and merged into the index, and their links become the next
    queue.
    """
    jobs = frontier.usable_jobs(jobs, CONFIG.max_depth)
    jobs = frontier.not_visited(frontier.first_seen(jobs, "enqueued_at"), visited)
    jobs = jobs.join(rules.select(F.col("domain").alias("_d"), "rules", "allow_rules"), jobs["domain"] == F.col("_d"), "left").where(
        robots.is_allowed(F.col("normalized"), F.col("rules"), F.col("allow_rules"))
    )
    got = fetched.select(url.normalize(F.col("url")).alias("normalized"), "html").join(jobs.select("normalized", "depth"), "normalized")
    pages = extract_pages(got.withColumnRenamed("normalized", "url"))
    batch = pages.drop("links")
    changes = index_dml.change_kind(index, batch)
    return Round(
        index_dml.upsert(index, batch, now), frontier.mark_visited(visited, jobs, now_ms), frontier.link_jobs(pages, now_ms), changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))
    )


@dataclass
class Request:
    q: str
    page: int = 1
    limit: int = 10
    domain: str | None = None
    language: str | None = None
    content_type: str | None = None
    sort: str = "relevance"
    order: str = "desc"
    cursor: str | None = None

    def key(self) -> str:
        """Cache key; empty for requests with a cursor, which are never cached."""
        if self.cursor:
            return ""
        from urllib.parse import quote

        names = {"q": self.q, "p": self.page, "l": self.limit, "domain": self.domain, "language": self.language, "contentType": self.content_type, "sort": self.sort, "order": self.order}
        return "|".join(sorted(f"{k}={quote(str(v), safe='')}" for k, v in names.items() if v))


@dataclass
class Searcher:
    """Search and completion over an index of pages, with a cache of answers that expire."""

    pages: DataFrame
    index: search.Index
    ttl_s: float = CONFIG.search_cache_ttl_s
    clock: object = time.monotonic
    cached: dict[str, tuple[float, dict]] = field(default_factory=dict)

    @classmethod
    def build(cls, pages: DataFrame) -> Searcher:
        return cls(pages, search.written_index(search.page_fields(pages), analyzed=True))

    def search(self, r: Request) -> dict:
        """Hits and envelope of a request; a ``ValueError`` without a query."""
        if not r.q:
            raise ValueError("a query is required")
        key = r.key()
        if key and key in self.cached and self.cached[key][0] > self.clock():
            return self.cached[key][1]
        spark: SparkSession = self.pages.sparkSession
        must = [search.score(self.index, search.query_terms(spark, [(0, r.q)], analyzed=True, fuzzy=self.index.terms))]
        if phrase := search.phrase_of(r.q):
            from ..functions.analysis import analyze

            words = spark.createDataFrame([(0, i, t) for i, t in analyze(phrase)], "query long, pos int, term string")
            must.append(search.phrase(self.index, words, search.PHRASE_BOOSTS))
        pages = self.pages
        for name in ("domain", "language", "content_type"):
            if (value := getattr(r, name)) is not None and value != "":
                pages = pages.where(F.col(name) == value)
        # scored once: the count and the rows are both taken from what is written
        found = materialize(search.both(must).select("doc", "score"), "hits")
        hits = found.join(pages, F.col("doc") == F.col("page_id")).drop("doc")
        total = hits.count()
        if r.cursor:
            rows = paging.keyset_page(hits, r.sort, r.order, r.cursor, r.limit)
        else:
            rows = paging.offset_page(hits, paging.order_columns(r.sort, r.order), r.page, r.limit)
        rows = search.highlight(rows.withColumn("asked", F.lit(r.q)).withColumn("body", F.col("content.full_text")), "body", "asked")
        shown = rows.select(
            "url", "title", "domain", text.description(F.col("highlights"), F.col("meta_description"), F.col("og_description")).alias("description"),
            "highlights", "content_type", "word_count", "last_indexed", "score",
        )
        found = [x.asDict() for x in shown.collect()]
        more = len(found) > r.limit if r.cursor else None
        found = found[: r.limit]
        env = paging.envelope(total, r.page, r.limit, found[-1] if found else None, r.sort, keyset=bool(r.cursor), more=more)
        answer = {"results": found, **asdict(env)}
        if key:
            self.cached[key] = (self.clock() + self.ttl_s, answer)
        return answer

    def autocomplete(self, typed: str, limit: int = 5) -> list[dict]:
        return [x.asDict() for x in search.autocomplete(self.index, self.pages.select("page_id", "url", "title"), typed, limit).collect()]
