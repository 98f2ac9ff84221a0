"""Frontier, retry, rate and page-source queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, schedule, text, url
from ..operators import frontier
from ..session import materialize, table
from .content import _index
from .urls import _NORMAL, _SAFE, _parts

NOW_MS = 1_730_000_000_000


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Frontier log, doubled rows once, usable jobs only."""
    return frontier.usable_jobs(table(spark, sf, "crawl_jobs").distinct(), 5)


def frontier_usable(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-9, FLT-26: jobs that are safe, valid and not too deep."""
    return _jobs(spark, sf).select("job_id", "normalized", "domain", "depth")


def visited_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-2, JOIN-3, SET-3, STR-4: first job of each URL that the index does not hold."""
    first = frontier.first_seen(_jobs(spark, sf), "job_id")
    visited = _index(spark, sf).select(url.normalize(F.col("url")).alias("url")).distinct()
    return frontier.not_visited(first, visited).select("job_id", "normalized", "depth")


def visited_marks(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-11: visited table after the jobs are marked, newest time of each URL."""
    visited = _index(spark, sf).select("url", F.floor(F.unix_micros(F.col("last_indexed").cast("timestamp")) / 1000).cast("long").alias("last_indexed"))
    return frontier.mark_visited(visited, _jobs(spark, sf), F.lit(NOW_MS))


def frontier_capacity(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-5, SNK-7, AGG-11: jobs queued and skipped in arrival order when 1,000 places are left."""
    jobs = table(spark, sf, "crawl_jobs").distinct()
    return frontier.accept(jobs, "job_id", 49_000).groupBy("accepted").agg(F.count(F.lit(1)).alias("n"), F.max("job_id").alias("last_job"))


def frontier_bfs(spark: SparkSession, sf: str) -> DataFrame:
    """STR-8: the first wave of the crawl that each page is found in, over links between pages of a site.

    A page links to the pages whose ids are two and three times its own (made-up links, as the tables hold
    none). Waves are joined until no page is new or the depth limit is reached; each is written down.
    """
    nodes = _index(spark, sf).select("page_id")
    edges = nodes.select(F.col("page_id").alias("a"), F.explode(F.array(F.col("page_id") * 2, F.col("page_id") * 3 + 1)).alias("b"))
    edges = edges.join(nodes.withColumnRenamed("page_id", "b"), "b", "left_semi")
    seen = materialize(nodes.where("page_id <= 3").select("page_id", F.lit(0).alias("wave")), "wave")
    for depth in range(1, 6):
        last = seen.where(F.col("wave") == depth - 1)
        new = edges.join(last, edges["a"] == last["page_id"]).select(F.col("b").alias("page_id")).distinct().join(seen, "page_id", "left_anti")
        seen = materialize(seen.unionByName(new.withColumn("wave", F.lit(depth))), "wave")
    return seen


def link_extract_filter_cap(spark: SparkSession, sf: str) -> DataFrame:
    """FN-H4, FLT-7, AGG-10, ORD-10, PRJ-6: links of each page from made-up hrefs, ordered and capped at five."""
    d = _index(spark, sf).select("page_id", "url", "depth")
    page = F.col("page_id").cast("string")
    hrefs = F.array(
        F.concat(F.lit("/a"), page), F.concat(F.lit("https://other.example/b"), page), F.lit("/c?z=1&a=2"), F.lit("/c?a=2&z=1#x"), F.lit("/d?utm_source=q"),
        F.lit("mailto:q@r.example"), F.lit("https://Other.example:443/e/"), F.lit("/f"), F.concat(F.lit("/a"), page, F.lit("#top")),
    )
    pages = d.select("page_id", "depth", frontier.page_links(hrefs, F.col("url"), 5).alias("links"))
    return pages.select("page_id", F.posexplode("links").alias("n", "link"))


def retry_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """FN-M2, SNK-8, FLT-27: due time of each retry, and whether it may be tried again."""
    r = table(spark, sf, "retry_jobs").select("retry_id", "attempt", "max_attempts", "enqueued_at").distinct()
    due = frontier.schedule_retries(r, F.col("enqueued_at"))
    return due.select("retry_id", "due_at", (F.col("attempt") < F.coalesce("max_attempts", F.lit(3))).alias("again"))


def retry_due(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-10, SRC-11, PRJ-7, ORD-13: retries that are due, as jobs."""
    return frontier.due_retries(table(spark, sf, "retry_jobs").distinct(), F.lit(NOW_MS)).select("retry_id", "url", "depth", "source", "attempt")


def error_route(spark: SparkSession, sf: str) -> DataFrame:
    """STR-9, FLT-16: action after a failure of each job, for four errors in turn."""
    errors = F.array(F.lit("HTTP 404 Not Found"), F.lit("timeout"), F.lit("503 Service Unavailable"), F.lit("connection reset"))
    j = table(spark, sf, "crawl_jobs").distinct().withColumn("error", F.element_at(errors, (F.col("job_id") % 4 + 1).cast("int")))
    r = schedule.error_route(F.col("error"), F.col("source"), F.col("attempt"), F.col("max_attempts"))
    return j.select("job_id", r.alias("r")).select("job_id", "r.action", "r.next_attempt")


def backoff(spark: SparkSession, sf: str) -> DataFrame:
    """FN-M1, FLT-17, FLT-25: waits between tries for statuses in turn."""
    statuses = F.array(F.lit(500), F.lit(429), F.lit(503), F.lit(404))
    j = table(spark, sf, "retry_jobs").select("retry_id", "attempt").distinct().withColumn("status", F.element_at(statuses, (F.col("retry_id") % 4 + 1).cast("int")))
    limited = schedule.is_rate_limit_error(F.col("status"), F.lit(""))
    return j.select("retry_id", limited.alias("limited"), schedule.backoff_ms(F.col("attempt"), limited).alias("wait_ms"))


def domain_rate_gap(spark: SparkSession, sf: str) -> DataFrame:
    """STR-2: gap to the same domain's previous job and the wait for the minimum gap."""
    j = _jobs(spark, sf).groupBy("domain", "enqueued_at").agg(F.min("job_id").alias("job_id"))
    return frontier.rate_gaps(j, "domain", "enqueued_at", 3_600_000).select("job_id", "gap_ms", "wait_ms")


def api_rate_window(spark: SparkSession, sf: str) -> DataFrame:
    """STR-14: requests of each client and hour, and how many exceed a limit of three."""
    e = table(spark, sf, "events").select("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"))
    return e.groupBy("user_id", "hour").agg(F.count(F.lit(1)).alias("requests"), F.greatest(F.lit(0), F.count(F.lit(1)) - 3).alias("refused"))


def render_workers(spark: SparkSession, sf: str) -> DataFrame:
    """FN-M5: render workers wanted for each domain's JavaScript pages."""
    q = _index(spark, sf).where("content_type = 'javascript'").groupBy("domain").agg(F.count(F.lit(1)).alias("queued"))
    return q.select("domain", "queued", schedule.render_workers(F.col("queued"), 2).alias("workers"))


def _pages_html(spark: SparkSession, sf: str) -> DataFrame:
    """Each page written as HTML, with scripts, an entity and markers in turn."""
    c = F.col("content")
    tags = lambda xs, tag: F.array_join(F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"<{tag}>"), F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit(f"</{tag}>"))), "")
    mark = F.element_at(F.array(*map(F.lit, ("", "<div id=\"root\"></div>", "<script>var t='</p>';</script>", "cloudflare ray id", "<div data-page=\"x\"></div>"))), (F.col("page_id") % 5 + 1).cast("int"))
    body = F.concat(
        F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title><meta name=\"description\" content=\"d\"></head><body><nav><p>This menu paragraph is outside of the main content of the page.</p></nav>"),
        F.lit("<article>"), tags(c["h1"], "h1"), tags(c["h2"], "h2"), tags(c["paragraphs"], "p"), F.lit("</article>"), mark, F.lit("</body></html>"),
    )
    return _index(spark, sf).select("page_id", "url", "content", body.alias("html"))


def spa_detect(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-12, FLT-14, FN-H8, SRC-2: pages that need rendering."""
    h = F.col("html")
    return _pages_html(spark, sf).select("page_id", html.spa_markers(h).alias("markers"), html.script_sources(h).alias("scripts"), html.needs_rendering(h).alias("render"))


def antibot_detect(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-15, FLT-13, FLT-24: blocked pages for statuses in turn."""
    status = F.element_at(F.array(F.lit(200), F.lit(403), F.lit(429), F.lit(200)), (F.col("page_id") % 4 + 1).cast("int"))
    p = _pages_html(spark, sf).select("page_id", html.is_anti_bot(status, F.col("html"), F.create_map().cast("map<string,string>")).alias("blocked"))
    return p


def html_title_headings(spark: SparkSession, sf: str) -> DataFrame:
    """FN-H1, FN-H2: title and headings by expressions."""
    h = F.col("html")
    return _pages_html(spark, sf).select("page_id", html.title_of(h).alias("title"), F.size(html.tag_texts(h, "h1")).alias("h1"), F.size(html.tag_texts(h, "h2")).alias("h2"))


def html_extract_full(spark: SparkSession, sf: str) -> DataFrame:
    """FN-H1 to FN-H4: the tree parser over every page: paragraphs of the article that pass the gate."""
    d = _pages_html(spark, sf).withColumn("e", html.extract(F.col("html")))
    return d.select("page_id", F.size("e.paragraphs").alias("paragraphs"), F.sha2(F.array_join("e.paragraphs", "\n"), 256).alias("hash"), text.word_count(F.array_join("e.paragraphs", " ")).alias("words"))


QUERIES = {
    f.__name__: f
    for f in (
        frontier_usable, visited_antijoin, visited_marks, frontier_capacity, frontier_bfs, link_extract_filter_cap, retry_schedule, retry_due, error_route, backoff,
        domain_rate_gap, api_rate_window, render_workers, spa_detect, antibot_detect, html_title_headings, html_extract_full,
    )
}

_J = f"""WITH {_parts('(SELECT DISTINCT * FROM crawl_jobs)', 'job_id, depth, source, enqueued_at, attempt, max_attempts')},
    j AS (SELECT *, {_NORMAL} AS normalized FROM c WHERE {_SAFE} AND depth <= 5)"""
_P = "(SELECT DISTINCT ON (page_id) * FROM pages_index)"
_HTML = f"""WITH t AS (SELECT page_id, title, content, ['', '<div id="root"></div>', '<script>var t=''</p>'';</script>', 'cloudflare ray id', '<div data-page="x"></div>'][page_id % 5 + 1] AS mark FROM {_P})"""
_BP = "|".join(text.BOILERPLATE).replace("'", "''")

SQL = {
    "frontier_usable": _J + " SELECT job_id, normalized, h AS domain, depth FROM j",
    "visited_antijoin": _J + f""", v AS (SELECT DISTINCT url FROM {_P}), pv AS (SELECT * FROM (WITH {_parts('v', '1 AS one')} SELECT {_NORMAL} AS n FROM c)),
        f AS (SELECT *, row_number() OVER (PARTITION BY normalized ORDER BY job_id) AS rn FROM j) SELECT job_id, normalized, depth FROM f WHERE rn = 1 AND normalized NOT IN (SELECT n FROM pv)""",
    "visited_marks": _J + f" SELECT url, max(t) AS last_indexed FROM (SELECT url, epoch_us(last_indexed) // 1000 AS t FROM {_P} UNION ALL SELECT normalized, {NOW_MS} FROM j) GROUP BY url",
    "frontier_capacity": "WITH j AS (SELECT job_id, row_number() OVER (ORDER BY job_id) <= 1000 AS accepted FROM (SELECT DISTINCT * FROM crawl_jobs)) SELECT accepted, count(*) AS n, max(job_id) AS last_job FROM j GROUP BY 1",
    "frontier_bfs": f"""WITH RECURSIVE n AS (SELECT page_id FROM {_P}), e AS (SELECT page_id AS a, unnest([page_id * 2, page_id * 3 + 1]) AS b FROM n),
        w(page_id, wave) AS (SELECT page_id, 0 FROM n WHERE page_id <= 3 UNION SELECT e.b, wave + 1 FROM w JOIN e ON e.a = w.page_id JOIN n ON n.page_id = e.b WHERE wave < 5)
        SELECT page_id, min(wave) AS wave FROM w GROUP BY page_id""",
    "link_extract_filter_cap": f"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) AS r FROM {_P})
        SELECT page_id, n, CASE n WHEN 0 THEN r || '/f' WHEN 1 THEN r || '/c?a=2&z=1' WHEN 2 THEN r || '/a' || page_id WHEN 3 THEN 'https://other.example/b' || page_id ELSE 'mailto:q@r.example' END AS link FROM p, range(0, 5) AS x(n)""",
    "retry_schedule": "SELECT DISTINCT retry_id, enqueued_at + [300000, 600000, 1200000][least(greatest(attempt, 1), 3)] AS due_at, attempt < coalesce(max_attempts, 3) AS again FROM retry_jobs",
    "retry_due": f"SELECT DISTINCT retry_id, url, 0 AS depth, 'retry' AS source, attempt FROM retry_jobs WHERE due_at <= {NOW_MS}",
    "error_route": """WITH j AS (SELECT *, ['HTTP 404 Not Found', 'timeout', '503 Service Unavailable', 'connection reset'][job_id % 4 + 1] AS e FROM (SELECT DISTINCT * FROM crawl_jobs)),
        r AS (SELECT job_id, CASE WHEN regexp_matches(e, '404|Not Found|410|Gone|503|Service Unavailable') THEN 'dead' WHEN source IS NULL OR source <> 'retry' THEN 'retry'
            WHEN coalesce(attempt, 1) < coalesce(nullif(max_attempts, 0), 3) THEN 'retry' ELSE 'drop' END AS action, source, attempt FROM j)
        SELECT job_id, action, CASE WHEN action = 'retry' THEN CASE WHEN source = 'retry' THEN coalesce(attempt, 1) + 1 ELSE 1 END END AS next_attempt FROM r""",
    "backoff": """WITH j AS (SELECT DISTINCT retry_id, attempt, [500, 429, 503, 404][retry_id % 4 + 1] AS s FROM retry_jobs)
        SELECT retry_id, s IN (429, 503, 504) AS limited, CAST(least(CASE WHEN s IN (429, 503, 504) THEN 2000 ELSE 1000 END * pow(2, attempt - 1), 10000) AS BIGINT) AS wait_ms FROM j""",
    "domain_rate_gap": _J + """, g AS (SELECT h, enqueued_at, min(job_id) AS job_id FROM j GROUP BY h, enqueued_at), l AS (SELECT job_id, enqueued_at - lag(enqueued_at) OVER (PARTITION BY h ORDER BY enqueued_at) AS gap_ms FROM g)
        SELECT job_id, gap_ms, greatest(0, 3600000 - coalesce(gap_ms, 3600000)) AS wait_ms FROM l""",
    "api_rate_window": "SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS requests, greatest(0, count(*) - 3) AS refused FROM events GROUP BY 1, 2",
    "render_workers": f"SELECT domain, count(*) AS queued, CAST(least(2, ceil(count(*) / 20.0)) AS INT) AS workers FROM {_P} WHERE content_type = 'javascript' GROUP BY 1",
    "spa_detect": _HTML + """, s AS (SELECT page_id, page_id % 5 IN (1, 4) OR regexp_matches(lower(array_to_string(list_concat(coalesce(content.paragraphs, []), [title]), ' ')), 'ng-app|data-vue|v-app|data-react|svelte:') AS m FROM t)
        SELECT page_id, m AS markers, 0 AS scripts, m AS render FROM s""",
    "antibot_detect": _HTML + """, l AS (SELECT page_id, lower(title || ' ' || array_to_string(content.paragraphs, ' ') || mark) AS x,
            length('<html><head><title>' || title || '</title><meta name="description" content="d"></head><body><nav><p>This menu paragraph is outside of the main content of the page.</p></nav><article>'
            || coalesce(array_to_string(list_transform(content.h1, lambda v: '<h1>' || replace(replace(replace(v, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</h1>'), ''), '')
            || coalesce(array_to_string(list_transform(content.h2, lambda v: '<h2>' || replace(replace(replace(v, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</h2>'), ''), '')
            || coalesce(array_to_string(list_transform(content.paragraphs, lambda v: '<p>' || replace(replace(replace(v, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>'), ''), '')
            || '</article>' || mark || '</body></html>') AS n FROM t)
        SELECT page_id, page_id % 4 = 1 OR (x LIKE '%cloudflare%' AND (x LIKE '%ray id%' OR x LIKE '%checking your browser%' OR x LIKE '%challenge%')) OR (x LIKE '%access denied%' AND x LIKE '%bot%') OR (n < 500 AND x LIKE '%javascript%') AS blocked FROM l""",
    "html_title_headings": _HTML + """ SELECT page_id, coalesce(nullif(trim(title), ''), trim(content.h1[1]), '') AS title, coalesce(len(content.h1), 0) AS h1, coalesce(len(content.h2), 0) AS h2 FROM t""",
    "html_extract_full": _HTML + f""", g AS (SELECT page_id, list_filter(list_transform(content.paragraphs, lambda x: regexp_replace(x, '^[\\s ]+|[\\s ]+$', '', 'g')), lambda x: length(x) > 30 AND NOT regexp_matches(lower(left(x, 100)), '{_BP}')) AS p FROM t)
        SELECT page_id, len(p) AS paragraphs, sha256(array_to_string(p, chr(10))) AS hash, len(list_filter(regexp_split_to_array(array_to_string(p, ' '), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) AS words FROM g""",
}
