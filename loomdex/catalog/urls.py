"""URL, robots and sitemap queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import robots, url
from ..session import table

# SQL macros as text: WHATWG-like parts of the URL in column {u}
_CLEAN = "regexp_replace(regexp_replace({u}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '[\\t\\n\\r]', '', 'g')"
_SCHEME = "nullif(lower(regexp_extract({u}, '^([a-zA-Z][a-zA-Z0-9+.\\-]*):', 1)), '')"
_AUTH = "regexp_extract({u}, '^([a-zA-Z]+)://([^/?#\\\\]*)', 2)"
_HOST = "lower(regexp_extract(" + _AUTH + ", '^(?:[^@]*@)?([^:@]*)(?::[0-9]*)?$', 1))"


def _parts(source: str, keep: str) -> str:
    """CTE body: scheme s, host h (null if invalid, '' for schemes without host), port, path, query of column url."""
    u = _CLEAN.format(u="url")
    return f"""
        a AS (SELECT {keep}, url, {u} AS u FROM {source}),
        b AS (SELECT *, {_SCHEME.format(u='u')} AS s, {_HOST.format(u='u')} AS h0,
                     regexp_extract({_AUTH.format(u='u')}, ':([0-9]*)$', 1) AS port,
                     regexp_extract(u, '^([a-zA-Z]+)://([^/?#]*)([^?#]*)(\\?[^#]*)?', 3) AS path,
                     regexp_extract(u, '^([a-zA-Z]+)://([^/?#]*)([^?#]*)(\\?[^#]*)?', 4) AS query FROM a),
        c AS (SELECT *, CASE WHEN s IN ('http', 'https', 'ftp') THEN CASE WHEN h0 <> '' AND NOT regexp_matches(h0, '[\\s<>^|%]') THEN h0 END
                             WHEN s IS NOT NULL THEN '' END AS h FROM b)"""


def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """FN-U1: canonical URL of each crawl job."""
    return table(spark, sf, "crawl_jobs").select("job_id", "url", url.normalize(F.col("url")).alias("normalized"))


def url_domain(spark: SparkSession, sf: str) -> DataFrame:
    """FN-U2, FLT-6: host and validity."""
    u = F.col("url")
    return table(spark, sf, "crawl_jobs").select("job_id", url.domain_of(u).alias("domain"), url.is_valid(u).alias("valid"))


def url_safe(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-5: safe URLs, over the jobs and made-up addresses of every octet range."""
    jobs = table(spark, sf, "crawl_jobs").select("job_id", "url")
    ips = jobs.select("job_id", F.expr("concat('http://', job_id % 256, '.', (job_id div 7) % 256, '.', job_id % 11, '.1/')").alias("url"))
    return jobs.unionByName(ips).select("job_id", "url", url.is_safe(F.col("url")).alias("safe"))


def url_resolve_links(spark: SparkSession, sf: str) -> DataFrame:
    """FN-U3: references of every form resolved against each page's URL."""
    refs = ["/root?x=1", "sub/page.html", "../up", "./here", "?q=2", "#frag", "//other.example/y", "https://abs.example/z", "mailto:a@b.example"]
    base = F.col("url")
    return (
        table(spark, sf, "pages_index").select("page_id", "url").distinct()
        .select("page_id", base, F.posexplode(F.array(*map(F.lit, refs))).alias("n", "href"))
        .select("page_id", "n", url.resolve(base, F.col("href")).alias("resolved"))
    )


def url_cache_key(spark: SparkSession, sf: str) -> DataFrame:
    """FN-U4: cache key of each search request."""
    q = table(spark, sf, "search_queries")
    key = url.cache_key({
        "q": F.col("q"), "p": F.col("page_no"), "l": F.col("limit_n"), "domain": F.col("domain"), "language": F.col("language"),
        "contentType": F.col("content_type"), "sort": F.coalesce("sort_by", F.lit("relevance")), "order": F.coalesce("sort_order", F.lit("desc")),
    })
    return q.select("query_id", key.alias("cache_key")).distinct()


def url_display(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-11: display URL, and title falling back to it."""
    hits = table(spark, sf, "search_hits")
    shown = url.display(F.col("url"))
    return hits.select("hit_id", shown.alias("display_url"), F.coalesce(F.nullif("title", F.lit("")), shown).alias("shown_title"))


def link_filter(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-7, FLT-26: jobs whose link is followed: not blocked, valid, safe."""
    jobs = table(spark, sf, "crawl_jobs")
    n = url.normalize(F.col("url"))
    keep = url.is_safe(F.col("url")) & n.isNotNull() & ~url.is_blocked_link(F.col("url")) & ~url.is_blocked_link(n)
    return jobs.where(keep).select("job_id", n.alias("normalized"))


def robots_allow(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-8, JOIN-6: jobs with the verdict of their site's rules. The planner broadcasts the rules while small."""
    jobs = table(spark, sf, "crawl_jobs").select("job_id", "url").distinct()
    rules = table(spark, sf, "robots_rules").select("domain", "rules", "allow_rules")
    d = url.domain_of(F.col("url"))
    return jobs.withColumn("domain", d).join(rules, "domain", "left").select(
        "job_id", robots.is_allowed(F.col("url"), F.col("rules"), F.col("allow_rules")).alias("allowed")
    )


def robots_delay(spark: SparkSession, sf: str) -> DataFrame:
    """FN-R2: delay of each site, the larger of its own and the configured one."""
    return table(spark, sf, "robots_rules").select("domain", robots.crawl_delay(F.col("crawl_delay"), 200).alias("delay_ms"))


def robots_parse(spark: SparkSession, sf: str) -> DataFrame:
    """FN-R1: each site's rules written as a robots.txt body with a second group, and parsed again."""
    r = table(spark, sf, "robots_rules")
    lines = lambda c, name: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"{name}: "), x)), "\n")
    body = F.concat_ws(
        "\n", F.lit("User-agent: other\nDisallow: /all\nUser-Agent: *"), lines(F.col("rules"), "Disallow"), lines(F.col("allow_rules"), "Allow"),
        F.concat(F.lit("Crawl-delay: "), (F.col("crawl_delay") / 1000).cast("string")), F.lit("User-agent: late\nDisallow: /late"),
    )
    return r.select("domain", robots.parse(body).alias("p")).select("domain", "p.disallow", "p.allow", "p.crawl_delay_ms")


def sitemap_parse(spark: SparkSession, sf: str) -> DataFrame:
    """FN-R3, FN-R4, FLT-19, FLT-20, FLT-22: locations of a sitemap made of each site's pages."""
    # a site's pages are written as several sitemaps, so that none grows with the site
    pages = table(spark, sf, "pages_index").select("domain", "url", F.shiftright("page_id", 10).alias("block")).distinct()
    xml = pages.groupBy("domain", "block").agg(
        F.concat(F.lit("<urlset>"), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<url><loc> "), F.col("url"), F.lit(" </loc></url>")))), ""),
                 F.concat(F.lit("<LOC>https://"), F.col("domain"), F.lit("/sitemap-2.xml.gz</LOC><loc>ftp://x/y</loc></urlset>"))).alias("xml")
    )
    loc = xml.select("domain", F.explode(robots.sitemap_locations(F.col("xml"))).alias("loc"))
    return loc.select("domain", "loc", robots.is_sitemap(F.col("loc")).alias("is_sitemap"), (url.domain_of(F.col("loc")) == F.lower("domain")).alias("same_domain"))


QUERIES = {
    f.__name__: f
    for f in (url_normalize, url_domain, url_safe, url_resolve_links, url_cache_key, url_display, link_filter, robots_allow, robots_delay, robots_parse, sitemap_parse)
}

_NORMAL = """CASE WHEN s IN ('http', 'https') AND h IS NOT NULL THEN s || '://' || h || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END
        || CASE WHEN path = '' THEN '/' WHEN length(path) > 1 AND path LIKE '%/' THEN left(path, length(path) - 1) ELSE path END
        || CASE WHEN query IN ('', '?') THEN '' ELSE '?' || array_to_string(list_transform(list_sort(list_transform(
               list_filter(string_split(substr(query, 2), '&'), lambda x: x <> ''), lambda x, i: {'k': split_part(x, '=', 1), 'i': i, 'v': substr(x, length(split_part(x, '=', 1)) + 2)})),
               lambda x: x.k || '=' || x.v), '&') END
      WHEN s NOT IN ('http', 'https') AND h IS NOT NULL THEN s || ':' || regexp_replace(regexp_replace(u, '^[a-zA-Z][a-zA-Z0-9+.\\-]*:', ''), '#.*$', '') END"""

_SAFE = """coalesce(s IN ('http', 'https') AND NOT (h IN ('localhost', '::1') OR CASE WHEN regexp_matches(h, '^\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}$') THEN
        CAST(split_part(h, '.', 1) AS INT) IN (0, 10, 127) OR CAST(split_part(h, '.', 1) AS INT) >= 224
        OR (CAST(split_part(h, '.', 1) AS INT) = 172 AND CAST(split_part(h, '.', 2) AS INT) BETWEEN 16 AND 31)
        OR (CAST(split_part(h, '.', 1) AS INT) = 192 AND CAST(split_part(h, '.', 2) AS INT) = 168) ELSE false END), false)"""

_BLOCKED = "regexp_matches(lower({u}), '_____tmd_____|x5secdata=|/redirect/|click_id=|utm_source|utm_medium|utm_campaign|scm=|icms-zebra-')"

_RULE = """CASE WHEN r LIKE '%$' THEN p = left(r, length(r) - 1) ELSE starts_with(p, regexp_replace(r, '[?*]$', '')) END"""

SQL = {
    "url_normalize": f"WITH {_parts('crawl_jobs', 'job_id')} SELECT job_id, url, {_NORMAL} AS normalized FROM c",
    "url_domain": f"WITH {_parts('crawl_jobs', 'job_id')} SELECT job_id, h AS domain, h IS NOT NULL AS valid FROM c",
    "url_safe": f"""WITH src AS (SELECT job_id, url FROM crawl_jobs UNION ALL
        SELECT job_id, 'http://' || (job_id % 256) || '.' || ((job_id // 7) % 256) || '.' || (job_id % 11) || '.1/' FROM crawl_jobs),
        {_parts('src', 'job_id')} SELECT job_id, url, {_SAFE} AS safe FROM c""",
    "url_resolve_links": """WITH p AS (SELECT DISTINCT page_id, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS root,
            regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^https?://[^/?#]*[^?#]*(\\?[^#]*)?', 1) AS q FROM pages_index),
        d AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS folder FROM p)
        SELECT page_id, n, CASE n WHEN 0 THEN root || '/root?x=1' WHEN 1 THEN root || folder || 'sub/page.html'
            WHEN 2 THEN root || CASE WHEN folder = '/' THEN '/' ELSE regexp_replace(folder, '[^/]+/$', '') END || 'up' WHEN 3 THEN root || folder || 'here'
            WHEN 4 THEN root || path || '?q=2' WHEN 5 THEN root || path || coalesce(q, '') || '#frag' WHEN 6 THEN split_part(url, ':', 1) || '://other.example/y'
            WHEN 7 THEN 'https://abs.example/z' ELSE 'mailto:a@b.example' END AS resolved
        FROM d, range(0, 9) AS r(n)""",
    "url_cache_key": """SELECT DISTINCT query_id, array_to_string(list_sort(list_filter([
            CASE WHEN q <> '' THEN 'q=' || url_encode(q) END, 'p=' || page_no, 'l=' || limit_n,
            CASE WHEN domain <> '' THEN 'domain=' || url_encode(domain) END, CASE WHEN language <> '' THEN 'language=' || url_encode(language) END,
            CASE WHEN content_type <> '' THEN 'contentType=' || url_encode(content_type) END,
            'sort=' || coalesce(nullif(sort_by, ''), 'relevance'), 'order=' || coalesce(nullif(sort_order, ''), 'desc')], lambda x: x IS NOT NULL)), '|') AS cache_key FROM search_queries""",
    "url_display": """WITH d AS (SELECT hit_id, title, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/$', '') AS u FROM search_hits)
        SELECT hit_id, u AS display_url, coalesce(nullif(title, ''), u) AS shown_title FROM d""",
    "link_filter": f"WITH {_parts('crawl_jobs', 'job_id')}, d AS (SELECT *, {_NORMAL} AS normalized FROM c) SELECT job_id, normalized FROM d WHERE {_SAFE} AND normalized IS NOT NULL AND NOT {_BLOCKED.format(u='url')} AND NOT {_BLOCKED.format(u='normalized')}",
    "robots_allow": f"""WITH {_parts('(SELECT DISTINCT job_id, url FROM crawl_jobs)', 'job_id')},
        d AS (SELECT job_id, coalesce(nullif(lower(path), ''), '/') AS p, r.rules, r.allow_rules FROM c LEFT JOIN robots_rules r ON r.domain = c.h)
        SELECT job_id, len(list_filter(coalesce(allow_rules, []), lambda r: {_RULE})) > 0 OR len(list_filter(coalesce(rules, []), lambda r: r <> '*' AND {_RULE})) = 0 AS allowed FROM d""",
    "robots_delay": "SELECT domain, greatest(coalesce(crawl_delay, 0), 200.0) AS delay_ms FROM robots_rules",
    "robots_parse": """SELECT domain, list_transform(rules, lambda x: lower(x)) AS disallow, list_transform(coalesce(allow_rules, []), lambda x: lower(x)) AS allow, coalesce(crawl_delay, 0.0) AS crawl_delay_ms FROM robots_rules""",
    "sitemap_parse": """SELECT DISTINCT domain, url AS loc, regexp_matches(url, '(?i)/sitemap[\\w-]*\\.\\w+(\\.gz)?$') AS is_sitemap, true AS same_domain FROM pages_index
        UNION ALL SELECT DISTINCT domain, 'https://' || domain || '/sitemap-2.xml.gz', true, true FROM pages_index""",
}
