"""Content, index change, statistics and paging queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import index_dml, paging, stats
from ..session import table

#: time at which the checked queries run
NOW = "2024-12-31 00:00:00"


def _index(spark: SparkSession, sf: str) -> DataFrame:
    """The page index with one row per URL."""
    return table(spark, sf, "pages_index").dropDuplicates(["page_id"])


def _now():  # noqa: ANN202
    return F.lit(NOW).cast("timestamp_ntz")


def boilerplate_filter(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-10, FLT-11: lines that pass the paragraph gate."""
    lines = table(spark, sf, "pages_index").select("page_id", F.posexplode("content.paragraphs").alias("n", "line")).distinct()
    return lines.select("page_id", "n", text.is_boilerplate(F.col("line")).alias("boilerplate"), text.is_paragraph(F.col("line")).alias("paragraph"))


def word_count_fulltext(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-8, FN-H9, FN-H6: full text, words and hash rebuilt from headings and paragraphs, and the stored count."""
    full = text.full_text(F.col("content"))
    d = _index(spark, sf).select("page_id", "word_count", full.alias("f"))
    return d.select("page_id", F.col("word_count").alias("stored"), text.word_count(F.col("f")).alias("words"), text.content_hash(F.col("f")).alias("hash"), text.short_hash(F.col("f")).alias("short"))


def content_hash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """FN-H6, STR-10: groups of documents with the same text, by hash; nulls are no text."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", text.content_hash(F.col("text")).alias("hash"))
    return d.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def description_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-1, PRJ-2: description of each hit from highlights, else its own."""
    h = table(spark, sf, "search_hits").distinct()
    return h.select("hit_id", text.description(F.col("highlights"), F.col("description"), F.lit(None).cast("string")).alias("shown"))


def highlight_parts(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-13, ORD-15: first highlight of each hit split at its marks."""
    h = table(spark, sf, "search_hits").where("size(highlights) > 0").select("hit_id", F.slice("highlights", 1, 1)[0].alias("hl")).distinct()
    parts = h.select("hit_id", text.emphasis_parts(F.col("hl")).alias("p"))
    return parts.select("hit_id", F.size("p").alias("parts"), F.array_join(F.transform(F.filter("p", lambda x: x["marked"]), lambda x: x["text"]), "|").alias("marked"))


def pagination_window(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-12: page window of each request over a total of ten pages."""
    q = table(spark, sf, "search_queries").select("query_id", "page_no").distinct()
    return q.select("query_id", F.array_join(text.page_window(F.col("page_no"), F.lit(10)), " ").alias("window"))


def keywords_clean(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-28, FN-H3: keywords trimmed, empty ones dropped."""
    k = F.filter(F.transform(F.split(F.array_join("meta_keywords", ", , "), ","), lambda x: F.trim(x)), lambda x: x != "")
    return _index(spark, sf).where("meta_keywords IS NOT NULL").select("page_id", k.alias("keywords"))


def top_domains(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-2."""
    return stats.stats("domains", _index(spark, sf), {})


def content_type_terms(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-3."""
    return stats.stats("content-type", _index(spark, sf), {})


def crawl_speed(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-4, ORD-7."""
    return stats.stats("speed", _index(spark, sf), {})


def recent_pages(spark: SparkSession, sf: str) -> DataFrame:
    """ORD-6, PRJ-10."""
    return stats.stats("recent", _index(spark, sf), {})


def index_size(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-6, AGG-1."""
    return stats.stats("size", _index(spark, sf), {})


def queue_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-5, AGG-14."""
    return stats.stats("queues", _index(spark, sf), {"crawl": table(spark, sf, "crawl_jobs"), "retry": table(spark, sf, "retry_jobs")})


def stale_pages(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-2, ORD-8, STR-6: reindex candidates of the last cycle."""
    return index_dml.stale(_index(spark, sf), _now(), 24 * 90, 10_000)


def exact_filters(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-1: each request's exact filters counted on the index (all that are set must hold)."""
    q = table(spark, sf, "search_queries").select("query_id", "domain", "language", "content_type").distinct()
    q = q.where("domain IS NOT NULL OR language IS NOT NULL OR content_type IS NOT NULL")
    cells = _index(spark, sf).groupBy("domain", "language", "content_type").agg(F.count(F.lit(1)).alias("n")).alias("c")
    # filters come in few combinations: each is answered once from the cell counts by an equi-join per pattern
    parts = []
    for mask in range(1, 8):
        on = [c for i, c in enumerate(("domain", "language", "content_type")) if mask >> i & 1]
        off = [c for c in ("domain", "language", "content_type") if c not in on]
        some = q.where(" AND ".join([f"{c} IS NOT NULL" for c in on] + [f"{c} IS NULL" for c in off])).select("query_id", *on)
        counts = cells.groupBy(*on).agg(F.sum("n").alias("n"))
        parts.append(some.join(counts, on, "left").select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("total")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of newly extracted pages: every third page again, some changed, some under a new URL, some fields absent."""
    d = _index(spark, sf).where("page_id % 3 = 0")
    return d.select(
        F.when(F.col("page_id") % 9 == 0, F.concat("url", F.lit("-new"))).otherwise(F.col("url")).alias("url"),
        "domain",
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("New "), "title")).alias("title"),
        F.when(F.col("page_id") % 6 == 0, F.lit("h" * 64)).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(F.col("page_id") % 12 == 0, F.lit(7)).alias("depth"),
    )


def index_upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-2, JOIN-9, JOIN-1: partial upsert by URL."""
    cols = ["url", "domain", "title", "meta_description", "depth", "content_hash", "first_indexed", "last_indexed", "updated_at"]
    return index_dml.upsert(_index(spark, sf).select(*cols), _batch(spark, sf), _now())


def index_touch(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-3: times of every fifth page set."""
    i = _index(spark, sf).select("page_id", "url", "last_indexed", "updated_at")
    return index_dml.touch(i, i.where("page_id % 5 = 0").select("url"), _now())


def index_delete(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-4: pages of the busiest domain deleted."""
    i = _index(spark, sf).select("page_id", "url", "domain")
    top = stats.terms(i, "domain", 1).select("domain")
    return index_dml.delete(i, i.join(top, "domain").select("url")).select("page_id", "url")


def change_detection(spark: SparkSession, sf: str) -> DataFrame:
    """STR-10: insert, touch or update of each page of a batch."""
    return index_dml.change_kind(_index(spark, sf), _batch(spark, sf)).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def search_offset_page(spark: SparkSession, sf: str) -> DataFrame:
    """ORD-2, ORD-3: third page of twenty by date."""
    return paging.offset_page(_index(spark, sf).select("page_id", "url", "last_indexed"), paging.order_columns("date", "desc"), 3, 20)


def search_after_page(spark: SparkSession, sf: str) -> DataFrame:
    """ORD-4, ORD-5: two keyset pages by date ascending; the second starts at the first one's cursor."""
    d = _index(spark, sf).select("page_id", "url", "last_indexed")
    first = paging.keyset_page(d, "date", "asc", None, 15).collect()[:15]
    if not first:
        return d.limit(0)
    return paging.keyset_page(d, "date", "asc", paging.cursor_of(first[-1].asDict(), "date"), 15)


QUERIES = {
    f.__name__: f
    for f in (
        boilerplate_filter, word_count_fulltext, content_hash_dedup, description_fallback, highlight_parts, pagination_window, keywords_clean,
        top_domains, content_type_terms, crawl_speed, recent_pages, index_size, queue_lengths, stale_pages, exact_filters,
        index_upsert_merge, index_touch, index_delete, change_detection, search_offset_page, search_after_page,
    )
}

_PAGES = "(SELECT DISTINCT ON (page_id) * FROM pages_index)"
_BP = "|".join(text.BOILERPLATE).replace("'", "''")
_FULL = "array_to_string(flatten([content.h1, content.h2, content.h3, content.h4, content.h5, content.h6, content.paragraphs]), ' ')"
_BATCH = f"""(SELECT CASE WHEN page_id % 9 = 0 THEN url || '-new' ELSE url END AS url, domain, CASE WHEN page_id % 2 = 0 THEN 'New ' || title END AS title,
    CASE WHEN page_id % 6 = 0 THEN repeat('h', 64) ELSE content_hash END AS content_hash, CASE WHEN page_id % 12 = 0 THEN 7 END AS depth FROM {_PAGES} WHERE page_id % 3 = 0)"""

SQL = {
    "boilerplate_filter": f"""WITH l AS (SELECT DISTINCT page_id, i - 1 AS n, content.paragraphs[i] AS line FROM pages_index, unnest(range(1, len(content.paragraphs) + 1)) AS u(i))
        SELECT page_id, n, regexp_matches(lower(left(line, 100)), '{_BP}') AS boilerplate,
               length(trim(line)) > 30 AND NOT regexp_matches(lower(left(trim(line), 100)), '{_BP}') AS paragraph FROM l""",
    "word_count_fulltext": f"""WITH d AS (SELECT page_id, word_count, {_FULL} AS f FROM {_PAGES})
        SELECT page_id, word_count AS stored, len(list_filter(regexp_split_to_array(f, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) AS words, sha256(f) AS hash, left(sha256(f), 8) AS short FROM d""",
    "content_hash_dedup": "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "description_fallback": "SELECT DISTINCT hit_id, coalesce(nullif(array_to_string(highlights, '...'), ''), nullif(description, ''), '') AS shown FROM search_hits",
    "highlight_parts": """WITH h AS (SELECT DISTINCT hit_id, highlights[1] AS hl FROM search_hits WHERE len(highlights) > 0)
        SELECT hit_id, len(list_filter(regexp_split_to_array(hl, '</?em>'), lambda x: x <> '')) AS parts, array_to_string(regexp_extract_all(hl, '<em>([^<]*)</em>', 1), '|') AS marked FROM h""",
    "pagination_window": """WITH q AS (SELECT DISTINCT query_id, page_no FROM search_queries), p AS (SELECT query_id, p, p - lag(p) OVER (PARTITION BY query_id ORDER BY p) AS gap
            FROM q, range(1, 11) AS r(p) WHERE p IN (1, 10) OR abs(p - page_no) <= 1)
        SELECT query_id, string_agg(CASE WHEN gap > 1 THEN '… ' ELSE '' END || p, ' ' ORDER BY p) AS window FROM p GROUP BY query_id""",
    "keywords_clean": f"SELECT page_id, list_filter(list_transform(meta_keywords, lambda x: trim(x)), lambda x: x <> '') AS keywords FROM {_PAGES} WHERE meta_keywords IS NOT NULL",
    "top_domains": f"SELECT domain, count(*) AS doc_count FROM {_PAGES} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "content_type_terms": f"SELECT content_type, count(*) AS doc_count FROM {_PAGES} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "crawl_speed": f"""WITH o AS (SELECT last_indexed FROM {_PAGES} ORDER BY last_indexed, url LIMIT 1000),
        a AS (SELECT count(*) AS pages, (epoch_us(max(last_indexed)) - epoch_us(min(last_indexed))) / 60000000.0 AS m FROM o)
        SELECT pages, round(pages / m, 2) AS per_minute, round(pages / (m / 60.0), 2) AS per_hour FROM a""",
    "recent_pages": f"SELECT left(title, 50) AS title, left(url, 60) AS url, strftime(date_trunc('millisecond', last_indexed), '%Y-%m-%dT%H:%M:%S.%gZ') AS time FROM (SELECT * FROM {_PAGES} ORDER BY last_indexed DESC, url LIMIT 10)",
    "index_size": f"SELECT count(*) AS pages, CAST(sum(strlen(content.full_text)) AS BIGINT) AS bytes, round(sum(strlen(content.full_text)) / 1048576.0, 2) AS mb, round(sum(strlen(content.full_text)) / 1073741824.0, 2) AS gb FROM {_PAGES}",
    "queue_lengths": "SELECT 'crawl' AS queue, count(*) AS length FROM crawl_jobs UNION ALL SELECT 'retry', count(*) FROM retry_jobs",
    "stale_pages": f"SELECT url, last_indexed FROM {_PAGES} WHERE last_indexed <= TIMESTAMP '{NOW}' - INTERVAL 2160 HOURS ORDER BY last_indexed, url LIMIT 10000",
    "exact_filters": f"""WITH q AS (SELECT DISTINCT query_id, domain, language, content_type FROM search_queries WHERE domain IS NOT NULL OR language IS NOT NULL OR content_type IS NOT NULL)
        SELECT query_id, count(p.page_id) AS total FROM q LEFT JOIN {_PAGES} p ON (q.domain IS NULL OR p.domain = q.domain) AND (q.language IS NULL OR p.language = q.language)
            AND (q.content_type IS NULL OR p.content_type = q.content_type) GROUP BY query_id""",
    "index_upsert_merge": f"""SELECT coalesce(n.url, o.url) AS url, coalesce(n.domain, o.domain) AS domain, coalesce(n.title, o.title) AS title, o.meta_description, coalesce(n.depth, o.depth) AS depth,
            coalesce(n.content_hash, o.content_hash) AS content_hash, CASE WHEN n.url IS NOT NULL THEN coalesce(o.first_indexed, TIMESTAMP '{NOW}') ELSE o.first_indexed END AS first_indexed,
            CASE WHEN n.url IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE o.last_indexed END AS last_indexed, CASE WHEN n.url IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE o.updated_at END AS updated_at
        FROM {_PAGES} o FULL JOIN {_BATCH} n ON o.url = n.url""",
    "index_touch": f"SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN TIMESTAMP '{NOW}' ELSE last_indexed END AS last_indexed, CASE WHEN page_id % 5 = 0 THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM {_PAGES}",
    "index_delete": f"SELECT page_id, url FROM {_PAGES} WHERE domain <> (SELECT domain FROM {_PAGES} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
    "change_detection": f"""SELECT CASE WHEN o.url IS NULL THEN 'insert' WHEN o.content_hash = n.content_hash THEN 'touch' ELSE 'update' END AS change, count(*) AS n
        FROM {_BATCH} n LEFT JOIN {_PAGES} o ON o.url = n.url GROUP BY 1""",
    "search_offset_page": f"SELECT page_id, url, last_indexed FROM {_PAGES} ORDER BY last_indexed DESC, url LIMIT 20 OFFSET 40",
    "search_after_page": f"SELECT page_id, url, last_indexed FROM {_PAGES} ORDER BY last_indexed, url LIMIT 16 OFFSET 15",
}
