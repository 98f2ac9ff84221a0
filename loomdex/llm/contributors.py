"""Capping of dominant contributors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import capping
from ..session import materialize, table


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    records = materialize(capping.hit_records(table(spark, sf, "search_hits")), "hit-records")
    split = capping.split_by_cap(records, "contributor", "word_count", "hit_id", 1 / 50, "input")
    return split.where("NOT _keep").select("hit_id")


def p7_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Records each contributor keeps when no one may have more than a fiftieth of what is kept (water-filling)."""
    records = materialize(capping.hit_records(table(spark, sf, "search_hits")), "hit-records")
    counts = capping.contributor_counts(records, "contributor")
    histogram = [(r[0], r[1]) for r in counts.groupBy("n").agg(F.count(F.lit(1))).collect()]
    level = capping.water_level(histogram, 1 / 50, "output")
    return counts.select("contributor", F.col("n").alias("records"), F.least("n", F.lit(level)).alias("kept"))


def p7_capped(spark: SparkSession, sf: str) -> DataFrame:
    """The records that stay when each contributor is cut to the water-filled level (a fiftieth of what is kept)."""
    records = materialize(capping.hit_records(table(spark, sf, "search_hits")), "hit-records")
    return capping.cap_contributors(records, "contributor", "word_count", "hit_id", 1 / 50, "output").select("hit_id", "contributor", "word_count")


QUERIES = {f.__name__: f for f in (p7_found, p7_levels, p7_capped)}

_RECORDS = r"""WITH h AS (
            SELECT hit_id, max(word_count) AS wc, min(coalesce(
                nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(domain, '\s+', '', 'g')),
                    '^[a-z][a-z0-9+.-]*://|^//', ''), '[/?#].*$', ''), ':[0-9]*$', ''), '\.+$', ''), '^www\.', ''), ''),
                nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(url, '\s+', '', 'g')),
                    '^[a-z][a-z0-9+.-]*://|^//', ''), '[/?#].*$', ''), ':[0-9]*$', ''), '\.+$', ''), '^www\.', ''), ''))) AS host
            FROM search_hits WHERE hit_id IS NOT NULL GROUP BY hit_id
        )"""

SQL = {
    "p7_found": f"""
        {_RECORDS}, r AS (
            SELECT hit_id, row_number() OVER (PARTITION BY host ORDER BY wc DESC NULLS LAST, hit_id) AS rn, count(*) OVER () AS n FROM h
        )
        SELECT hit_id FROM r WHERE rn > greatest(1, n // 50)
    """,
    "p7_levels": f"""
        {_RECORDS}, c AS (SELECT host, count(*) AS n FROM h GROUP BY host), t AS (SELECT l, sum(least(n, l)) AS kept FROM c, range(1, (SELECT max(n) + 1 FROM c)) AS r(l) GROUP BY l),
        best AS (SELECT coalesce(max(l), 1) AS l FROM t WHERE l <= kept / 50.0)
        SELECT host AS contributor, n AS records, least(n, l) AS kept FROM c, best
    """,
    "p7_capped": f"""
        {_RECORDS}, c AS (SELECT host, count(*) AS n FROM h GROUP BY host), t AS (SELECT l, sum(least(n, l)) AS kept FROM c, range(1, (SELECT max(n) + 1 FROM c)) AS r(l) GROUP BY l),
        best AS (SELECT coalesce(max(l), 1) AS l FROM t WHERE l <= kept / 50.0),
        r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY wc DESC NULLS LAST, hit_id) AS rn FROM h)
        SELECT hit_id, host AS contributor, wc AS word_count FROM r, best WHERE rn <= l
    """,
}
