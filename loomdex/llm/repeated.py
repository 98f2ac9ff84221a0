"""Lines repeated across one site's documents, by sparse bitmaps of pages per line.

A line's pages are a compressed bitmap: of the 64-bit words of the page-id space only the non-zero
ones are stored, one row (site, wording, word number, bits) each. All of it is built-in aggregation:
``bit_or`` unites the bitmaps of variant lines, ``bit_count`` gives exact cardinalities, and a hot
line is spread over its words, so no task holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_PAGES = 6


def wording(line: Column) -> Column:
    """Letters (category L) of a line, lower-cased, in order; all else dropped."""
    return F.lower(F.regexp_replace(line, r"[^\p{L}]+", ""))


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, para_no, s, k1, k2, word, bit) of each line with letters.

    ``s`` is a hash of the site and (k1, k2) a 128-bit hash of the wording, so that lines of any length
    shuffle as 24 bytes. Null sites, null ids and null or letterless lines are left out.
    """
    return (
        pages.where("page_id IS NOT NULL AND domain IS NOT NULL")
        .select("page_id", "domain", F.posexplode("content.paragraphs").alias("para_no", "line"))
        .select("page_id", F.col("para_no").cast("long").alias("para_no"), "domain", wording(F.col("line")).alias("w"))
        .where("w <> ''")
        .select(
            "page_id", "para_no",
            F.xxhash64("domain").alias("s"), F.xxhash64("w").alias("k1"), F.xxhash64(F.lit(7), F.col("w")).alias("k2"),
            F.shiftright("page_id", 6).alias("word"),
            F.expr("shiftleft(1L, cast(page_id & 63 as int))").alias("bit"),
        )
    )


def line_bitmaps(lines: DataFrame) -> DataFrame:
    """Bitmap words of each wording of a site, variants united."""
    return lines.groupBy("s", "k1", "k2", "word").agg(F.bit_or("bit").alias("bits"))


def repeated_bitmaps(bitmaps: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """The bitmaps of wordings that stand on ``min_pages`` or more pages of their site."""
    often = (
        bitmaps.groupBy("s", "k1", "k2")
        .agg(F.sum(F.bit_count("bits").cast("long")).alias("n"))
        .where(F.col("n") >= min_pages)
        .select("s", "k1", "k2")
    )
    return bitmaps.join(often, ["s", "k1", "k2"], "left_semi")


def repeated_lines(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, para_no) of each line whose wording stands on ``min_pages`` or more pages of its site.

    ``pages`` has ``page_id BIGINT``, ``domain`` and ``content.paragraphs``; other columns are ignored.
    Doubled pages count once (a page is one bit) and come out once. A wording that a page holds twice
    counts once but both lines come out. An empty table gives no rows.
    """
    lines = page_lines(pages)
    hits = repeated_bitmaps(line_bitmaps(lines), min_pages)
    found = lines.join(hits, ["s", "k1", "k2", "word"]).where("(bits & bit) <> 0")
    return found.select("page_id", "para_no").distinct()


def without_lines(pages: DataFrame, drop: DataFrame) -> DataFrame:
    """``pages`` with the lines listed in ``drop`` (page_id, para_no) taken out of ``content.paragraphs``.

    Null paragraphs stay null; all other columns and fields are unchanged; doubled pages stay doubled.
    """
    gone = drop.groupBy(F.col("page_id").alias("_p")).agg(F.collect_set(F.col("para_no").cast("int")).alias("_gone"))
    kept = F.filter(F.col("content.paragraphs"), lambda x, i: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<int>")), i))
    return (
        pages.join(gone, pages["page_id"] == gone["_p"], "left")
        .withColumn("content", F.col("content").withField("paragraphs", kept))
        .drop("_p", "_gone")
    )
