"""The pN_ queries of the operators for training data, with SQL where SQL can say it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table
from . import bpe, contributors, langid, packing, pages, pii, repeated, residue


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    found = pages.assess(table(spark, sf, "pages_index")).where("sound")
    return found.select("page_id", F.explode("furniture").alias("para_no")).select("page_id", F.col("para_no").cast("long"))


def p1_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Each sound page with only its article's own paragraphs, in order."""
    src = table(spark, sf, "pages_index")
    found = pages.assess(src).where("sound").select(F.col("page_id").alias("_p"), "furniture")
    lines = src.select("page_id", "content.paragraphs").dropDuplicates(["page_id"]).join(found, F.col("page_id") == F.col("_p"))
    own = F.filter("paragraphs", lambda x, i: ~F.array_contains("furniture", i))
    return lines.select("page_id", own.alias("paragraphs"), F.array_join(own, " ").alias("full_text"))


def _with_languages(spark: SparkSession, sf: str, label_residue: bool = True) -> tuple[DataFrame, DataFrame]:
    src, codes = table(spark, sf, "pages_index"), table(spark, sf, "language_codes")
    labels = src.select("page_id", langid.normalized_label(F.col("language"), codes).alias("lang"))
    return pages.assess(src, langid.train_on_labels(src, codes), label_residue), labels


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    # pages with residue are not sound, so their languages are not asked for here
    assessed, labels = _with_languages(spark, sf, label_residue=False)
    return langid.misnamed_languages(assessed.where("sound"), labels)


def p2_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Each page and each of its segments with language and confidence."""
    assessed, _ = _with_languages(spark, sf)
    return assessed.select("page_id", "page_lang", "page_confidence", F.posexplode_outer("segments").alias("segment", "s")).select(
        "page_id", "page_lang", "page_confidence", "segment", "s.first_sentence", "s.last_sentence", "s.lang", "s.confidence"
    )


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return repeated.repeated_lines(table(spark, sf, "pages_index"))


def p3_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Each page without the lines repeated in its domain."""
    src = table(spark, sf, "pages_index").select("page_id", "domain", "content").dropDuplicates(["page_id"])
    return repeated.without_lines(src, repeated.repeated_lines(src)).select("page_id", "content.paragraphs")


def p4_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of each page's full text, its stored word count, and whether its own content is natural prose."""
    src = table(spark, sf, "pages_index")
    kinds = pages.assess(src).select(F.col("page_id").alias("_p"), "kind", "kind_p")
    measured = pages.full_text_stats(src.select("page_id", "word_count", "content.full_text")).dropDuplicates(["page_id"])
    return measured.join(kinds, F.col("page_id") == F.col("_p")).drop("_p").withColumn("is_prose", F.col("kind") == "prose")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return pages.assess(table(spark, sf, "pages_index")).where("low_quality").select("page_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    src = table(spark, sf, "pages_index").select("page_id", "title", "content.paragraphs")
    return residue.residue_pages(src).where("residue").select("page_id").distinct()


def p5_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of which residue covers little, with that share: the operator's rule, relative to the document's length."""
    src = table(spark, sf, "pages_index").select("page_id", "title", "content.paragraphs")
    return residue.without_residue(src).dropDuplicates(["page_id"])


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    # a page that is residue is no spam case of its own: p4, p5 and p6 exclude one another
    return pages.assess(table(spark, sf, "pages_index")).where("spam AND NOT residue").select("page_id")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.token_ids(bpe.one_row_per_key(table(spark, sf, "documents"), "doc_id"))


def p9_packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text <> ''")
    docs = bpe.one_row_per_key(docs, "doc_id")
    targets = table(spark, sf, "pack_targets").dropDuplicates()
    packed = []
    for (name,) in sorted(targets.select("tokenizer").distinct().collect()):
        counts = materialize(bpe.token_counts(docs, tokenizer=name), "token-counts")
        packed.append(packing.pack(counts, targets.where(F.col("tokenizer") == name)))
    return reduce(DataFrame.unionByName, packed)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find(bpe.one_row_per_key(table(spark, sf, "documents"), "doc_id"))


def p10_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Each document readable, with personal information replaced by typed placeholders."""
    return pii.redacted(bpe.one_row_per_key(table(spark, sf, "documents"), "doc_id"))


QUERIES = contributors.QUERIES | {f.__name__: f for f in (
    p1_found, p1_articles, p2_found, p2_segments, p3_found, p3_clean, p4_found, p4_statistics, p5_found, p5_clean, p6_found, p8_ids, p9_packing, p10_found, p10_redacted,
)}

SQL: dict[str, str] = contributors.SQL | {
    "p3_found": """
        WITH l AS (
            SELECT DISTINCT page_id, domain, i - 1 AS para_no,
                   lower(regexp_replace(content.paragraphs[i], '[^\\p{L}]+', '', 'g')) AS w
            FROM pages_index, unnest(range(1, len(content.paragraphs) + 1)) AS u(i)
        ), k AS (
            SELECT domain, w FROM l WHERE w <> '' GROUP BY domain, w HAVING count(DISTINCT page_id) >= 6
        )
        SELECT page_id, CAST(para_no AS BIGINT) AS para_no FROM l JOIN k USING (domain, w)
    """,
    "p3_clean": """
        WITH p AS (SELECT DISTINCT ON (page_id) * FROM pages_index), l AS (
            SELECT page_id, domain, i, content.paragraphs[i] AS x, lower(regexp_replace(content.paragraphs[i], '[^\\p{L}]+', '', 'g')) AS w
            FROM p, unnest(range(1, len(content.paragraphs) + 1)) AS u(i)
        ), k AS (SELECT domain, w FROM l WHERE w <> '' GROUP BY domain, w HAVING count(DISTINCT page_id) >= 6),
        c AS (SELECT page_id, list(x ORDER BY i) AS paragraphs FROM l LEFT JOIN k USING (domain, w) WHERE k.w IS NULL GROUP BY page_id)
        SELECT page_id, coalesce(c.paragraphs, []) AS paragraphs FROM p LEFT JOIN c USING (page_id)
    """,
}
