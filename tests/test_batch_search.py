"""Search by a batch of requests in one scan, against the index of all words; what it writes."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loomdex import queries as core
from loomdex.functions import analysis
from loomdex.operators import batch_search, search
from loomdex.session import shared_dir

CONTENT = "struct<h1:array<string>,h2:array<string>,h3:array<string>,h4:array<string>,h5:array<string>,h6:array<string>,paragraphs:array<string>,full_text:string>"
PAGE = f"page_id long, url string, title string, content {CONTENT}, meta_description string, og_title string, og_description string"
COMMON = "stone bridge the library node.js libary ebook images walking walked of town 3d 1a1 кот".split()


def written(spark) -> int:
    path = shared_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(5)
    words = lambda n: " ".join(rnd.choice(COMMON) if rnd.random() < 0.3 else "".join(rnd.choices("abcdefghij", k=9)) for _ in range(n))
    pages = []
    for i in range(120):
        text = [words(rnd.randrange(40)) for _ in range(8)]
        lists = [[words(2)], None, [], [None, words(3)], None, None]
        pages.append((i, f"https://e.example/{i % 100}", words(5) if i % 9 else None, (*lists, text, " ".join(text) if i % 7 else None), words(8) if i % 2 else None, words(4) if i % 3 else "", None))
    pages += pages[:10] + [(None, None, "Stone bridge", None, None, "stone", None), (900, None, None, None, None, None, None), (901, "u", "The of", None, "stone bridge", None, None)]
    asked = ['"stone bridge"', '"the stone" town', '"node.js"', '"bridge of town"', '"the of"', '"walks library" stone', '"1a1"', '""', '"кот"', '"stone bridge"', '"', '"ebook images"', None]
    asked += ["librery", "stone bridges town walked", " ", "zzzz", "node.js ebook", "the stone", "the of", "3d librari walkin stown", "stone stone"]
    sf = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(pages, PAGE).repartition(3).write.parquet(f"{sf}/pages_index.parquet")
    spark.createDataFrame([(100 * i, q) for i, q in enumerate(asked)] + [(0, asked[0])], "query_id long, q string").write.parquet(f"{sf}/search_queries.parquet")
    return str(sf)


def index_of(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages_index.parquet").dropDuplicates(["page_id"])
    return search.written_index(search.page_fields(pages), analyzed=True)


def run(spark, sf, name):
    """Rows of a query and the bytes that it left in the shared folder."""
    before = written(spark)
    rows = core.QUERIES[name](spark, sf).collect()
    return rows, written(spark) - before


def test_quoted_needs_no_index(spark, corpus):
    got, wrote = run(spark, corpus, "bm25_quoted")
    ix = index_of(spark, corpus)
    asked = spark.read.parquet(f"{corpus}/search_queries.parquet").where("q LIKE '\"%\"'").select(F.col("query_id").alias("query"), F.col("q").alias("asked")).distinct()
    found = search.both([search.score(ix, search.request_terms(asked, analyzed=True)), search.phrase(ix, search.phrase_terms(asked), search.PHRASE_BOOSTS)])
    want = found.select("query", "doc", F.round("score", 5)).collect()
    assert len(want) > 20 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    source = sum(f.stat().st_size for f in os.scandir(f"{corpus}/pages_index.parquet"))
    assert wrote < source, (wrote, source)


def test_analyzed_needs_no_index(spark, corpus):
    got, wrote = run(spark, corpus, "bm25_analyzed")
    ix = index_of(spark, corpus)
    asked = spark.read.parquet(f"{corpus}/search_queries.parquet").where("trim(q) <> ''").select(F.col("query_id").alias("query"), F.col("q").alias("asked")).distinct()
    terms = search.request_terms(asked, analyzed=True, fuzzy=ix.terms).localCheckpoint()
    assert terms.where("variant > 0").count() > 3 and terms.where("variant = 0").groupBy("query", "pos").count().where("count > 1").count() > 0
    urls = spark.read.parquet(f"{corpus}/pages_index.parquet").dropDuplicates(["page_id"]).select(F.col("page_id").alias("doc"), "url")
    scored = search.score(ix, terms).join(urls, "doc").withColumn("exact", F.col("score")).withColumn("score", F.round("score", 9))
    want = search.top(scored, 10).select("query", "rank", "doc", F.round("exact", 5)).collect()
    assert len(want) > 50 and {r["rank"] for r in want} == set(range(1, 11))
    # urls repeat among the pages: where score and url are equal the page is open
    page = {r["doc"]: r["url"] for r in urls.collect()}
    plain = lambda rows: sorted((q, n, page[d], s) for q, n, d, s in map(tuple, rows))
    assert plain(got) == plain(want)
    source = sum(f.stat().st_size for f in os.scandir(f"{corpus}/pages_index.parquet"))
    assert wrote < source, (wrote, source)


def test_near_is_fuzziness():
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abc", k=rnd.randrange(2, 9))) for _ in range(300)]
    near = batch_search.Near(set(words[:30]))
    for w in words:
        want = any(w[:2] == a[:2] and analysis.edit_limit(a) and analysis.edits(a, w, analysis.edit_limit(a)) <= analysis.edit_limit(a) for a in words[:30])
        assert near(w) == want
