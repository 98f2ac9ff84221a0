"""Operators on small tables: nulls, empty tables, repeated rows, ties, extra columns, paging and merge laws."""

import random

import pytest
from pyspark.sql import functions as F

from loomdex.operators import frontier, index_dml, paging, search, stats
from loomdex.plans.crawl import Request, Searcher, crawl_round
from loomdex.sources import readers
from loomdex.sources.store import IndexStore
from loomdex.streaming import frontier as streaming


# --- index changes ----------------------------------------------------------------------------------

def test_upsert(spark):
    s = "url string, domain string, title string, content struct<h1:array<string>,full_text:string>, first_indexed timestamp_ntz, last_indexed timestamp_ntz, updated_at timestamp_ntz"
    t0, now = "2024-01-01", F.lit("2024-06-01").cast("timestamp_ntz")
    from datetime import datetime

    d0 = datetime.fromisoformat(t0)
    index = spark.createDataFrame([("u1", "d", "A", (["x"], "f"), d0, d0, d0), ("u2", "d", "B", None, d0, d0, d0)], s)
    batch = spark.createDataFrame([("u1", None, (None, "g")), ("u3", "C", None)], "url string, title string, content struct<h1:array<string>,full_text:string>").withColumn("extra", F.lit(1))
    got = {r["url"]: r for r in index_dml.upsert(index, batch, now).collect()}
    assert set(got) == {"u1", "u2", "u3"} and got["u1"]["title"] == "A" and got["u1"]["content"]["h1"] == ["x"] and got["u1"]["content"]["full_text"] == "g"
    assert got["u1"]["first_indexed"] == d0 and got["u1"]["last_indexed"].month == 6 and got["u2"]["last_indexed"] == d0 and got["u3"]["first_indexed"].month == 6
    again = {r["url"]: r for r in index_dml.upsert(index_dml.upsert(index, batch, now), batch, now).collect()}
    assert again == got
    assert index_dml.upsert(index.limit(0), batch, now).count() == 2 and index_dml.upsert(index, batch.limit(0), now).count() == 2


def test_store(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"))
    store.ensure()
    assert store.version() == 1 and store.read().count() == 0
    store.ensure()
    assert store.version() == 1
    store.swap(store.read())
    assert store.version() == 2
    store.swap(store.read())
    store.vacuum(2)
    assert sorted(p.name for p in (tmp_path / "ix").glob("v=*")) == ["v=2", "v=3"]


# --- paging -------------------------------------------------------------------------------------------

@pytest.mark.parametrize("order", ["asc", "desc"])
def test_keyset_pages_are_the_ordering(spark, order):
    rows = [(f"u{i:02}", i % 4 + 0.1, i % 3) for i in range(23)]
    df = spark.createDataFrame(rows, "url string, score double, last_indexed int")
    for sort in ("date", "relevance"):
        want = [r["url"] for r in df.orderBy(*paging.order_columns(sort, order)).collect()]
        got, cursor = [], None
        for _ in range(10):
            page = [r.asDict() for r in paging.keyset_page(df, sort, order, cursor, 5).collect()]
            got += [r["url"] for r in page[:5]]
            if len(page) <= 5:
                break
            cursor = paging.cursor_of(page[4], sort)
        assert got == want
        assert [r["url"] for n in range(1, 6) for r in paging.offset_page(df, paging.order_columns(sort, order), n, 5).collect()] == want
    with pytest.raises(ValueError):
        paging.offset_page(df, paging.order_columns(None, None), 0, 5)


def test_envelope():
    e = paging.envelope(23, 2, 10, {"score": 1.5, "url": "u"}, None)
    assert (e.total_pages, e.next_cursor) == (3, '[1.5, "u"]')
    assert paging.envelope(20, 2, 10, {"score": 1.5, "url": "u"}, None).next_cursor is None
    assert paging.envelope(0, 1, 10, None, "date").total_pages == 0


# --- frontier -----------------------------------------------------------------------------------------

def test_capacity(spark):
    jobs = spark.createDataFrame([(i,) for i in range(3)], "id long")
    count = lambda queued: jobs and frontier.accept(jobs, "id", queued).where("accepted").count()
    assert (count(49_999), count(50_002), count(0)) == (1, 0, 3)
    many = spark.range(0, 200_000, 3).withColumnRenamed("id", "k")
    taken = frontier.accept(many, "k", 0, 30_000).where("accepted")
    assert taken.count() == 30_000 and taken.agg(F.max("k")).first()[0] == 3 * 29_999


def test_page_links(spark):
    hrefs = ["/1", "https://b.com/x", "/2", "/1#z", "mailto:q@r.s", "/p?utm_source=x"]
    df = spark.createDataFrame([(hrefs, "https://a.com/")], "h array<string>, b string")
    got = df.select(frontier.page_links(F.col("h"), F.col("b"))).first()[0]
    assert got == ["https://a.com/2", "https://a.com/1", "https://b.com/x", "mailto:q@r.s"]


def test_frontier_never_revisits(spark):
    jobs = spark.createDataFrame([("http://A.com/x/", 0, "seed", 2), ("http://a.com/x", 1, "link", 1), ("http://a.com/y#q", 0, None, 3), (None, 0, None, 4), ("nope", 0, None, 5)], "url string, depth int, source string, enqueued_at long")
    first = frontier.first_seen(frontier.usable_jobs(jobs, 5), "enqueued_at")
    assert {(r["normalized"], r["depth"]) for r in first.collect()} == {("http://a.com/x", 1), ("http://a.com/y", 0)}
    visited = frontier.mark_visited(spark.createDataFrame([], "url string, last_indexed long"), first, F.lit(9))
    assert frontier.not_visited(first, visited).count() == 0


def test_crawl_round(spark):
    page = "<html><title>T</title><body><article><p>{}</p></article><a href='/n'>n</a><a href='https://o.example/'>o</a></body></html>"
    jobs = spark.createDataFrame([("https://a.example/p", 0, "seed", 1), ("https://a.example/private/q", 0, "seed", 2), ("http://10.0.0.1/", 0, "seed", 3)], "url string, depth int, source string, enqueued_at long")
    fetched = spark.createDataFrame([("https://a.example/p", page.format("This paragraph is longer than thirty characters.")), ("https://a.example/private/q", page.format("x"))], "url string, html string")
    rules = spark.createDataFrame([("a.example", ["/private"], None)], "domain string, rules array<string>, allow_rules array<string>")
    visited = spark.createDataFrame([], "url string, last_indexed long")
    now, ms = F.lit("2024-06-01").cast("timestamp_ntz"), F.lit(5)
    r = crawl_round(jobs, fetched, index_dml.empty_index(spark), visited, rules, now, ms)
    rows = r.index.collect()
    assert [x["url"] for x in rows] == ["https://a.example/p"] and rows[0]["word_count"] == 7 and rows[0]["title"] == "T"
    assert {x["url"] for x in r.queue.collect()} == {"https://a.example/n", "https://o.example/"} and r.visited.count() == 1
    again = crawl_round(jobs, fetched, r.index, visited, rules, now, ms)
    assert [tuple(x) for x in again.changes.collect()] == [("touch", 1)]


def test_readers(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("# c\n\n https://a.example/ \nhttps://b.example/\n")
    assert {r["url"] for r in readers.seeds(spark, str(tmp_path / "seeds.txt")).collect()} == {"https://a.example/", "https://b.example/"}
    changed, h = readers.seeds_changed(spark, str(tmp_path / "seeds.txt"), None)
    assert changed and not readers.seeds_changed(spark, str(tmp_path / "seeds.txt"), h)[0]
    assert readers.submitted(spark, "http://localhost/", 1, 5).count() == 0 and readers.submitted(spark, "http://e.com/", 1, 5).first()["source"] == "manual"
    bodies = spark.createDataFrame([("a.example", "Sitemap: https://a.example/s.xml\nUser-agent: *\nDisallow: /x"), ("b.example", None)], "domain string, body string")
    assert readers.robots_rules(bodies, 1).first()["rules"] == ["/x"]
    assert readers.candidate_sitemaps(bodies.select("domain"), bodies).where("domain = 'a.example'").count() == 7


# --- search -------------------------------------------------------------------------------------------

def tiny_index(spark):
    rows = [(1, "text", ["spark sql engine"]), (2, "text", ["spark spark streaming"]), (3, "text", ["web search engine ranking"])]
    return search.build_index(spark.createDataFrame(rows, "doc long, field string, values array<string>"))


def test_bm25_values(spark):
    ix = tiny_index(spark)
    terms = search.query_terms(spark, [(0, "spark engine")])
    assert {r["doc"]: round(r["score"], 6) for r in search.score(ix, terms, {"text": 1.0}).collect()} == {1: 0.445501}
    single = {w: {r["doc"]: round(r["score"], 6) for r in search.score(ix, search.query_terms(spark, [(0, w)]), {"text": 1.0}).collect()} for w in ("spark", "engine")}
    assert single["spark"][2] == 0.302253 and single["engine"][3] == 0.197481


def test_required(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 8)], "n int")
    assert [r[0] for r in df.select(search.required(F.col("n"))).collect()] == [1, 2, 2, 3, 3, 6]


def test_phrase_and_quotes(spark):
    rows = [(1, "text", ["a stone bridge here", "stone"]), (2, "text", ["bridge stone"]), (3, "text", ["the stone", "bridge"])]
    ix = search.build_index(spark.createDataFrame(rows, "doc long, field string, values array<string>"))
    got = search.phrase(ix, search.query_terms(spark, [(0, "stone bridge")]), {"text": 1.0})
    assert [r["doc"] for r in got.collect()] == [1]
    assert search.phrase_of('x "a b" "c"') == "a b" and search.phrase_of(None) is None


def test_fuzzy_and_synonyms(spark):
    rows = [(1, "text", ["javascript engine"]), (2, "text", ["libary books"]), (3, "text", ["library"])]
    ix = search.build_index(spark.createDataFrame(rows, "doc long, field string, values array<string>"), analyzed=True)
    ask = lambda q: {r["doc"]: r["score"] for r in search.score(ix, search.query_terms(spark, [(0, q)], analyzed=True, fuzzy=ix.terms), {"text": 1.0}).collect()}
    assert set(ask("library")) == {2, 3} and ask("library")[3] > ask("library")[2]
    assert set(ask("ebook")) == {2}
    assert ask("zzzz") == {}


def test_highlight_fragments():
    body = "The stone bridge was closed. " * 3 + "Nothing else. " * 20 + "A bridge again."
    got = search.fragments(body, {"bridge"})
    assert len(got) == 2 and all("<em>bridge</em>" in x for x in got)
    assert search.fragments(None, {"x"}) == [] and search.fragments("abc", set()) == []


def test_autocomplete(spark):
    t = spark.createDataFrame([("u1", "Hello World"), ("u2", "Say hello"), ("u3", None)], "url string, title string")
    ask = lambda q: {r["url"] for r in search.complete_titles(t, q).collect()}
    assert [ask(q) for q in ("hel", "hello wo", "hell wo", "world hello", "w")] == [{"u1", "u2"}, {"u1"}, set(), set(), set()]


def test_searcher(spark):
    c = "struct<h1:array<string>,h2:array<string>,h3:array<string>,h4:array<string>,h5:array<string>,h6:array<string>,paragraphs:array<string>,full_text:string>"
    s = f"page_id long, url string, domain string, title string, content {c}, meta_description string, og_title string, og_description string, content_type string, word_count int, language string, last_indexed timestamp_ntz"
    from datetime import datetime

    body = lambda t: (None, None, None, None, None, None, [t], t)
    rows = [(i, f"https://e.com/{i}", "e.com", "Stone bridge" if i % 2 else "Other", body("The stone bridge of the town." if i % 2 else "Nothing here"), "M", None, None, "static", 5, "eng", datetime(2024, 1, i)) for i in range(1, 8)]
    now = [0.0]
    e = Searcher.build(spark.createDataFrame(rows, s))
    e.clock = lambda: now[0]
    a = e.search(Request('"stone bridge"', limit=3))
    assert a["total"] == 4 and len(a["results"]) == 3 and a["total_pages"] == 2 and "<em>" in a["results"][0]["description"]
    b = e.search(Request('"stone bridge"', limit=3, cursor=a["next_cursor"]))
    assert [x["url"] for x in b["results"]] == ["https://e.com/7"] and b["next_cursor"] is None and (b["page"], b["total_pages"]) == (1, 0)
    assert e.search(Request('"stone bridge"', limit=3)) is a and len(e.cached) == 1
    now[0] = 31
    assert e.search(Request('"stone bridge"', limit=3)) is not a
    assert e.search(Request("bridge", domain="x.com"))["total"] == 0
    assert [x["url"] for x in e.search(Request("bridge", sort="date", limit=1))["results"]] == ["https://e.com/7"]
    assert e.autocomplete("stone br")[0]["text"] == "Stone bridge"
    with pytest.raises(ValueError):
        e.search(Request(""))


# --- statistics and streams -----------------------------------------------------------------------------

def test_crawl_speed(spark):
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(f"u{i}", t + timedelta(seconds=60 * i)) for i in range(3)], "url string, last_indexed timestamp_ntz")
    assert tuple(stats.crawl_speed(df).first()) == (3, 1.5, 90.0)
    assert tuple(stats.crawl_speed(df.limit(1)).first()) == (1, 0.0, 0.0)
    assert stats.crawl_speed(df.limit(0)).first()["pages"] == 0
    with pytest.raises(ValueError):
        stats.stats("nope", df, {})


def test_token_bucket_steps():
    passed, tokens, last = streaming.take_tokens([0, 0, 0, 500, 1000], 2, None, 1.0, 2.0)
    assert passed == [True, True, False, False, True] and last == 1000 and tokens == 0


def test_streams_equal_batch(spark, tmp_path):
    df = spark.createDataFrame([("http://a.com/x", 1), ("http://A.com/x/", 2), ("http://b.com/", 3), (None, 4)], "url string, enqueued_at long")
    df.coalesce(1).write.parquet(str(tmp_path / "crawl_jobs.parquet"))
    got = streaming.run_available(streaming.unseen(streaming.table_stream(spark, str(tmp_path), "crawl_jobs")).select("normalized"))
    assert {r[0] for r in got.collect()} == {"http://a.com/x", "http://b.com/"}
