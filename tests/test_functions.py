"""Functions against hand-derived values."""

import pytest
from pyspark.sql import functions as F

from loomdex import config
from loomdex.functions import analysis, html, language, robots, schedule, text, url


def one(spark, value, column):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTP://Example.COM:80/a/", "http://example.com/a"), ("https://example.com:443/", "https://example.com/"), ("http://example.com:443/x", "http://example.com/x"),
        ("https://e.com", "https://e.com/"), ("https://e.com/p?b=2&a=1#f", "https://e.com/p?a=1&b=2"), ("https://e.com/p?q=a%20b", "https://e.com/p?q=a+b"),
        ("https://e.com/p?a", "https://e.com/p?a="), ("https://e.com/a//", "https://e.com/a/"), ("not a url", None), ("", None), (None, None),
        ("https://e.com:8080/x", "https://e.com:8080/x"),
    ],
)
def test_normalize(spark, raw, want):
    got = one(spark, raw, url.normalize)
    assert got == want
    if want and not want.endswith("a/"):  # one slash only is stripped at a time
        assert one(spark, got, url.normalize) == want


def test_safe(spark):
    good = ["https://e.com/", "http://172.15.0.1/", "http://169.254.1.1/"]
    bad = ["ftp://e.com/", "mailto:a@b.c", "http://localhost/", "http://10.0.0.1/", "http://172.16.0.1/", "http://192.168.1.1/", "http://127.9.9.9/", "http://0.0.0.0/", "http://224.0.0.1/", "", None]
    df = spark.createDataFrame([(u, True) for u in good] + [(u, False) for u in bad], "u string, want boolean")
    assert [r for r in df.withColumn("got", url.is_safe(F.col("u"))).collect() if r["got"] != r["want"]] == []


def test_resolve(spark):
    base = "https://a.com/d/e/f?x=1"
    cases = {"/r": "https://a.com/r", "g": "https://a.com/d/e/g", "../g": "https://a.com/d/g", "../../../g": "https://a.com/g", "./": "https://a.com/d/e/", "?y": "https://a.com/d/e/f?y", "#z": "https://a.com/d/e/f?x=1#z", "//b.c/h": "https://b.c/h", "mailto:q@r.s": "mailto:q@r.s"}
    df = spark.createDataFrame(list(cases.items()), "h string, want string")
    assert [r for r in df.withColumn("got", url.resolve(F.lit(base), F.col("h"))).collect() if r["got"] != r["want"]] == []


def test_cache_key(spark):
    key = url.cache_key({"q": F.lit("a b"), "p": F.lit(1), "l": F.lit(10), "domain": F.lit(None).cast("string"), "sort": F.lit("relevance"), "order": F.lit("desc")})
    assert spark.range(1).select(key).first()[0] == "l=10|order=desc|p=1|q=a%20b|sort=relevance"


def test_robots(spark):
    body = "User-agent: *\nDisallow: /private\nAllow: /private/ok\nDisallow: /x$\nDisallow: /*.pdf"
    df = spark.createDataFrame([(body, p, w) for p, w in {"/private/a": False, "/PRIVATE/a": False, "/private/ok/1": True, "/x": False, "/xy": True, "/a.pdf": True}.items()], "body string, path string, want boolean")
    p = df.withColumn("r", robots.parse(F.col("body")))
    got = p.withColumn("got", robots.is_allowed(F.concat(F.lit("https://e.com"), "path"), F.col("r.disallow"), F.col("r.allow")))
    assert [r for r in got.collect() if r["got"] != r["want"]] == []
    assert one(spark, "User-agent: *\nUser-agent: bot\nDisallow: /", robots.parse)["disallow"] == []
    assert one(spark, "Sitemap: https://A.com/S.xml\n", robots.sitemaps_of) == ["https://A.com/S.xml"]


def test_sitemap(spark):
    xml = "<loc> https://a.com/p </loc><loc>https://a.com/sitemap-2.xml.gz</loc><loc>ftp://x</loc>"
    assert one(spark, xml, robots.sitemap_locations) == ["https://a.com/p", "https://a.com/sitemap-2.xml.gz"]
    assert one(spark, "https://a.com/sitemap-2.xml.gz", robots.is_sitemap)


def test_boilerplate(spark):
    cases = {"Please log in to continue reading": True, "Cookie settings for this site": True, "He unmuted the microphone": True, "The cookie was tasty": False}
    df = spark.createDataFrame(list(cases.items()), "t string, want boolean")
    assert [r for r in df.withColumn("got", text.is_boilerplate(F.col("t"))).collect() if r["got"] != r["want"]] == []


def test_hash_words_window(spark):
    assert one(spark, "Title Body", text.content_hash) == "741d0c362998707880aac62c0fbb8ae1fff02c065b0e201696e09540409f630b"
    assert [one(spark, x, text.word_count) for x in ("", " a  b\n", None)] == [0, 2, 0]
    assert spark.range(1).select(text.page_window(F.lit(5), F.lit(10))).first()[0] == ["1", "…", "4", "5", "6", "…", "10"]
    assert spark.range(1).select(text.page_window(F.lit(1), F.lit(1))).first()[0] == ["1"]
    assert [tuple(x) for x in one(spark, "a <em>b</em> c", text.emphasis_parts)] == [("a ", False), ("b", True), (" c", False)]


def test_schedule(spark):
    df = spark.range(1)
    f = lambda c: df.select(c).first()[0]
    assert [f(schedule.retry_delay_ms(F.lit(n))) for n in (1, 2, 3, 4)] == [300_000, 600_000, 1_200_000, 1_200_000]
    assert [f(schedule.retry_delay_ms(F.lit(n), zero_based=True)) for n in (1, 2, 3)] == [600_000, 1_200_000, 1_200_000]
    assert [f(schedule.backoff_ms(F.lit(n), F.lit(r))) for r in (False, True) for n in (1, 2)] == [1000, 2000, 2000, 4000]
    route = lambda *a: tuple(f(schedule.error_route(*[F.lit(x) if x is not None else F.lit(None).cast("string") for x in a[:2]], *[F.lit(x).cast("int") for x in a[2:]])))
    assert route("404 Not Found", "link", None, None) == ("dead", None)
    assert route("timeout", "link", None, None) == ("retry", 1)
    assert route("timeout", "retry", 2, 3) == ("retry", 3)
    assert route("timeout", "retry", 3, 3) == ("drop", None)
    assert route("timeout", None, None, None) == ("retry", 1)


def test_porter_and_chain():
    pairs = "caresses caress ponies poni relational relat conditional condit hopping hop motoring motor sized size happy happi adjustment adjust triplicate triplic electricity electr controlling control".split()
    assert [analysis.porter(w) for w in pairs[::2]] == pairs[1::2]
    kept = {w for w in analysis.STOP_WORDS if analysis.porter(w) not in analysis.STOP_WORDS}
    assert kept == {"are", "they", "this", "was"}
    assert analysis.analyze("The PS5 and node.js!") == [(1, "ps"), (1, "5"), (3, "node"), (3, "js")]
    assert analysis.expand_synonyms(["javascript", "web"])[0] == {"javascript", "js"}


def test_edits():
    assert [analysis.edit_limit("x" * n) for n in (2, 3, 5, 6)] == [0, 1, 1, 2]
    assert analysis.edits("ab", "ba", 2) == 1
    assert analysis.edits("ca", "abc", 3) == 3
    assert analysis.edits("abc", "xyz", 1) == 2


PAGE = """<html><head><title>T</title><meta name="keywords" content="a, ,b "><meta property="og:title" content=" OG "><meta property="og:description" content="D">
</head><body><nav><h2>Menu</h2></nav><main><h1>Head</h1><p>short</p><p>This paragraph is longer than thirty characters.</p></main></body></html>"""


def test_html_page():
    p = html.parse_page(PAGE)
    assert (p["title"], p["meta_description"], p["meta_keywords"], p["h1"], p["h2"]) == ("OG", "D", ["a", "b"], ["Head"], ["Menu"])
    assert p["paragraphs"] == ["This paragraph is longer than thirty characters."]
    assert html.parse_page(None) is None
    assert html.parse_page("")["paragraphs"] == []
    broken = html.parse_page("<article><p>First <b>bold paragraph without any end tags at all<p>Second paragraph, also without an end tag &amp; more</article>")
    assert broken["paragraphs"] == ["First bold paragraph without any end tags at all", "Second paragraph, also without an end tag & more"]
    script = html.parse_page("<main><script>var x='</p><p>not a paragraph, it is longer than thirty';</script><p>A real paragraph of more than thirty letters.</p></main>")
    assert script["paragraphs"] == ["A real paragraph of more than thirty letters."]
    body = html.parse_page("<body><div class='sidebar'><p>This paragraph stands in a side bar of it.</p></div><div><p>This one stands in the content of the page.</p></div></body>")
    assert body["paragraphs"] == ["This one stands in the content of the page."]


def test_html_signals(spark):
    empty = F.create_map().cast("map<string,string>")
    assert one(spark, '<div id="root"></div>' + "x" * 100, html.spa_markers)
    assert not one(spark, PAGE, html.needs_rendering)
    assert one(spark, "<script src='a'></script>" * 30 + "text " * 100, html.needs_rendering)
    assert one(spark, "cloudflare ... ray id", lambda c: html.is_anti_bot(F.lit(200), c, empty))
    assert one(spark, "x" * 600, lambda c: html.is_anti_bot(F.lit(403), c, empty))
    assert not one(spark, "x" * 600 + "javascript", lambda c: html.is_anti_bot(F.lit(429), c, empty))


def test_language(spark):
    cases = {"The house is on the hill and it was sold": "eng", "Das Haus ist auf dem Hügel und nicht zu kaufen": "deu", "short": "und", "xxxx yyyy zzzz wwww qqqq": "und"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert [r for r in df.withColumn("got", language.detect(F.col("t"))).collect() if r["got"] != r["want"]] == []


def test_config():
    c = config.load({"LOOMDEX_MAX_DEPTH": "7", "LOOMDEX_GLOBAL_RPS": "-1", "LOOMDEX_RETRY_DELAYS": " 1,2 "})
    assert (c.max_depth, c.global_rps, c.retry_delays_ms) == (7, 10, [1, 2])
