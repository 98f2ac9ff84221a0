"""Operators for training data on small tables: methods, edge cases and brute-force comparisons."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.llm import boosting, bpe, langid, mixture, packing, pages, pii, pii_training, repeated, residue, stats, wrappers

PAGES = "page_id long, domain string, title string, content struct<paragraphs:array<string>>, extra int"


def page_table(spark, rows):
    return spark.createDataFrame([(i, d, t, (p,) if p is not False else None, 1) for i, d, t, p in rows], PAGES)


PROSE = [
    "The choir met on Friday evening and sang for an hour. After that the members talked about the trip to the coast, which had been put off twice.",
    "A bus that had been ordered for the school arrived two days late. The driver said that the road was closed, so he took the long way.",
    "Nobody wanted to wait any longer for the letter. In the end it came by mail, and everyone who had asked for it was glad to read it.",
    "The mill by the river has a new wheel since the spring. It was built by two brothers who had learned the trade from their aunt.",
]


# --- problem 3 ------------------------------------------------------------------------------------------

def brute_repeated(rows, least):
    import unicodedata

    key = lambda x: "".join(c for c in x if unicodedata.category(c)[0] == "L").lower()
    on = {}
    for i, d, _, ps in rows:
        for x in ps or []:
            if x and key(x) and d:
                on.setdefault((d, key(x)), set()).add(i)
    return {(i, n) for i, d, _, ps in rows for n, x in enumerate(ps or []) if x and d and len(on.get((d, key(x)), ())) >= least}


def test_repeated_lines(spark):
    r = random.Random(1)
    variants = ["Share this page!", "share THIS page", "Share — this · page 12", "Élan vital", "élan, vital", "12345", "", None, "once only", "Copyright 2020"]
    rows = [(r.randrange(10_000), r.choice(["a", "a", "b", None]), None, r.choice([None, [r.choice(variants) for _ in range(r.randrange(4))]])) for _ in range(120)]
    rows = list({x[0]: x for x in rows}.values())
    df = page_table(spark, rows + rows[:30])  # doubled deliveries count once
    for least in (2, 6, 12):
        got = repeated.repeated_lines(df, least)
        assert {(x["page_id"], x["para_no"]) for x in got.collect()} == brute_repeated(rows, least)
        assert got.count() == len(brute_repeated(rows, least))
    assert repeated.repeated_lines(df.limit(0)).count() == 0
    clean = repeated.without_lines(page_table(spark, rows), repeated.repeated_lines(df, 6)).collect()
    gone = brute_repeated(rows, 6)
    by = {x["page_id"]: x for x in clean}
    for i, _, _, ps in rows:
        want = None if ps is None else [x for n, x in enumerate(ps) if (i, n) not in gone]
        assert by[i]["content"]["paragraphs"] == want and by[i]["extra"] == 1


# --- problem 8 ------------------------------------------------------------------------------------------

TEXTS = ["", "a", "hello world", "  two  blanks \n\n and\ttabs ", "<|endoftext|> is text", "naïve café Привет 你好 👩‍🌾", "a\x1cb \x00\x07", "don't we'll I'M", "x" * 5000, "ab" * 3000 + " 123456789", "\r\n\r\n end ", "​ zero\xa0width", "½²™ﬁ"]


def test_bpe_equals_public_library(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    r = random.Random(0)
    more = ["".join(r.choice("ab c\n1.é—\t'sдЖ") for _ in range(r.randrange(60))) for _ in range(200)]
    texts = TEXTS + more
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    df = spark.createDataFrame([(i, x, "ids") for i, x in enumerate(texts)] + [(len(texts), None, None)], "doc_id long, text string, ids string")
    got = {x["doc_id"]: x["ids"] for x in bpe.token_ids(df).collect()}
    assert [got[i] for i in range(len(texts))] == want and got[len(texts)] == []
    counts = {x["doc_id"]: x["n_tokens"] for x in bpe.token_counts(df).collect()}
    assert all(counts[i] == len(x) for i, x in enumerate(want)) and counts[len(texts)] == 0
    assert bpe.token_ids(df.limit(0)).count() == 0
    assert bpe.one_row_per_key(df.unionByName(df.limit(3)), "doc_id").count() == len(texts) + 1


def test_bpe_heap_equals_scan():
    enc = bpe.Encoder()
    r = random.Random(2)
    for _ in range(200):
        w = bytes(r.choice(b"aabcdethinro ") for _ in range(r.randrange(2, 160)))
        assert bpe.merge_word(w, enc.ranks) == bpe._merge_long(w, enc.ranks)


# --- problem 9 ------------------------------------------------------------------------------------------

def test_fill_window_is_optimal():
    r = random.Random(3)
    for _ in range(200):
        counts = {s: r.randrange(1, 4) for s in r.sample(range(1, 30), r.randrange(1, 6))}
        left = r.randrange(1, 60)
        got = packing.fill_window(left, sorted(counts, reverse=True), counts)
        assert all(0 < k <= counts[s] for s, k in got.items())
        sums = {0}
        for s, n in counts.items():
            sums = {x + s * k for x in sums for k in range(n + 1)}
        assert sum(s * k for s, k in got.items()) == max(x for x in sums if x <= left)


def first_fit(sizes, cap):
    """Containers that first fit decreasing needs."""
    room = []
    for s in sorted(sizes, reverse=True):
        i = next((i for i, x in enumerate(room) if x >= s), None)
        if i is None:
            room.append(cap - s)
        else:
            room[i] -= s
    return len(room)


def test_packing(spark):
    r = random.Random(4)
    sizes = [r.choice([0, 1, 7, 7, 7, 30, 64, 99, 100, 101, 250, 333]) for _ in range(500)]
    counts = spark.createDataFrame([(i, n, 0) for i, n in enumerate(sizes)], "doc_id long, n_tokens int, size int")
    targets = spark.createDataFrame([(1, 100), (5, 256)], "target_id int, capacity_tokens int")
    rows = packing.pack(counts, targets).collect()
    for target, cap in ((1, 100), (5, 256)):
        mine = [x for x in rows if x["target_id"] == target]
        bins, docs = {}, {}
        for x in mine:
            bins.setdefault(x["container"], []).append(x)
            docs.setdefault(x["doc_id"], []).append(x)
        assert sorted(docs) == list(range(500))
        for i, ps in docs.items():
            n = max(1, sizes[i])
            assert sum(p["size"] for p in ps) == n and sorted(p["piece"] for p in ps) == list(range(len(ps))) and len(ps) == -(-n // cap)
        for ps in bins.values():
            assert sum(p["size"] for p in ps) <= cap and sorted(p["place"] for p in ps) == list(range(len(ps)))
        assert sorted(bins) == list(range(len(bins)))
        assert len(bins) <= first_fit([x["size"] for x in mine], cap) + 1
    assert packing.pack(counts.limit(0), targets).count() == 0
    with pytest.raises(ValueError):
        packing.pack(counts, spark.createDataFrame([(1, 0)], "target_id int, capacity_tokens int"))


# --- problems 1, 4, 5, 6 --------------------------------------------------------------------------------

VERBS = "sang met saw left found made took lost sold built moved kept".split()
NOUNS = "choir bus driver letter mill river wheel teacher lake road brother aunt window market song boat garden school".split()


def article(r):
    """Sentences of their own."""
    one = lambda: f"{r.choice(['The', 'A', 'One', 'Her', 'That'])} {r.choice(NOUNS)} {r.choice(VERBS)} the {r.choice(NOUNS)} of a {r.choice(NOUNS)} with the {r.choice(NOUNS)} in the {r.choice(NOUNS)}."
    return " ".join(one() for _ in range(r.randrange(2, 6)))


def site(n, start, host, r):
    """Pages of one site: a menu, a labelled link and a notice around articles of their own."""
    out = []
    for i in range(n):
        lines = ["Home | News | Sport | Jobs", *(article(r) for _ in range(3)), f"Read also: the {r.choice(['bridge', 'mill', 'bus', 'choir', 'lake', 'school'])} of {r.randrange(1000)} tales by {r.choice(['ann', 'bob', 'eve'])}"]
        if r.random() < 0.5:
            lines.insert(2, f"Write to {host} if you find a mistake on page {i}.")
        out.append((start + i, f"www.{host}.example", "A walk", lines))
    return out


def inferred(df):
    """The wrapper of each host of a table, by domain."""
    domains = {r["d"]: r["domain"] for r in df.where("domain IS NOT NULL").select(F.xxhash64("domain").alias("d"), "domain").distinct().collect()}
    return {domains[r["d"]]: wrappers.Wrapper(domains[r["d"]], r["entries"]) for r in wrappers.wrappers(df).collect()}


def test_align_resolves_mismatches():
    go = lambda *x: wrappers.infer_template(x).split(" ")
    S, O, R = wrappers.SLOT, wrappers.OPTIONAL, wrappers.REPEATED
    assert go("read also : the mill", "read also : a bus to town") == ["read", "also", ":", f"{S}2,4"]
    assert go("posted by ann in news", "posted in news") == ["posted", f"{O}by_ann", "in", "news"]
    assert go("tag tag end", "tag end", "tag tag tag end")[-1] == "end" and any(x[0] == R for x in go("tag tag end", "tag end"))
    both = go("comments on the bridge show all", "comments on old mills of the north show all")
    assert both[:2] == ["comments", "on"] and both[-2:] == ["show", "all"] and any(x[0] == S for x in both)
    variants = ["by ann in news", "by bob smith in news", "by ann and eve in town news", "in news"]
    match = __import__("re").compile(wrappers.expression(wrappers.infer_template(variants))).fullmatch
    assert all(match(" " + v) for v in variants) and not match(" at home in news of the day")
    r = random.Random(9)
    for _ in range(200):
        vs = [" ".join(r.choice("ab:cd") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 6))]
        found = wrappers.infer_template(vs)
        assert all(__import__("re").fullmatch(wrappers.expression(found), " " + v) for v in vs), (vs, found)
    assert wrappers.infer_template([]) == "" and wrappers.infer_template(["a b"]) == "a b"


def test_wrappers(spark):
    r = random.Random(5)
    rows = site(30, 0, "lorena", r) + site(30, 100, "pirana", r)
    found = inferred(page_table(spark, rows))
    w = found["www.lorena.example"]
    assert w.furniture("Home | News | Sport | Jobs") and w.furniture("  HOME |  NEWS | Sport | Jobs ")
    assert w.furniture("Jobs | Sport | News | Home") and not w.furniture("jam | bread | tea | soap")
    assert w.furniture("Read also: the lake of 7 tales by ann")
    assert w.furniture("Write to lorena if you find a mistake on page 7.")
    assert not any(w.furniture(x) for x in [*(article(r) for _ in range(50)), "", None, "12 34", "A single line that stands alone.", "- the old bridge, Marlow"])
    assert inferred(page_table(spark, rows).limit(0)) == {}
    assert inferred(page_table(spark, [(1, None, None, None), (2, "a", None, [None, ""]), (3, "a", None, False)])) == {}


def test_wrappers_stay_on_their_host(spark):
    r = random.Random(7)
    notice = "Please read the terms of this shop before you order anything from it."
    rows = [(i, d, t, [*p, notice]) for i, d, t, p in site(30, 0, "lorena", r)] + site(30, 100, "pirana", r)
    # an article of another host quotes the notice
    rows += [(200, "www.pirana.example", "T", [article(r), notice])]
    found = {x["page_id"]: x["furniture"] for x in pages.scan(page_table(spark, rows), wrappers.wrappers(page_table(spark, rows))).collect()}
    assert all(len(p) - 1 in found[i] for i, d, _, p in rows[:30]) and found[200] == []
    # three hosts that use a template make it one of every host that shows it
    rows += [(1000 * k + i, f"{d}.example", "T", [article(r), notice] if i < 9 else [article(r)]) for k, d in enumerate(("alba", "birk", "cove"), 1) for i in range(20)]
    found = {x["page_id"]: x["furniture"] for x in pages.scan(page_table(spark, rows), wrappers.wrappers(page_table(spark, rows))).collect()}
    assert found[200] == [1]


def test_wrappers_do_not_recombine(spark):
    r = random.Random(11)
    rows = [(i, "a.example", "T", [article(r), "Subscribe to our weekly newsletter", "Read our terms of use"]) for i in range(20)]
    w = inferred(page_table(spark, rows))["a.example"]
    assert w.furniture("Subscribe to our weekly newsletter") and w.furniture("Read our terms of use!")
    assert not w.furniture("Read our weekly newsletter") and not w.furniture("subscribe to our terms of use")


def test_wrappers_no_host_outvotes_the_others(spark):
    own = lambda d, i: [f"Page {d} {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]} tells of its own things."]
    small = [f"{x}.example" for x in ("alba", "birk", "cove", "dune", "elms", "ford", "glen", "holm")]
    rows = [(1000 * k + i, d, "T", own(d[:4], i) + (["Read also about rivers"] if i < 5 else [])) for k, d in enumerate(small) for i in range(200)]
    # a third of the pages is of one host, which has the line once
    rows += [(9000 + i, "mega.example", "T", own("mega", i) + (["Read also about rivers"] if i == 0 else []) + (["Our own menu here"] if i % 2 else [])) for i in range(800)]
    df = page_table(spark, rows)
    found = inferred(df)
    assert all(found[d].furniture("Read also about rivers") for d in (*small, "mega.example")) and found["mega.example"].furniture("Our own menu here")
    assert not found["alba.example"].furniture("Our own menu here")
    # a large host is spread over tasks, and no page is lost or doubled
    scanned = pages.scan(df.unionByName(df.limit(40)), wrappers.wrappers(df))
    assert scanned.count() == len(rows) == scanned.select("page_id").distinct().count()
    assert pages.by_host(df, wrappers.wrappers(df)).where("page_id IS NULL AND d = xxhash64('mega.example')").count() > 100


def test_wrappers_of_any_length(spark):
    r = random.Random(8)
    legal = "This notice, number 7, is a legal text. " * 6 + "All rights stay with the owner of the site."
    huge = "Terms of use: " + "nothing here may be copied without leave, " * 40
    cookies = lambda who: f"We and our partners store and read information on your device for the purposes named below, and {who} {'may do the same on all pages of this site ' * 6}until you change your choice in the settings."
    copied = "The mill by the river was painted again this spring, " * 6
    rows = site(30, 0, "lorena", r)
    rows = [(i, d, t, [*p, legal, huge, cookies(r.choice(NOUNS)), "Home", "My account", *([copied] if i < 3 else []), *(["Tea"] if i < 2 else [])]) for i, d, t, p in rows]
    w = inferred(page_table(spark, rows))["www.lorena.example"]
    assert len(cookies("x").split()) > 60
    assert all(w.furniture(x) for x in (legal, legal.replace("7", "12").upper(), huge, cookies("somebody"), "Home", "» My account"))
    assert not any(w.furniture(x) for x in (copied, "Tea", "Home made", legal + " And more of it.", " ".join(PROSE * 9)))


def test_wrappers_align_whole_long_lines(spark):
    r = random.Random(12)
    ends = lambda middle: f"Dear readers of our small paper from the old town by the river, {middle} so we wish all of you a quiet week and a very warm evening at home."
    own = [ends(" ".join(r.choice(NOUNS) + r.choice(VERBS) for _ in range(40))) for _ in range(30)]
    notice = lambda who: ends(f"please note that {who} may not copy any text of this paper {'without the written leave of its owner ' * 5}")
    dashes = "-" * 70 + " Nothing on these pages may be sold, printed or read aloud. " * 4 + "=" * 70
    rows = [(i, d, t, [*p, own[i], notice(r.choice(NOUNS)), dashes]) for i, d, t, p in site(30, 0, "lorena", r)]
    found = {x["page_id"]: x["furniture"] for x in pages.scan(page_table(spark, rows), wrappers.wrappers(page_table(spark, rows))).collect()}
    assert all(len(p) - 3 not in found[i] and found[i][-2:] == [len(p) - 2, len(p) - 1] for i, _, _, p in rows)
    w = inferred(page_table(spark, rows))["www.lorena.example"]
    assert w.furniture(notice("somebody")) and not w.furniture(ends("we " * 60)) and not w.furniture(notice("somebody") + " Or so.")
    # more variants than one piece holds
    rows = [(i, "www.big.example", "T", [article(r), own[i % 30], notice(f"{r.choice(NOUNS)} {'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100]}")]) for i in range(700)]
    rows = [(i, d, t, p if i % 30 < 3 else [p[0], p[2]]) for i, d, t, p in rows]
    w = inferred(page_table(spark, rows))["www.big.example"]
    assert all(w.furniture(p[-1]) for *_, p in rows) and not w.furniture(ends("we " * 60))


def test_ends_are_those_of_the_whole_line(spark):
    r = random.Random(13)
    bits = ["Straßenverkehrsordnungsänderung", "a", "der", "12", "1.5:30/:/:/", "—", "|", "/", ":", "…", "Тестирование", "42,", "»", " ", "x" * 70, "-" * 40]
    lines = [" ".join(r.choice(bits) for _ in range(r.randrange(20, 90))) for _ in range(400)]
    lines = [x for x in lines if len(x) > wrappers.LONG_CHARS]
    df = spark.createDataFrame(list(enumerate(lines)), "i long, line string").select("i", wrappers.line_ends(F.col("line")).alias("t"))
    n = wrappers.LONG_EDGE_WORDS
    want = [wrappers.line_tokens(x) for x in lines]
    assert len(lines) > 300 and {x["i"]: x["t"] for x in df.collect()} == {i: " ".join([*t[:n], *t[-n:]]) if t else "" for i, t in enumerate(want)}


def test_texts_and_matches_of_long_lines():
    r = random.Random(14)
    for _ in range(300):
        a, b = ([r.choice("abcde") for _ in range(r.randrange(25))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        halves, wrappers.LCS_BYTES = wrappers.LCS_BYTES, 1
        found = [wrappers._lcs(a, b)]
        wrappers.LCS_BYTES = halves
        found.append(wrappers._lcs(a, b))
        assert all(len(m) == best[-1][-1] and all(a[i] == b[j] for i, j in m) and sorted(set(m)) == m for m in found)
        vs = [" ".join(r.choice("ab:cd") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 6))]
        t = wrappers.infer_template(vs[:3])
        assert [wrappers.is_text(t, v.split(" ")) for v in vs] == [__import__("re").fullmatch(wrappers.expression(t), " " + v) is not None for v in vs]
    assert wrappers.infer_texts([]) == []
    got = wrappers.infer_texts([("a b c d e", 3), ("a b x d e", 2), ("a p q r e", 9), ("a s t u e", 1)])
    assert got == [("a p q r e", 9), (f"a b {wrappers.SLOT}1,1 d e", 5)]


def test_assess(spark):
    r = random.Random(6)
    rows = site(40, 0, "lorena", r)
    menu = "Home | News | Sport | Jobs"
    spam = " ".join(f"buy red shoes, cheap red shoes {r.choice(['sale', 'order', 'best'])}," for _ in range(60))
    links = [f"http://www.site{i}.example/p" for i in range(12)]
    rows += [
        (900, "x.example", "Shoes", [menu, spam]), (901, "x.example", "Links", links), (902, "x.example", "T", [f"• {w}, {i} kg" for i, w in enumerate("tea jam soap ink milk rope tiles cups pears wool".split())]),
        (903, "x.example", "T", ["a\tb\tc"] + [f"{i}\t{i * 37}.5%\t-" for i in range(12)]), (904, "x.example", "404 – Page not found", ["x"]), (905, "x.example", "{{ title }}", PROSE[:2]),
        (906, "x.example", "T", ["Lorem ipsum dolor sit amet, consectetur adipiscing elit.", PROSE[0]]), (907, "x.example", "T", ["When the server died, people saw the words 404 not found for two days and learned to laugh about it.", *PROSE[:2]]),
        (908, "x.example", None, None), (909, None, "", [None, ""]), (910, "x.example", "T", False), (911, "x.example", "long", [" ".join(PROSE * 400)]),
    ]
    df = page_table(spark, rows + rows[:5])
    got = {x["page_id"]: x for x in pages.assess(df).collect()}
    assert len(got) == len(rows)
    assert {i for i in got if got[i]["residue"]} == {904, 905, 906}
    assert {i for i in got if got[i]["spam"]} == {900, 901}
    assert got[902]["low_quality"] and got[903]["low_quality"] and not got[907]["low_quality"] and not got[911]["low_quality"]
    assert all(got[i]["sound"] for i in range(40)) and all(0 in got[i]["furniture"] for i in range(40))
    assert got[908]["stats"] is None and got[908]["kind"] is None and not got[908]["low_quality"] and got[910]["furniture"] == []


def test_residue_lines():
    x = residue.Residue()
    yes = ["You need to enable JavaScript to run this app.", "Die angeforderte Seite existiert nicht (mehr). Bitte prüfen Sie die Adresse.", "Hello {{ first_name }} of ${home.town}!", "К сожалению, запрошенная страница не существует.", "Lorem ipsum dolores quadrant sub mirabilis."]
    no = ["", None, "Internal server error was the title that the band chose for its record.", "Printers still use lorem ipsum as filler when they show a layout, because readable words distract.", "A name in double braces, such as {{ town }}, is replaced by the value before the page is sent to the reader."]
    assert all(map(x.line, yes)) and not any(map(x.line, no))
    assert x.title("Error") and x.title("%%TITLE%%") and not x.title("The error of the clock") and not x.title(None)


def test_residue_coverage_of_the_document(spark):
    error = "Page not found. Please try again later."
    rows = [(1, "T", [error]), (2, "T", [error, *PROSE * 3]), (3, "T", PROSE), (4, None, None), (5, "", [None, ""])]
    df = spark.createDataFrame(rows, "page_id long, title string, paragraphs array<string>")
    got = {x["page_id"]: x for x in residue.residue_pages(df).collect()}
    assert [got[i]["residue"] for i in range(1, 6)] == [True, True, False, False, False]
    assert got[1]["coverage"] > 0.8 and 0 < got[2]["coverage"] < 0.1 and got[3]["coverage"] == got[4]["coverage"] == got[5]["coverage"] == 0
    assert {x["page_id"] for x in residue.without_residue(df).collect()} == {2, 3, 4, 5}


def test_stats_and_compression():
    assert stats.text_stats(None) is None and stats.text_stats(" \n ") is None
    s = dict(zip(stats.NAMES, stats.text_stats("The cat is on the mat.\nno end"), strict=True))
    assert (s["words"], s["end_punctuation"], s["words_per_line"]) == (8, 0.5, 4) and abs(s["common_share"] - 4 / 8) < 0.2
    assert stats.redundancy("buy shoes now, " * 200) < 0.4 < 0.8 < stats.redundancy(" ".join(PROSE)) and stats.redundancy("") == 1.0
    links = " ".join(f"http://www.place{i}.example/{i * 37 % 91}" for i in range(40))
    assert stats.redundancy(links) < 0.5 and stats.main_language(PROSE[0]) == "eng" and stats.main_language("") is None and stats.main_language("12 34") is None


def test_mixture_recovers_clusters():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.3, (200, 2)) for m in ((0, 0), (5, 0), (0, 5))])
    m = mixture.fit(x, 3, x.mean(0), x.std(0))
    k = m.posterior(x).argmax(1)
    assert sorted(np.bincount(k, minlength=3)) == [200, 200, 200] and len(set(k[:200])) == 1
    assert mixture.fit(x[:2], 5, x.mean(0), np.zeros(2)).posterior(x[:1]).sum() == pytest.approx(1)
    # sums of parts are sums of the whole, and further rounds keep a settled fit
    assert np.allclose(m.sums(x), m.sums(x[:100]) + m.sums(x[100:]) + m.sums(x[:0]))
    again, _ = m.refit(m.sums(x))
    assert (again.posterior(x).argmax(1) == k).all() and np.allclose(again.centers, m.centers, atol=0.02)


# --- problem 2 ------------------------------------------------------------------------------------------

LANGS = {
    "eng": PROSE,
    "deu": ["Der Chor traf sich am Freitag und sang eine Stunde lang. Danach sprachen die Mitglieder über die Reise an die Küste.", "Das Rathaus bleibt in der nächsten Woche geschlossen, weil die Fenster erneuert werden. Wer einen Ausweis braucht, kann ihn am Markt abholen."],
    "rus": ["Хор собрался в пятницу вечером и пел целый час. Потом участники говорили о поездке на побережье.", "Школьный автобус опоздал на два дня. Водитель сказал, что дорога была закрыта, и он поехал вокруг озера."],
}


def test_gradients_through_time():
    net, rng = langid.Network(["a", "b", "c"]), np.random.default_rng(0)
    x, y, mask = rng.integers(97, 110, (7, 3, 4)), rng.integers(0, 3, (7, 3)), np.ones((7, 3), np.float32)
    mask[5:, 1] = 0
    _, g = net.gradients(x, mask, y)
    for k in ("u", "v", "b", "c", "w"):
        i = (1, int(x[2, 0, 1]), 1, 40) if k == "w" else tuple(0 for _ in net.p[k].shape)
        old, e = net.p[k][i], 1e-2
        net.p[k][i] = old + e
        up = net.gradients(x, mask, y)[0]
        net.p[k][i] = old - e
        down = net.gradients(x, mask, y)[0]
        net.p[k][i] = old
        assert (up - down) / (2 * e) == pytest.approx(g[k][i], rel=0.05, abs=2e-4)


def test_language_network(spark):
    labelled = [(k, t) for k, ts in LANGS.items() for t in ts]
    net = langid.train(labelled, steps=60)
    for k, ts in LANGS.items():
        runs, lang, p = langid.segments_of(net, [ts])[0][:3]
        assert lang == k and p > 0.5 and len(runs) == 1
    mixed = [LANGS["eng"][0], LANGS["rus"][0], LANGS["eng"][1]]
    assert [r[2] for r in langid.segments_of(net, [mixed])[0][0]] == ["eng", "rus", "eng"]
    long = langid.segments_of(net, [LANGS["deu"] * 300])[0]
    assert long[1] == "deu" and len(long[0]) == 1
    assert langid.segments_of(net, [[]]) == [([], None, 0.0, [])]
    # lines without an end mark are labelled too, but make no written language
    heading = langid.segments_of(net, [["The choir sang for an hour on Friday evening", "Хор собрался в пятницу вечером и пел целый час. Потом участники говорили о поездке."]])[0]
    assert [r[2] for r in heading[0]] == ["eng", "rus"] and heading[3] == ["rus"]
    rng = np.random.default_rng(0)
    x, mask = rng.integers(97, 120, (20, 5, langid.CHUNK)).astype(np.uint8), np.ones((20, 5), np.float32)
    mask[12:, 3] = 0
    lp = net._logits(net.states(x, mask))
    lp = (lp - np.log(np.exp(lp).sum(-1, keepdims=True))).mean(2)
    assert np.allclose(lp[mask > 0], net.log_probabilities(x, mask)[mask > 0], atol=1e-4)
    codes = spark.createDataFrame([("eng", "eng", "en", "English"), ("deu", "ger", "de", "German")], "iso3 string, iso3_bib string, iso2 string, english_name string")
    cases = {"en": "eng", " ENG ": "eng", "ger": "deu", "de-AT": "deu", "en_us": "eng", "German": "deu", "es-419": None, "und": None, "": None, "n/a": None, None: None, "english words": None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "l string, want string").withColumn("got", langid.normalized_label(F.col("l"), codes))
    assert [x for x in df.collect() if x["got"] != x["want"]] == []
    scanned = spark.createDataFrame([(1, ["deu", "eng"]), (2, ["eng"]), (3, []), (4, None)], "page_id long, written array<string>")
    labels = spark.createDataFrame([(1, "eng"), (1, "eng"), (2, None)], "page_id long, lang string")
    assert {(x["page_id"], x["lang"]) for x in langid.misnamed_languages(scanned, labels).collect()} == {(1, "deu"), (2, "eng")}
    assert langid.train([]).languages == ["und"]


def test_sentences_without_end_marks_and_residue_pages(spark):
    net = langid.train([(k, t) for k, ts in LANGS.items() for t in ts], steps=60)
    russian = ["Хор собрался в пятницу вечером и пел целый час", "Водитель сказал, что дорога была закрыта"]
    written = lambda lines: langid.segments_of(net, [lines])[0][3]
    assert written([PROSE[0], *russian]) == ["eng", "rus"] == written([PROSE[0], russian[0] + ".", russian[1]])
    # phrases and items are none, and do not part sentences
    assert written([PROSE[0], "Хор собрался", "в пятницу вечером"]) == ["eng"] == written([PROSE[0], *("- " + x for x in russian), "2) " + russian[0]])
    assert written([PROSE[0], russian[0] + ".", "at home", russian[1] + "."]) == ["eng", "rus"]
    rows = [(1, "x.example", "T", ["Page not found. Please try again later.", *PROSE[:2], *LANGS["rus"]]), (2, "x.example", "T", PROSE), (3, "x.example", "{{ title }}", ["Home"])]
    df = page_table(spark, rows)
    got = {x["page_id"]: x for x in pages.scan(df, wrappers.wrappers(df), net).collect()}
    assert got[1]["residue"] and {x["lang"] for x in got[1]["segments"]} == {"eng", "rus"} and got[1]["page_lang"] and "rus" in got[1]["written"]
    assert got[3]["residue"] and got[3]["page_lang"] and len(got[3]["segments"]) == 1
    short = {x["page_id"]: x for x in pages.scan(df, wrappers.wrappers(df), net, label_residue=False).collect()}
    assert short[2]["written"] == got[2]["written"] == ["eng"] and short[1]["page_lang"] is None


# --- problem 10 -----------------------------------------------------------------------------------------

def test_boosting_learns_a_rule():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 16, (2000, 5))
    y = ((x[:, 0] > 7) ^ (x[:, 3] > 4)).astype(float)
    p = boosting.fit(x, y).score(x)
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.98


@pytest.fixture(scope="module")
def model():
    return pii_training.train(4000)


def test_held_out_accuracy(model):
    held = pii_training.labelled_texts(500, seed=77)
    found = model.find([t for t, _ in held])
    right = sum(len(set(f) & s) for f, (_, s) in zip(found, held, strict=True))
    assert right / sum(len(f) for f in found) > 0.97 and right / sum(len(s) for _, s in held) > 0.95


def test_redaction(spark, model):
    text = "Contact: Ruth Bergson, 555-201-3344, ruth@mail.example.org\nOrder no. 490-826-903 was shipped. The Lantern Street Theatre opens at 9:30."
    rows = [(1, text, None), (2, None, "k"), (3, "", "k"), (4, "Nothing here at all.", "k"), (5, text, "copy"), (6, ("The mill was sold. " * 5000) + "Tax ID J91291806 is needed.", "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = {(x["doc_id"], x["kind"], x["value"]) for x in pii.find(df, model=model).collect()}
    mine = {("person", "Ruth Bergson"), ("phone", "555-201-3344"), ("email", "ruth@mail.example.org")}
    assert got == {(i, k, v) for i in (1, 5) for k, v in mine} | {(6, "id_number", "J91291806")}
    out = {x["doc_id"]: x["text"] for x in pii.redacted(df, model=model).collect()}
    assert out[1].startswith("Contact: [PERSON], [PHONE], [EMAIL]\nOrder no. 490-826-903") and out[2] is None and out[3] == "" and out[4] == rows[3][1]
    assert pii.find(df.limit(0), model=model).count() == 0
