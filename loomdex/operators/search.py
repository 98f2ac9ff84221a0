"""Ranked full-text search over an inverted index of DataFrames.

``Index`` holds postings (field, term, doc, tf, positions), lengths (field, doc, dl), term statistics (field, term,
df) and field statistics (field, docs, avgdl), all built by aggregation. A batch of queries is joined to the
postings by term; nothing but the query terms is looked up by name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import analysis, text
from ..session import materialize

K1, B = 1.2, 0.75
#: gap between the positions of a field's values, so that phrases do not cross them
VALUE_GAP = 100
MAX_EXPANSIONS = 50
BOOSTS = {"title": 10.0, "all_text": 1.0, "meta_description": 3.0, "og_title": 5.0}
PHRASE_BOOSTS = {"title": 5.0, "all_text": 3.0}


@dataclass
class Index:
    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    fields: DataFrame

    def map(self, how) -> Index:  # noqa: ANN001
        """The index with each table replaced, e.g. by its materialized form."""
        return Index(how(self.postings), how(self.lengths), how(self.terms), how(self.fields))


def all_text(page: DataFrame) -> Column:
    """Values that the catch-all field collects; repeats are kept, as they count twice."""
    c, empty = F.col("content"), F.array().cast("array<string>")
    lists = [F.coalesce(c[k], empty) for k in ("h1", "h2", "h3", "h4", "h5", "h6", "paragraphs")]
    return F.array_compact(F.concat(F.array("title"), *lists, F.array(c["full_text"], "meta_description", "og_title", "og_description")))


def page_fields(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(doc, field, values) of the searched fields of pages; fields without text are left out."""
    one = lambda c: F.array_compact(F.array(c))
    fields = F.array(*[
        F.struct(F.lit(name).alias("field"), values.alias("values"))
        for name, values in (("title", one("title")), ("all_text", all_text(pages)), ("meta_description", one("meta_description")), ("og_title", one("og_title")))
    ])
    return pages.select(F.col(key).alias("doc"), F.explode(fields).alias("f")).select("doc", "f.field", "f.values").where("size(values) > 0")


def build_index(docs: DataFrame, analyzed: bool = False) -> Index:
    """Index of (doc, field, values ARRAY<STRING>).

    ``analyzed`` applies stems, stop words and word parts, computed per distinct word; without it terms are the
    standard tokens. Positions run through a field's values with a gap between them.
    """
    parts = docs.select("doc", "field", F.posexplode("values").alias("v", "text")).select(
        "doc", "field", "v", F.posexplode(text.standard_tokens(F.col("text"))).alias("i", "word")
    )
    # positions of value v start after VALUE_GAP for each value before; lengths of values do not matter for phrases
    parts = parts.withColumn("pos", F.col("v").cast("long") * (1 << 32) + F.col("i"))
    if analyzed:
        words = analysis.term_of_word(parts.select("word").distinct())
        parts = parts.join(words, "word").select("doc", "field", "pos", F.explode("terms").alias("term"))
    else:
        parts = parts.withColumnRenamed("word", "term")
    postings = parts.groupBy("field", "term", "doc").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return from_postings(postings)


def from_postings(postings: DataFrame) -> Index:
    """The statistics of an index from its postings: lengths are sums of term frequencies."""
    lengths = postings.groupBy("field", "doc").agg(F.sum("tf").alias("dl"))
    terms = postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    fields = lengths.groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("avgdl"))
    return Index(postings, lengths, terms, fields)


def written_index(docs: DataFrame, analyzed: bool = False) -> Index:
    """The index of ``docs`` as tables of the shared folder; the texts are read once."""
    built = from_postings(materialize(build_index(docs, analyzed).postings, "postings"))
    built = Index(built.postings, materialize(built.lengths, "lengths"), materialize(built.terms, "terms"), built.fields)
    fields = built.lengths.groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("avgdl"))
    return Index(built.postings, built.lengths, built.terms, materialize(fields, "fields"))


def bm25(tf: Column, df: Column, dl: Column, docs: Column, avgdl: Column) -> Column:
    """Lucene's BM25 (no k1 + 1 factor)."""
    idf = F.log1p((docs - df + 0.5) / (df + 0.5))
    return idf * tf / (tf + K1 * (1 - B + B * dl / avgdl))


def required(clauses: Column) -> Column:
    """minimum_should_match ``2<75%``: all of one or two clauses, else three quarters rounded down."""
    return F.when(clauses <= 2, clauses).otherwise(F.floor(clauses * 0.75)).cast("int")


def query_terms(spark: SparkSession, queries: list[tuple[int, str]], analyzed: bool = False, fuzzy: DataFrame | None = None) -> DataFrame:
    """:func:`request_terms` of a few query texts that are in memory anyway."""
    return request_terms(spark.createDataFrame(queries, "query long, asked string"), analyzed, fuzzy)


def request_terms(requests: DataFrame, analyzed: bool = False, fuzzy: DataFrame | None = None) -> DataFrame:
    """(query, pos, variant, term, weight, clauses) of query texts (query, asked); null and empty ones give no rows.

    Terms that stand for one another by synonym rules form variant 0 of a position and count as one term. With
    ``fuzzy`` (the term statistics of an index) terms within the edits allowed, with the same first two letters, are
    further variants: their weight falls with the distance; at most fifty a term.
    """
    names = ["query", "pos", "variant", "term", "weight", "clauses", "own", "grouped"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for q, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [t for _, t in analysis.analyze(s or "")] if analyzed else analysis.tokens(s or "")
                groups = analysis.expand_synonyms(found) if analyzed else [{t} for t in found]
                rows += [(q, i, 0, t, 1.0, len(groups), t == found[i], len(g) > 1) for i, g in enumerate(groups) for t in sorted(g)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    schema = "query long, pos int, variant int, term string, weight double, clauses int, own boolean, grouped boolean"
    base = requests.select(F.col("query").cast("long"), "asked").mapInArrow(run, schema)
    if fuzzy is not None:
        base = base.unionByName(_fuzzy(base, fuzzy))
    return base.drop("own", "grouped")


def phrase_terms(requests: DataFrame, analyzed: bool = True) -> DataFrame:
    """(query, pos, term) of the first quoted part of each query text (query, asked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for q, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                quoted = phrase_of(s) or ""
                rows += [(q, i, t) for i, t in (analysis.analyze(quoted) if analyzed else enumerate(analysis.tokens(quoted)))]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string()), strict=True)], names=["query", "pos", "term"])

    return requests.select(F.col("query").cast("long"), "asked").mapInArrow(run, "query long, pos int, term string")


def _fuzzy(base: DataFrame, terms: DataFrame) -> DataFrame:
    @F.arrow_udf("int")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            most = analysis.edit_limit(x)
            d = analysis.edits(x, y, most)
            out.append(d if 0 < d <= most else None)
        return pa.array(out, pa.int32())

    vocabulary = terms.groupBy("term").agg(F.max("df").alias("df")).withColumn("head", F.substring("term", 1, 2))
    want = base.where("own AND NOT grouped AND length(term) >= 3").withColumnRenamed("term", "asked").withColumn("head", F.substring("asked", 1, 2))
    near = (
        want.join(vocabulary, "head")
        .where(F.abs(F.length("term") - F.length("asked")) <= F.when(F.length("asked") < 6, 1).otherwise(2))
        .withColumn("d", distance("asked", "term"))
        .where("d IS NOT NULL")
        .withColumn("variant", F.row_number().over(W.partitionBy("query", "pos").orderBy("d", F.desc("df"), "term")))
        .where(F.col("variant") <= MAX_EXPANSIONS)
    )
    weight = 1 - F.col("d") / F.least(F.length("asked"), F.length("term"))
    return near.select("query", "pos", "variant", "term", weight.alias("weight"), "clauses", F.lit(False).alias("own"), F.lit(False).alias("grouped"))


def score(index: Index, terms: DataFrame, boosts: dict[str, float] | None = None, all_terms: bool = False) -> DataFrame:
    """(query, doc, score): the best field's boosted sum of term scores, for documents with enough terms in a field.

    ``boosts`` names the fields searched. A position counts once, by its best variant.
    """
    boosts = BOOSTS if boosts is None else boosts
    boost = F.element_at(F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv]), F.col("field"))
    names = list(boosts)
    stats = (
        terms.join(index.terms.where(F.col("field").isin(names)), "term")
        .groupBy("query", "pos", "variant", "field")
        .agg(F.max("df").alias("df"), F.first("weight").alias("weight"), F.first("clauses").alias("clauses"))
        .join(index.fields, "field")
    )
    hits = terms.select("query", "pos", "variant", "term").join(index.postings.where(F.col("field").isin(names)).select("field", "term", "doc", "tf"), "term")
    hits = hits.groupBy("query", "pos", "variant", "field", "doc").agg(F.sum("tf").alias("tf"))
    scored = hits.join(stats, ["query", "pos", "variant", "field"]).join(index.lengths, ["field", "doc"])
    s = F.col("weight") * bm25(F.col("tf"), F.col("df"), F.col("dl"), F.col("docs"), F.col("avgdl"))
    by_pos = scored.groupBy("query", "field", "doc", "pos").agg(F.max(s).alias("s"), F.first("clauses").alias("clauses"))
    by_field = by_pos.groupBy("query", "field", "doc").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("matched"), F.first("clauses").alias("clauses"))
    enough = F.col("matched") >= (F.col("clauses") if all_terms else required(F.col("clauses")))
    return by_field.where(enough).groupBy("query", "doc").agg(F.max(boost * F.col("s")).alias("score"))


def phrase_of(q: str | None) -> str | None:
    """The first quoted part of a query."""
    m = re.search(r'"([^"]+)"', q or "")
    return m[1] if m else None


def phrase(index: Index, terms: DataFrame, boosts: dict[str, float]) -> DataFrame:
    """(query, doc, score) of documents that hold each query's terms in a row in **every** field of ``boosts``.

    ``terms`` has the phrase's terms with their positions from 0. Occurrences are aligned by subtracting the term's
    position: a phrase starts where all its terms give the same start. The score is the field's BM25 of the phrase
    frequency with the sum of the terms' idf, boosted and summed over the fields.
    """
    names = list(boosts)
    n = terms.groupBy("query").agg(F.countDistinct("pos").alias("need"))
    at = (
        terms.select("query", "pos", "term")
        .join(index.postings.where(F.col("field").isin(names)), "term")
        .select("query", "field", "doc", "pos", F.explode("positions").alias("p"))
        .groupBy("query", "field", "doc", (F.col("p") - F.col("pos")).alias("start"))
        .agg(F.countDistinct("pos").alias("got"))
        .join(n, "query")
        .where("got = need")
        .groupBy("query", "field", "doc")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    idf = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = terms.select("query", "pos", "term").join(index.terms, "term").join(index.fields, "field").groupBy("query", "field").agg(F.sum(idf).alias("idf"), F.first("avgdl").alias("avgdl"))
    boost = F.element_at(F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv]), F.col("field"))
    s = boost * F.col("idf") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    found = at.join(weights, ["query", "field"]).join(index.lengths, ["field", "doc"])
    return found.groupBy("query", "doc").agg(F.sum(s).alias("score"), F.count(F.lit(1)).alias("fields")).where(F.col("fields") == len(names)).drop("fields")


def both(must: list[DataFrame]) -> DataFrame:
    """Documents in every branch, scores added."""
    out = must[0]
    for m in must[1:]:
        out = out.join(m.withColumnRenamed("score", "_s"), ["query", "doc"]).select("query", "doc", (F.col("score") + F.col("_s")).alias("score"))
    return out


def top(scored: DataFrame, k: int, key: str = "url") -> DataFrame:
    """The best ``k`` rows of each query, ties by ``key``; the row number is a per-partition limit first."""
    w = W.partitionBy("query").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fragments(body: str | None, terms: set[str], size: int = 150, most: int = 3) -> list[str]:
    """Best fragments of a text with the terms marked ``<em>``; whole words, in order of their matches."""
    if not body or not terms:
        return []
    spans = [(m.start(), m.end(), m.group().lower() in terms) for m in re.finditer(r"\w+(?:[.']\w+)*", body)]
    cuts, at = [], 0
    while at < len(spans):
        end = at
        while end + 1 < len(spans) and spans[end + 1][1] - spans[at][0] <= size:
            end += 1
        cuts.append((sum(x[2] for x in spans[at : end + 1]), at, end))
        at = end + 1
    best = sorted((c for c in cuts if c[0]), key=lambda c: (-c[0], c[1]))[:most]
    out = []
    for _, a, b in best:
        s, at = "", spans[a][0]
        for x, y, hit in spans[a : b + 1]:
            s += body[at:x] + (f"<em>{body[x:y]}</em>" if hit else body[x:y])
            at = y
        out.append(s)
    return out


def highlight(rows: DataFrame, body: str, asked: str) -> DataFrame:
    """``rows`` with ``highlights``: fragments of column ``body`` for the query text in ``asked``. For the few rows of a page."""

    @F.arrow_udf("array<string>")
    def mark(bodies: pa.Array, queries: pa.Array) -> pa.Array:
        return pa.array([fragments(b, set(analysis.tokens(q))) for b, q in zip(bodies.to_pylist(), queries.to_pylist(), strict=True)], pa.list_(pa.string()))

    return rows.withColumn("highlights", mark(body, asked))


# --- completion ---------------------------------------------------------------------------------------

GRAM = 10


def _grams(words: Column) -> Column:
    return F.filter(F.transform(words, lambda w: F.substring(w, 1, GRAM)), lambda w: F.length(w) >= 2)


def complete_titles(titles: DataFrame, typed: str) -> DataFrame:
    """Titles (url, title) with the typed words in a row, the last one as a prefix; one-letter words vanish."""
    words = [w[:GRAM] for w in re.findall(r"[^\W_]+", typed.lower()) if len(w) >= 2]
    if not words:
        return titles.limit(0)
    t = titles.withColumn("_w", _grams(analysis.edge_words(F.col("title"))))
    n = len(words)
    ok = lambda i: F.forall(F.sequence(F.lit(1), F.lit(n)), lambda k: _fits(F.element_at("_w", (i + k).cast("int")), k, words))
    starts = F.sequence(F.lit(0), F.size("_w") - n)
    return t.where(F.size("_w") >= n).where(F.exists(starts, ok)).drop("_w")


def _fits(word: Column, k: Column, words: list[str]) -> Column:
    want = F.element_at(F.array(*map(F.lit, words)), k)
    return F.when(k == len(words), word.startswith(want)).otherwise(word == want)


def complete_text(index: Index, titles: DataFrame, typed: str, field: str = "all_text") -> DataFrame:
    """Titles of pages with at least half of the typed terms (at least one) in ``field``, the last one as a prefix."""
    words = analysis.tokens(typed)
    if not words:
        return titles.limit(0)
    need = max(1, len(words) // 2)
    exact = index.postings.where((F.col("field") == field) & F.col("term").isin(words[:-1])) if words[:-1] else index.postings.limit(0)
    prefix = index.postings.where((F.col("field") == field) & F.col("term").startswith(words[-1])).select("doc").distinct()
    scored = (
        exact.join(index.terms, ["field", "term"]).join(index.lengths, ["field", "doc"]).join(index.fields, "field")
        .select("doc", "term", bm25(F.col("tf"), F.col("df"), F.col("dl"), F.col("docs"), F.col("avgdl")).alias("s"))
        .unionByName(prefix.select("doc", F.lit("*").alias("term"), F.lit(1.0).alias("s")))
        .groupBy("doc").agg(F.sum("s").alias("score"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= need)
    )
    return titles.join(scored, titles["page_id"] == scored["doc"]).drop("doc", "n")


def autocomplete(index: Index, titles: DataFrame, typed: str, limit: int = 5) -> DataFrame:
    """Suggestions (text, url): titles first; if they are sparse, pages found by their text fill up.

    Sparse means fewer than three for five typed characters or more, else fewer than ``limit``.
    """
    if not typed or not typed.strip():
        raise ValueError("a query is required")
    first = complete_titles(titles, typed).select(F.col("title").alias("text"), "url").distinct().orderBy("url").limit(limit)
    found = first.collect()
    if len(found) >= (3 if len(typed) >= 5 else limit):
        return first
    rest = complete_text(index, titles, typed).where(~F.col("url").isin([r["url"] for r in found]) if found else F.lit(True))
    rest = rest.orderBy(F.desc("score"), "url").limit(limit - len(found)).select(F.col("title").alias("text"), "url")
    return first.unionByName(rest)
