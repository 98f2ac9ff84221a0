"""Search by a batch of requests in one pass over the pages, without an index of all their words.

The pages are shuffled once, by key, so that repeated rows meet; their tokens are counted where they are made. A scan
writes what the requests at hand need of each page, and sums for the statistics that BM25 takes of all pages; a second
pass over that table scores. What is broadcast are the terms of at most ``BLOCK`` requests, with
their fuzzy variants of ``FUZZY_BLOCK``; more are done in blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import analysis, text
from ..session import materialize
from . import search

#: quoted requests, and others, done with one scan
BLOCK, FUZZY_BLOCK = 100_000, 20_000
#: pages whose tokens are in arrays at once
SLICE = 512
FIELDS = list(search.BOOSTS)
TITLE, ALL_TEXT, META, OG = range(4)
#: distance between the token positions of two values, which no phrase spans
GAP = 1 << 32

_STATS = "s_field int, s_term string, s_docs long, s_total long"
_STAT_TYPES = [pa.int32(), pa.string(), pa.int64(), pa.int64()]


def tokenized(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(doc, url, tokens) with a token list for each value of the catch-all field; the first is of the title, the last
    three of the meta description, the og title and the og description. Rows of a page are in one partition."""
    c, empty = F.col("content"), F.array().cast("array<string>")
    lists = [F.coalesce(c[k], empty) for k in ("h1", "h2", "h3", "h4", "h5", "h6", "paragraphs")]
    values = F.concat(F.array("title"), *lists, F.array(c["full_text"], "meta_description", "og_title", "og_description"))
    rows = pages.select(F.col(key).alias("doc"), "url", values.alias("values")).repartition("doc")
    return rows.select("doc", "url", F.transform("values", text.standard_tokens).alias("tokens"))


@lru_cache(maxsize=1 << 18)
def _terms(word: str) -> tuple[str, ...]:
    """What the analysis makes of a token."""
    s = analysis.porter(word)
    return () if s in analysis.STOP_WORDS else tuple(analysis.word_parts(s))


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


class Tokens:
    """Terms of some pages in arrays: ``lengths`` of the four fields, and an entry of ``doc``, ``value``, ``place`` and
    ``term`` for each occurrence of a wanted term. ``names`` numbers these terms; ``wanted`` says which others are."""

    def __init__(self, tokens: pa.ListArray, names: dict[str, int], wanted: Callable[[str], bool] | None = None) -> None:
        ints = lambda x: pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
        values = tokens.flatten()
        per_doc, per_value = ints(tokens), ints(values)
        coded = values.flatten().dictionary_encode()
        ids = coded.indices.to_numpy(zero_copy_only=False)
        words = [_terms(w) for w in coded.dictionary.to_pylist()]
        self.first, start = _offsets(per_doc), _offsets(per_value)
        upto = _offsets(np.array([len(w) for w in words], np.int64)[ids])[start]
        ends = self.first[1:]
        one = lambda v: upto[v + 1] - upto[v]
        self.lengths = np.stack([one(self.first[:-1]), upto[ends] - upto[self.first[:-1]], one(ends - 3), one(ends - 2)], 1)

        kept = []
        for w in words:
            for t in w:
                if t not in names and wanted and wanted(t):
                    names[t] = len(names)
            kept.append([names[t] for t in w if t in names])
        n = np.array([len(k) for k in kept], np.int64)
        flat = np.array([t for k in kept for t in k], np.int64)
        many = n[ids]
        at = np.repeat(np.arange(len(ids)), many)
        within = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        self.term = flat[_offsets(n)[ids[at]] + within] if len(at) else np.zeros(0, np.int64)
        self.value = np.repeat(np.arange(len(per_value)), per_value)[at]
        self.doc = np.repeat(np.arange(len(per_doc)), per_doc)[self.value]
        self.place = at + self.value * GAP

    def counts(self, names: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc, field, term, tf) sorted by the first three."""
        size, ends = max(1, len(names)), self.first[1:][self.doc]
        keys = [(self.doc * 4 + ALL_TEXT) * size + self.term]
        for field, v in ((TITLE, self.first[:-1][self.doc]), (META, ends - 3), (OG, ends - 2)):
            here = self.value == v
            keys.append((self.doc[here] * 4 + field) * size + self.term[here])
        key, tf = np.unique(np.concatenate(keys), return_counts=True)
        return key // size // 4, key // size % 4, key % size, tf


class Sums:
    """Document frequencies and field sums of a task."""

    def __init__(self) -> None:
        self.df: dict[tuple[int, int], int] = defaultdict(int)
        self.docs, self.total = np.zeros(4, np.int64), np.zeros(4, np.int64)

    def add(self, t: Tokens, field: np.ndarray, term: np.ndarray, size: int) -> None:
        self.docs += (t.lengths > 0).sum(0)
        self.total += t.lengths.sum(0)
        n = np.bincount(field * max(1, size) + term)
        for k in np.flatnonzero(n).tolist():
            self.df[k // size, k % size] += int(n[k])

    def rows(self, names: dict[str, int]) -> list[pa.Array]:
        words = list(names)
        rows = [(f, None, int(self.docs[f]), int(self.total[f])) for f in range(4)] + [(f, words[t], n, None) for (f, t), n in self.df.items()]
        return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _STAT_TYPES, strict=True)]


def _record(schema: pa.Schema, own: list[pa.Array] | None, stats: list[pa.Array] | None) -> pa.RecordBatch:
    n = len((own or stats)[0])
    split = len(schema) - len(_STAT_TYPES)
    nulls = lambda part: [pa.nulls(n, f.type) for f in part]
    return pa.RecordBatch.from_arrays((own or nulls(list(schema)[:split])) + (stats or nulls(list(schema)[split:])), schema=schema)


def _scan(pages: DataFrame, own: str, types: list[pa.DataType], names: dict[str, int], wanted: Callable[[str], bool] | None, rows: Callable) -> DataFrame:
    """``rows`` (doc ids, urls, Tokens, counts, names) of each slice of pages, and the sums of each task, as one table.

    A page that stands in several rows is taken once. Pages without a key count for the statistics only.
    """
    columns = [x.split()[0] for x in f"{own}, {_STATS}".split(", ")]
    schema = pa.schema(list(zip(columns, [*types, *_STAT_TYPES], strict=True)))
    shared = pages.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums, seen = dict(shared.value), Sums(), set()
        other = lru_cache(maxsize=1 << 18)(wanted) if wanted else None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                docs, new = part.column(0).to_pylist(), []
                for i, d in enumerate(docs):
                    if d not in seen:
                        seen.add(d)
                        new.append(i)
                if not new:
                    continue
                if len(new) < len(docs):
                    part, docs = part.take(pa.array(new)), [docs[i] for i in new]
                t = Tokens(part.column(2), known, other)
                counts = t.counts(known)
                sums.add(t, counts[1], counts[2], len(known))
                found = rows(docs, part.column(1), t, counts, known)
                if len(found[0]):
                    yield _record(schema, found, None)
        yield _record(schema, None, sums.rows(known))

    return materialize(tokenized(pages).mapInArrow(run, f"{own}, {_STATS}"), "scan")


def _ints(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1), pa.int32()))


def _fields(scan: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents and average length of each field; fields without terms have length 1, as nothing is found in them."""
    docs, total = np.zeros(4), np.zeros(4)
    for r in scan.where("s_field IS NOT NULL AND s_term IS NULL").groupBy("s_field").agg(F.sum("s_docs").alias("n"), F.sum("s_total").alias("t")).collect():
        docs[r["s_field"]], total[r["s_field"]] = r["n"], r["t"]
    return docs, np.where(total > 0, total / np.maximum(docs, 1), 1.0)


def _term_stats(scan: DataFrame) -> DataFrame:
    """(field number, term, df) of the terms that the scan counted."""
    return scan.where("s_term IS NOT NULL").groupBy(F.col("s_field").alias("field"), F.col("s_term").alias("term")).agg(F.sum("s_docs").alias("df"))


def _idf(docs: np.ndarray, df: np.ndarray) -> np.ndarray:
    return np.log1p((docs - df + 0.5) / (df + 0.5))


def _blocks(requests: DataFrame, size: int) -> list[DataFrame]:
    n = -(-requests.count() // size)
    return [requests.where(F.pmod(F.xxhash64("query", "asked"), F.lit(n)) == i) for i in range(n)]


def _in_blocks(requests: DataFrame, size: int, one: Callable[[DataFrame], DataFrame | None], schema: str) -> DataFrame:
    done = [d for b in _blocks(requests, size) if (d := one(b)) is not None]
    return reduce(DataFrame.unionByName, done) if done else requests.sparkSession.createDataFrame([], schema)


def _required(clauses: int) -> int:
    """:func:`search.required` of a number."""
    return clauses if clauses <= 2 else clauses * 3 // 4


# --- quoted requests ----------------------------------------------------------------------------------


def quoted(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """(query, doc, score) of quoted requests (query, asked): the pages that :func:`search.score` finds among those
    that hold the phrase in title and text (:func:`search.phrase`), scores added. Analyzed terms."""
    return _in_blocks(requests, BLOCK, lambda block: _quoted(pages, block), "query long, doc long, score double")


def _quoted(pages: DataFrame, block: DataFrame) -> DataFrame | None:
    clauses, phrases = defaultdict(lambda: defaultdict(list)), defaultdict(list)
    for r in search.request_terms(block, analyzed=True).collect():
        clauses[r["query"]][r["pos"]].append(r["term"])
    for r in search.phrase_terms(block).collect():
        phrases[r["query"]].append((r["pos"], r["term"]))
    # requests of the same terms are searched with once
    same = defaultdict(list)
    for q in clauses.keys() & phrases.keys():
        same[tuple(tuple(sorted(clauses[q][p])) for p in sorted(clauses[q])), tuple(sorted(phrases[q]))].append(q)
    if not same:
        return None
    asked = sorted(same)
    names = {t: i for i, t in enumerate(sorted({t for c, p in asked for t in [*(x for g in c for x in g), *(x for _, x in p)]}))}
    groups = [[[names[t] for t in g] for g in c] for c, _ in asked]
    steps = [[(p, sorted({names[t] for _, t in ts})) for p, ts in groupby(phrase, lambda x: x[0])] for _, phrase in asked]
    starting = defaultdict(list)
    for i, s in enumerate(steps):
        for t in s[0][1]:
            starting[t].append(i)
    shared = pages.sparkSession.sparkContext.broadcast((groups, steps, dict(starting)))

    def rows(docs: list, _: pa.Array, t: Tokens, counts: tuple, __: dict) -> list[pa.Array]:
        groups, steps, starting = shared.value
        cuts = np.searchsorted(t.doc, np.arange(len(docs) + 1))
        cells = np.searchsorted(counts[0], np.arange(len(docs) + 1))
        in_title = t.value == t.first[:-1][t.doc]
        out_doc, out_request, out_tf = [], [], []
        for i, doc in enumerate(docs):
            lo, hi = cuts[i], cuts[i + 1]
            title = in_title[lo:hi]
            if doc is None or not title.any():
                continue
            in_titles, in_text, tf = defaultdict(list), None, None
            for term, place in zip(t.term[lo:hi][title].tolist(), t.place[lo:hi][title].tolist(), strict=True):
                in_titles[term].append(place)
            for r in sorted({r for term in in_titles for r in starting.get(term, ())}):
                if not (n := _starts(in_titles, steps[r])):
                    continue
                if in_text is None:
                    in_text, tf = defaultdict(list), {}
                    for term, place in zip(t.term[lo:hi].tolist(), t.place[lo:hi].tolist(), strict=True):
                        in_text[term].append(place)
                    a, b = cells[i], cells[i + 1]
                    for field, term, k in zip(counts[1][a:b].tolist(), counts[2][a:b].tolist(), counts[3][a:b].tolist(), strict=True):
                        tf[field, term] = k
                out_doc.append(i)
                out_request.append(r)
                out_tf.append([n, _starts(in_text, steps[r]), *(sum(tf.get((f, x), 0) for x in g) for g in groups[r] for f in range(4))])
        ids = pa.array([docs[i] for i in out_doc], pa.int64())
        return [ids, pa.array(out_request, pa.int32()), _ints(t.lengths[out_doc]), pa.array(out_tf, pa.list_(pa.int32()))]

    types = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    scan = _scan(pages, "doc long, request int, lengths array<int>, tf array<int>", types, names, None, rows)

    docs, avgdl = _fields(scan)
    df = np.zeros((4, len(names)))
    for r in _term_stats(scan).collect():
        df[r["field"], names[r["term"]]] = r["df"]
    boosts = np.array([search.BOOSTS[f] for f in FIELDS])
    phrase_boosts = [search.PHRASE_BOOSTS[FIELDS[f]] for f in (TITLE, ALL_TEXT)]
    size = np.array([len(c) for c, _ in asked])
    place = np.zeros(len(asked), np.int64)
    idf = {}
    for n in sorted(set(size.tolist())):
        own = np.flatnonzero(size == n)
        place[own] = np.arange(len(own))
        idf[n] = np.array([[_idf(docs, df[:, g].max(1)) for g in groups[i]] for i in own])
    known = [[names[t] for _, t in p] for _, p in asked]
    phrase_idf = np.array([[sum(float(_idf(docs[f], df[f, t])) for t in k if df[f, t]) for f in (TITLE, ALL_TEXT)] for k in known])
    queries = [same[a] for a in asked]
    per, ids = np.array([len(q) for q in queries]), np.array([x for q in queries for x in q], np.int64)
    weights = pages.sparkSession.sparkContext.broadcast((avgdl, size, place, idf, phrase_idf, per, _offsets(per), ids))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        avgdl, size, place, idf, phrase_idf, per, start, ids = weights.value
        for batch in batches:
            doc, request = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            norms = search.K1 * (1 - search.B + search.B * batch.column(2).flatten().to_numpy().reshape(-1, 4) / avgdl)
            tfs, cuts = batch.column(3).flatten().to_numpy(), _offsets(pc.list_value_length(batch.column(3)).to_numpy())
            best, phrase = np.zeros(len(doc)), np.zeros(len(doc))
            for n in np.unique(size[request]).tolist():
                at = np.flatnonzero(size[request] == n)
                tf = tfs[cuts[at][:, None] + np.arange(2 + 4 * n)]
                own = tf[:, 2:].reshape(-1, n, 4)
                s = np.zeros((len(at), 4))
                for i in range(n):
                    s += idf[n][place[request[at]], i] * own[:, i] / (own[:, i] + norms[at])
                best[at] = np.where((own > 0).sum(1) >= _required(n), boosts * s, 0.0).max(1)
                for f, b in zip((TITLE, ALL_TEXT), phrase_boosts, strict=True):
                    phrase[at] += b * phrase_idf[request[at], f] * tf[:, f] / (tf[:, f] + norms[at, f])
            hit = np.flatnonzero(best > 0)
            many = per[request[hit]]
            rows = np.repeat(hit, many)
            within = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
            columns = [ids[start[request[rows]] + within], doc[rows], (best + phrase)[rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "doc", "score"])

    matches = scan.where("s_field IS NULL").select("doc", "request", "lengths", "tf")
    return matches.mapInArrow(score, "query long, doc long, score double")


def _starts(places: dict[int, list[int]], steps: list[tuple[int, list[int]]]) -> int:
    """Places where all steps of a phrase fit."""
    found = None
    for pos, terms in steps:
        here = {p - pos for t in terms for p in places.get(t, ())}
        found = here if found is None else found & here
        if not found:
            return 0
    return len(found)


# --- best pages of requests with fuzzy terms ------------------------------------------------------------


class Near:
    """Says of a term whether it is within the edits allowed of one that is asked for, with the same first two letters."""

    def __init__(self, asked: set[str]) -> None:
        self.by_head = defaultdict(list)
        for a in sorted(asked):
            if most := analysis.edit_limit(a):
                self.by_head[a[:2]].append((a, most, _letters(a)))

    def __call__(self, term: str) -> bool:
        if not (near := self.by_head.get(term[:2])):
            return False
        have = _letters(term)
        for a, most, letters in near:
            # an edit takes away at most one letter and adds at most one
            few = abs(len(a) - len(term)) <= most and (have & ~letters).bit_count() <= most and (letters & ~have).bit_count() <= most
            if few and analysis.edits(a, term, most) <= most:
                return True
        return False


def _letters(word: str) -> int:
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


def best_analyzed(pages: DataFrame, requests: DataFrame, k: int) -> DataFrame:
    """(query, doc, url, score, rank) of the ``k`` best pages of each request (query, asked), as :func:`search.score` ranks
    them with the terms of ``request_terms(requests, analyzed=True, fuzzy=...)``; ties by url."""
    found = _in_blocks(requests, FUZZY_BLOCK, lambda block: _best(pages, block, k), "query long, doc long, url string, score double")
    return search.top(found, k)


def _variants(pages: DataFrame, asked: list[str], terms: DataFrame) -> dict[str, list[tuple[float, list[str]]]]:
    """The fuzzy variants of each term by the term statistics, in the order of their rank."""
    rows = [(i, 0, 0, t, 1.0, 1, True, False) for i, t in enumerate(asked)]
    base = pages.sparkSession.createDataFrame(rows, "query long, pos int, variant int, term string, weight double, clauses int, own boolean, grouped boolean")
    out = defaultdict(list)
    for r in sorted(search._fuzzy(base, terms).collect(), key=lambda r: (r["query"], r["variant"])):
        out[asked[r["query"]]].append((r["weight"], [r["term"]]))
    return out


def _best(pages: DataFrame, block: DataFrame, k: int) -> DataFrame | None:
    groups = defaultdict(lambda: defaultdict(list))
    for r in search.request_terms(block, analyzed=True).collect():
        groups[r["query"]][r["pos"]].append(r["term"])
    # requests of the same clauses are searched with once; their order does not count
    same = defaultdict(list)
    for q, by_pos in groups.items():
        same[tuple(sorted(tuple(sorted(g)) for g in by_pos.values()))].append(q)
    if not same:
        return None
    clauses = sorted({g for c in same for g in c})
    alone = [g[0] for g in clauses if len(g) == 1]
    names = {t: i for i, t in enumerate(sorted({t for g in clauses for t in g}))}

    def rows(docs: list, urls: pa.Array, t: Tokens, counts: tuple, known: dict) -> list[pa.Array]:
        doc, field, term, tf = counts
        starts = pa.array(_offsets(np.bincount(doc, minlength=len(docs))), pa.int32())
        lists = (pa.array(field, pa.int32()), pa.array(list(known), pa.string()).take(pa.array(term)), pa.array(tf, pa.int32()))
        columns = [pa.array(docs, pa.int64()), urls, _ints(t.lengths), *(pa.ListArray.from_arrays(starts, x) for x in lists)]
        kept = pa.array([i for i, n in enumerate(np.diff(starts.to_numpy())) if n and docs[i] is not None], pa.int32())
        return [c.take(kept) for c in columns]

    types = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32())]
    scan = _scan(pages, "doc long, url string, lengths array<int>, field array<int>, term array<string>, tf array<int>", types, names, Near(set(alone)), rows)

    docs, avgdl = _fields(scan)
    stats = _term_stats(scan)
    near = _variants(pages, alone, stats)
    wide = [[(1.0, list(g)), *(near.get(g[0], []) if len(g) == 1 else [])] for g in clauses]
    used = {t: i for i, t in enumerate(sorted({t for c in wide for _, g in c for t in g}))}
    df = np.zeros((4, len(used)))
    for r in stats.where(F.col("term").isNotNull()).toLocalIterator():
        if r["term"] in used:
            df[r["field"], used[r["term"]]] = r["df"]
    # (weight times idf of the four fields, terms) of each variant
    weighted = [[(w * _idf(docs, df[:, ids].max(1)), ids) for w, g in c if (ids := [used[t] for t in g])] for c in wide]
    number = {g: i for i, g in enumerate(clauses)}
    asked = [([number[g] for g in c], q) for c, q in sorted(same.items())]
    shared = pages.sparkSession.sparkContext.broadcast((avgdl, used, weighted, asked))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        avgdl, used, weighted, asked = shared.value
        best: list[list[tuple]] = [[] for _ in asked]
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * SLICE):
                part = batch.slice(at, 4 * SLICE)
                ids, urls = part.column(0), part.column(1)
                scores = Scores(part, avgdl, used, weighted)
                for r, (own, _) in enumerate(asked):
                    s = scores.of(own)
                    if s is None:
                        continue
                    least = -best[r][-1][0] if len(best[r]) == k else 0.0
                    hit = np.flatnonzero((s > 0) & (s >= least))
                    if len(hit) > k:
                        hit = hit[s[hit] >= np.partition(s[hit], -k)[-k]]
                    if len(hit):
                        # ties by url, nulls first
                        new = [(-float(s[i]), (u := urls[i].as_py()) is not None, u or "", ids[i].as_py()) for i in hit.tolist()]
                        best[r] = sorted(best[r] + new)[:k]
        out = [(q, d, u if known else None, -s) for rows, (_, queries) in zip(best, asked, strict=True) for s, known, u, d in rows for q in queries]
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query", "doc", "url", "score"])

    postings = scan.where("s_field IS NULL").select("doc", "url", "lengths", "field", "term", "tf")
    return postings.mapInArrow(score, "query long, doc long, url string, score double")


class Scores:
    """Scores of some pages, with the postings of their terms in arrays."""

    def __init__(self, part: pa.RecordBatch, avgdl: np.ndarray, used: dict[str, int], weighted: list) -> None:
        self.n, self.weighted = part.num_rows, weighted
        self.norms = search.K1 * (1 - search.B + search.B * part.column(2).flatten().to_numpy().reshape(-1, 4) / avgdl)
        doc = np.repeat(np.arange(self.n), pc.list_value_length(part.column(3)).to_numpy())
        field, tf = part.column(3).flatten().to_numpy(), part.column(5).flatten().to_numpy()
        coded = part.column(4).flatten().dictionary_encode()
        term = np.array([used.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        key = np.where(term < 0, -1, term * 4 + field)
        order = np.argsort(key, kind="stable")
        self.doc, self.tf = doc[order], tf[order].astype(float)
        keys, starts = np.unique(key[order], return_index=True)
        self.at = dict(zip(keys.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True), strict=True))
        self.clauses: dict[tuple[int, int], tuple[np.ndarray, np.ndarray] | None] = {}

    def clause(self, c: int, f: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(pages, score) of a clause in a field: the best of its variants, each a term or terms that count as one."""
        if (c, f) not in self.clauses:
            found = []
            for weight, terms in self.weighted[c]:
                lists = [self.at[t * 4 + f] for t in terms if t * 4 + f in self.at]
                if not lists:
                    continue
                doc, tf = self.doc[lists[0][0] : lists[0][1]], self.tf[lists[0][0] : lists[0][1]]
                if len(lists) > 1:
                    sums = np.zeros(self.n)
                    for a, b in lists:
                        sums[self.doc[a:b]] += self.tf[a:b]
                    doc = np.flatnonzero(sums)
                    tf = sums[doc]
                found.append((doc, weight[f] * tf / (tf + self.norms[doc, f])))
            if len(found) > 1:
                most = np.zeros(self.n)
                for doc, s in found:
                    most[doc] = np.maximum(most[doc], s)
                doc = np.flatnonzero(most)
                found = [(doc, most[doc])]
            self.clauses[c, f] = found[0] if found else None
        return self.clauses[c, f]

    def of(self, own: list[int]) -> np.ndarray | None:
        """The best field's boosted sum for each page, 0 where no field has enough clauses; null if none has."""
        best, need = None, _required(len(own))
        for f, name in enumerate(FIELDS):
            found = [x for c in own if (x := self.clause(c, f))]
            if len(found) < need:
                continue
            s, matched = np.zeros(self.n), np.zeros(self.n, np.int32)
            for doc, x in found:
                s[doc] += x
                matched[doc] += 1
            s = np.where(matched >= need, search.BOOSTS[name] * s, 0.0)
            best = s if best is None else np.maximum(best, s)
        return best
