"""One pass over the lines of each page: furniture, residue, spam evidence and quality statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread
from . import langid, mixture, stats
from .examples import EXAMPLES
from .residue import Residue
from .wrappers import Wrapper, host_sizes, wrappers

#: components of the quality mixture, and the rows its first guess is made on (EM itself runs over all pages)
COMPONENTS = 14
START_ROWS = 10_000
#: rounds of EM over all pages, fewer if it settles
EM_ROUNDS = 6
#: columns of ``stats.NAMES`` that the mixture uses, and how they are drawn nearer to a normal shape
SHAPES = {
    "mean_word_length": "log", "symbol_ratio": "sqrt", "digit_ratio": "sqrt", "end_punctuation": "", "end_punctuation_words": "",
    "common_share": "", "words_per_line": "log", "short_lines": "", "odd_words": "sqrt",
    "comma_words": "sqrt", "item_marks": "sqrt",
}
#: languages with fewer pages than this are not normalized by their own median
MIN_LANGUAGE_PAGES = 30

#: compression is extreme where it lies so many deviations (from the middle half of the language's pages) below
#: the language's median: where sentence punctuation is sparse, and where it is not
EXTREME = 4.0
EXTREME_IN_SENTENCES = 5.0
#: sentence ends a word below which sentence punctuation is sparse
SPARSE = 0.03
#: a host with more than this share of all pages is spread over several tasks
HOST_SHARE = 0.001

_SENTENCE_END = re.compile(r"[.!?…](?=\s|$)")

SCHEMA = (
    "page_id long, lines int, furniture array<int>, residue boolean, stats array<double>, language string, "
    "redundancy double, sentence_density double"
)
SEGMENTS = (
    "segments array<struct<first_sentence:int, last_sentence:int, lang:string, confidence:double>>, "
    "page_lang string, page_confidence double, written array<string>"
)
_RUN = ("first_sentence", "last_sentence", "lang", "confidence")
_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.bool_(), pa.list_(pa.float64()), pa.string(), pa.float64(), pa.float64()]
_SEGMENT_COLUMNS = ["segments", "page_lang", "page_confidence", "written"]
_SEGMENT_TYPES = [pa.list_(pa.struct(list(zip(_RUN, (pa.int32(), pa.int32(), pa.string(), pa.float64()), strict=True)))), pa.string(), pa.float64(), pa.list_(pa.string())]


def _own_evidence(own: list[str]) -> tuple:
    text = "\n".join(own)
    st, language = stats.measure(text)
    if st is None:
        return None, None, None, None
    return st, language, stats.redundancy(text), len(_SENTENCE_END.findall(text)) / st[0]


def by_host(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """The pages of each host after a row with its wrapper, sorted within partitions by host, salt and page.

    A host with more than ``HOST_SHARE`` of all pages is cut into salts; the wrapper stands before each of them. Such
    hosts are at most 1 / ``HOST_SHARE``, so what is broadcast is bounded whatever the corpus.
    """
    sizes = host_sizes(pages)
    total = sizes.agg(F.sum("pages")).first()[0] or 0
    share = max(1.0, HOST_SHARE * total)
    # no more rows than 1 / HOST_SHARE
    large = F.broadcast(sizes.where(F.col("pages") > share).select("d", F.ceil(F.col("pages") / share).cast("int").alias("salts")).limit(int(1 / HOST_SHARE)))
    salts = F.coalesce("salts", F.lit(1))
    rows = pages.select(F.xxhash64(F.coalesce("domain", F.lit(""))).alias("d"), "page_id", F.coalesce("domain", F.lit("")).alias("domain"), "title", F.col("content.paragraphs").alias("paragraphs"))
    rows = rows.join(large, "d", "left").withColumn("salt", F.pmod(F.xxhash64("page_id"), salts).cast("int")).drop("salts")
    heads = entries.join(large, "d", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    both = rows.unionByName(heads, allowMissingColumns=True)
    placed = both.repartition("d", "salt").sortWithinPartitions("d", "salt", F.col("page_id").asc_nulls_first())
    return placed.select("d", "page_id", "domain", "title", "paragraphs", "entries")


def scan(pages: DataFrame, entries: DataFrame, network: langid.Network | None = None, label_residue: bool = True) -> DataFrame:
    """One row per page of ``pages`` (page_id, domain, title, content.paragraphs), columns as in ``SCHEMA``.

    ``entries`` has each host's wrapper; ``furniture`` lists the positions of its lines. Statistics and spam
    evidence are of the page's own lines; null if it has none with words. Null paragraphs count as no lines, null
    lines as empty; rows without id are left out, rows of one host with the same id come out once. With a ``network``
    the columns of ``SEGMENTS`` are added, of the own lines' sentences, those of pages with residue too unless
    ``label_residue`` is false (for results that leave such pages out).
    """
    shared = pages.sparkSession.sparkContext.broadcast(network)
    names, types = (_COLUMNS + _SEGMENT_COLUMNS, _TYPES + _SEGMENT_TYPES) if network else (_COLUMNS, _TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, residue = shared.value, Residue()
        wrapper, host, last = Wrapper(""), None, None
        for batch in batches:
            out, owns = [], []
            for d, page, domain, title, lines, heads in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if page is None:
                    wrapper, host, last = Wrapper("", heads), d, None
                    continue
                if host != d:
                    wrapper, host = Wrapper(""), d
                wrapper.domain = domain
                if (d, page) == last:
                    continue
                last = (d, page)
                lines = lines or []
                is_furniture = list(map(wrapper.furniture, lines))
                own = [x for x, f in zip(lines, is_furniture, strict=True) if x and not f]
                is_residue = residue.title(title) or any(map(residue.line, lines))
                out.append((page, len(lines), [i for i, f in enumerate(is_furniture) if f], is_residue, *_own_evidence(own)))
                owns.append(own if label_residue or not is_residue else [])
            columns = list(zip(*out, strict=True)) or [()] * len(_COLUMNS)
            if net:
                found = langid.segments_of(net, owns)
                columns += [[[dict(zip(_RUN, r, strict=True)) for r in x[0]] for x in found], *([x[i] for x in found] for i in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return by_host(pages.where("page_id IS NOT NULL"), entries).mapInArrow(run, f"{SCHEMA}, {SEGMENTS}" if network else SCHEMA)


def full_text_stats(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, word_count, full_text) with the statistics of ``stats.NAMES`` as columns; null for texts
    without words and null texts."""
    names = ["page_id", "word_count", *stats.NAMES]
    schema = "page_id long, word_count int, " + ", ".join(f"{n} double" for n in stats.NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [stats.text_stats(t) or [None] * len(stats.NAMES) for t in batch.column(2).to_pylist()]
            columns = [pa.array(c, pa.float64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.float64()) for _ in stats.NAMES]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), *columns], names=names)

    return spread(pages.select("page_id", "word_count", "full_text")).mapInArrow(run, schema)


def shaped(x: np.ndarray) -> np.ndarray:
    """Columns of the mixture from rows of ``stats.NAMES``."""
    out = []
    for name, how in SHAPES.items():
        c = x[:, stats.NAMES.index(name)]
        out.append(np.log(np.maximum(c, 1e-6)) if how == "log" else np.sqrt(np.maximum(c, 0)) if how == "sqrt" else c)
    return np.stack(out, 1)


def shaped_columns() -> list[Column]:
    """The same for the column ``stats``."""
    out = []
    for name, how in SHAPES.items():
        c = F.col("stats")[stats.NAMES.index(name)]
        out.append(F.log(F.greatest(c, F.lit(1e-6))) if how == "log" else F.sqrt(F.greatest(c, F.lit(0.0))) if how == "sqrt" else c)
    return out


def fit_quality(scanned: DataFrame, components: int = COMPONENTS, start_rows: int = START_ROWS, rounds: int = EM_ROUNDS) -> tuple[mixture.Mixture, list[str]]:
    """The mixture and the class (prose, list, table, junk) of each component.

    Fitted by EM over all pages that are neither residue nor spam, and the inspected examples. The first guess comes
    from at most ``start_rows`` pages picked by a hash of the id; from there each round is one pass over all pages
    that sums what the next round needs. A component gets the class whose examples it explains most; one without
    examples gets the class of the example nearest to its center.
    """
    known = scanned.where("stats IS NOT NULL AND NOT residue AND NOT spam")
    cols = shaped_columns()
    row = known.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    examples = np.array([stats.text_stats(t) for _, t in EXAMPLES])
    kinds = np.array([k for k, _ in EXAMPLES])
    sample = [r[0] for r in known.select("stats", F.xxhash64("page_id").alias("h")).orderBy("h").limit(start_rows).select("stats").collect()]
    z = shaped(np.array([*sample, *examples]))
    n = len(cols)
    if sample:
        mean, scale = np.array(row[:n], float), np.array(row[n:], float)
    else:
        mean, scale = z.mean(0), z.std(0)
    m = mixture.fit(z, components, mean, scale)
    last = None
    for _ in range(rounds if sample else 0):
        sums = _expected(known, m) + m.sums(shaped(examples))
        m, now = m.refit(sums)
        if last is not None and now - last < 1e-3:
            break
        last = now
    p = m.posterior(shaped(examples))
    classes = sorted(set(kinds))
    votes = np.stack([p[kinds == c].mean(0) for c in classes])
    named = votes.max(0) > 0.02
    at = (shaped(examples) - m.mean) / m.scale
    names = []
    for k in range(len(m.weights)):
        if not named[k]:
            names.append(str(kinds[int(((at - m.centers[k]) ** 2).sum(1).argmin())]))
            continue
        names.append(classes[int(votes[:, k].argmax())])
    return m, names


def _expected(known: DataFrame, m: mixture.Mixture) -> np.ndarray:
    """``m.sums`` over all rows: summed within partitions, then per component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            if b.num_rows:
                total = total + m.sums(shaped(np.array(b.column(0).to_pylist())))
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["k", "s"])

    parts = known.select("stats").mapInArrow(run, "k int, s array<double>")
    rows = parts.select("k", F.posexplode("s").alias("i", "x")).groupBy("k", "i").agg(F.sum("x").alias("x")).collect()  # a fixed number
    out = m.sums(np.empty((0, len(SHAPES))))
    for r in rows:
        out[r["k"], r["i"]] = r["x"]
    return out


def with_quality(scanned: DataFrame, model: tuple[mixture.Mixture, list[str]]) -> DataFrame:
    """``scanned`` with ``kind`` (prose, list, table, junk; null without own words) and its probability."""
    m, names = model
    classes = sorted(set(names))
    pick = np.array([[float(x == c) for c in classes] for x in names])

    @F.pandas_udf("struct<kind:string, p:double>")
    def judge(s):  # noqa: ANN001, ANN202
        import pandas as pd

        kind, p = np.full(len(s), None, object), np.full(len(s), np.nan)
        ok = s.notna().to_numpy()
        if ok.any():
            q = m.posterior(shaped(np.array(s[ok].tolist()))) @ pick
            kind[ok] = np.array(classes, object)[q.argmax(1)]
            p[ok] = q.max(1)
        return pd.DataFrame({"kind": kind, "p": p})

    return scanned.withColumn("_j", judge("stats")).withColumns({"kind": F.col("_j.kind"), "kind_p": F.col("_j.p")}).drop("_j")


def with_spam(scanned: DataFrame) -> DataFrame:
    """``scanned`` with ``spam``.

    The block-wise compression of a page's own lines, already normalized by length, is set against the median of
    its language. It is extreme if it lies ``EXTREME`` deviations below; the deviation is that of the middle half of
    the language's pages. Low density of sentence ends confirms it; where sentences are punctuated it must be
    more extreme. Machine output and item lists repeat themselves too, but in digits, symbols and item marks.
    """
    languages = (
        scanned.where("redundancy IS NOT NULL AND language IS NOT NULL")
        .groupBy(F.col("language").alias("_l"))
        .agg(F.percentile_approx("redundancy", [0.25, 0.5, 0.75]).alias("_q"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= MIN_LANGUAGE_PAGES)
        .select("_l", F.col("_q")[1].alias("_m"), ((F.col("_q")[2] - F.col("_q")[0]) / 1.349).alias("_d"))
    )
    below = (F.coalesce("_m", F.lit(1.0)) - F.col("redundancy")) / F.coalesce("_d", F.lit(0.045))
    st = dict(zip(stats.NAMES, (F.col("stats")[i] for i in range(len(stats.NAMES))), strict=True))
    worded = (st["digit_ratio"] < 0.08) & (st["symbol_ratio"] < 0.15) & ~((st["item_marks"] >= 0.17) & (st["short_lines"] > 0.5))
    spam = worded & (below >= F.when(F.col("sentence_density") < SPARSE, EXTREME).otherwise(EXTREME_IN_SENTENCES))
    # at most one row a language of COMMON_WORDS
    return (
        scanned.join(F.broadcast(languages), F.col("language") == F.col("_l"), "left")
        .withColumns({"compression": below, "spam": F.coalesce(spam, F.lit(False))})
        .drop("_l", "_m", "_d")
    )


def assess(pages: DataFrame, network: langid.Network | None = None, label_residue: bool = True) -> DataFrame:
    """One row per page: ``SCHEMA`` with compression (deviations below the language's median), spam, kind and kind_p,
    ``low_quality`` for pages that are neither residue nor spam but mainly list, table or junk, and ``sound`` for pages
    that are none of the three.

    Doubled pages come out once. The pass over the texts is written to the shared folder, as the statistics
    of all pages are needed before any page can be judged.
    """
    scanned = with_spam(materialize(scan(pages, wrappers(pages), network, label_residue), "page-scan"))
    judged = with_quality(scanned, fit_quality(scanned))
    low = F.coalesce(F.col("kind") != "prose", F.lit(False)) & ~F.col("residue") & ~F.col("spam")
    return judged.withColumn("low_quality", low).withColumn("sound", ~(F.col("residue") | F.col("spam") | low))
