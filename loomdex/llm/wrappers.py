"""Page boilerplate: one wrapper per host, inferred by aligning the token streams of its pages.

A wrapper is a list of union-free regular expressions over the tokens of a line: constants, text slots, optional
and repeated groups. Tokens are lower-cased words and the marks that separate parts of a line; digits and other marks
are dropped and the host's own name is the token ``@``.

1. Lines that come back word for word are constants of the host. Lines that share an opening or a closing are
   variants of one template. Both are counted per host on page bitmaps, so no task holds a host.
2. The variants of a template are aligned one after the other (:func:`align`): tokens that match stay constant; a
   mismatch on both sides becomes a text slot, one on a single side an optional group, or a repeated group if it
   repeats what stands before it. A host's variants are aligned in pieces, and the pieces' templates again, until one
   is left.
3. A menu is a repeated group of items: its items are counted like lines, and a line that is cut into known items by
   separators is the group ``(item)+``.
4. Long lines that share both ends are aligned as a whole (:func:`long_templates`). Those of which less than half is the
   same are different texts; each text is counted again and taken only if it comes back itself.

A template is taken into a host's wrapper if the host itself repeats it, or if at least ``MIN_HOSTS`` hosts use it
(templates come with the software of a site, so a host with few pages shows some of them once only). A host's wrapper
holds only what stands on the host's own pages and is applied to these only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.url import let
from ..session import materialize, spread

#: a sequence is constant on a host if it comes back on this share of its further pages (the page that shows it first
#: is not counted) ...
MIN_SHARE = 0.015
#: ... and stands on at least so many of them
MIN_PAGES = 3
#: hosts that must have a sequence before it counts on hosts that show it less often
MIN_HOSTS = 3
#: weight of a host of more pages in the average over hosts, so that no large host outvotes the others
HOST_PAGES = 200
#: a line of more characters is long: a paragraph, unless it comes back; two words that open or close many of them are
#: no template
LONG_CHARS = 200
MAX_LONG_SHARE = 0.1
#: tokens that open or close a template, and those that do so on long lines; these are looked for in so many characters
#: first, and in the whole line if so many do not hold them
EDGE_WORDS = 2
LONG_EDGE_WORDS = 6
EDGE_CHARS = 64
#: a line of fewer words and a long one are constant only on so many pages of a host or on most of its pages:
#: a paragraph copied to a few pages is not wrapper text
MIN_WORDS = 3
MIN_WHOLE_PAGES = 6
#: items of a menu line, the words of an item, and the share of items that must be known
MIN_ITEMS = 4
ITEM_WORDS = 3
MIN_KNOWN_ITEMS = 0.6
#: variants aligned by one call, and templates of pieces aligned by one call
PIECE = 256
FAN_IN = 64
#: cells of a table of two lines above which they are aligned by bits, and bytes that these may take at once
LCS_CELLS = 10_000
LCS_BYTES = 1 << 24
#: salts that spread the lines of one host over tasks where its page count is looked up
SALTS = 16

MARKS = "/|·>»–«“:"
_NUMBER = r"\d[\d.,:/%-]*"
_NOISE = rf"[^\p{{L}}{MARKS}]+"
_SEPARATORS = r"\s*[·|/>,»–•]+\s*|\s{2,}"
#: kinds of sequences; hashes of different kinds start from different seeds
LINE, SHORT, ENDS, ITEM, OPEN, CLOSE = range(6)
_seeds = [xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42) for k in range(6)]


def _hash(kind: int, k: Column) -> Column:
    return F.xxhash64(F.lit(kind), k)


def sequence_hash(kind: int, k: str) -> int:
    """As the hash of the built-in function, in Python."""
    h = xxhash.xxh64_intdigest(k.encode("utf-8", "replace"), _seeds[kind])
    return h - (1 << 64) if h >> 63 else h


def tokens(text: Column) -> Column:
    """The tokens of a text, joined by blanks; marks at either end are dropped. Null for null."""
    x = F.regexp_replace(F.regexp_replace(F.lower(text), _NUMBER, " "), _NOISE, " ")
    x = F.regexp_replace(x, f"[{MARKS}]", r" $0 ")
    x = F.replace(F.replace(x, F.lit("   "), F.lit(" ")), F.lit("  "), F.lit(" "))
    return F.btrim(x, F.lit(" " + MARKS))


def opening(t: Column, n: int) -> Column:
    """The first ``n`` tokens, or the last if negative."""
    return F.substring_index(t, " ", n)


def line_ends(line: Column) -> Column:
    """The first and the last ``LONG_EDGE_WORDS`` tokens of a long line, as of :func:`tokens` of the whole line.

    The tokens of ``EDGE_CHARS`` characters at either end hold them if there is one more, which the cut may have
    changed; else the whole line is cut into tokens.
    """
    # what the cut leaves of a number is no mark
    tail = F.ltrim(F.substring(line, -EDGE_CHARS, EDGE_CHARS), F.lit("0123456789.,:/%-"))
    whole = tokens(line)

    def found(x: Column) -> Column:
        first, last = opening(x["head"], LONG_EDGE_WORDS), opening(x["tail"], -LONG_EDGE_WORDS)
        held = (F.length(x["head"]) > F.length(first)) & (F.length(x["tail"]) > F.length(last))
        return F.when(held, F.concat_ws(" ", first, last)).when(whole == "", "").otherwise(F.concat_ws(" ", opening(whole, LONG_EDGE_WORDS), opening(whole, -LONG_EDGE_WORDS)))

    return let(F.struct(tokens(F.substring(line, 1, EDGE_CHARS)).alias("head"), tokens(tail).alias("tail")), found)


def menu_like(line: Column) -> Column:
    """Whether a line has any separator of menu items."""
    return reduce(Column.__or__, [F.contains(line, F.lit(x)) for x in (",", "  ", "|", "·", "/", ">", "»", "–", "•")])


def menu_items(line: Column) -> Column:
    """Items of a line that is cut into ``MIN_ITEMS`` or more short ones by separators, else null."""
    parts = F.transform(F.split(F.trim(F.lower(line)), _SEPARATORS), lambda x: F.trim(F.regexp_replace(x, r"[^\p{L}]+", " ")))
    parts = F.filter(parts, lambda x: x != "")
    return F.when((F.size(parts) >= MIN_ITEMS) & F.forall(parts, lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "))) < ITEM_WORDS), parts)


def page_lines(pages: DataFrame) -> DataFrame:
    """(d, page_id, long, t, words, items, whole) of each line with letters; ``d`` is a hash of the domain.

    ``t`` has the tokens, of long lines those of both ends, by which they are grouped; ``whole`` is the line if it is
    long, else null; ``items`` are those of a menu, empty for other lines. Rows without id or domain and null lines
    are left out.
    """
    line = F.col("line")
    long = F.length(line) > LONG_CHARS
    marks = F.length("t") - F.length(F.translate("t", MARKS, ""))
    src = pages.where("page_id IS NOT NULL AND domain IS NOT NULL").select("page_id", "domain", F.col("content.paragraphs").alias("lines"))
    t = F.when(F.col("long"), F.col("t")).otherwise(named(F.col("t"), F.col("domain")))
    return (
        spread(src)
        .select("page_id", "domain", F.explode("lines").alias("line"))
        .where("line <> ''")
        .select(
            "domain", "page_id", long.alias("long"), F.when(long, line_ends(line)).otherwise(tokens(line)).alias("t"), F.when(long, line).alias("whole"),
            F.transform(F.coalesce(F.when(~long & menu_like(line), menu_items(line)), F.array().cast("array<string>")), lambda x: named(x, F.col("domain"))).alias("items"),
        )
        .where("t <> ''")
        .select(F.xxhash64("domain").alias("d"), "page_id", "long", t.alias("t"), (F.size(F.split("t", " ")) - marks).alias("words"), "items", "whole")
    )


def _bits() -> Column:
    return F.bit_or(F.expr("shiftleft(1L, cast(page_id & 63 as int))")).alias("bits")


def host_counts(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """(d, kind, h, n, long, rows, pages): the sequences of each host, hashed, and the pages that hold them.

    Kinds are whole lines (``SHORT`` of under ``MIN_WORDS`` words), the ends of long lines, items, and openings and
    closings of two tokens. ``n`` of the host's ``pages`` pages have the sequence, on ``rows`` lines, ``long`` of them
    long.
    """
    long, t = F.col("long"), F.col("t")
    several = F.length(t) > F.length(opening(t, EDGE_WORDS))

    def seq(when: Column, kind: Column, h: Column) -> Column:
        return F.array(F.when(when, F.struct(kind.cast("byte").alias("kind"), h.alias("h"))))

    keyed = lines.select(
        "d", "page_id", long.cast("int").alias("long"),
        F.explode(F.array_compact(F.concat(
            seq(~long & (F.col("words") >= MIN_WORDS), F.lit(LINE), _hash(LINE, t)),
            seq(~long & (F.col("words") < MIN_WORDS), F.lit(SHORT), _hash(SHORT, t)),
            seq(long, F.lit(ENDS), _hash(ENDS, t)),
            seq(several, F.lit(OPEN), _hash(OPEN, opening(t, EDGE_WORDS))),
            seq(several, F.lit(CLOSE), _hash(CLOSE, opening(t, -EDGE_WORDS))),
            F.transform("items", lambda x: F.struct(F.lit(ITEM).cast("byte").alias("kind"), _hash(ITEM, x).alias("h"))),
        ))).alias("x"),
    ).select("d", "page_id", "long", "x.kind", "x.h")
    return _counted(keyed, sizes)


def _counted(keyed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sequences (d, page_id, long, kind, h) counted as :func:`host_counts` states."""
    counted = (
        keyed.groupBy("d", "kind", "h", F.shiftright("page_id", 6).alias("word"))
        .agg(_bits(), F.sum("long").cast("int").alias("long"), F.count(F.lit(1)).cast("int").alias("rows"))
        .groupBy("d", "kind", "h")
        .agg(F.sum(F.bit_count("bits").cast("long")).alias("n"), F.sum("long").alias("long"), F.sum("rows").alias("rows"))
        .withColumn("salt", F.pmod(F.hash("h"), F.lit(SALTS)))
    )
    salted = sizes.select("d", "pages", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return counted.join(salted, ["d", "salt"]).drop("salt")


def host_sizes(pages: DataFrame) -> DataFrame:
    """(d, pages): pages of each host, doubled pages counted once; null domains count as one host."""
    return (
        pages.where("page_id IS NOT NULL")
        .groupBy(F.xxhash64(F.coalesce("domain", F.lit(""))).alias("d"), F.shiftright("page_id", 6).alias("word"))
        .agg(_bits())
        .groupBy("d")
        .agg(F.sum(F.bit_count("bits").cast("long")).alias("pages"))
    )


def named(t: Column, domain: Column) -> Column:
    """A token string with the host's own name as ``@``."""
    return F.array_join(F.transform(F.split(t, " "), lambda x: F.when((F.length(x) > 2) & domain.contains(x), F.lit("@")).otherwise(x)), " ")


def accepted(counts: DataFrame) -> DataFrame:
    """(d, kind, h, rows, shared): the sequences of each host that its wrapper takes.

    A host counts with its share of further pages; the shares of the hosts that have a sequence are averaged with
    their further pages as weight, ``HOST_PAGES`` at most. Where that average reaches ``MIN_SHARE``, a host that
    reaches it too and has ``MIN_PAGES`` pages of it takes the sequence; where ``MIN_HOSTS`` hosts have it, all of
    them do (``shared``).
    """
    others = F.col("pages") - 1
    weight = F.least(others, F.lit(HOST_PAGES))
    pooled = counts.groupBy("kind", "h").agg(
        F.sum((F.col("n") - 1) * weight / F.greatest(others, F.lit(1))).alias("more"), F.sum(weight).alias("others"), F.max("n").alias("most"),
        F.max(F.when(F.col("n") * 2 > F.col("pages"), F.col("n"))).alias("usual"), F.sum("long").alias("all_long"), F.sum("rows").alias("all_rows"),
        F.count(F.lit(1)).alias("hosts"),
    )
    whole = F.col("kind").isin(SHORT, ENDS)
    # rounded, as the order of a sum of fractions is not fixed
    often = F.round(F.col("more") - MIN_SHARE * F.col("others"), 6) >= 0
    enough = F.when(whole, (F.col("most") >= MIN_WHOLE_PAGES) | (F.coalesce("usual", F.lit(0)) >= MIN_PAGES)).otherwise(F.col("most") >= MIN_PAGES)
    brief = whole | (F.col("all_long") <= MAX_LONG_SHARE * F.col("all_rows"))
    good = pooled.where(enough & often & brief).select("kind", "h", (F.col("hosts") >= MIN_HOSTS).alias("shared"))
    own = (F.col("n") >= MIN_PAGES) & (F.col("n") - 1 >= MIN_SHARE * others)
    return counts.join(good, ["kind", "h"]).where(F.col("shared") | own).select("d", "kind", "h", "rows", "shared")


# --- alignment ------------------------------------------------------------------------------------------------
# A template is a string of elements joined by blanks: a token; a text slot ``\1a,b`` of a to b tokens; an
# optional group ``\2x_y``; a repeated group ``\3x_y`` (once or more).

SLOT, OPTIONAL, REPEATED = "\x01", "\x02", "\x03"


def _extent(element: str) -> tuple[int, int]:
    """Fewest and most tokens an element stands for; a repeated group is taken as up to eight times."""
    if element[0] == SLOT:
        a, b = element[1:].split(",")
        return int(a), int(b)
    if element[0] == OPTIONAL:
        return 0, element.count("_") + 1
    if element[0] == REPEATED:
        return element.count("_") + 1, 8 * (element.count("_") + 1)
    return 1, 1


def _is_constant(element: str) -> bool:
    return element[0] > REPEATED


def _lcs_rows(a: list[str], b: list[str]) -> Iterator[int]:
    """For each beginning of ``a`` a number of ``len(b)`` bits; bit j is 0 where one more token of ``b`` adds one to the
    longest common subsequence."""
    full, at = (1 << len(b)) - 1, {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    row = full
    yield row
    for x in a:
        y = row & at.get(x, 0)
        row = ((row + y) | (row - y)) & full
        yield row


def _lcs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence; where its rows would take more than ``LCS_BYTES``, of the two halves of ``a``."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > 8 * LCS_BYTES:
        mid = len(a) // 2
        *_, one = _lcs_rows(a[:mid], b)
        *_, two = _lcs_rows(a[:mid - 1 : -1], b[::-1])
        one, two = f"{one:0{len(b)}b}"[::-1], f"{two:0{len(b)}b}"
        best = now = two.count("0")
        cut = 0
        for j in range(len(b)):
            now += (one[j] == "0") - (two[j] == "0")
            if now > best:
                best, cut = now, j + 1
        return _lcs(a[:mid], b[:cut]) + [(i + mid, j + cut) for i, j in _lcs(a[mid:], b[cut:])]
    rows, out = list(_lcs_rows(a, b)), []
    i, j = len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def _matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Longest common subsequence of the constants of two element lists, common ends first."""
    start, end = 0, 0
    while start < len(a) and start < len(b) and a[start] == b[start] and _is_constant(a[start]):
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end] and _is_constant(a[-1 - end]):
        end += 1
    inner_a, inner_b = a[start : len(a) - end], b[start : len(b) - end]
    out = [(i, i) for i in range(start)]
    common = {x for x in inner_a if _is_constant(x)} & set(inner_b)
    if common:
        ia, ib = [i for i, x in enumerate(inner_a) if x in common], [j for j, x in enumerate(inner_b) if x in common]
        if len(ia) * len(ib) > LCS_CELLS:
            found = _lcs([inner_a[i] for i in ia], [inner_b[j] for j in ib])
            return out + [(start + ia[i], start + ib[j]) for i, j in found] + [(len(a) - end + i, len(b) - end + i) for i in range(end)]
        best = [[0] * (len(ib) + 1) for _ in range(len(ia) + 1)]
        for i in range(len(ia) - 1, -1, -1):
            row, below, x = best[i], best[i + 1], inner_a[ia[i]]
            for j in range(len(ib) - 1, -1, -1):
                row[j] = below[j + 1] + 1 if x == inner_b[ib[j]] else max(below[j], row[j + 1])
        i = j = 0
        while i < len(ia) and j < len(ib):
            if inner_a[ia[i]] == inner_b[ib[j]]:
                out.append((start + ia[i], start + ib[j]))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return out + [(len(a) - end + i, len(b) - end + i) for i in range(end)]


def _resolve(x: list[str], y: list[str], before: list[str]) -> list[str]:
    """One mismatch: what stands between two matches on either side, after the elements ``before``."""
    if x == y:
        return x
    if not x or not y:
        only = x or y
        if len(only) == 1 and only[0][0] in (OPTIONAL, REPEATED):
            return [OPTIONAL + only[0][1:]] if only[0][0] == OPTIONAL else [f"{SLOT}0,{_extent(only[0])[1]}"]
        if all(map(_is_constant, only)):
            if before[-len(only) :] == only:
                return [REPEATED + "_".join(only)]
            return [OPTIONAL + "_".join(only)]
    for one, other in ((x, y), (y, x)):
        if len(one) == 1 and one[0][0] in (OPTIONAL, REPEATED) and other == one[0][1:].split("_"):
            return one
    low = high = None
    for side in (x, y):
        extents = [_extent(e) for e in side]
        a, b = sum(e[0] for e in extents), sum(e[1] for e in extents)
        low, high = (a, b) if low is None else (min(low, a), max(high, b))
    return [f"{SLOT}{low},{high}"]


def align(a: list[str], b: list[str]) -> list[str]:
    """The union-free expression of two element lists."""
    if a == b:
        return a
    out: list[str] = []
    ends = [*_matches(a, b), (len(a), len(b))]
    i = j = 0
    for p, q in ends:
        if p > i or q > j:
            found = _resolve(a[i:p], b[j:q], out)
            if found and found[0][0] == REPEATED and len(found) == 1:
                # the group takes in the occurrence before it
                k = found[0].count("_") + 1
                if out[-k:] == found[0][1:].split("_"):
                    del out[-k:]
            out += found
        if p < len(a):
            out.append(a[p])
        i, j = p + 1, q + 1
    merged: list[str] = []
    for e in out:
        if merged and e[0] == SLOT and merged[-1][0] == SLOT:
            (a1, b1), (a2, b2) = _extent(merged[-1]), _extent(e)
            merged[-1] = f"{SLOT}{a1 + a2},{b1 + b2}"
        else:
            merged.append(e)
    return merged


def infer_template(variants: Iterable[str]) -> str:
    """The template of token strings or templates, aligned one after the other in sorted order."""
    out: list[str] | None = None
    for v in sorted(set(variants)):
        e = v.split(" ")
        out = e if out is None else align(out, e)
    return " ".join(out or [])


def infer_texts(variants: Iterable[tuple[str, int]]) -> list[tuple[str, int]]:
    """Templates with their pages from long token strings or templates, each with its pages.

    A variant is aligned with the first text of which at least half stays constant with it, slots at their widest, the
    more frequent ones first; else it is a text of its own. Texts on fewer than ``MIN_PAGES`` pages or ``MIN_SHARE`` of
    all are left out.
    """
    texts: list[tuple[list[str], Counter, int, int]] = []
    total = 0
    for t, n in sorted(variants, key=lambda v: (-v[1], v[0])):
        total += n
        e = t.split(" ")
        words, width = Counter(filter(_is_constant, e)), _width(e)
        for k, (other, others, its, pages) in enumerate(texts):
            # no more can be constant than both have
            if 2 * min(words.total(), others.total()) < max(width, its) or 2 * (words & others).total() < max(width, its):
                continue
            both = align(other, e)
            constant, wide = Counter(filter(_is_constant, both)), _width(both)
            if 2 * constant.total() >= wide:
                texts[k] = both, constant, wide, pages + n
                break
        else:
            texts.append((e, words, width, n))
    return [(" ".join(e), n) for e, _, _, n in texts if n >= MIN_PAGES and n >= MIN_SHARE * total]


def _width(template: list[str]) -> int:
    return sum(_extent(e)[1] for e in template)


def is_text(template: str, words: list[str]) -> bool:
    """Whether all of a line's tokens are of a template: as :func:`expression`, for long lines in steady time.

    Bit i is set while the elements so far may end before token i.
    """
    n, at = len(words), {}
    for i, x in enumerate(words):
        at[x] = at.get(x, 0) | 1 << i
    ends, full = 1, (2 << n) - 1

    def after(ends: int, group: list[str]) -> int:
        for x in group:
            ends = (ends & at.get(x, 0)) << 1
        return ends

    for e in template.split(" "):
        if e[0] == SLOT:
            a, b = _extent(e)
            ends = ends << a & full
            more, done = b - a, 0
            while done < more and ends:
                k = min(done + 1, more - done)
                ends, done = (ends | ends << k) & full, done + k
        elif e[0] == OPTIONAL:
            ends |= after(ends, e[1:].split("_"))
        elif e[0] == REPEATED:
            group, now, ends = e[1:].split("_"), ends, 0
            while now := after(now, group) & ~ends:
                ends |= now
        else:
            ends = (ends & at.get(e, 0)) << 1
        if not ends:
            return False
    return bool(ends >> n & 1)


def expression(template: str) -> str:
    """The regular expression of a template over a token string with a blank before each token."""
    out = []
    for e in template.split(" "):
        if e[0] == SLOT:
            a, b = _extent(e)
            out.append(rf"(?: \S+){{{a},{b}}}")
        elif e[0] in (OPTIONAL, REPEATED):
            words = "".join(" " + re.escape(x) for x in e[1:].split("_"))
            out.append(f"(?:{words}){'?' if e[0] == OPTIONAL else '+'}")
        else:
            out.append(" " + re.escape(e))
    return "".join(out)


def _fold(groups: DataFrame) -> DataFrame:
    """``groups`` with the array column ``variants`` replaced by their ``template``."""
    kept = [c for c in groups.columns if c != "variants"]
    schema = ", ".join(f"`{c}` {groups.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([infer_template(v) for v in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], names=[*kept, "template"])

    return groups.select(*kept, "variants").mapInArrow(run, f"{schema}, template string")


def templates(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """(d, kind, h, template) of the accepted openings and closings of each host.

    The distinct lines with that edge are aligned in pieces of about ``PIECE``, then the pieces' templates by
    ``FAN_IN``, until each edge has one.
    """
    keys = ["d", "kind", "h"]
    t = F.col("t")
    cuts = [F.struct(F.lit(kind).cast("byte").alias("kind"), _hash(kind, opening(t, n)).alias("h")) for kind, n in ((OPEN, EDGE_WORDS), (CLOSE, -EDGE_WORDS))]
    some = lines.where("NOT long").select("d", "t", F.explode(F.array(*cuts)).alias("x")).select("d", "x.kind", "x.h", "t")
    pieces = F.ceil(F.col("rows") / PIECE)
    got = _fold(some.join(edges, keys).withColumn("piece", F.pmod(F.xxhash64("t"), pieces)).groupBy(*keys, "piece").agg(F.collect_set("t").alias("variants")))
    left = -(-(edges.agg(F.max("rows")).first()[0] or 0) // PIECE)
    while left > 1:
        got = _fold(got.groupBy(*keys, F.floor(F.col("piece") / FAN_IN).alias("piece")).agg(F.collect_list("template").alias("variants")))
        left = -(-left // FAN_IN)
    return got.select(*keys, "template")


def _fold_texts(groups: DataFrame) -> DataFrame:
    """``groups`` (scope, h, piece, variants) with a row (template, n) for each of :func:`infer_texts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for scope, h, piece, variants in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [(scope, h, piece, t, n) for t, n in infer_texts((v["t"], v["n"]) for v in variants)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["scope", "h", "piece", "t", "n"])

    variants = F.collect_list(F.struct("t", "n")).alias("variants")
    return groups.groupBy("scope", "h", "piece").agg(variants).mapInArrow(run, "scope long, h long, piece long, t string, n long")


def _texts_of(lines: DataFrame) -> DataFrame:
    """(d, page_id, h, template): the ``texts`` that each line (d, page_id, h, t) is of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, page, h, t, texts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = t.split(" ")
                rows += [(d, page, h, x) for x in texts if is_text(x, words)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["d", "page_id", "h", "template"])

    return lines.select("d", "page_id", "h", "t", "texts").mapInArrow(run, "d long, page_id long, h long, template string")


def long_templates(lines: DataFrame, ends: DataFrame, sizes: DataFrame) -> DataFrame:
    """(d, kind, h, template) of the long lines that a host's wrapper takes; several may share their ends ``h``.

    Whole lines with the accepted ``ends`` are aligned, those of one host or, where the ends are shared, of all hosts,
    in pieces as in :func:`templates`. The lines of each text found are counted like other sequences.
    """
    keys = ["scope", "h"]
    ends = ends.select("d", "h", F.when(F.col("shared"), F.lit(0).cast("long")).otherwise(F.col("d")).alias("scope"))
    some = lines.where("long").select("d", "page_id", _hash(ENDS, F.col("t")).alias("h"), "whole").join(ends, ["d", "h"])
    some = materialize(some.select("d", "page_id", *keys, tokens(F.col("whole")).alias("t")).distinct(), "wrapper-long")
    variants = some.groupBy(*keys, "t").agg(F.count_distinct("page_id").alias("n"))
    pieces = variants.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("pieces"))
    got = _fold_texts(variants.join(pieces, keys).withColumn("piece", F.pmod(F.xxhash64("t"), F.col("pieces"))))
    left = pieces.agg(F.max("pieces")).first()[0] or 0
    while left > 1:
        got = _fold_texts(got.withColumn("piece", F.floor(F.col("piece") / FAN_IN)))
        left = -(-left // FAN_IN)
    texts = got.groupBy(*keys).agg(F.collect_set("t").alias("texts"))
    found = materialize(_texts_of(some.join(texts, keys)).withColumn("k", F.xxhash64("h", "template")), "wrapper-texts")
    counts = _counted(found.select("d", "page_id", F.lit(1).alias("long"), F.lit(ENDS).cast("byte").alias("kind"), F.col("k").alias("h")), sizes)
    good = accepted(counts).select("d", F.col("h").alias("k"))
    return found.select("d", "h", "template", "k").distinct().join(good, ["d", "k"], "left_semi").select("d", F.lit(ENDS).cast("byte").alias("kind"), "h", "template")


def wrappers(pages: DataFrame) -> DataFrame:
    """(d, entries ARRAY<STRUCT<kind, h, template>>): each host's wrapper, for :class:`Wrapper`. Hosts without one are
    left out."""
    lines = materialize(page_lines(pages), "wrapper-lines")
    sizes = host_sizes(pages)
    taken = materialize(accepted(materialize(host_counts(lines, sizes), "wrapper-counts")), "wrapper-sequences")
    edge, ends = F.col("kind").isin(OPEN, CLOSE), F.col("kind") == ENDS
    every = taken.where(~edge & ~ends).select("d", "kind", "h", F.lit(None).cast("string").alias("template")).unionByName(templates(lines, taken.where(edge)))
    if not taken.where(ends).isEmpty():
        every = every.unionByName(long_templates(lines, taken.where(ends), sizes))
    return every.groupBy("d").agg(F.collect_list(F.struct("kind", "h", "template")).alias("entries"))


_number = re.compile(_NUMBER, re.ASCII).sub
_tokens = re.compile(rf"[^\W\d_]+|[{MARKS}]").findall
_letters = regex.compile(rf"\p{{L}}+|[{MARKS}]").findall


def line_tokens(text: str) -> list[str]:
    """As :func:`tokens`, in Python."""
    low = _number(" ", text.lower())
    t = _tokens(low)
    if not low.isascii() and not all(x.isalpha() or x in MARKS for x in t):
        t = _letters(low)
    a, b = 0, len(t)
    while a < b and t[a] in MARKS:
        a += 1
    while b > a and t[b - 1] in MARKS:
        b -= 1
    return t[a:b]


class Wrapper:
    """The wrapper of one host; ``entries`` are (kind, hash, template) as rows or dictionaries."""

    __slots__ = ("domain", "line", "short", "ends", "item", "open", "close")
    _words = re.compile(r"[^\W\d_]+").findall
    _cut = re.compile(_SEPARATORS).split

    def __init__(self, domain: str, entries: Iterable = ()) -> None:
        self.domain = domain
        self.line, self.short, self.item = set(), set(), set()
        self.open, self.close, self.ends = {}, {}, {}
        sets = {LINE: self.line, SHORT: self.short, ITEM: self.item}
        for e in entries:
            if e["kind"] in sets:
                sets[e["kind"]].add(e["h"])
            elif e["kind"] == ENDS:
                self.ends.setdefault(e["h"], []).append(e["template"])
            else:
                (self.open if e["kind"] == OPEN else self.close)[e["h"]] = e["template"]

    def _named(self, words: list[str]) -> list[str]:
        d = self.domain
        return ["@" if len(x) > 2 and x in d else x for x in words]

    @staticmethod
    def _template(of: dict, h: int, line: str) -> bool:
        found = of.get(h)
        if found is None:
            return False
        if isinstance(found, str):
            found = of[h] = re.compile(expression(found)).fullmatch
        return found(" " + line) is not None

    def furniture(self, line: str | None) -> bool:
        """Whether a line is text of the wrapper. Null lines and lines without letters are not."""
        if not line:
            return False
        if len(line) > LONG_CHARS:
            if not self.ends:
                return False
            t = line_tokens(line)
            texts = self.ends.get(sequence_hash(ENDS, " ".join([*t[:LONG_EDGE_WORDS], *t[-LONG_EDGE_WORDS:]])), ()) if t else ()
            return any(is_text(x, t) for x in texts)
        t = line_tokens(line)
        n = len(t)
        if not n:
            return False
        t = self._named(t)
        s = " ".join(t)
        if sequence_hash(LINE, s) in self.line or (n <= 2 * MIN_WORDS and sequence_hash(SHORT, s) in self.short):
            return True
        if n > EDGE_WORDS:
            if self.open and self._template(self.open, sequence_hash(OPEN, f"{t[0]} {t[1]}"), s):
                return True
            if self.close and self._template(self.close, sequence_hash(CLOSE, f"{t[-2]} {t[-1]}"), s):
                return True
        return n >= MIN_ITEMS and bool(self.item) and self._menu(line)

    def _menu(self, line: str) -> bool:
        """A repeated group: enough of the line's items, cut by separators, are known."""
        parts = self._cut(line.lower().strip())
        if len(parts) < MIN_ITEMS:
            return False
        found = [x for x in (" ".join(self._words(p)) for p in parts) if x]
        if len(found) < MIN_ITEMS or any(x.count(" ") >= ITEM_WORDS for x in found):
            return False
        return sum(sequence_hash(ITEM, " ".join(self._named(x.split(" ")))) in self.item for x in found) >= MIN_KNOWN_ITEMS * len(found)
