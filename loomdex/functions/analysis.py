"""Text analysis: tokens, Porter stems, stop words, word parts, synonyms, edit distance.

Corpus text is only tokenized; stems and word parts are functions of a word, so they are computed once per
distinct word of the vocabulary.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import standard_tokens

# The 33 English stop words of the usual analyzer.
STOP_WORDS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())

# Synonym rules; terms of a rule stand for one another.
SYNONYMS = """
js, javascript
react, reactjs
ts, typescript
node, nodejs, node.js
frontend, front-end, front end
backend, back-end, back end
css, styles, styling
html, markup
api, apis, endpoint, endpoints
db, database, databases
book, ebook, e-book, e book, books
document, doc, docs
video, videos, vid
image, images, img, pic, pictures
website, web site, web
webpage, web page
download, dl
login, log in, signin, sign in
logout, log out, signout, sign out
search, find, lookup
fix, patch, repair
bug, issue, defect, error
config, configuration, cfg
deploy, deployment, release
server, service, svc
client, frontend
python, py
golang, go
rust, rs
java, jvm
csharp, c#
vue, vuejs
angular, ng
""".strip().split("\n")

_WORD = re.compile(r"\w+(?:[.']\w+)*")


def tokens(text: str | None) -> list[str]:
    """Standard tokens of a query text, as ``standard_tokens`` makes them of columns."""
    return _WORD.findall((text or "").lower())


# --- Porter (1980) ------------------------------------------------------------------------------------

_VOWELS = "aeiou"


def _shape(w: str) -> str:
    """c or v for each letter; y after a consonant is a vowel."""
    out: list[str] = []
    for i, ch in enumerate(w):
        out.append("v" if ch in _VOWELS or ch == "y" and i and out[-1] == "c" else "c")
    return "".join(out)


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _short(w: str) -> bool:
    """Ends consonant-vowel-consonant, the last not w, x or y."""
    return _shape(w).endswith("cvc") and w[-1] not in "wxy"


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    """Porter stem of a lower-cased word; words of one or two letters and words with other letters stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    trimmed = False
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        w, trimmed = w[:-2], True
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        w, trimmed = w[:-3], True
    if trimmed:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, new in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                w = w[: -len(end)] + new if _measure(w[: -len(end)]) > 0 else w
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short(w[:-1]):
            w = w[:-1]
    if _measure(w) > 1 and w.endswith("ll"):
        w = w[:-1]
    return w


def word_parts(word: str) -> list[str]:
    """Parts of a word at changes of case, between letters and digits, and at other marks; possessive dropped."""
    word = re.sub(r"'s$", "", word)
    return re.findall(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+(?![^\W\d_A-Z])|\d+", word) or []


def analyze(text: str | None) -> list[tuple[int, str]]:
    """(position, term) of a query text: tokens, stems, stop words out (positions kept), word parts."""
    out = []
    for i, t in enumerate(tokens(text)):
        s = porter(t)
        if s not in STOP_WORDS:
            out += [(i, p) for p in word_parts(s)]
    return out


def term_of_word(words: DataFrame) -> DataFrame:
    """(word, terms) of a vocabulary (word): what the chain makes of each word; stop words have no terms."""

    @F.arrow_udf("array<string>")
    def terms(w: pa.Array) -> pa.Array:
        return pa.array([[] if (s := porter(x)) in STOP_WORDS else word_parts(s) for x in w.to_pylist()], pa.list_(pa.string()))

    # kept above the distinct: a filter on its result must not be pushed below, to every occurrence of a word
    return words.withColumn("terms", terms.asNondeterministic()("word"))


@functools.cache
def synonym_rules() -> list[list[tuple[str, ...]]]:
    """Rules after the chain: each a list of term sequences."""
    rules = []
    for line in SYNONYMS:
        rules.append(sorted({tuple(t for _, t in analyze(x)) for x in line.split(",")} - {()}))
    return rules


def expand_synonyms(terms: list[str]) -> list[set[str]]:
    """For each query term the single terms that stand for it (itself included); rules do not chain.

    A sequence of terms that matches a rule's multi-word side gives its alternatives to its first term.
    """
    out = [{t} for t in terms]
    for rule in synonym_rules():
        for seq in rule:
            for i in range(len(terms) - len(seq) + 1):
                if tuple(terms[i : i + len(seq)]) == seq:
                    out[i] |= {x[0] for x in rule if len(x) == 1}
    return out


def edit_limit(term: str) -> int:
    """Edits that automatic fuzziness allows."""
    return 0 if len(term) < 3 else 1 if len(term) < 6 else 2


def edits(a: str, b: str, most: int) -> int:
    """Restricted edit distance with transpositions; ``most`` + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        last, before, row = before, row, [i, *[0] * len(b)]
        for j in range(1, len(b) + 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], last[j - 2] + 1)
        if min(row) > most:
            return most + 1
    return row[-1]


def edge_words(text: Column) -> Column:
    """Words of letters and digits, lower-cased, for prefix completion."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


__all__ = ["analyze", "edge_words", "edit_limit", "edits", "expand_synonyms", "porter", "standard_tokens", "term_of_word", "tokens", "word_parts"]
