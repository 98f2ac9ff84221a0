"""Per-document text statistics and block-wise compression."""

from __future__ import annotations

import re
import zlib

# The most common function words, by language (ISO 639-3).
COMMON_WORDS = {
    "eng": "the a an of and to in is was for on with that at by from but it as are be this has had its not or which were he they their".split(),
    "deu": "der die das und in den von zu mit ist des im für auf ein eine einen dem nicht auch es sich an als aus bei nach war aber zum einer".split(),
    "fra": "le la les de des du et un une en dans que est pour par sur au aux avec plus qui pas a il ne ce cette mais ou son été".split(),
    "spa": "el la los las de del y en un una que por con para es se no su al lo como más pero o este esta fue sin sobre ha".split(),
    "por": "o a os as de do da dos das e em um uma que por com para é se não no na ao mais mas ou sua seu foi pela pelo".split(),
    "ita": "il lo la i gli le di del della dei e in un una che per con non si è al alla da dal nel sono ha più ma anche su una".split(),
    "rus": "и в на не с по из за к от для о что это как но а у же был была было его до во со при их то все".split(),
}
COMMON = frozenset(w for words in COMMON_WORDS.values() for w in words)

NAMES = ("words", "mean_word_length", "symbol_ratio", "digit_ratio", "end_punctuation", "end_punctuation_words", "common_share", "words_per_line", "short_lines", "odd_words", "comma_words", "item_marks")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"’‘“”«»„…()\-–—]|_")
_DIGIT = re.compile(r"\d")
_END = (".", "!", "?", "…", ".”", '."', "»", "”", '"', ")")
_MARK = re.compile(r"(?:[•*▪◦·–-]|\[ ?[xX]?\]|\]|\[|\d{1,3}[.)])")
_STRIP = ".,;:!?'\"’‘“”«»„…()[]{}-–—|/*•#<>="
_COMMON_SETS = {lang: frozenset(words) for lang, words in COMMON_WORDS.items()}
_LANGUAGES = list(COMMON_WORDS)
#: bytes of a compression block
BLOCK = 1024
#: distinct words a worker remembers; the memory is emptied when full
MEMORY_WORDS = 200_000
_FIELD = 40
_MASK = (1 << _FIELD) - 1


class _Words(dict):
    """What each word adds to the counts of a text, as fields of one integer, so that a text is one sum."""

    def __missing__(self, word: str) -> int:
        low = word.lower()
        fields = [
            len(word), len(_SYMBOL.findall(word)), len(_DIGIT.findall(word)), low in COMMON, low.strip(_STRIP).isalpha(),
            word[-1] in ",;", len(word) < 5 and _MARK.fullmatch(low) is not None, *(low in _COMMON_SETS[x] for x in _LANGUAGES),
        ]
        packed = sum(int(f) << (_FIELD * i) for i, f in enumerate(fields))
        if len(self) >= MEMORY_WORDS:
            self.clear()
        self[word] = packed
        return packed


_words = _Words()


def measure(text: str | None) -> tuple[list[float] | None, str | None]:
    """Statistics of a text in the order of ``NAMES`` and the language whose common words are the most frequent.

    Null for texts without words (and for the language if no word is common). Lines are the text's lines; a text
    without line breaks is one line.
    """
    words: list[str] = []
    sizes, ended = [], []
    for line in (text or "").split("\n"):
        if x := line.split():
            words += x
            sizes.append(len(x))
            ended.append(x[-1].endswith(_END))
    n = len(words)
    if not n:
        return None, None
    total = sum(map(_words.__getitem__, words))
    letters, symbols, digits, common, alpha, commas, marks, *by_language = ((total >> (_FIELD * i)) & _MASK for i in range(7 + len(_LANGUAGES)))
    most = max(by_language)
    return [
        float(n),
        letters / n,
        symbols / len(text),
        digits / len(text),
        sum(ended) / len(sizes),
        sum(k for k, e in zip(sizes, ended, strict=True) if e) / n,
        common / n,
        n / len(sizes),
        sum(k < 6 for k in sizes) / len(sizes),
        1.0 - alpha / n,
        commas / n,
        marks / n,
    ], _LANGUAGES[by_language.index(most)] if most else None


def text_stats(text: str | None) -> list[float] | None:
    """Statistics of a text in the order of ``NAMES``; null for texts without words."""
    return measure(text)[0]


#: web addresses; their characters tell nothing about how a text repeats itself
_ADDRESS = re.compile(rb"(?:https?://|www\.)[^\s<>\"\])]+|[\w-]+(?:\.[\w-]+)*\.[a-z]{3,}\b(?:/[^\s<>\"\])]*)?")
_DOTTED = re.compile(rb"\w\.[a-z]{3}|://")


def block_ratios(text: str) -> list[tuple[int, float]]:
    """(bytes, compressed bytes / bytes) of each block of a lower-cased text; the last one may be short.

    A web address is one symbol to the compressor, though all its bytes count as text: what is compressed is
    the wording, and a list of links has hardly any.
    """
    raw = text.lower().encode("utf-8", "replace")
    out = []
    for i in range(0, len(raw), BLOCK):
        block = raw[i : i + BLOCK]
        said = _ADDRESS.sub(b"\1", block) if _DOTTED.search(block) else block
        out.append((len(block), len(zlib.compress(said, 6)) / len(block)))
    return out


def expected_ratio(n: int) -> float:
    """Compression ratio of usual prose in a block of ``n`` bytes: short blocks carry the overhead and repeat less.

    The shape over the length of a curve through blocks of prose; the level is taken from each language's own pages
    (``pages.with_spam``).
    """
    return 0.2958 - 5.418 / n + 6.4996 * n**-0.5


def redundancy(text: str) -> float:
    """Block-wise compression ratio relative to usual prose of the blocks' lengths, weighted by length.

    About 1 for prose, 0.3 to 0.7 for extreme redundancy; 1 for an empty text.
    """
    blocks = [(n, r) for n, r in block_ratios(text) if n >= 40]
    total = sum(n for n, _ in blocks)
    return sum(n * r / expected_ratio(n) for n, r in blocks) / total if total else 1.0



def main_language(text: str) -> str | None:
    """The language whose common words are the most frequent; null if there are none."""
    return measure(text)[1]
