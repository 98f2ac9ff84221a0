"""Language of an extracted page by a vote of function words (for the index; see the llm package for segments)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words by ISO 639-3 code.
FUNCTION_WORDS = {
    "eng": "the and of to in is was for on with that it as at by from this are be has not have".split(),
    "deu": "der die das und ist nicht ein eine mit von zu den im auf für sich des dem auch es".split(),
    "fra": "le la les des et est un une dans pour que qui par sur pas au plus avec ce du".split(),
    "spa": "el la los las de y en que un una por con para es se no su del al como".split(),
    "por": "o a os as de e em que um uma por com para não se na no do da mais".split(),
    "ita": "il lo la i gli le di e in che un una per con non si del della è sono".split(),
    "rus": "и в не на с что как по это к но из у за от о так же для был".split(),
}
ISO1 = {"eng": "en", "deu": "de", "fra": "fr", "spa": "es", "por": "pt", "ita": "it", "rus": "ru"}
MIN_LENGTH = 20
LOOK_AT = 500


def _member(known: Column):  # noqa: ANN202
    return lambda w: F.array_contains(known, w)


def detect(text: Column) -> Column:
    """ISO 639-3 code, ``und`` for short texts and texts without function words; looks at the first 500 characters."""
    words = F.split(F.lower(F.substring(text, 1, LOOK_AT)), r"[^\p{L}]+")
    known = [F.array(*map(F.lit, ws)) for ws in FUNCTION_WORDS.values()]
    votes = [
        F.struct(F.size(F.filter(words, _member(ws))).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k"))
        for i, (k, ws) in enumerate(zip(FUNCTION_WORDS, known, strict=True))
    ]
    best = F.greatest(*votes)
    return F.when((F.length(text) < MIN_LENGTH) | text.isNull() | (best["n"] == 0), "und").otherwise(best["k"])


def iso1(code: Column) -> Column:
    """Two-letter code of a three-letter one; other values stay."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ISO1.items() for x in kv]), code), code)
