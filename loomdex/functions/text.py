"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Openings of paragraphs that are page furniture of wikis, players and consent dialogs; an
# alternative without ^ matches anywhere, as in the original list.
BOILERPLATE = (
    "^jump to:?", "^navigation$", "^main menu", "^personal tool", "^views$", "^actions$", "^(search|search this site)", "^donate",
    "^create account|log in|log out", "^privacy policy|terms of use", "^about wikipedia|disclaimers", "^contact us|contact wikipedia",
    "^cookie|i agree", "^developed by|powered by", "^all text available under", "^wikipedia® is a registered trademark",
    "^this page was last edited", "^categories?:", "^hidden categories?:", "^navigation menu", "^toggle the table of contents",
    r"\[\]", r"^edit(\ssource)?$", "^from wikipedia, the free encyclopedia", "^video player is loading", "^play video",
    "^skip backward|skip forward", "^current time|duration|stream type", "^playback rate|fullscreen", "^this is a modal window",
    "^beginning of dialog window", "^escape will cancel", "^this modal can be closed", "^activating the close button",
    "^live news and current affairs", "^unmute|mute|captions", "^quality levels|audio track", "^seek to live", "^error code:",
)
BOILERPLATE_REGEX = "|".join(BOILERPLATE)
MIN_PARAGRAPH = 30


def is_boilerplate(text: Column) -> Column:
    """Whether the first hundred characters, lower-cased, match the boilerplate list."""
    return F.lower(F.substring(text, 1, 100)).rlike(BOILERPLATE_REGEX)


def is_paragraph(text: Column) -> Column:
    """Gate for extracted paragraphs: more than 30 characters once trimmed, and no boilerplate."""
    t = F.trim(text)
    return (F.length(t) > MIN_PARAGRAPH) & ~is_boilerplate(t)


def word_count(text: Column) -> Column:
    """Number of runs of non-blanks; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(0)).cast("int")


def full_text(content: Column) -> Column:
    """Headings h1 to h6, then paragraphs, joined by a blank; null lists count as empty."""
    empty = F.array().cast("array<string>")
    return F.array_join(F.concat(*[F.coalesce(content[k], empty) for k in ("h1", "h2", "h3", "h4", "h5", "h6", "paragraphs")]), " ")


def content_hash(text: Column) -> Column:
    """SHA-256 in hex."""
    return F.sha2(text, 256)


def short_hash(text: Column, length: int = 8) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def description(highlights: Column, meta: Column, og: Column) -> Column:
    """First of joined highlights, meta description and og description that is not empty; else ''."""
    empty = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(empty(F.array_join(F.coalesce(highlights, F.array().cast("array<string>")), "...")), empty(meta), empty(og), F.lit(""))


def emphasis_parts(text: Column) -> Column:
    """(text, marked) parts of a highlighted text, split at ``<em>`` tags; empty parts dropped."""
    pieces = F.flatten(
        F.transform(
            F.split(text, "<em>"),
            lambda p, i: F.when(
                i == 0, F.array(F.struct(p.alias("text"), F.lit(False).alias("marked")))
            ).otherwise(
                F.array(
                    F.struct(F.split_part(p, F.lit("</em>"), F.lit(1)).alias("text"), F.lit(True).alias("marked")),
                    F.struct(F.regexp_replace(F.substring(p, F.length(F.split_part(p, F.lit("</em>"), F.lit(1))) + 1, F.length(p)), "^</em>", "").alias("text"), F.lit(False).alias("marked")),
                )
            ),
        )
    )
    return F.filter(pieces, lambda x: x["text"] != "")


def page_window(current: Column, total: Column) -> Column:
    """Page numbers to show: first, last and one each side of the current; ``…`` where pages are left out."""
    pages = F.filter(F.sequence(F.lit(1), F.greatest(total, F.lit(1))), lambda p: (p == 1) | (p == total) | (F.abs(p - current) <= 1))
    marks = F.transform(
        pages,
        lambda p, i: F.when((i > 0) & (p - F.get(pages, i - 1) > 1), F.array(F.lit("…"), p.cast("string"))).otherwise(F.array(p.cast("string"))),
    )
    return F.flatten(marks)


def standard_tokens(text: Column) -> Column:
    """Lower-cased words: runs of letters, digits and underscores, inner dots and apostrophes kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+(?:[.'][\p{L}\p{N}_]+)*"), F.lit(0))


def bytes_mb(n: Column) -> Column:
    return F.round(n / F.lit(1024.0 * 1024.0), 2)


def bytes_gb(n: Column) -> Column:
    return F.round(n / F.lit(1024.0**3), 2)
