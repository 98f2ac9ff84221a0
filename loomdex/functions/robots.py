"""robots.txt and sitemap functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .url import path_of

_EMPTY = "array<string>"


def _rule_matches(rule: Column, path: Column) -> Column:
    exact = rule.endswith("$")
    clean = F.when(exact, F.substring(rule, F.lit(1), F.length(rule) - 1)).otherwise(F.regexp_replace(rule, "[?*]$", ""))
    return F.when(exact, path == clean).otherwise(path.startswith(clean))


def is_allowed(url: Column, disallow: Column, allow: Column) -> Column:
    """Whether robots rules let a URL be fetched.

    Any allow match wins before any disallow match, whatever the lengths; ``$`` makes a rule exact, one trailing
    ``*`` or ``?`` is dropped, other rules are prefixes. The path is lower-cased, the query ignored. Without rules,
    and for null rules, everything is allowed.
    """
    path = path_of(url)
    ok = F.exists(F.coalesce(allow, F.array().cast(_EMPTY)), lambda r: _rule_matches(r, path))
    no = F.exists(F.coalesce(disallow, F.array().cast(_EMPTY)), lambda r: (r != "*") & _rule_matches(r, path))
    return ok | ~no


def parse(body: Column) -> Column:
    """Struct (disallow, allow, crawl_delay_ms) of the ``*`` group; every user-agent line decides anew."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.lower(F.trim(F.regexp_replace(x, r"[\r\t]+", " "))))
    start = F.struct(
        F.array().cast(_EMPTY).alias("disallow"), F.array().cast(_EMPTY).alias("allow"), F.lit(0.0).alias("crawl_delay_ms"), F.lit(False).alias("star")
    )

    def value(x: Column) -> Column:
        return F.trim(F.regexp_replace(x, r"^[a-z\-]+:", ""))

    def step(s: Column, x: Column) -> Column:
        v = value(x)
        delay = F.regexp_extract(v, r"^([0-9]*\.?[0-9]+)", 1).try_cast("double")
        here = s["star"]
        return F.struct(
            F.when(here & x.startswith("disallow:") & (v != ""), F.array_append(s["disallow"], v)).otherwise(s["disallow"]).alias("disallow"),
            F.when(here & x.startswith("allow:") & (v != ""), F.array_append(s["allow"], v)).otherwise(s["allow"]).alias("allow"),
            F.when(here & x.startswith("crawl-delay:") & delay.isNotNull(), delay * 1000).otherwise(s["crawl_delay_ms"]).alias("crawl_delay_ms"),
            F.when(x.startswith("user-agent:"), v == "*").otherwise(here).alias("star"),
        )

    done = F.aggregate(lines, start, step)
    return F.struct(done["disallow"].alias("disallow"), done["allow"].alias("allow"), done["crawl_delay_ms"].alias("crawl_delay_ms"))


def crawl_delay(robots_ms: Column, default_ms: int) -> Column:
    """The larger of the site's and the configured delay; the configured one without a site's."""
    return F.greatest(F.coalesce(robots_ms, F.lit(0.0)), F.lit(float(default_ms)))


def sitemaps_of(body: Column) -> Column:
    """URLs of ``Sitemap:`` lines of a robots.txt, case kept."""
    return F.regexp_extract_all(body, F.lit(r"(?im)^[ \t]*sitemap:[ \t]*(http\S*)"), F.lit(1))


def sitemap_locations(xml: Column) -> Column:
    """Trimmed ``<loc>`` values that start with http; entities are not decoded."""
    found = F.transform(F.regexp_extract_all(xml, F.lit(r"(?i)<loc>([^<]+)</loc>"), F.lit(1)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(found, lambda x: x.startswith("http"))


def is_sitemap(url: Column) -> Column:
    """Whether a location is a sitemap itself."""
    return url.rlike(r"(?i)/sitemap[\w-]*\.\w+(\.gz)?$")
