"""URL functions as Column expressions (WHATWG parsing of the schemes a crawler meets)."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
#: scheme, authority, path, query of a URL with authority; control characters and outer blanks are stripped first
HTTP = r"^([a-zA-Z]+)://([^/?#\\]*)([^?#]*)(\?[^#]*)?"
AUTHORITY = r"^(?:[^@]*@)?(\[[0-9a-fA-F:.]+\]|[^:@\[\]]*)(?::([0-9]*))?$"

# Substrings of URLs (lower-cased) that are not followed.
BLOCKED_LINKS = ("_____tmd_____", "x5secdata=", "/redirect/", "click_id=", "utm_source", "utm_medium", "utm_campaign", "scm=", "icms-zebra-")


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)`` with the value evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _clean(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")


def _scheme(clean: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(clean, SCHEME, 1)), F.lit(""))


def scheme(url: Column) -> Column:
    """Lower-cased scheme; null if there is none."""
    return _scheme(_clean(url))


def _with_slashes(clean: Column) -> Column:
    return F.regexp_replace(clean, r"^([a-zA-Z]+):[/\\]*", "$1://")


def _authority(clean: Column) -> Column:
    return F.regexp_extract(_with_slashes(clean), HTTP, 2)


def _host(s: Column, h: Column) -> Column:
    """Host from scheme and lower-cased host text."""
    good = (h != "") & ~h.rlike(r"[\s<>^|%#?/\\\[\]@]") | h.rlike(r"^\[[0-9a-f:.]+\]$")
    return F.when(s.isin("http", "https", "ftp"), F.when(good, h)).when(s.isNotNull(), F.lit(""))


def host(url: Column) -> Column:
    """Lower-cased host of an http(s) or ftp URL, '' for other valid schemes, null if the URL is invalid."""
    parts = lambda u: F.struct(_scheme(u).alias("s"), F.lower(F.regexp_extract(_authority(u), AUTHORITY, 1)).alias("h"))
    return let(_clean(url), lambda u: let(parts(u), lambda x: _host(x["s"], x["h"])))


def is_valid(url: Column) -> Column:
    """Whether the URL parses: a scheme, and for web schemes a host. Null is not valid."""
    return F.coalesce(host(url).isNotNull(), F.lit(False))


def domain_of(url: Column) -> Column:
    """Lower-cased host with ``www.`` kept; null if the URL is invalid."""
    return host(url)


def is_private_host(h: Column) -> Column:
    """Whether a host is this machine or a private, loopback, null or multicast IPv4 address."""
    ip = h.rlike(
        r"^(?:0*(?:0|10|127)\.\d{1,3}|0*(?:22[4-9]|2[3-9]\d|[3-9]\d\d)\.\d{1,3}|0*172\.0*(?:1[6-9]|2\d|3[01])|0*192\.0*168)\.\d{1,3}\.\d{1,3}$"
    )
    return h.isin("localhost", "::1") | ip


def is_safe(url: Column) -> Column:
    """Whether a URL may be fetched: http(s) and not a loopback, private or multicast address."""
    parts = lambda u: F.struct(_scheme(u).alias("s"), F.lower(F.regexp_extract(_authority(u), AUTHORITY, 1)).alias("h"))
    safe = lambda x: F.coalesce(x["s"].isin("http", "https") & ~let(_host(x["s"], x["h"]), is_private_host), F.lit(False))
    return let(_clean(url), lambda u: let(parts(u), safe))


def is_blocked_link(url: Column) -> Column:
    """Whether a link is dropped as tracking or redirect noise."""
    return let(F.lower(url), lambda u: functools.reduce(Column.__or__, [u.contains(x) for x in BLOCKED_LINKS]))


def _encode_form(s: Column) -> Column:
    """Form-style encoding of a query component: decode, then encode with ``+`` for blanks."""
    return F.replace(F.replace(F.url_encode(F.try_url_decode(s)), F.lit("%7E"), F.lit("%7E")), F.lit("%20"), F.lit("+"))


def sorted_query(query: Column) -> Column:
    """Query parameters sorted by name (stable) and re-encoded; '' without parameters."""
    pairs = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda p: p != "")
    keyed = F.transform(
        pairs,
        lambda p, i: F.struct(
            _encode_form(F.substring_index(p, "=", 1)).alias("k"),
            i.alias("i"),
            F.when(p.contains("="), _encode_form(F.substring(p, F.instr(p, "=") + 1, F.length(p)))).otherwise(F.lit("")).alias("v"),
        ),
    )
    joined = F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat(x["k"], F.lit("="), x["v"])), "&")
    return F.when(F.coalesce(F.length(query), F.lit(0)) < 2, F.lit("")).otherwise(F.concat(F.lit("?"), joined))


def normalize(url: Column) -> Column:
    """Canonical form of a URL; null if it does not parse.

    Lower-cased scheme and host (``www.`` kept), ports 80 and 443 dropped for either scheme, one trailing
    slash stripped, query sorted and re-encoded, fragment dropped. Other schemes lose only the fragment.
    """
    return let(_clean(url), _normalize_clean)


def _normalize_clean(u: Column) -> Column:
    w = _with_slashes(u)
    web = F.struct(
        F.regexp_extract(w, HTTP, 2).alias("a"), F.regexp_extract(w, HTTP, 3).alias("p"), F.regexp_extract(w, HTTP, 4).alias("q"),
    )

    def build(s: Column, x: Column) -> Column:
        port = F.regexp_extract(x["a"], AUTHORITY, 2)
        kept = F.when(port.isin("", "80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port))
        path = F.replace(F.replace(x["p"], F.lit("\\"), F.lit("/")), F.lit(" "), F.lit("%20"))
        path = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "^(.+)/$", "$1"))
        return F.concat(s, F.lit("://"), _host(s, F.lower(F.regexp_extract(x["a"], AUTHORITY, 1))), kept, path, sorted_query(x["q"]))

    def of(s: Column) -> Column:
        other = F.concat(s, F.lit(":"), F.regexp_replace(F.regexp_replace(u, SCHEME, ""), r"#.*$", ""))
        valid = (s != "ftp") | _host(s, F.lower(F.regexp_extract(_authority(u), AUTHORITY, 1))).isNotNull()
        return F.when(s.isin("http", "https"), let(web, lambda x: build(s, x))).when(s.isNotNull() & valid, other)

    return let(_scheme(u), of)


def resolve(base: Column, href: Column) -> Column:
    """Absolute URL of ``href`` on a page at ``base``; null if either cannot be parsed.

    Absolute, scheme-relative, root-relative, query-only, fragment-only and relative references; dot segments
    are removed (up to eight levels).
    """
    return let(F.struct(_clean(href).alias("h"), _clean(base).alias("b")), lambda x: let(_resolved(x["b"], x["h"]), lambda j: F.when(is_valid(j), j)))


def _resolved(base: Column, h: Column) -> Column:
    root = F.concat(_scheme(base), F.lit("://"), F.lower(_authority(base)))
    base_path = F.regexp_replace(F.regexp_extract(base, HTTP, 3), "^$", "/")
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    query = F.regexp_extract(base, HTTP, 4)
    return (
        F.when(h.rlike(SCHEME), h)
        .when(h.startswith("//"), F.concat(_scheme(base), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(root, _dots(h)))
        .when(h == "", F.concat(root, base_path, query))
        .when(h.startswith("?"), F.concat(root, base_path, h))
        .when(h.startswith("#"), F.concat(root, base_path, query, h))
        .otherwise(F.concat(root, _dots(F.concat(folder, h))))
    )


def _dots(path: Column) -> Column:
    tail = F.regexp_extract(path, r"([?#].*)$", 1)
    p = F.regexp_replace(path, r"[?#].*$", "")
    p = F.regexp_replace(F.regexp_replace(p, r"/\.(?=/)", ""), r"/\.$", "/")
    for _ in range(8):
        p = F.regexp_replace(p, r"^((?:/[^/]+)*?)/(?!\.\.(?:/|$))[^/]+/\.\.(/|$)", "$1/")
    p = F.regexp_replace(p, r"^(?:/\.\.)+(?=/|$)", "")
    return F.concat(F.when(p == "", F.lit("/")).otherwise(F.regexp_replace(p, "^//+", "/")), tail)


def display(url: Column) -> Column:
    """Host and path without trailing slash, as shown beside a result; the URL itself if it has no host."""
    shown = lambda u: let(host(u), lambda h: F.when(h != "", F.concat(h, F.regexp_replace(F.regexp_extract(_clean(u), HTTP, 3), "/$", ""))).otherwise(u))
    return let(url, shown)


def path_of(url: Column) -> Column:
    """Lower-cased path, '/' if empty."""
    return F.regexp_replace(F.lower(F.regexp_extract(_clean(url), HTTP, 3)), "^$", "/")


def cache_key(parts: dict[str, Column]) -> Column:
    """Cache key of a search request: non-empty parts percent-encoded as ``name=value``, sorted, joined by ``|``."""
    made = [
        F.when(
            F.coalesce(v.cast("string"), F.lit("")) != "",
            F.concat(F.lit(f"{k}="), F.replace(F.url_encode(v.cast("string")), F.lit("+"), F.lit("%20"))),
        )
        for k, v in parts.items()
    ]
    return F.array_join(F.array_sort(F.array_compact(F.array(*made))), "|")
