"""HTML: rendering and bot signals as expressions, and a tolerant tree extractor as an Arrow function."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import BOILERPLATE_REGEX, MIN_PARAGRAPH

# Markers of client-rendered pages.
SPA_MARKERS = (
    "__next_data__", "__next_rev", "__next_build_id", "/_next/static", "data-react", "ng-app", "data-vue", "v-app", "ng-version", "_nghost", "_ngcontent",
    "data-svelte", "svelte:",
)
SPA_PATTERNS = (
    r'(?i)id="(app|mount|root|__next)"[>\s]',
    r"(?i)<body[^>]*>\s*<[a-z]+-[a-z]+[^>]*>\s*</[a-z]+-[a-z]+>",
    r'(?i)data-(page|component|props)="',
)
RENDER_HEADERS = ("x-js-render", "x-spa", "x-nextjs-cached")
MIN_SCRIPTS = 30
MIN_TEXT_RATIO = 0.05
SHELL_TEXT = 50
# Containers of the main content, in order of preference.
CONTAINERS = (
    ("tag", "article"), ("tag", "main"), ("role", "main"), ("id", "content"), ("class", "content"), ("class", "mw-parser-output"), ("id", "mw-content-text"),
    ("class", "post-content"), ("class", "article-content"), ("id", "article-content"), ("class", "entry-content"), ("id", "bodyContent"),
)
NON_CONTENT_TAGS = frozenset("nav footer header aside script style noscript".split())
NON_CONTENT_ROLES = frozenset("navigation complementary contentinfo".split())
NON_CONTENT_NAMES = re.compile(r"nav|footer|header|sidebar|aside|advert", re.I)


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def spa_markers(html: Column) -> Column:
    """First tier: framework markers, root elements, component shells, loaders and data attributes."""
    low = F.lower(html)
    body = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)</body>", 1), r"(?is)<noscript.*?</noscript>", ""))
    shell = body.rlike(r"<[a-z]+-[a-z]+[^>]*>") & (F.length(F.trim(F.regexp_replace(body, r"<[^>]+>", ""))) < SHELL_TEXT)
    loader = low.contains("loading...") & low.contains("window.onload")
    return _any([low.contains(m) for m in SPA_MARKERS] + [html.rlike(p) for p in SPA_PATTERNS] + [shell, loader])


def script_sources(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"(?i)<script[^>]+src="))


def text_ratio(html: Column) -> Column:
    n = F.length(html)
    return F.when(n > 0, F.length(F.trim(F.regexp_replace(html, r"<[^>]+>", ""))) / n).otherwise(F.lit(0.0))


def needs_rendering(html: Column, headers: Column | None = None) -> Column:
    """Whether a page is rendered by scripts: a header says so, a marker of the first tier, many scripts, next to no
    text, or a notice that scripts are needed. Null pages are not."""
    signals = [
        spa_markers(html), script_sources(html) >= MIN_SCRIPTS, text_ratio(html) < MIN_TEXT_RATIO,
        html.rlike(r"(?i)<noscript[^>]*>.*?(javascript|enable|enable javascript).*?</noscript>"),
    ]
    if headers is not None:
        signals += [F.coalesce(F.element_at(headers, h).isin("true", "1"), F.lit(False)) for h in RENDER_HEADERS]
    return F.coalesce(_any(signals), F.lit(False))


def is_anti_bot(status: Column, html: Column, headers: Column) -> Column:
    """Whether a response is a block page of a bot defence rather than the page."""
    low = F.lower(html)
    has = lambda *xs: _any([low.contains(x) for x in xs])
    return F.coalesce(
        status.isin(401, 403, 503)
        | (low.contains("cloudflare") & has("checking your browser", "challenge", "ray id", "__cf_"))
        | F.element_at(headers, "x-datadome").isNotNull()
        | has("datadome", "incapsula", "imperva", "perimeterx", "arkose")
        | (low.contains("access denied") & low.contains("bot"))
        | ((F.length(html) > 0) & (F.length(html) < 500) & low.contains("javascript")),
        F.lit(False),
    )


def _unescape(x: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def tag_texts(html: Column, tag: str) -> Column:
    """Trimmed non-empty texts of a tag by regular expression (well-formed pages)."""
    raw = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    return F.filter(F.transform(raw, lambda x: F.trim(_unescape(F.regexp_replace(x, r"<[^>]+>", "")))), lambda x: x != "")


def title_of(html: Column) -> Column:
    """og:title, else the title tag, else the first h1, else ''; trimmed."""
    og = F.trim(F.regexp_extract(html, r"(?is)<meta[^>]+property=[\"']og:title[\"'][^>]+content=[\"']([^\"']*)[\"']", 1))
    title = F.trim(_unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.coalesce(F.nullif(og, F.lit("")), F.nullif(title, F.lit("")), F.get(tag_texts(html, "h1"), F.lit(0)), F.lit(""))


# --- tree extractor ---------------------------------------------------------------------------------

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_BOILERPLATE = re.compile(BOILERPLATE_REGEX)


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):  # noqa: ANN201
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, _Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)


class _Tree(HTMLParser):
    """Builds a tree as browsers do where it matters: void tags, implied ends of paragraphs, stray end tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _CLOSES_P:
            self._close("p", stop={"button", "table", "td", "th"})
        if tag == "li":
            self._close("li", stop={"ul", "ol"})
        n = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(n)
        if tag not in _VOID:
            self.at = n

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def _close(self, tag: str, stop: set[str]) -> None:
        n = self.at
        while n.parent is not None and n.tag not in stop:
            if n.tag == tag:
                self.at = n.parent
                return
            n = n.parent

    def handle_endtag(self, tag: str) -> None:
        self._close(tag, stop=set())

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def _is_container(n: _Node, how: str, name: str) -> bool:
    if how == "tag":
        return n.tag == name
    value = n.attrs.get(how, "")
    return name in value.split() if how == "class" else value == name


def _paragraphs(nodes: list[_Node]) -> list[str]:
    out = []
    for root in nodes:
        for n in root.walk():
            if n.tag == "p":
                t = n.text().strip()
                if len(t) > MIN_PARAGRAPH and not _BOILERPLATE.search(t[:100].lower()):
                    out.append(t)
    return out


def parse_page(html: str | None) -> dict | None:
    """Everything the index keeps of a page; null for null.

    Headings come from the whole document, paragraphs from the first container of ``CONTAINERS`` that exists (all
    articles, if that is ``article``), else from the children of the body that are not navigation, footers and the
    like. ``hrefs`` are the raw link targets in document order.
    """
    if html is None:
        return None
    tree = _Tree()
    tree.feed(html)
    tree.close()
    nodes = list(tree.root.walk())
    heads = {h: [t for n in nodes if n.tag == h and (t := n.text().strip())] for h in _HEADINGS}
    main: list[_Node] = []
    for how, name in CONTAINERS:
        main = [n for n in nodes if _is_container(n, how, name)]
        if main:
            main = main if name == "article" and how == "tag" else main[:1]
            break
    if not main:
        body = next((n for n in nodes if n.tag == "body"), tree.root)
        main = [
            c for c in body.children
            if isinstance(c, _Node) and c.tag not in NON_CONTENT_TAGS and c.attrs.get("role") not in NON_CONTENT_ROLES
            and not NON_CONTENT_NAMES.search(c.attrs.get("id", "")) and not NON_CONTENT_NAMES.search(c.attrs.get("class", ""))
        ]
        # a paragraph that stands in the body itself is not inside any child
        main = [_Node("", {}, None) if c.tag == "p" else c for c in main]
    meta: dict[str, str] = {}
    for n in nodes:
        if n.tag == "meta":
            key = n.attrs.get("name") or n.attrs.get("property")
            if key and key.lower() not in meta:
                meta[key.lower()] = n.attrs.get("content", "").strip()
    title = next((n.text() for n in nodes if n.tag == "title"), "")
    og = meta.get("og:title", "")
    return {
        "title": (og or title.strip() or (heads["h1"][0] if heads["h1"] else "")).strip(),
        **heads,
        "paragraphs": _paragraphs(main),
        "meta_description": meta.get("description") or meta.get("og:description") or None,
        "meta_keywords": [k.strip() for k in meta.get("keywords", "").split(",") if k.strip()] or None,
        "og_title": og or None,
        "og_description": meta.get("og:description") or None,
        "og_image": meta.get("og:image") or None,
        "hrefs": [n.attrs["href"] for n in nodes if n.tag == "a" and n.attrs.get("href")],
    }


_LIST = T.ArrayType(T.StringType())
EXTRACTED = T.StructType(
    [T.StructField("title", T.StringType())]
    + [T.StructField(h, _LIST) for h in _HEADINGS]
    + [T.StructField("paragraphs", _LIST), T.StructField("meta_description", T.StringType()), T.StructField("meta_keywords", _LIST)]
    + [T.StructField(c, T.StringType()) for c in ("og_title", "og_description", "og_image")]
    + [T.StructField("hrefs", _LIST)]
)
_ARROW = pa.struct([(f.name, pa.list_(pa.string()) if f.dataType == _LIST else pa.string()) for f in EXTRACTED.fields])


@F.arrow_udf(EXTRACTED)
def _extract(html: pa.Array) -> pa.Array:
    return pa.array([parse_page(h) for h in html.to_pylist()], _ARROW)


def extract(html: Column) -> Column:
    """Struct ``EXTRACTED`` of a page; the hrefs are raw, ``frontier.page_links`` resolves them."""
    return _extract(html)
