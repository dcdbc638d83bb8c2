"""Reading stored HTML: one Arrow UDF parses a page once; everything after it is columns.

The parsers here hold no Spark objects, so tests and UDFs share them.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser
from urllib.parse import parse_qs, unquote, urljoin, urlparse

import pandas as pd

from loomkit.functions.udfs import arrow_udf
from loomkit.schemas import PAGE, RESULTS

# Elements whose content is dropped; elements that start a line; classes of search results.
DROPPED = frozenset(["script", "style", "noscript"])
LINE_STARTS = frozenset(["p", "div", "section", "article", "header", "footer", "li", "br", "h1", "h2", "h3"])
RESULT_CLASSES = frozenset(["result-link", "result__a"])
SEARCH_HOST = "duckduckgo.com"
WEB = ("http", "https")


def spaced(text: str) -> str:
    """Decodes character references (once more, for text that was decoded before) and collapses white space."""
    return re.sub(r"\s+", " ", unescape(text)).strip()


def resolved(base: str, href: str) -> str:
    """The absolute link; one that can't be resolved is no web link."""
    try:
        return urljoin(base, href)
    except ValueError:
        return ""


def web_parts(url: str):
    """The parsed URL if it is http or https, else None."""
    try:
        parts = urlparse(url)
    except ValueError:
        return None
    return parts if parts.scheme in WEB else None


class Anchors(HTMLParser):
    """Collects the text of anchors. `wanted` gives an anchor's target from its attributes, or None to pass over it;
    an anchor that opens inside another replaces it, one that never closes is never reported."""

    def __init__(self):
        super().__init__()
        self.target: str | None = None
        self.label: list[str] = []
        self.found: dict[tuple[str, str], None] = {}  # ordered, without repetitions

    def opened(self, attrs: dict[str, str | None]) -> bool:
        target = self.wanted(attrs)
        if target is not None:
            self.target, self.label = target, []
        return target is not None

    def closed(self) -> bool:
        if self.target is None:
            return False
        entry = self.reported(spaced("".join(self.label)), self.target)
        if entry:
            self.found.setdefault(entry)
        self.target, self.label = None, []
        return True

    def labelled(self, data: str) -> None:
        if self.target is not None:
            self.label.append(data)


class PageReader(Anchors):
    def __init__(self, url: str):
        super().__init__()
        self.url, self.dropping, self.naming = url, 0, False
        self.names: list[str] = []
        self.body: list[str] = []

    def wanted(self, attrs):
        href = attrs.get("href")
        return resolved(self.url, href) if href else None

    def reported(self, label, target):
        return (label or target, target) if web_parts(target) else None

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.dropping += 1
        elif self.dropping:
            pass
        elif tag == "title":
            self.naming = True
        elif tag == "a":
            if self.opened(dict(attrs)):
                self.body.append(" ")
        elif tag in LINE_STARTS:
            self.body.append("\n")

    def handle_endtag(self, tag):
        if self.dropping:
            self.dropping -= tag in DROPPED
        elif tag == "title":
            self.naming = False
        elif tag == "a" and self.closed():
            self.body.append(" ")

    def handle_data(self, data):
        if self.dropping:
            return
        if self.naming:
            self.names.append(data)
        else:
            self.labelled(data)
            self.body.append(data)

    def result(self) -> tuple[str, str, list[dict[str, str]]]:
        lines = "\n".join(map(spaced, "".join(self.body).splitlines()))
        text = re.sub(r"\n{3,}", "\n\n", lines).strip()
        return spaced("".join(self.names)), text, [{"label": a, "href": b} for a, b in self.found]


class ResultReader(Anchors):
    def wanted(self, attrs):
        classes = (attrs.get("class") or "").translate({34: " ", 39: " "}).split()
        return attrs.get("href") or None if RESULT_CLASSES.intersection(classes) else None

    def reported(self, label, target):
        target = cleaned(target)
        parts = web_parts(target) if label and target else None
        return (label, target) if parts and not parts.netloc.endswith(SEARCH_HOST) else None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.opened(dict(attrs))

    def handle_endtag(self, tag):
        if tag == "a":
            self.closed()

    def handle_data(self, data):
        self.labelled(data)


def cleaned(href: str) -> str:
    """A result's own address: protocol-relative and root-relative links made absolute, redirects unwrapped."""
    href = "https:" + href if href.startswith("//") else href
    href = resolved(f"https://{SEARCH_HOST}", href) if href.startswith("/") else href
    try:
        wrapped = parse_qs(urlparse(href).query).get("uddg")
    except ValueError:
        return ""
    return unquote(wrapped[0]) if wrapped else href


def read_page(url: str | None, html: str | None) -> tuple[str | None, str | None, list | None]:
    """(title, text, links) of a page; a null page has none of them."""
    if html is None:
        return None, None, None
    reader = PageReader(url or "")
    reader.feed(html)
    return reader.result()


def read_results(html: str | None) -> list[dict[str, str]] | None:
    if html is None:
        return None
    reader = ResultReader()
    reader.feed(html)
    return [{"title": a, "url": b} for a, b in reader.found]


def decoded(body: bytes | None, content_type: str | None) -> str | None:
    """A fetched body as text by the charset its content type names, UTF-8 by default; bad bytes are replaced.

    A charset that Python doesn't know gives null."""
    if body is None:
        return None
    named = re.search(r"charset=([^;\s]+)", content_type or "", re.I)
    try:
        return body.decode(named[1].strip('"') if named else "utf-8", "replace")
    except LookupError:
        return None


@arrow_udf(PAGE, deterministic=False)
def parse_page(urls: pd.Series, pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(u, p) for u, p in zip(urls, pages, strict=True)], columns=["title", "text", "links"])


@arrow_udf(RESULTS, deterministic=False)
def parse_results(pages: pd.Series) -> pd.Series:
    return pages.map(read_results)


@arrow_udf("string")
def decode_body(bodies: pd.Series, types: pd.Series) -> pd.Series:
    return pd.Series([decoded(b, t) for b, t in zip(bodies, types, strict=True)], dtype=object)


@arrow_udf("string")
def unwrap_redirect(hrefs: pd.Series) -> pd.Series:
    return hrefs.map(cleaned, na_action="ignore")

