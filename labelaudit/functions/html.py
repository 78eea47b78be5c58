"""Product data from HTML pages: a small reader on the standard library's parser, run over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = "page_id long, url string, title string, description string, specifications map<string,string>, image_urls array<string>, raw_text string"
# Parts of an image's address that mark it as no product picture.
SKIPPED_IMAGES = ("sprite", "transparent", "1x1", "blank", "icon", "logo", "loading")


class _Reader(HTMLParser):
    """Text pieces, and the pieces inside the elements that matter."""

    WATCHED = ("title", "h1", "p", "li", "th", "td", "tr")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.open: list[tuple[str, list]] = []
        self.found: dict[str, list] = {t: [] for t in self.WATCHED}
        self.images: list[str] = []
        self.texts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and (a.get("property") or a.get("name")):
            self.meta.setdefault(a.get("property") or a.get("name"), a.get("content") or "")
        elif tag == "img":
            source = a.get("src") or a.get("data-src") or a.get("data-original")
            if source:
                self.images.append(source)
        elif tag in ("script", "style"):
            self.hidden += 1
        if tag in self.WATCHED:
            if tag in ("p", "li", "tr", "td", "th") and self.open and self.open[-1][0] == tag:
                self._close(tag)
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag in self.WATCHED:
            self._close(tag)

    def _close(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                for name, parts in reversed(self.open[i:]):
                    self.found[name].append(parts)
                    if name in ("th", "td"):
                        for outer, cells in reversed(self.open[:i]):
                            if outer == "tr":
                                cells.append(("cell", parts))
                                break
                del self.open[i:]
                return

    def handle_data(self, data):
        text = data.strip()
        if not text or self.hidden:
            return
        self.texts.append(text)
        for _, parts in self.open:
            parts.append(text)


def _text(parts: list) -> str:
    return " ".join(p for p in parts if isinstance(p, str))


def _first(values: list[str | None]) -> str | None:
    return next((v.strip() for v in values if v and v.strip()), None)


def read_page(url: str, html: str) -> dict:
    """Title, description, specifications (the first of a name wins), pictures and text of a page."""
    r = _Reader()
    r.feed(html or "")
    r.close()
    while r.open:
        r._close(r.open[-1][0])
    first = lambda tag: _text(r.found[tag][0]) if r.found[tag] else None
    specs: dict[str, str] = {}
    for row in r.found["tr"]:
        cells = [_text(p[1]) for p in row if isinstance(p, tuple)]
        if len(cells) >= 2 and cells[0] and cells[1]:
            specs.setdefault(cells[0], cells[1])
    for item in r.found["li"]:
        key, colon, value = _text(item).partition(":")
        if colon and key.strip() and value.strip():
            specs.setdefault(key.strip(), value.strip())
    images = [u for u in dict.fromkeys(urljoin(url or "", s) for s in r.images) if u.startswith("http")]
    return {
        "title": _first([r.meta.get("og:title"), r.meta.get("twitter:title"), first("title"), first("h1")]),
        "description": _first([r.meta.get("description"), r.meta.get("og:description"), first("p")]),
        "specifications": specs,
        "image_urls": images,
        "raw_text": "\n".join(r.texts),
    }


def pages_to_products(pages: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [read_page(u, h) for u, h in zip(f["url"], f["html"], strict=True)]
            out = pd.DataFrame(rows, columns=["title", "description", "specifications", "image_urls", "raw_text"])
            yield pd.concat([f[["page_id", "url"]].reset_index(drop=True), out], axis=1)

    return pages.select("page_id", "url", "html").mapInPandas(run, FIELDS)


#: What the addresses of product pages hold, by marketplace, and where relative ones lead.
PRODUCT_LINKS = {"amazon": (r"/dp/|/gp/product/", "https://www.amazon.in", True), "flipkart": (r"/p/", "https://www.flipkart.com", False)}


def product_links(pages: DataFrame, marketplace: str, most: int) -> DataFrame:
    """page_id, position, url: the first `most` different product links of each result page, in the order of the page."""
    words, base, cut = PRODUCT_LINKS[marketplace]
    links = F.filter(F.regexp_extract_all("html", F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1)), lambda h: h.rlike(words))
    whole = lambda h: F.when(h.rlike("(?i)^https?://"), h).otherwise(F.concat(F.lit(base), F.when(F.startswith(h, F.lit("/")), h).otherwise(F.concat(F.lit("/"), h))))
    found = F.array_distinct(F.transform(links, lambda h: whole(F.substring_index(h, "?", 1) if cut else h)))
    return pages.select("page_id", F.posexplode(F.slice(found, 1, most)).alias("position", "url"))


def route(url: Column) -> Column:
    low = F.lower(url)
    return F.when(F.contains(low, F.lit("amazon")), "amazon").when(F.contains(low, F.lit("flipkart")), "flipkart").otherwise("generic")


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>\s*(.*?)\s*</title>", 1))


def clean_value(x: Column) -> Column:
    """Without direction marks and double space; `X: X` becomes X."""
    x = F.trim(F.regexp_replace(F.translate(x, "‎‏", ""), r"\s+", " "))
    return F.regexp_replace(x, r"^([^:]+?): \1$", "$1")


def first_non_empty(*values: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(v) != "", F.trim(v)) for v in values], F.lit(""))


def image_key(url: Column) -> Column:
    """An address without its size token; null for icons and the like."""
    plain = F.regexp_replace(url, r"\._[A-Z0-9_]+_\.", ".")
    return F.when(~F.lower(url).rlike("|".join(map(re.escape, SKIPPED_IMAGES))), plain)
