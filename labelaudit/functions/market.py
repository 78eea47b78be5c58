"""Product pages of two marketplaces: a small element tree, and where each page keeps what."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

from labelaudit.functions.html import FIELDS, SKIPPED_IMAGES

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Element:
    """An element of a page. The page's elements lie in one list by where they begin, so what is inside one is a slice."""

    __slots__ = ("tag", "attrs", "children", "page", "at", "end")

    def __init__(self, tag: str, attrs: dict[str, str], page: list[Element]) -> None:
        self.tag, self.attrs, self.children, self.page, self.at, self.end = tag, attrs, [], page, len(page), None
        page.append(self)

    def walk(self) -> list[Element]:
        return self.page[self.at + 1 : self.end]

    def strings(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, Element):
                if c.tag not in ("script", "style"):
                    yield from c.strings()
            elif c.strip():
                yield c.strip()

    def text(self, by: str = " ") -> str:
        return by.join(self.strings())

    def all(self, *tags: str, **attrs: str) -> list[Element]:
        found = [e for e in self.walk() if e.tag in tags] if tags else self.walk()
        for k, v in attrs.items():
            found = [e for e in found if e.has(k, v)]
        return found

    def one(self, *tags: str, **attrs: str) -> Element | None:
        return next(iter(self.all(*tags, **attrs)), None)

    def ids(self) -> dict[str, Element]:
        """The first element of each id."""
        return {e.attrs["id"]: e for e in reversed(self.walk()) if "id" in e.attrs}

    def has(self, name: str, value: str) -> bool:
        """Whether an attribute is the value; for `cls`, the whole class list or one of its names."""
        own = self.attrs.get("class" if name == "cls" else name, "")
        return own == value or (name == "cls" and value in own.split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("page", {}, [])
        self.open = [self.root]

    def updatepos(self, i, j):
        return j  # lines and columns are not asked for

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs}, self.root.page)
        self.open[-1].children.append(e)
        if tag not in VOID:
            self.open.append(e)
        else:
            e.end = len(e.page)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                for e in self.open[i:]:
                    e.end = len(e.page)
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str | None) -> Element:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def first(*values: str | None) -> str | None:
    return next((v.strip() for v in values if v and v.strip()), None)


def shown(e: Element | None, by: str = " ") -> str | None:
    return e.text(by) if e is not None else None


def meta(page: Element, name: str) -> str | None:
    e = page.one("meta", property=name) or page.one("meta", name=name)
    return e.attrs.get("content") if e is not None else None


class Specs(dict):
    """Names and values without direction marks; the first value of a name wins."""

    def add(self, key: str, value: str) -> None:
        key = re.sub("[‎‏:]", "", key).strip()
        value = re.sub(r"\s+", " ", re.sub("[‎‏]", "", value)).strip()
        head, _, tail = value.partition(": ")
        value = head.strip() if tail and head.strip() == tail.strip() else value
        if 2 <= len(key) <= 100 and "\n" not in key and value:
            self.setdefault(key, value)

    def rows(self, part: Element | None, left: str = "th", right: str = "td") -> None:
        for row in part.all("tr") if part is not None else []:
            cells = (row.all(left)[:1] + row.all(right)[:1]) if left != right else row.all(left)[:2]
            if len(cells) == 2:
                self.add(cells[0].text(), cells[1].text())


class Images:
    """Addresses of pictures, icons and repeats (but for their size) left out."""

    def __init__(self, url: str) -> None:
        self.url, self.seen, self.found = url, set(), []

    def add(self, source: str | None, full_size: bool = False) -> None:
        if not source:
            return
        if source.startswith("{"):  # sizes by address: the largest
            try:
                sizes = json.loads(source)
                source = max(sizes, key=lambda k: sizes[k][0] * sizes[k][1])
            except (ValueError, TypeError, IndexError, KeyError):
                return
        small = lambda u: re.sub(r"\._[A-Z0-9_]+_\.", ".", u)
        source = small(source) if full_size else source
        whole = urljoin(self.url, source)
        if any(s in source.lower() for s in SKIPPED_IMAGES) or not whole.startswith("http") or small(whole) in self.seen:
            return
        self.seen.add(small(whole))
        self.found.append(whole)


# The identifiers of the sections of the first marketplace's pages, in the order they are read.
AMAZON_TABLES = ("productDetails_detailBullets_sections1", "productDetails_techSpec_section_1", "productDetails_db_sections")
AMAZON_GALLERIES = ("altImages", "imageBlock")
AMAZON_PICTURES = ("aplus", "productDescription", "important-information", "richProductDescription", "feature-bullets", "productOverview_feature_div")
AMAZON_SECTIONS = (
    "productTitle", "titleSection", "centerCol", "leftCol", "rightCol", "dp-container", "productDescription", "productDetails_feature_div",
    "detailBulletsWrapper_feature_div", "technical-data", "product-facts", "featurebullets_feature_div", "btfContent", "brand-story-widget",
)
LICENCES = (r"FSSAI\s*(?:License|Lic\.?|No\.?|Number)?[:\s]*(\d{14})", r"License\s*No\.?[:\s]*(\d{14})", r"Lic\.?\s*No\.?[:\s]*(\d{14})")


def amazon(url: str, html: str | None) -> dict:
    page = tree(html)
    of = page.ids().get
    title = first(shown(page.one("span", id="productTitle"), ""), shown(page.one("h1", id="title"), ""), meta(page, "og:title"))
    price = first(shown(page.one("span", cls="a-price-whole"), ""), *[shown(page.one("span", id=f"priceblock_{n}price"), "") for n in ("our", "deal")])
    mrp = first(shown(page.one("span", cls="a-text-price"), ""), shown(page.one("span", **{"data-a-strike": "true"}), ""))
    bullets = [li.text() for n in ("feature-bullets", "featurebullets_feature_div") if of(n) for li in of(n).all("li")]
    bullets = list(dict.fromkeys(b for b in bullets if len(b) > 5))

    specs = Specs()
    for name in AMAZON_TABLES:
        specs.rows(of(name))
    for li in of("detailBullets_feature_div").all("li") if of("detailBullets_feature_div") else []:
        for span in li.all("span", cls="a-list-item") or li.all("span"):
            key, colon, value = span.text().partition(":")
            if colon and "\n" not in span.text():
                specs.add(key, value)
    specs.rows(page.one("table", cls="a-normal a-spacing-micro"), "td", "td")
    specs.rows(of("prodDetails"))
    facts, heading = of("important-information"), None
    for e in facts.all("h4", "h5", "b", "strong", "p", "div") if facts else []:
        if e.tag not in ("p", "div"):
            heading = e.text("").replace(":", "").strip()
        elif heading and len(e.text()) > 3:
            specs.add(heading, e.text())
            heading = None
    whole = page.text()
    number = next((m for m in (re.search(p, whole, re.IGNORECASE) for p in LICENCES) if m), None) or (re.search(r"(\d{14})", facts.text("\n")) if facts else None)
    if number:
        specs.add("FSSAI License Number", number.group(1))

    images = Images(url)
    main = page.one("img", id="landingImage")
    for name in ("data-old-hires", "data-a-dynamic-image", "src") if main is not None else ():
        images.add(main.attrs.get(name))
    for name in AMAZON_GALLERIES:
        for img in of(name).all("img") if of(name) else []:
            images.add(img.attrs.get("src"), full_size=True)
            images.add(img.attrs.get("data-old-hires"))
    for name in AMAZON_PICTURES:
        for img in of(name).all("img") if of(name) else []:
            images.add(img.attrs.get("src"))
            images.add(img.attrs.get("data-src") if name == "aplus" else None)
    for script in page.all("script", type="text/javascript"):
        code = "".join(c for c in script.children if isinstance(c, str))
        for name in ("hiRes", "large"):
            for address in re.findall(rf'"{name}"\s*:\s*"(https?://[^"]+)"', code):
                images.add(address)

    description = first(shown(page.one("div", id="productDescription")), meta(page, "description"), meta(page, "og:description"))
    lines = [f"{n}: {v}" for n, v in (("Title", title), ("Price", price), ("MRP", mrp)) if v]
    lines += ["Features:", *[f"- {b}" for b in bullets]] if bullets else []
    lines += ["\nProduct Specifications:", *[f"{k}: {v}" for k, v in specs.items()]] if specs else []
    for name, text in (("Description", description), ("Important Information", shown(facts, "\n")), ("A+ Content / Enhanced Brand Content", shown(of("aplus"), "\n"))):
        lines += [f"\n{name}:", text] if text else []
    for name in AMAZON_SECTIONS:
        text = shown(of(name))
        if text and len(text) > 50 and text not in lines:
            lines += [f"\n[Section {name}]:", text[:5000]]
    lines += ["\n[Full Page Text Extract]:", whole[:10_000]]
    extra = {n: v for n, v in (("Selling Price", price), ("MRP", mrp)) if v}
    return {"title": title, "description": description, "specifications": dict(specs) | extra, "image_urls": images.found, "raw_text": "\n".join(x for x in lines if x)}


# Class names of the second marketplace's pages.
FLIPKART_TITLES = (("span", "VU-ZEz"), ("span", "B_NuCI"), ("h1", "_6EBuvT"))
FLIPKART_PRICES = ("Nx9bqj CxhGGd", "_30jeq3 _16Jk6d")
FLIPKART_MRPS = ("yRaY8j A6+E6v", "_3I9_wc _2p6lqe")
FLIPKART_TABLES = ("_4BJ2V+", "_14cfVK")


def flipkart(url: str, html: str | None) -> dict:
    page = tree(html)
    by_class = lambda tag, names: [shown(page.one(tag, cls=n), "") for n in names]
    title = first(*[shown(page.one(tag, cls=n), "") for tag, n in FLIPKART_TITLES], meta(page, "og:title"))
    price, mrp = first(*by_class("div", FLIPKART_PRICES)), first(*by_class("div", FLIPKART_MRPS))
    specs: dict[str, str] = {}
    highlights = page.one("div", cls="_1AN87F")
    for li in highlights.all("li") if highlights else []:
        key, colon, value = li.text().partition(":")
        if colon:
            specs[key.strip()] = value.strip()
    tables = next((found for found in (page.all("div", cls=n) for n in FLIPKART_TABLES) if found), [])
    for row in (r for t in tables for r in t.all("tr")):
        cells = [c.text() for c in row.all("td")[:2]]
        if len(cells) == 2 and all(cells):
            specs[cells[0]] = cells[1]
    images: dict[str, None] = {}

    def add(source: str | None) -> None:
        if source and source.startswith("http") and not re.search("loading|placeholder", source.lower()):
            images.setdefault(re.sub(r"/\d+/\d+/", "/832/832/", source))

    for name in ("_396cs4", "_2amPTt _3nMsss"):
        for img in page.all("img", cls=name):
            add(img.attrs.get("src"))
    for img in page.all("img"):
        source = img.attrs.get("src") or img.attrs.get("data-src") or ""
        if re.search(r"_\w+\s*_\w+", img.attrs.get("class", "")) and re.search("flipkart|f1commerce", source):
            add(source)
    about = next((e for e in page.all("div") if re.search("RmoJUa|_1mXcCf", e.attrs.get("class", ""))), None)
    for img in about.all("img") if about else []:
        add(img.attrs.get("src"))
    extra = {n: v for n, v in (("Selling Price", price), ("MRP", mrp)) if v}
    description = first(shown(page.one("div", cls="_1mXcCf RmoJUa")), meta(page, "description"))
    return {"title": title, "description": description, "specifications": specs | extra, "image_urls": list(images), "raw_text": "\n".join(page.strings())}


def products(pages: DataFrame, read) -> DataFrame:
    """page_id, url and what `read` (amazon or flipkart) finds, page by page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [read(u or "", h) for u, h in zip(f["url"], f["html"], strict=True)]
            found = pd.DataFrame(rows, columns=["title", "description", "specifications", "image_urls", "raw_text"])
            yield pd.concat([f[["page_id", "url"]].reset_index(drop=True), found], axis=1)

    return pages.select("page_id", "url", "html").mapInPandas(run, FIELDS)
