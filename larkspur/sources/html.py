"""Captured HTML pages parsed by one Arrow function over the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "page_id long, url string, title string, description string, lang string, viewport boolean, charset boolean, headings map<string,int>, links array<struct<href:string,text:string,relative:boolean,internal:boolean>>, images int, images_with_alt int, lists int, forms int, tables int, text string, meta map<string,string>, heading_texts array<struct<level:string,text:string>>, image_list array<struct<src:string,alt:string,title:string,width:string,height:string>>"


class Page(HTMLParser):
    """What the analyses need of a page, in one pass."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.title, self.description, self.lang = url, None, None, None
        self.viewport = self.charset = False
        self.headings: dict[str, int] = {}
        self.links: list[dict] = []
        self.images = self.alts = self.lists = self.forms = self.tables = 0
        self.pieces: list[str] = []
        self.meta: dict[str, str] = {}
        self.heading_texts: list[dict] = []
        self.heading: dict | None = None
        self.image_list: list[dict] = []
        self.quiet = 0
        self.in_title = False
        self.link: dict | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in ("script", "style"):
            self.quiet += 1
        elif tag == "title":
            self.in_title = self.title is None
        elif tag == "html":
            self.lang = a.get("lang") or self.lang
        elif tag == "meta":
            name = a.get("name", "").lower()
            if name == "description" and self.description is None:
                self.description = a.get("content", "")
            if (key := a.get("name") or a.get("property")) and a.get("content"):
                self.meta[key] = a["content"]
            self.viewport |= name == "viewport"
            self.charset |= "charset" in a or a.get("http-equiv", "").lower() == "content-type"
        elif tag == "a" and "href" in a:
            href = a["href"]
            self.link = {"href": href, "text": "", "relative": href.startswith("/"), "internal": False}
            self.links.append(self.link)
        elif tag == "img":
            self.images += 1
            self.alts += bool(a.get("alt"))
            if a.get("src"):
                self.image_list.append({"src": a["src"]} | {k: a.get(k, "") for k in ("alt", "title", "width", "height")})
        self.lists += tag in ("ul", "ol")
        self.forms += tag == "form"
        self.tables += tag == "table"
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.headings[tag] = self.headings.get(tag, 0) + 1
            self.heading = {"level": tag, "text": ""}
            self.heading_texts.append(self.heading)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.quiet = max(0, self.quiet - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "a":
            self.link = None
        elif self.heading is not None and tag == self.heading["level"]:
            self.heading = None

    def handle_data(self, data: str) -> None:
        if self.quiet:
            return
        if self.in_title:
            self.title = (self.title or "") + data
        self.pieces.append(data)
        if self.link is not None:
            self.link["text"] += data
        if self.heading is not None:
            self.heading["text"] += data


def absolute(base: str, href: str) -> tuple[str, str]:
    """A reference as an absolute address, and its host; as it is, without a host, if it can't be read."""
    try:
        full = urljoin(base, href)
        return full, urlparse(full).netloc
    except ValueError:
        return href, ""


REFERENCE = re.compile("&([A-Za-z][A-Za-z0-9]*;|#[0-9]+;|#[xX][0-9A-Fa-f]+;)?")


def whole_references(html: str) -> str:
    """Markup whose ampersands that begin no known reference up to a semicolon are written out; else the parser takes cut ones (``&amp``) and prefixes too."""
    return REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + (m[1] or ""), html)


def parse(page_id: int | None, url: str | None, html: str | None) -> dict:
    p = Page(url or "")
    p.feed(whole_references(html or ""))
    p.close()
    home = absolute(p.url, "")[1]
    links = []
    for x in p.links:
        if x["href"] and not x["href"].startswith(("javascript:", "mailto:", "tel:")):
            full, host = absolute(p.url, x["href"])
            links.append({"href": full, "text": x["text"].strip(), "relative": x["relative"], "internal": host in ("", home)})
    heads = [{"level": h["level"], "text": h["text"].strip()} for h in p.heading_texts if h["text"].strip()]
    images = [x | {"src": absolute(p.url, x["src"])[0]} for x in p.image_list]
    lines = [s.strip() for s in "".join(p.pieces).splitlines() if s.strip()]
    return {"page_id": page_id, "url": url, "title": p.title, "description": p.description or "", "lang": p.lang, "viewport": p.viewport,
        "charset": p.charset, "headings": list(p.headings.items()), "links": links, "images": p.images, "images_with_alt": p.alts,
        "lists": p.lists, "forms": p.forms, "tables": p.tables, "text": "\n".join(lines), "meta": list(p.meta.items()),
        "heading_texts": heads, "image_list": images}


def parse_pages(pages: DataFrame) -> DataFrame:
    """One row of parsed fields per page; null html is an empty page."""
    link = pa.struct([("href", pa.string()), ("text", pa.string()), ("relative", pa.bool_()), ("internal", pa.bool_())])
    heading = pa.struct([("level", pa.string()), ("text", pa.string())])
    image = pa.struct([(k, pa.string()) for k in ("src", "alt", "title", "width", "height")])
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("title", pa.string()), ("description", pa.string()), ("lang",
                pa.string()), ("viewport", pa.bool_()), ("charset", pa.bool_()), ("headings", pa.map_(pa.string(), pa.int32())), ("links",
                pa.list_(link)), ("images", pa.int32()), ("images_with_alt", pa.int32()), ("lists", pa.int32()), ("forms", pa.int32()), (
                "tables", pa.int32()), ("text", pa.string()), ("meta", pa.map_(pa.string(), pa.string())), ("heading_texts",
                pa.list_(heading)), ("image_list", pa.list_(image))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = [parse(*r) for r in zip(*[c.to_pylist() for c in batch.slice(i, 256).columns])]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)
