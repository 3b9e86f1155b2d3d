"""Headlines of web pages: containers by class name, or links where there are none."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from newsgrid.schema import PAGE
from newsgrid.sources.feeds import fetch

#: Elements of a page that are looked at.
LIMIT = 20
_BOXES = {"article", "div", "li"}
_NAMES = ("post", "article", "item", "card", "entry")
_HEADS = {"h1", "h2", "h3", "h4"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Element:
    __slots__ = ("tag", "href", "text", "head", "link", "has_head", "in_head")

    def __init__(self, tag: str, href: str | None) -> None:
        self.tag, self.href, self.text, self.head, self.link, self.has_head, self.in_head = tag, href, [], [], None, False, 0


class _Page(HTMLParser):
    """Collects containers and links of a page in one pass, in the order in which they begin."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.boxes: list[_Element] = []
        self.links: list[_Element] = []
        self.open: list[tuple[str, _Element | None]] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs) -> None:
        attrs = dict(attrs)
        if tag in ("script", "style"):
            self.silent += 1
        href = attrs.get("href")
        for _, e in self.open:
            if e is not None:
                if tag == "a" and href is not None and e.link is None:
                    e.link = href
                if tag in _HEADS and (not e.has_head or e.in_head):
                    e.has_head = True
                    e.in_head += 1
        own = None
        if tag in _BOXES and any(n in (attrs.get("class") or "").lower() for n in _NAMES):
            own = _Element(tag, None)
            self.boxes.append(own)
        elif tag == "a" and "href" in attrs:
            own = _Element(tag, href or "")
            self.links.append(own)
        if tag not in _VOID:
            self.open.append((tag, own))

    def handle_endtag(self, tag) -> None:
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        if any(t == tag for t, _ in self.open):
            while self.open:
                t, _ = self.open.pop()
                if t in _HEADS:
                    for _, e in self.open:
                        if e is not None and e.in_head:
                            e.in_head -= 1
                if t == tag:
                    break

    def handle_data(self, data) -> None:
        if self.silent or not data.strip():
            return
        for _, e in self.open:
            if e is not None:
                e.text.append(data.strip())
                if e.in_head:
                    e.head.append(data.strip())


def headlines(url: str | None, html: str | None) -> list[tuple[int, str, str]]:
    """(position, title, link) of the first `LIMIT` elements of a page that have a title of ten characters or more."""
    page = _Page()
    try:
        page.feed(html or "")
        page.close()
    except (AssertionError, ValueError):
        pass
    out = []
    for k, e in enumerate((page.boxes or page.links)[:LIMIT]):
        title = "".join(e.head) if e.has_head else "".join(e.text)[:100]
        link = (e.href if e.tag == "a" else e.link) or ""
        if link and not link.startswith("http"):
            try:
                link = urljoin(url or "", link)
            except ValueError:
                pass
        if len(title) >= 10:
            out.append((k, title, link))
    return out


def scrape(pages: DataFrame) -> DataFrame:
    """(`source_name`, `entry_ord`, `title`, `link`, `id`) of pages (`source_name`, `url`, `html`); bad or missing markup gives no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, k, t, link) for s, u, h in zip(b.source_name, b.url, b.html) for k, t, link in headlines(u, h)]
            yield pd.DataFrame(rows, columns=["source_name", "entry_ord", "title", "link"])

    found = pages.select("source_name", "url", "html").mapInPandas(run, "source_name string, entry_ord int, title string, link string")
    return found.withColumn("id", F.md5(F.concat("link", "title")))


class _Page1(InputPartition):
    def __init__(self, name: str, url: str) -> None:
        self.name, self.url = name, url


class _PageReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.pages = [_Page1(p["name"], p["url"]) for p in json.loads(options["pages"])]
        self.timeout = float(options.get("timeout", "15"))

    def partitions(self):
        return self.pages

    def read(self, partition):
        try:
            yield (partition.name, partition.url, fetch(partition.url, self.timeout).decode("utf-8", "replace"), None)
        except (OSError, ValueError) as e:
            yield (partition.name, partition.url, None, str(e))


class PageSource(DataSource):
    """`spark.read.format("newspage")` with `pages`, a JSON list of names and addresses, and `timeout` in seconds."""

    @classmethod
    def name(cls) -> str:
        return "newspage"

    def schema(self) -> str:
        return f"{PAGE}, error string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


def read_pages(spark: SparkSession, pages: list[dict[str, str]], timeout: float = 15) -> DataFrame:
    """Pages given as `name` and `url`, one partition each; one that can't be read has null for `html` and tells the `error`."""
    spark.dataSource.register(PageSource)
    return spark.read.format("newspage").option("pages", json.dumps(pages)).option("timeout", str(timeout)).load()
