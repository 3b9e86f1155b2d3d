"""RSS and Atom feeds as a Spark data source: one partition per feed, read from files or over HTTP."""

from __future__ import annotations

import json
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from newsgrid.schema import FEED_ENTRY

_SCHEMA = f"{FEED_ENTRY}, error string"


#: How readers of feeds and pages name themselves.
USER_AGENT = "Mozilla/5.0 (compatible; newsgrid)"
#: The columns between name and error of a row that only tells an error.
_NOTHING = (None,) * 10


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def _text(e: ET.Element) -> str:
    return "".join(e.itertext()).strip()


def parse_feed(source_name: str, xml: bytes | str) -> Iterator[tuple]:
    """Entries of a feed. One that breaks in the midst gives those before the break, the last row telling the error."""
    parser = ET.XMLPullParser(("start", "end"))
    error, n = None, 0
    try:
        parser.feed(xml)
        parser.close()
    except ET.ParseError as e:
        error = str(e)
    try:
        for event, e in parser.read_events():
            if event == "end" and _local(e.tag) in ("item", "entry"):
                got: dict[str, str] = {}
                for c in e:
                    name = _local(c.tag)
                    value = (c.get("href") or _text(c)) if name == "link" else _text(c)
                    got.setdefault({"pubdate": "published", "date": "dc_date", "content": "summary" if "description" not in got else "content", "encoded": "content"}.get(name, name), value)
                yield (source_name, n, got.get("title"), got.get("summary"), got.get("description"), got.get("link"), None, None, got.get("dc_date"), got.get("published"), got.get("updated"), None)
                n += 1
    except ET.ParseError as e:
        error = str(e)
    if error:
        yield (source_name, *_NOTHING, error)


def fetch(url: str, timeout: float) -> bytes:
    """What an address holds: over HTTP with a browser's name, or from a file."""
    if "://" in url and not url.startswith("file:"):
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": USER_AGENT}), timeout=timeout) as r:
            return r.read()
    with open(url.removeprefix("file://"), "rb") as f:
        return f.read()


class _Feed(InputPartition):
    def __init__(self, name: str, url: str) -> None:
        self.name, self.url = name, url


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.feeds = [_Feed(f["name"], f["url"]) for f in json.loads(options["feeds"])]
        self.timeout = float(options.get("timeout", "15"))

    def partitions(self):
        return self.feeds

    def read(self, partition):
        try:
            body = fetch(partition.url, self.timeout)
        except (OSError, ValueError) as e:
            yield (partition.name, *_NOTHING, str(e))
            return
        yield from parse_feed(partition.name, body)


class FeedSource(DataSource):
    """`spark.read.format("newsfeed")` with `feeds`, a JSON list of names and addresses, and `timeout` in seconds."""

    @classmethod
    def name(cls) -> str:
        return "newsfeed"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_feeds(spark: SparkSession, feeds: list[dict[str, str]], timeout: float = 15) -> DataFrame:
    """Entries of feeds given as `name` and `url`; a feed that can't be read gives a row with `error`."""
    spark.dataSource.register(FeedSource)
    return spark.read.format("newsfeed").option("feeds", json.dumps(feeds)).option("timeout", str(timeout)).load()


def parse_feeds(documents: DataFrame) -> DataFrame:
    """Entries of stored feeds (`source_name`, `xml`), in the form of `read_feeds`; a null one has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for name, xml in zip(*[c.to_pylist() for c in b.columns]) if xml for r in parse_feed(name, xml)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], _NAMES)

    return documents.select("source_name", "xml").mapInArrow(run, _SCHEMA)


_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
_TYPES = [{"int": pa.int32(), "timestamp_ntz": pa.timestamp("us")}.get(c.split()[1], pa.string()) for c in _SCHEMA.split(", ")]
