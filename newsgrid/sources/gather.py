"""All sources of a dimension as articles: feeds first, then pages, each link once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsgrid.operators.articles import from_feed, from_pages, union_sources
from newsgrid.sources.feeds import read_feeds
from newsgrid.sources.web import read_pages, scrape

#: Rows of a dimension of sources; more are an error.
MOST_SOURCES = 10_000


def gather(spark: SparkSession, sources: DataFrame, timeout: float = 15) -> DataFrame:
    """Articles of all `sources` (`ord`, `name`, `url`, `type`), read in parallel, one task a source.

    Sources that can't be read give no article and don't stop the others; a source of no known type is not read.
    """
    rows = sources.where("name is not null and url is not null").select("name", "url", "type").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"there are more than {MOST_SOURCES} sources")
    of = {kind: [{"name": r.name, "url": r.url} for r in rows if r.type == kind] for kind in ("rss", "web")}
    return union_sources(from_feed(read_feeds(spark, of["rss"], timeout).where("error is null"), sources), from_pages(scrape(read_pages(spark, of["web"], timeout)), sources))
