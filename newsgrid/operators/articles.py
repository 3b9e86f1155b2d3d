"""Articles: identity, time window, title rules and keep-first de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgrid.operators.instants import first_instant
from newsgrid.operators.text import stored_summary
from newsgrid.session import cut, small, task_slices

DAYS = 14
LEAST_TITLE = 10
#: Order in which articles are met: sources in their order, then entries in theirs.
ORDER = ("source_ord", "entry_ord", "published_at", "id")


def item_id(link: Column, title: Column) -> Column:
    """md5 of link and title without a separator; nulls count as ''."""
    return F.md5(F.concat(F.coalesce(link, F.lit("")), F.coalesce(title, F.lit(""))))


def iso_date(at: Column) -> Column:
    """The ISO text of a timestamp, null for null."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def lookback(articles: DataFrame, as_of: str, days: int = DAYS) -> DataFrame:
    """Articles without a date or from `days` days before `as_of` on; nothing is too new."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    return articles.where(F.col("published_at").isNull() | (F.col("published_at") >= cutoff))


def with_title(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles with a title: not empty, and of `LEAST_TITLE` characters or more where the source is scraped."""
    kinds = small(sources.groupBy(F.col("name").alias("source_name")).agg(F.min("type").alias("_type")))
    title = F.coalesce(F.col("title"), F.lit(""))
    need = F.when(F.col("_type") == "web", LEAST_TITLE).otherwise(1)
    return articles.join(kinds, "source_name", "left").where(F.length(title) >= need).drop("_type")


def keep_first(articles: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """One article per link, the first by `order`; '' is a link as any other. Null links count as ''.

    The least row per link is found by a grouped minimum, which combines before the shuffle, so that a link with a third of all rows
    travels as one row per task.
    """
    rest = [c for c in articles.columns if c not in order and c != "link"]
    packed = F.min(F.struct(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(c) for c in order], *[F.col(c) for c in rest])).alias("_r")
    first = articles.groupBy(F.coalesce("link", F.lit("")).alias("link")).agg(packed)
    chosen = {c: F.col(f"_r.{c}.v") if c in order else F.col(f"_r.{c}") for c in articles.columns if c != "link"}
    return first.select(*[F.col("link") if c == "link" else chosen[c].alias(c) for c in articles.columns])


def union_sources(rss: DataFrame, web: DataFrame) -> DataFrame:
    """Feeds before pages, then each link once."""
    both = rss.withColumn("_kind", F.lit(0)).unionByName(web.withColumn("_kind", F.lit(1)))
    return keep_first(both, ("_kind", *ORDER)).drop("_kind")


def from_feed(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles of raw feed entries: title, text, link and date by their rules; entries without a title are dropped.

    The date is the first usable of the parsed and of the textual ones, as UTC whatever the session's zone; textual ones may have any
    form that `parse_instant` reads, those without a zone count in the source's `zone_name`, where `sources` has one.
    """
    extra = [c for c in ("zone_name", "day_first") if c in sources.columns]
    dim = sources.groupBy(F.col("name").alias("source_name")).agg(F.min(F.struct("ord", *extra)).alias("_s"))
    zone, first = (F.col(f"_s.{c}") if c in extra else F.lit(None).cast(k) for c, k in (("zone_name", "string"), ("day_first", "boolean")))
    dim = small(dim.select("source_name", F.col("_s.ord").alias("source_ord"), zone.alias("_zone"), first.alias("_first")))
    given = F.coalesce(F.col("published_parsed"), F.col("updated_parsed"))
    texts = [F.when(given.isNull(), F.col(c)) for c in ("dc_date", "published", "updated")]
    rows = entries.where(F.coalesce("title", F.lit("")) != "").join(dim, "source_name", "left").withColumn("_us", first_instant(*texts, F.col("_zone"), F.col("_first")))
    at = F.coalesce(given, F.expr("timestampadd(MICROSECOND, _us, TIMESTAMP_NTZ'1970-01-01 00:00:00')"))
    link = F.coalesce("link", F.lit(""))
    return rows.select(
        item_id(link, F.col("title")).alias("id"), "title", stored_summary(F.col("summary"), F.col("description")).alias("summary"), link.alias("link"), at.alias("published_at"), "source_name", "source_ord", "entry_ord"
    )


def from_pages(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles of scraped headlines (`source_name`, `entry_ord`, `title`, `link`), in the form of `from_feed`: no text, no date."""
    dim = small(sources.groupBy(F.col("name").alias("source_name")).agg(F.min("ord").alias("source_ord")))
    return found.join(dim, "source_name", "left").select(
        item_id(F.col("link"), F.col("title")).alias("id"), "title", F.lit("").alias("summary"), "link", F.lit(None).cast("timestamp_ntz").alias("published_at"), "source_name", "source_ord", "entry_ord"
    )


def positions(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The frame with `position`, from 0 by `order` (nulls last), without bringing all rows to one place.

    Rows are sorted by range over the cluster and numbered within their part; the parts' sizes, one row a part, move the numbers on.
    `order` must tell rows apart for the same numbers in every run.
    """
    by = [F.col(c).asc_nulls_last() for c in order]
    parted = df.repartitionByRange(task_slices(df.sparkSession), *by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id())
    parted = cut(parted.withColumn("_part", F.shiftright("_m", 33)).withColumn("_row", F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m"), "positions")
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    starts = small(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    return parted.join(starts, "_part").withColumn("position", F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")
