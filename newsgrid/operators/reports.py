"""Reports by theme and by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgrid.operators.summarise import CLASS_ORDER, first_of
from newsgrid.session import small


def themes_of(keywords: DataFrame) -> DataFrame:
    """(`theme_ord`, `theme`, `color_hex`, `colormap`), one row per theme."""
    return keywords.where("theme is not null").groupBy("theme").agg(F.min("theme_ord").alias("theme_ord"), F.min("color_hex").alias("color_hex"), F.min("colormap").alias("colormap"))


def theme_counts(classified: DataFrame, keywords: DataFrame) -> DataFrame:
    """(`theme_ord`, `theme`, `short`, `label`, `n`) of every theme, those without articles with 0."""
    counts = classified.groupBy("theme").agg(F.count("*").alias("n"))
    dim = themes_of(keywords)
    return small(dim).join(counts, "theme", "left").select(
        F.col("theme_ord").cast("bigint").alias("theme_ord"), "theme", F.substring_index("theme", " ", 1).alias("short"), F.substring_index("theme", " ", 2).alias("label"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def source_overview(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(`Name`, `Type`, `Category`, `Articles`, `Link`, `first_ord`): articles per source with what the dimension knows of it."""
    first = F.min(F.struct(F.coalesce("source_ord", F.lit(2**31 - 1)).alias("a"), F.coalesce("entry_ord", F.lit(2**31 - 1)).alias("b")))
    counts = articles.groupBy(F.coalesce("source_name", F.lit("Unknown")).alias("name")).agg(F.count("*").alias("n"), first.alias("f"))
    dim = sources.groupBy("name").agg(F.min_by(F.struct("url", "type", "category"), "ord").alias("s"))
    return counts.join(small(dim), "name", "left").select(
        F.col("name").alias("Name"), F.upper(F.coalesce("s.type", F.lit("unknown"))).alias("Type"), F.initcap(F.coalesce("s.category", F.lit("unknown"))).alias("Category"),
        F.col("n").cast("bigint").alias("Articles"), F.coalesce("s.url", F.lit("")).alias("Link"), F.col("f.a").cast("bigint").alias("first_ord"),
    )


def source_themes(classified: DataFrame) -> DataFrame:
    """(`source_name`, `theme`, `n`), missing names and themes as Unknown."""
    return classified.groupBy(F.coalesce("source_name", F.lit("Unknown")).alias("source_name"), F.coalesce("theme", F.lit("Unknown")).alias("theme")).agg(F.count("*").cast("bigint").alias("n"))


def first_articles(articles: DataFrame, n: int = 10) -> DataFrame:
    """(`source_name`, `rank`, `id`, `heading`): the first `n` articles of each source, titles at 80 characters and dots."""
    top = first_of(articles, "source_name", n, ["source_ord", "entry_ord", "published_at", "id"])
    return top.select("source_name", F.col("rank").cast("bigint").alias("rank"), "id", F.concat(F.substring(F.coalesce("title", F.lit("")), 1, 80), F.lit("...")).alias("heading"))


def _date(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM-dd"), F.lit("Unknown"))


def _short(text: Column, size: int) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(F.lit(""))


def deep_dive(classified: DataFrame, theme: str) -> DataFrame:
    """(`Title`, `Source`, `Date`, `Summary`, `URL`) of the articles of a theme."""
    rows = classified.where(F.col("theme") == theme)
    return rows.select(F.coalesce("title", F.lit("")).alias("Title"), F.coalesce("source_name", F.lit("Unknown")).alias("Source"), _date(F.col("published_at")).alias("Date"), _short(F.col("summary"), 150).alias("Summary"), F.coalesce("link", F.lit("")).alias("URL"))


def source_articles(classified: DataFrame, source: str) -> DataFrame:
    """(`Title`, `Theme`, `Date`, `Summary`, `URL`) of the articles of a source."""
    rows = classified.where(F.col("source_name") == source)
    return rows.select(F.coalesce("title", F.lit("")).alias("Title"), F.coalesce("theme", F.lit("Unknown")).alias("Theme"), _date(F.col("published_at")).alias("Date"), _short(F.col("summary"), 100).alias("Summary"), F.coalesce("link", F.lit("")).alias("URL"))


def overview_cards(classified: DataFrame, keywords: DataFrame, summaries: DataFrame) -> DataFrame:
    """Themes in order with their counts and summaries; `has_summary` marks those with something to tell."""
    happening = F.coalesce("what_is_happening", F.lit(""))
    return theme_counts(classified, keywords).join(small(summaries), "theme", "left").select(
        "theme_ord", "theme", "n", F.when(happening == "", "No analysis available.").otherwise(happening).alias("what_is_happening"),
        F.coalesce("what_to_watch", F.lit("No items to watch.")).alias("what_to_watch"), (happening != "").alias("has_summary"),
    )


def date_range(as_of: Column, days: int = 14, first_year: bool = True) -> Column:
    """The label of a window of days that ends with `as_of`; the overview leaves the first day's year out."""
    first = F.date_format(as_of - F.expr(f"INTERVAL {int(days)} DAYS"), "MMMM dd, yyyy" if first_year else "MMMM dd")
    return F.concat(first, F.lit(" - "), F.date_format(as_of, "MMMM dd, yyyy"))


def by_count(overview: DataFrame) -> DataFrame:
    """`source_overview` with `rank`, from 1: most articles first, of equal ones the source met first, then by name."""
    window = Window.orderBy(F.desc("Articles"), F.asc("first_ord"), F.asc("Name"))  # one row a source
    return overview.withColumn("rank", F.row_number().over(window).cast("bigint"))


def source_list(articles: DataFrame) -> DataFrame:
    """(`rank`, `source_name`): the names of all sources in order, each once; null names are left out."""
    names = articles.where(F.col("source_name").isNotNull()).select("source_name").distinct()
    return names.select(F.row_number().over(Window.orderBy("source_name")).cast("bigint").alias("rank"), "source_name")  # one row a source


def csv_name(theme: str) -> str:
    """File name under which a theme's articles are written."""
    return f"{theme.replace(' ', '_')}_articles.csv"


def write_csv(df: DataFrame, path: str) -> None:
    """Write a report as one CSV file with a header, in a folder of the shared file system."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def theme_first(classified: DataFrame, n: int = 15) -> DataFrame:
    """(`theme`, `rank`, `id`) of the first `n` articles of each theme."""
    return first_of(classified, "theme", n, CLASS_ORDER).select("theme", F.col("rank").cast("bigint").alias("rank"), "id")
