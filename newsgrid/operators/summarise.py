"""Prompts of a theme's first articles, and the sections of what a model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgrid.functions.regex import strip

FIRST, PROMPT_SUMMARY, ENOUGH = 15, 300, 3

# Markers of the sections in the order in which a line is tried for them, with what stands for a missing section.
SECTIONS = (
    ("WHAT IS HAPPENING", "what_is_happening", "Unable to generate summary."),
    ("WHY IT MATTERS", "why_it_matters", "Unable to generate analysis."),
    ("WHAT TO WATCH", "what_to_watch", "No specific items to watch."),
    ("FURTHER READING", "further_reading", ""),
)
# Texts for themes with no article, and with too few of them.
NONE_TEXTS = ("No articles found for this theme in the past two weeks.", "Limited coverage this week.", "Check back next week for updates.", "")
FEW_TEXTS = (
    "This theme has fewer articles this week, possibly indicating lower activity or a quiet period.",
    "Monitor for upcoming announcements and developments.",
    "",
)


# Texts where no summary came back.
FAILED = ("Error calling Ollama API: ", "Error generating summary: ", "Unable to analyze at this time.", "Please try again later.", "")


def first_of(articles: DataFrame, by: str, n: int, order: list[str]) -> DataFrame:
    """The first `n` articles of each value of `by`, with their `rank` from 1."""
    window = Window.partitionBy(by).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return articles.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


CLASS_ORDER = ["class_phase", "source_ord", "entry_ord", "published_at", "id"]


def prompts(classified: DataFrame, n: int = FIRST) -> DataFrame:
    """(`theme`, `prompt`): a numbered block for each of a theme's first articles."""
    top = first_of(classified, "theme", n, CLASS_ORDER)
    summary, link = F.substring(F.coalesce("summary", F.lit("")), 1, PROMPT_SUMMARY), F.coalesce("link", F.lit(""))
    block = F.concat_ws(
        "\n",
        F.concat(F.col("rank").cast("string"), F.lit(". "), F.coalesce("title", F.lit("Untitled"))),
        F.concat(F.lit("   Source: "), F.coalesce("source_name", F.lit("Unknown"))),
        F.when(summary != "", F.concat(F.lit("   Summary: "), summary)),
        F.when(link != "", F.concat(F.lit("   URL: "), link)),
        F.lit(""),
    )
    grouped = top.select("theme", "rank", block.alias("block")).groupBy("theme").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return grouped.select("theme", F.array_join(F.transform("b", lambda x: x.block), "\n").alias("prompt"))


def summary_status(counts: DataFrame) -> DataFrame:
    """(`theme`, `n`, `status`, `what_is_happening`): what a theme with `n` articles is due: a canned text or a request."""
    n = F.col("n")
    text = F.when(n == 0, NONE_TEXTS[0]).when(n < ENOUGH, F.concat(F.lit("Limited coverage this week with only "), n.cast("string"), F.lit(" articles found.")))
    return counts.select("theme", n.cast("bigint").alias("n"), F.when(n == 0, "none").when(n < ENOUGH, "few").otherwise("request").alias("status"), text.alias("what_is_happening"))


def summary_prompt() -> Column:
    """The question about a theme's articles (`theme`, `prompt`): who is to answer, the articles, and the four sections wanted."""
    names = [m for m, _, _ in SECTIONS]
    who = "System: You analyse technical news for readers who know the field. Stay factual and exact, leave out hype, and write plainly."
    wanted = (
        f"\n\nWrite four sections under these headings:\n{names[0]}: the main developments in three to five sentences\n{names[1]}: what they mean, in two to five sentences\n"
        f"{names[2]}: two to five points to follow up, each on a line that begins with a dash\n{names[3]}: the five articles most worth reading, each on a line of the form\n- Title | Source | URL | Reason"
    )
    return F.concat(F.lit(who + "\n\nUser: News items of the past two weeks on the theme "), F.col("theme"), F.lit(":\n\n"), F.col("prompt"), F.lit(wanted))


def answered(replies: DataFrame, key: str = "theme") -> DataFrame:
    """(`key`, `reply`) of the replies that came back with status 200."""
    return replies.where((F.coalesce("status", F.lit(200)) == 200) & F.col("error").isNull()).select(key, "reply")


def failed_summaries(replies: DataFrame, key: str = "theme") -> DataFrame:
    """The four sections of the replies that didn't come back, telling the status or the error."""
    bad = replies.where(F.col("error").isNotNull() | (F.coalesce("status", F.lit(200)) != 200))
    told = F.when(F.col("error").isNotNull(), F.concat(F.lit(FAILED[1]), "error")).otherwise(F.concat(F.lit(FAILED[0]), F.col("status").cast("string")))
    return bad.select(key, told.alias(SECTIONS[0][1]), *[F.lit(t).alias(n) for (_, n, _), t in zip(SECTIONS[1:], FAILED[2:])])


def standing_summaries(status: DataFrame) -> DataFrame:
    """The four sections of the themes of `summary_status` that aren't asked about."""
    rest = [F.when(F.col("status") == "none", NONE_TEXTS[k + 1]).otherwise(FEW_TEXTS[k]).alias(n) for k, (_, n, _) in enumerate(SECTIONS[1:])]
    return status.where("status != 'request'").select("theme", SECTIONS[0][1], *rest)


def parse_sections(replies: DataFrame, key: str = "theme") -> DataFrame:
    """(`key`, four sections) of replies (`key`, `reply`).

    A line that names a marker anywhere opens that section with what follows its first colon; other lines join it, blank ones don't.
    Text before the first marker is dropped, a section opened again replaces the earlier one, and one that is open when the first
    marker comes is lost. Missing sections, null replies included, get their standing text.
    """
    lines = replies.select(key, F.posexplode(F.split(F.coalesce("reply", F.lit("")), "\n")).alias("i", "raw")).select(key, "i", strip(F.col("raw")).alias("line"))
    marker = F.coalesce(*[F.when(F.contains(F.upper("line"), F.lit(m)), F.lit(name)) for m, name, _ in SECTIONS])
    ordered = Window.partitionBy(key).orderBy("i")
    runs = lines.withColumn("marker", marker).withColumn("run", F.count("marker").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).where("run > 0")
    at = F.instr("line", ":")
    piece = F.when(F.col("marker").isNull(), F.when(F.col("line") != "", F.col("line"))).when(at > 0, strip(F.expr("substring(line, instr(line, ':') + 1)")))
    texts = runs.withColumn("piece", piece).groupBy(key, "run").agg(F.max("marker").alias("section"), F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("i", "piece")))).alias("p"))
    joined = texts.select(key, "run", "section", F.array_join(F.transform("p", lambda x: x.piece), " ").alias("text"))
    kept = joined.withColumn("next", F.lead("section").over(Window.partitionBy(key).orderBy("run"))).where(F.coalesce(F.col("next") != SECTIONS[0][1], F.lit(True)))
    found = kept.groupBy(key).agg(*[F.max_by("text", F.when(F.col("section") == name, F.col("run"))).alias(name) for _, name, _ in SECTIONS])
    return replies.select(key).distinct().join(found, key, "left").select(key, *[F.coalesce(name, F.lit(default)).alias(name) for _, name, default in SECTIONS])


def parse_further_reading(texts: DataFrame, key: str = "theme", text: str = "text") -> DataFrame:
    """(`key`, `pos`, `title`, `source`, `url`, `reason`) of lines with at least three parts between bars; one bullet before is dropped."""
    lines = texts.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "raw")).select(key, "pos", strip(F.col("raw")).alias("line"))
    bare = F.when(F.substring("line", 1, 1).isin("-", "*"), strip(F.expr("substring(line, 2)"))).otherwise(F.col("line"))
    parts = lines.where("line != ''").select(key, "pos", F.split(bare, "[|]").alias("p")).where(F.size("p") >= 3)
    return parts.select(key, F.col("pos").cast("bigint").alias("pos"), *[strip(F.coalesce(F.get("p", F.lit(k)), F.lit(""))).alias(n) for k, n in enumerate(("title", "source", "url", "reason"))])


def watch_bullets(text):
    """The lines of a text with line breaks, stripped, blank ones dropped; a text without any is one item."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    return F.when(F.contains(text, F.lit("\n")), lines).otherwise(F.array(text))
