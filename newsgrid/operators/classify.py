"""Themes by whole-word keyword scores, with a fallback for what no keyword matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsgrid.functions.regex import strip, word_pattern
from newsgrid.operators.articles import ORDER, positions

#: Rows of a keyword dictionary that become expressions.
MOST_KEYWORDS = 5000
BATCH = 10


def dictionary(keywords: DataFrame) -> list[tuple[int, str, list[str]]]:
    """(order, theme, keywords) of a dictionary of at most `MOST_KEYWORDS` rows."""
    rows = keywords.where("theme is not null and keyword is not null").select("theme_ord", "theme", "kw_ord", "keyword").orderBy("theme_ord", "kw_ord").limit(MOST_KEYWORDS + 1).collect()
    if len(rows) > MOST_KEYWORDS:
        raise ValueError(f"the dictionary holds more than {MOST_KEYWORDS} keywords")
    out: dict = {}
    for r in rows:
        out.setdefault((r.theme_ord, r.theme), []).append(r.keyword)
    return [(o, t, k) for (o, t), k in out.items()]


def _text() -> Column:
    return F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit(""))))


def score_columns(articles: DataFrame, themes: list[tuple[int, str, list[str]]]) -> DataFrame:
    """The articles with `_scores`: one sum of whole-word matches per theme, in theme order, computed in one pass.

    The keywords are one constant array that a lambda walks, so that the generated code stays small with any dictionary; a pattern
    runs only where a plain search finds its keyword.
    """
    if not any(words for _, _, words in themes):
        return articles.withColumn("_scores", F.array(*[F.lit(0).cast("bigint") for _ in themes]).cast("array<bigint>"))
    entries = [F.array(*[F.struct(F.lit(w.lower()).alias("low"), F.lit(word_pattern(w)).alias("pattern")) for w in words if w]) if any(words) else F.lit(None) for _, _, words in themes]
    kind = "array<struct<low:string,pattern:string>>"
    with_text = articles.withColumn("_text", _text())

    def score(words: Column) -> Column:
        hits = F.transform(words, lambda w: F.when(F.contains(F.col("_text"), w.low), F.regexp_count(F.col("_text"), w.pattern)).otherwise(F.lit(0)))
        return F.coalesce(F.aggregate(hits, F.lit(0).cast("bigint"), lambda total, n: total + n.cast("bigint")), F.lit(0).cast("bigint"))

    return with_text.withColumn("_scores", F.transform(F.array(*[e.cast(kind) for e in entries]), score)).drop("_text")


def keyword_scores(articles: DataFrame, keywords: DataFrame) -> DataFrame:
    """(`id`, `theme_ord`, `theme`, `score`) of each article and theme with a score above zero."""
    themes = dictionary(keywords)
    names = F.array(*[F.struct(F.lit(o).alias("theme_ord"), F.lit(t).alias("theme")) for o, t, _ in themes])
    scored = score_columns(articles, themes).select("id", F.explode(F.arrays_zip(names.alias("t"), F.col("_scores").alias("s"))).alias("x"))
    return scored.select("id", F.col("x.t.theme_ord").alias("theme_ord"), F.col("x.t.theme").alias("theme"), F.col("x.s").alias("score")).where("score > 0")


def keyword_classify(articles: DataFrame, keywords: DataFrame) -> DataFrame:
    """The articles with `theme` and `score` of the best theme, of equal ones the earlier; null where no keyword matches."""
    themes = dictionary(keywords)
    scored = score_columns(articles, themes)
    best = F.array_max("_scores")
    where = F.array_position(F.col("_scores"), best).cast("int")
    names = F.array(*[F.lit(t) for _, t, _ in themes])
    return scored.drop("theme", "score").withColumn("theme", F.when(best > 0, F.element_at(names, where))).withColumn("score", F.when(best > 0, best)).drop("_scores")


def batches(unmatched: DataFrame, size: int = BATCH) -> DataFrame:
    """The articles with `batch_id` and `pos`: groups of `size` in the order they are met."""
    return positions(unmatched, ORDER).withColumn("batch_id", F.floor(F.col("position") / size).cast("bigint")).withColumn("pos", (F.col("position") % size).cast("bigint")).drop("position")


def _item(size: int) -> Column:
    return F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\nSummary: "), F.substring(F.coalesce("summary", F.lit("")), 1, size))


def batch_prompts(batched: DataFrame, themes: list[str]) -> DataFrame:
    """(`batch_id`, `prompt`): one question about all articles of a batch, in order, summaries at 300 characters."""
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", _item(300).alias("item")))), lambda x: x.item), "\n\n")
    head = f"Below are numbered-by-order news items. The themes are: {'; '.join(themes)}.\nAnswer with one line per item, in order, holding nothing but the name of the theme that fits it best.\n\n"
    return batched.groupBy("batch_id").agg(F.concat(F.lit(head), items).alias("prompt"))


def single_prompt(themes: list[str]) -> Column:
    """A question about one article, its summary at 500 characters."""
    return F.concat(F.lit(f"The themes are: {'; '.join(themes)}.\nName the one that fits this news item best, and write nothing else.\n\n"), _item(500))


def match_theme(line: Column, themes: list[str]) -> Column:
    """The first theme whose name stands anywhere in a line, in any case; null if none does."""
    return F.coalesce(*[F.when(F.contains(F.lower(line), F.lit(t.lower())), F.lit(t)) for t in themes]) if themes else F.lit(None).cast("string")


def match_single(replies: DataFrame, themes: list[str], key: str = "id") -> DataFrame:
    """(`key`, `theme`) of replies about one article each: null where the status isn't 200, something failed or no theme is named."""
    ok = (F.coalesce("status", F.lit(200)) == 200) & F.col("error").isNull()
    return replies.select(key, F.when(ok, match_theme(strip(F.coalesce("reply", F.lit(""))), themes)).alias("theme"))


def parse_replies(batched: DataFrame, replies: DataFrame, themes: list[str]) -> DataFrame:
    """`batched` (`batch_id`, `pos`) with `theme` and `class_phase` from replies (`batch_id`, `reply`, `status`, `error`).

    Line j of a reply is for the item at position j; a line that names no theme gives the first one. Items without a line get the
    first theme too, in phase 2, or phase 1 where the whole batch failed. A status other than 200 counts as no line at all.
    """
    ok = (F.coalesce("status", F.lit(200)) == 200) & F.col("error").isNull()
    lines = replies.where(ok).select("batch_id", F.posexplode(F.split(strip(F.coalesce("reply", F.lit(""))), "\n")).alias("pos", "line"))
    failed = replies.groupBy("batch_id").agg(F.max(F.col("error").isNotNull()).alias("_failed"))
    joined = batched.join(lines.withColumn("pos", F.col("pos").cast("bigint")), ["batch_id", "pos"], "left").join(failed, "batch_id", "left")
    default = F.lit(themes[0])
    return joined.withColumn("theme", F.coalesce(match_theme(F.col("line"), themes), default)).withColumn("class_phase", F.when(F.col("line").isNotNull() | F.coalesce("_failed", F.lit(False)), 1).otherwise(2)).drop("line", "_failed")


def classify_articles(articles: DataFrame, keywords: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """All articles with `theme` and `class_phase` (0 keyword, 1 reply, 2 default): themes outside the dictionary can't occur."""
    themes = [t for _, t, _ in dictionary(keywords)]
    found = keyword_classify(articles, keywords).drop("score", "class_phase")
    matched = found.where("theme is not null").withColumn("class_phase", F.lit(0))
    rest = found.where("theme is null").drop("theme")
    if replies is None:
        return matched.unionByName(rest.withColumn("theme", F.lit(themes[0])).withColumn("class_phase", F.lit(2)))
    return matched.unionByName(parse_replies(batches(rest), replies, themes).drop("batch_id", "pos"))
