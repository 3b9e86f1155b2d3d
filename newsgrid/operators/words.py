"""Word counts by theme, and the frequencies behind a word cloud."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from newsgrid.operators.text import clean_text
from newsgrid.session import cut, small

TOP, CLOUD, LIKELY = 20, 100, 30.0


def tokens(articles: DataFrame, by: str = "theme", order: tuple[str, ...] = ("class_phase", "source_ord", "entry_ord", "id")) -> DataFrame:
    """(`by`, `ord`, `pos`, `word`) of the cleaned title and summary of each article."""
    text = clean_text(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit(""))))
    rows = articles.select(by, F.struct(*[F.coalesce(F.col(c).cast("string") if c == "id" else F.col(c).cast("bigint"), F.lit("" if c == "id" else 2**40)).alias(c) for c in order]).alias("ord"), text.alias("t")).where("t != ''")
    return rows.select(by, "ord", F.posexplode(F.split("t", " ")).alias("pos", "word"))


def word_counts(articles: DataFrame, stop_words: DataFrame, by: str = "theme") -> DataFrame:
    """(`by`, `word`, `n`, `first`): counts of words of three letters or more that are no stop-words, and where each is first met."""
    stops = small(stop_words.select(F.lower("word").alias("word")).where("word is not null").distinct())
    kept = tokens(articles, by).where(F.length("word") > 2).join(stops, "word", "left_anti")
    return kept.groupBy(by, "word").agg(F.count("*").alias("n"), F.min(F.struct("ord", "pos")).alias("first"))


def top_words(articles: DataFrame, stop_words: DataFrame, by: str = "theme", n: int = TOP) -> DataFrame:
    """(`by`, `rank`, `word`, `n`): the most frequent words, of equal ones the one met first."""
    window = Window.partitionBy(by).orderBy(F.desc("n"), F.asc("first"), F.asc("word"))
    ranked = word_counts(articles, stop_words, by).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)
    return ranked.select(by, F.col("rank").cast("bigint").alias("rank"), "word", "n")


def keyword_table(top: DataFrame, by: str = "theme") -> DataFrame:
    """Top words with their share of the most frequent one of the group."""
    return top.withColumn("share", F.col("n") / F.max("n").over(Window.partitionBy(by)))


def cloud_words(articles: DataFrame, by: str = "theme") -> DataFrame:
    """(`by`, `words`): the cleaned words of two letters or more of each article, in order."""
    text = clean_text(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit(""))))
    return articles.select(by, F.filter(F.split(text, " "), lambda w: F.length(w) > 1).alias("words"))


def _stops(stop_words: DataFrame) -> DataFrame:
    return small(stop_words.select(F.lower("word").alias("word")).where("word is not null").distinct())


def _pairs(worded: DataFrame, stops: DataFrame, by: str) -> DataFrame:
    """Counts of neighbours, each word beside the next one of its own array, so that no row travels before it is counted."""
    n = F.greatest(F.size("words") - 1, F.lit(0))
    both = worded.select(by, F.explode(F.arrays_zip(F.slice("words", F.lit(1), n).alias("first"), F.slice("words", F.lit(2), n).alias("second"))).alias("p")).select(by, "p.first", "p.second")
    counted = both.groupBy(by, "first", "second").agg(F.count("*").alias("n"))
    return counted.join(stops.withColumnRenamed("word", "first"), "first", "left_anti").join(stops.withColumnRenamed("word", "second"), "second", "left_anti").select(by, "first", "second", "n")


def bigrams(articles: DataFrame, stop_words: DataFrame, by: str = "theme") -> DataFrame:
    """(`by`, `first`, `second`, `n`) of neighbouring words of one article neither of which is a stop-word."""
    return _pairs(cloud_words(articles, by), _stops(stop_words), by)


def _folded(counts: DataFrame, by: str, term: str) -> DataFrame:
    """`counts` with `to`: the term without its final s where that is a term of the same group too, else the term itself."""
    shorter = F.when(F.col(term).endswith("s") & ~F.col(term).endswith("ss"), F.expr(f"left({term}, length({term}) - 1)"))
    there = counts.select(by, F.col(term).alias("_stem")).withColumn("_there", F.lit(True))
    return counts.withColumn("_stem", shorter).join(there, [by, "_stem"], "left").withColumn("to", F.when(F.col("_there"), F.col("_stem")).otherwise(F.col(term))).drop("_stem", "_there")


def cloud_frequencies(articles: DataFrame, stop_words: DataFrame, by: str = "theme", n: int = CLOUD) -> DataFrame:
    """(`by`, `rank`, `term`, `n`, `share`): words and likely pairs of a word cloud, at most `n` per group.

    A word or pair whose form without a final s occurs too counts with that. A pair is judged by the counts of its words as folded; one
    whose log-likelihood ratio passes `LIKELY` is a term of its own and is taken off its words. Pairs are those within an article. The
    words are written once and counted from there.
    """
    worded, stops = cut(cloud_words(articles, by), "words"), _stops(stop_words)
    single = cut(worded.select(by, F.explode("words").alias("word")).groupBy(by, "word").agg(F.count("*").alias("n")).join(stops, "word", "left_anti"), "counts")
    forms = cut(_folded(single, by, "word"), "forms")
    words = forms.groupBy(by, F.col("to").alias("word")).agg(F.sum("n").alias("n"))
    total = single.groupBy(by).agg(F.sum("n").alias("N"))
    pairs = cut(_pairs(worded, stops, by).select(by, F.concat_ws(" ", "first", "second").alias("pair"), "n"), "pairs")
    pairs = _folded(pairs, by, "pair").groupBy(by, F.col("to").alias("pair")).agg(F.sum("n").alias("c12"))
    form = forms.select(by, "word", "to")
    c = pairs.withColumn("first", F.substring_index("pair", " ", 1)).withColumn("second", F.substring_index("pair", " ", -1))
    for side, count in (("first", "c1"), ("second", "c2")):
        own = form.withColumnRenamed("word", side).withColumnRenamed("to", f"{side}_to").join(words.select(by, F.col("word").alias(f"{side}_to"), F.col("n").alias(count)), [by, f"{side}_to"])
        c = c.join(own, [by, side])
    c = c.join(small(total), by)

    def like(k, m, x):
        return k * F.log(F.greatest(x, F.lit(1e-10))) + (m - k) * F.log(F.greatest(1 - x, F.lit(1e-10)))

    k, c1, c2, size = (F.col(x).cast("double") for x in ("c12", "c1", "c2", "N"))
    p, p1, p2 = c2 / size, k / c1, (c2 - k) / F.greatest(size - c1, F.lit(1.0))
    score = -2 * (like(k, c1, p) + like(c2 - k, size - c1, p) - like(k, c1, p1) - like(c2 - k, size - c1, p2))
    likely = cut(c.where((F.col("N") > F.col("c1")) & (F.col("N") > F.col("c2")) & (score > LIKELY)).select(by, "pair", "first_to", "second_to", "c12"), "likely")
    taken = likely.select(by, F.explode(F.array("first_to", "second_to")).alias("word"), "c12").groupBy(by, "word").agg(F.sum("c12").alias("off"))
    left = words.join(taken, [by, "word"], "left").select(by, F.col("word").alias("term"), (F.col("n") - F.coalesce("off", F.lit(0))).alias("n")).where("n > 0")
    terms = left.unionByName(likely.select(by, F.col("pair").alias("term"), F.col("c12").alias("n")))
    ranked = terms.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "term"))).where(F.col("rank") <= n)
    return ranked.select(by, F.col("rank").cast("bigint").alias("rank"), "term", "n", (F.col("n") / F.max("n").over(Window.partitionBy(by))).alias("share"))
