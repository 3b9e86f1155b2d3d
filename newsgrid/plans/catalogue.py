"""All queries of the core by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgrid.operators import articles as A, classify as C, reports as R, summarise as S, words as W
from newsgrid.operators.instants import VERSION, found_instants
from newsgrid.operators.text import clean_text, html_to_text
from newsgrid.session import shared_dir, small, table
from newsgrid.sources.feeds import parse_feeds
from newsgrid.sources.web import scrape

AS_OF = "2025-09-01 00:00:00"
THEME = "Model Research"
SOURCE = "Copper Lantern AI"
SOURCES = ("Copper Lantern AI", "Silbenwerk", "Dozen Crows")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def base(spark: SparkSession, d: str) -> DataFrame:
    """Stored articles as the operators take them: the time they were fetched stands for their date, missing texts are ''."""
    return table(spark, d, "article").select(
        "id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("link", F.lit("")).alias("link"),
        F.col("fetched_at").alias("published_at"), "source_name", "source_ord", "entry_ord",
    )


def recent(spark: SparkSession, d: str) -> DataFrame:
    return A.keep_first(A.lookback(base(spark, d), AS_OF))


def classified(spark: SparkSession, d: str) -> DataFrame:
    return C.classify_articles(recent(spark, d), table(spark, d, "theme_keyword"))


BASE = """base AS (SELECT id, coalesce(title, '') AS title, coalesce(summary, '') AS summary, coalesce(link, '') AS link, fetched_at AS published_at,
 source_name, source_ord, entry_ord FROM article)"""
ORDER = "source_ord NULLS LAST, entry_ord NULLS LAST, published_at NULLS LAST, id"
LOOK = f"look AS (SELECT * FROM base WHERE published_at IS NULL OR published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY)"
RECENT = f"recent AS (SELECT * FROM look QUALIFY row_number() OVER (PARTITION BY link ORDER BY {ORDER}) = 1)"
_W = r"[\p{L}\p{N}_]"
_N = r"[^\p{L}\p{N}_]"
# Every other character is doubled, so that neighbouring keywords don't share the one between them.
SCORES = rf"""kw AS (SELECT theme_ord, theme, lower(keyword) AS k FROM theme_keyword WHERE theme IS NOT NULL AND keyword IS NOT NULL),
pat AS (SELECT theme_ord, theme, k, (CASE WHEN regexp_matches(left(k, 1), '{_W}') THEN '(^|{_N})' ELSE '{_W}' END)
 || regexp_escape(regexp_replace(k, '({_N})', '\1\1', 'g')) || (CASE WHEN regexp_matches(right(k, 1), '{_W}') THEN '($|{_N})' ELSE '{_W}' END) AS p FROM kw),
txt AS (SELECT id, lower(title || ' ' || summary) AS t, regexp_replace(lower(title || ' ' || summary), '({_N})', '\1\1', 'g') AS tt FROM recent),
hit AS (SELECT id, theme_ord, theme, len(regexp_extract_all(tt, p)) AS n FROM txt JOIN pat ON contains(t, k)),
score AS (SELECT id, theme_ord, theme, sum(n)::BIGINT AS score FROM hit GROUP BY ALL HAVING sum(n) > 0),
best AS (SELECT id, theme, score FROM score QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, theme_ord) = 1),
dim AS (SELECT theme, min(theme_ord) AS theme_ord FROM theme_keyword GROUP BY theme),
cls AS (SELECT r.*, coalesce(b.theme, (SELECT theme FROM dim ORDER BY theme_ord LIMIT 1)) AS theme, CASE WHEN b.theme IS NULL THEN 2 ELSE 0 END AS class_phase
 FROM recent r LEFT JOIN best b ON r.id = b.id)"""
CLS = f"WITH {BASE}, {LOOK}, {RECENT}, {SCORES}"
CORDER = f"class_phase, {ORDER}"


@query(f"WITH {BASE} SELECT id, md5(link || title) AS own_id, substr(summary, 1, 500) AS summary, strftime(published_at, '%Y-%m-%dT%H:%M:%S') AS published_date FROM base")
def articles_projection(spark, d):
    return base(spark, d).select("id", A.item_id(F.col("link"), F.col("title")).alias("own_id"), F.substring("summary", 1, 500).alias("summary"), A.iso_date(F.col("published_at")).alias("published_date"))


@query(f"WITH {BASE}, {LOOK} SELECT id, published_at FROM look")
def lookback_filter(spark, d):
    return A.lookback(base(spark, d), AS_OF).select("id", "published_at")


@query("SELECT event_id, ts FROM events WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY")
def lookback_events(spark, d):
    return A.lookback(table(spark, d, "events").withColumn("published_at", F.col("ts")), "2024-01-31 00:00:00").select("event_id", "ts")


@query(f"WITH {BASE}, kind AS (SELECT name, min(type) AS type FROM sources GROUP BY name) SELECT id, title FROM base LEFT JOIN kind ON source_name = name WHERE length(title) >= CASE WHEN type = 'web' THEN 10 ELSE 1 END")
def title_filters(spark, d):
    return A.with_title(base(spark, d), table(spark, d, "sources")).select("id", "title")


@query(f"WITH {BASE}, one AS (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY link ORDER BY {ORDER}) = 1) SELECT id, link, title, published_at, source_name FROM one")
def dedup_keep_first(spark, d):
    return A.keep_first(base(spark, d)).select("id", "link", "title", "published_at", "source_name")


@query(
    f"WITH {BASE}, kind AS (SELECT name, min(type) AS type FROM sources GROUP BY name), two AS (SELECT b.*, CASE WHEN type = 'web' THEN 1 ELSE 0 END AS k FROM base b LEFT JOIN kind ON source_name = name), "
    f"one AS (SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY link ORDER BY k, {ORDER}) = 1) SELECT id, link, source_name FROM one"
)
def union_dedup_sources(spark, d):
    kinds = table(spark, d, "sources").groupBy(F.col("name").alias("source_name")).agg(F.min("type").alias("type"))
    rows = base(spark, d).join(small(kinds), "source_name", "left")
    web = F.coalesce(F.col("type") == "web", F.lit(False))
    return A.union_sources(rows.where(~web).drop("type"), rows.where(web).drop("type")).select("id", "link", "source_name")


@query(f"{CLS} SELECT id, theme_ord::BIGINT AS theme_ord, theme, score FROM score")
def keyword_scores(spark, d):
    return C.keyword_scores(recent(spark, d), table(spark, d, "theme_keyword")).withColumn("theme_ord", F.col("theme_ord").cast("bigint"))


@query(f"{CLS} SELECT id, theme, score FROM best")
def keyword_classify(spark, d):
    return C.keyword_classify(recent(spark, d), table(spark, d, "theme_keyword")).where("theme is not null").select("id", "theme", "score")


@query(f"{CLS} SELECT id, title FROM recent WHERE id NOT IN (SELECT id FROM best)")
def keyword_unmatched(spark, d):
    return C.keyword_classify(recent(spark, d), table(spark, d, "theme_keyword")).where("theme is null").select("id", "title")


@query(f"{CLS}, num AS (SELECT id, row_number() OVER (ORDER BY {ORDER}) - 1 AS n FROM recent WHERE id NOT IN (SELECT id FROM best)) SELECT id, (n // 10)::BIGINT AS batch_id, (n % 10)::BIGINT AS pos FROM num")
def llm_batches(spark, d):
    rest = C.keyword_classify(recent(spark, d), table(spark, d, "theme_keyword")).where("theme is null")
    return C.batches(rest).select("id", "batch_id", "pos")


# Replies made from the tables: every third batch names the themes in turn, and lines that name none; others fail in each possible way.
_NUM = f"num AS (SELECT id, row_number() OVER (ORDER BY {ORDER}) - 1 AS n FROM recent WHERE id NOT IN (SELECT id FROM best)), items AS (SELECT id, n // 10 AS batch_id, n % 10 AS pos FROM num)"
_DIM = "named AS (SELECT theme, row_number() OVER (ORDER BY min(theme_ord)) - 1 AS o FROM theme_keyword GROUP BY theme), size AS (SELECT count(*) AS m FROM named)"


def _stored_replies(items: DataFrame, themes: list[str]) -> DataFrame:
    names = F.array(*[F.lit(f"{k + 1}. {t.upper()} ") for k, t in enumerate(themes)])
    batch = items.select("batch_id").distinct()
    lines = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.coalesce(F.get(names, ((F.col("batch_id") + k) % (len(themes) + 1)).cast("int")), F.lit("nonsense")))
    ok, kind = F.col("batch_id") % 4 == 0, F.col("batch_id") % 4
    return batch.select(
        "batch_id", F.when(ok, F.concat(F.lit(" \n"), F.array_join(lines, "\n"))).when(kind == 3, F.lit("")).alias("reply"),
        F.when(kind == 1, F.lit(500)).when(kind != 2, F.lit(200)).alias("status"), F.when(kind == 2, F.lit("timed out")).alias("error"),
    )


@query(
    f"{CLS}, {_NUM}, {_DIM}, line AS (SELECT i.*, CASE WHEN batch_id % 4 = 0 AND pos < 8 THEN (batch_id + pos) % (SELECT m + 1 FROM size) WHEN batch_id % 4 = 3 AND pos = 0 THEN (SELECT m FROM size) END AS o FROM items i) "
    "SELECT id, batch_id::BIGINT AS batch_id, pos::BIGINT AS pos, coalesce(t.theme, (SELECT theme FROM named WHERE o = 0)) AS theme, (CASE WHEN line.o IS NOT NULL OR batch_id % 4 = 2 THEN 1 ELSE 2 END)::BIGINT AS class_phase FROM line LEFT JOIN named t ON t.o = line.o"
)
def batch_reply_parse(spark, d):
    themes = [t for _, t, _ in C.dictionary(table(spark, d, "theme_keyword"))]
    items = C.batches(C.keyword_classify(recent(spark, d), table(spark, d, "theme_keyword")).where("theme is null"))
    return C.parse_replies(items, _stored_replies(items, themes), themes).select("id", "batch_id", "pos", "theme", F.col("class_phase").cast("bigint").alias("class_phase"))


@query("WITH t AS (SELECT DISTINCT theme FROM theme_keyword) SELECT a.id, a.entry_ord::BIGINT AS entry_ord, CASE WHEN a.entry_ord % 5 = 0 THEN NULL ELSE t.theme END AS theme FROM (SELECT DISTINCT id, entry_ord, theme FROM article) a LEFT JOIN t ON t.theme = a.theme")
def single_reply_match(spark, d):
    themes = [t for _, t, _ in C.dictionary(table(spark, d, "theme_keyword"))]
    rows = table(spark, d, "article").select("id", "entry_ord", "theme").distinct()
    failed = F.coalesce(F.col("entry_ord") % 5 == 0, F.lit(False))
    replies = rows.select(F.struct("id", F.col("entry_ord").cast("bigint").alias("entry_ord"), "theme").alias("k"), F.concat(F.lit(" The theme is "), F.upper("theme"), F.lit(".\n")).alias("reply"), F.when(failed, 503).otherwise(200).alias("status"), F.lit(None).cast("string").alias("error"))
    return C.match_single(replies, themes, "k").select("k.id", "k.entry_ord", "theme")


@query(f"{CLS} SELECT d.theme_ord::BIGINT AS theme_ord, d.theme, split_part(d.theme, ' ', 1) AS short, array_to_string(string_split(d.theme, ' ')[1:2], ' ') AS label, count(c.id)::BIGINT AS n FROM dim d LEFT JOIN cls c ON c.theme = d.theme GROUP BY ALL")
def theme_counts(spark, d):
    return R.theme_counts(classified(spark, d), table(spark, d, "theme_keyword"))


@query(
    f"WITH {BASE}, {LOOK}, {RECENT}, s AS (SELECT * FROM sources QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord) = 1), "
    "c AS (SELECT coalesce(source_name, 'Unknown') AS n, count(*) AS k, min(coalesce(source_ord, 2147483647)) AS o FROM recent GROUP BY 1) "
    "SELECT n AS Name, upper(coalesce(type, 'unknown')) AS Type, upper(left(coalesce(category, 'unknown'), 1)) || substr(coalesce(category, 'unknown'), 2) AS Category, k::BIGINT AS Articles, coalesce(url, '') AS Link, o::BIGINT AS first_ord FROM c LEFT JOIN s ON n = name"
)
def source_overview(spark, d):
    return R.source_overview(recent(spark, d), table(spark, d, "sources"))


@query(
    f"WITH {BASE}, {LOOK}, {RECENT}, c AS (SELECT coalesce(source_name, 'Unknown') AS n, count(*) AS k, min(coalesce(source_ord, 2147483647)) AS o FROM recent GROUP BY 1) "
    "SELECT row_number() OVER (ORDER BY k DESC, o, n)::BIGINT AS rank, n AS Name, k::BIGINT AS Articles FROM c"
)
def sources_by_count(spark, d):
    return R.by_count(R.source_overview(recent(spark, d), table(spark, d, "sources"))).select("rank", "Name", "Articles")


@query("SELECT row_number() OVER (ORDER BY source_name)::BIGINT AS rank, source_name FROM (SELECT DISTINCT source_name FROM article WHERE source_name IS NOT NULL)")
def source_list(spark, d):
    return R.source_list(table(spark, d, "article"))


@query("SELECT n_name AS name, coalesce(r_name, '') AS region, count(c_custkey)::BIGINT AS n FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def lookup_counts(spark, d):
    counts = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    nations = table(spark, d, "nation").join(small(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return nations.join(counts, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("n_name").alias("name"), F.coalesce("r_name", F.lit("")).alias("region"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query(f"{CLS} SELECT coalesce(source_name, 'Unknown') AS source_name, theme, count(*)::BIGINT AS n FROM cls GROUP BY ALL")
def source_theme_breakdown(spark, d):
    return R.source_themes(classified(spark, d))


@query(f"WITH {BASE}, {LOOK}, {RECENT}, r AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY {ORDER}) AS k FROM recent) SELECT source_name, k::BIGINT AS rank, id, substr(title, 1, 80) || '...' AS heading FROM r WHERE k <= 10")
def source_top10_articles(spark, d):
    return R.first_articles(recent(spark, d))


@query(f"{CLS} SELECT title AS \"Title\", source_name AS \"Source\", coalesce(strftime(published_at, '%Y-%m-%d'), 'Unknown') AS \"Date\", CASE WHEN summary = '' THEN '' ELSE substr(summary, 1, 150) || '...' END AS \"Summary\", link AS \"URL\" FROM cls WHERE theme = '{THEME}'")
def deep_dive_table(spark, d):
    return R.deep_dive(classified(spark, d), THEME)


@query(f"{CLS} SELECT title AS \"Title\", theme AS \"Theme\", coalesce(strftime(published_at, '%Y-%m-%d'), 'Unknown') AS \"Date\", CASE WHEN summary = '' THEN '' ELSE substr(summary, 1, 100) || '...' END AS \"Summary\", link AS \"URL\" FROM cls WHERE source_name = '{SOURCE}'")
def source_articles_table(spark, d):
    return R.source_articles(classified(spark, d), SOURCE)


@query(f"SELECT count(*)::BIGINT AS n FROM article WHERE source_name IN {SOURCES}")
def source_in_list_count(spark, d):
    return table(spark, d, "article").where(F.col("source_name").isin(*SOURCES)).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT source_name FROM article")
def distinct_sources(spark, d):
    return table(spark, d, "article").select("source_name").distinct()


@query(f"WITH {BASE}, {LOOK}, {RECENT} SELECT count(*)::BIGINT AS n FROM recent")
def total_articles(spark, d):
    return recent(spark, d).agg(F.count("*").alias("n"))


@query(f"{CLS}, r AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY {CORDER}) AS k FROM cls) SELECT theme, k::BIGINT AS rank, id FROM r WHERE k <= 15")
def theme_top15(spark, d):
    return R.theme_first(classified(spark, d))


@query(
    f"{CLS}, r AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY {CORDER}) AS k FROM cls) SELECT theme, string_agg(k || '. ' || title || chr(10) || '   Source: ' || coalesce(source_name, 'Unknown') || chr(10) || "
    "CASE WHEN substr(summary, 1, 300) = '' THEN '' ELSE '   Summary: ' || substr(summary, 1, 300) || chr(10) END || CASE WHEN link = '' THEN '' ELSE '   URL: ' || link || chr(10) END, chr(10) ORDER BY k) AS prompt FROM r WHERE k <= 15 GROUP BY theme"
)
def theme_prompt(spark, d):
    return S.prompts(classified(spark, d))


@query(
    f"{CLS}, n AS (SELECT d.theme, count(c.id) AS n FROM dim d LEFT JOIN cls c ON c.theme = d.theme GROUP BY ALL) SELECT theme, n::BIGINT AS n, CASE WHEN n = 0 THEN 'none' WHEN n < 3 THEN 'few' ELSE 'request' END AS status, "
    "CASE WHEN n = 0 THEN 'No articles found for this theme in the past two weeks.' WHEN n < 3 THEN 'Limited coverage this week with only ' || n || ' articles found.' END AS what_is_happening FROM n"
)
def summary_status(spark, d):
    return S.summary_status(R.theme_counts(classified(spark, d), table(spark, d, "theme_keyword")))


_TEXT = "SELECT DISTINCT id, coalesce(source_name, 'none') AS s, coalesce(theme, 'none') AS t, coalesce(entry_ord, 0) AS e FROM article"


def _reply_rows(spark, d):
    return table(spark, d, "article").select("id", F.coalesce("source_name", F.lit("none")).alias("s"), F.coalesce("theme", F.lit("none")).alias("t"), F.coalesce("entry_ord", F.lit(0)).alias("e")).distinct()


@query(
    f"""WITH r AS ({_TEXT}) SELECT id || e || t AS theme, CASE WHEN e % 4 = 1 THEN 'h' WHEN e % 4 = 2 THEN 'Unable to generate summary.' ELSE id || ' ' || s END AS what_is_happening,
CASE WHEN e % 4 IN (1, 2) THEN 'Unable to generate analysis.' ELSE t END AS why_it_matters, CASE WHEN e % 4 = 0 OR e % 4 = 3 THEN '- ' || s || ' - q' ELSE 'No specific items to watch.' END AS what_to_watch,
CASE WHEN e % 4 = 0 OR e % 4 = 3 THEN 'z - T | ' || s || ' | U | R' ELSE '' END AS further_reading FROM r"""
)
def section_parse(spark, d):
    s = F.col("s")
    whole = F.concat(F.lit("preamble\n1. WHAT IS HAPPENING: "), "id", F.lit(" \n"), s, F.lit("\n\n**WHY IT MATTERS**\n"), "t", F.lit("\n3. What to watch:\n"), F.lit("- "), s, F.lit("\n- q\nsee further reading list: z\n- T | "), s, F.lit(" | U | R"))
    turned = F.concat(F.lit("WHY IT MATTERS: m\n"), s, F.lit("\nWHAT IS HAPPENING: h"))
    kind = F.col("e") % 4
    rows = _reply_rows(spark, d).select(F.concat("id", F.col("e").cast("string"), "t").alias("theme"), F.when(kind == 1, turned).when((kind == 2), F.when(F.col("e") % 8 == 2, F.lit(""))).otherwise(whole).alias("reply"))
    parsed = S.parse_sections(rows)
    return parsed.withColumn("what_to_watch", F.trim("what_to_watch"))


@query(f"WITH r AS ({_TEXT}) SELECT id || e || t AS theme, 0::BIGINT AS pos, t AS title, s AS source, id AS url, 'R' AS reason FROM r UNION ALL SELECT id || e || t, 2::BIGINT, 'T2', s, 'U2', '' FROM r")
def further_reading_parse(spark, d):
    text = F.concat(F.lit("- "), "t", F.lit(" | "), "s", F.lit(" | "), "id", F.lit(" | R\nno bars\n* T2|"), "s", F.lit("|U2\n"))
    return S.parse_further_reading(_reply_rows(spark, d).select(F.concat("id", F.col("e").cast("string"), "t").alias("theme"), text.alias("text")))


@query(f"WITH r AS ({_TEXT}) SELECT id || e || t AS theme, CASE WHEN e % 2 = 0 THEN '- ' || s ELSE s END AS item, (CASE WHEN e % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS n FROM r")
def watch_items(spark, d):
    text = F.when(F.col("e") % 2 == 0, F.concat(F.lit("- "), "s", F.lit(" \n\n  - q"))).otherwise(F.col("s"))
    rows = _reply_rows(spark, d).select(F.concat("id", F.col("e").cast("string"), "t").alias("theme"), S.watch_bullets(text).alias("items"))
    return rows.select("theme", F.element_at("items", 1).alias("item"), F.size("items").cast("bigint").alias("n"))


@query(
    "WITH d AS (SELECT theme, min(theme_ord) AS o FROM theme_keyword WHERE theme IS NOT NULL GROUP BY theme) SELECT theme, CASE WHEN o % 2 = 0 THEN 'Error calling Ollama API: 500' ELSE 'Error generating summary: timed out' END AS what_is_happening, "
    "'Unable to analyze at this time.' AS why_it_matters, 'Please try again later.' AS what_to_watch, '' AS further_reading FROM d WHERE o < 4"
)
def failed_summary_texts(spark, d):
    o = F.col("theme_ord")
    replies = R.themes_of(table(spark, d, "theme_keyword")).select("theme", F.when(o >= 4, "WHAT IS HAPPENING: h").alias("reply"), F.when((o % 2 == 0) & (o < 4), 500).when(o >= 4, 200).alias("status"), F.when((o % 2 == 1) & (o < 4), "timed out").alias("error"))
    return S.failed_summaries(replies)


CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), 'http\S+|www\S+', '', 'g'), '[^a-zA-Z\s]', ' ', 'g'), '\s+', ' ', 'g'))"
TOKENS = f"tok AS (SELECT theme, class_phase, source_ord, entry_ord, id, unnest(string_split({CLEAN.format("title || ' ' || summary")}, ' ')) AS word, generate_subscripts(string_split({CLEAN.format("title || ' ' || summary")}, ' '), 1) AS pos FROM cls)"
STOP = "stop AS (SELECT DISTINCT lower(word) AS word FROM stop_word)"
COUNTS = (
    "cnt AS (SELECT theme, word, count(*)::BIGINT AS n, min(struct_pack(a := class_phase, b := coalesce(source_ord, 1099511627776), c := coalesce(entry_ord, 1099511627776), d := id, e := pos)) AS first "
    "FROM tok WHERE length(word) > 2 AND word NOT IN (SELECT word FROM stop) GROUP BY ALL), top AS (SELECT theme, row_number() OVER (PARTITION BY theme ORDER BY n DESC, first, word)::BIGINT AS rank, word, n FROM cnt QUALIFY rank <= 20)"
)


@query(f"SELECT doc_id, {CLEAN.format('text')} AS cleaned FROM documents")
def clean_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@query(f"{CLS}, {TOKENS}, {STOP}, {COUNTS} SELECT theme, word, n FROM cnt")
def token_counts(spark, d):
    return W.word_counts(classified(spark, d), table(spark, d, "stop_word")).select("theme", "word", "n")


@query(f"{CLS}, {TOKENS}, {STOP}, {COUNTS} SELECT theme, rank, word, n FROM top")
def top_words_by_theme(spark, d):
    return W.top_words(classified(spark, d), table(spark, d, "stop_word"))


@query(f"{CLS}, {TOKENS}, {STOP}, {COUNTS} SELECT theme, rank, word, n, n / max(n) OVER (PARTITION BY theme) AS share FROM top")
def keyword_table(spark, d):
    return W.keyword_table(W.top_words(classified(spark, d), table(spark, d, "stop_word")))


@query(
    f"{CLS}, {TOKENS}, {STOP}, two AS (SELECT theme, word AS first, lead(word) OVER (PARTITION BY theme, id ORDER BY pos) AS second FROM tok WHERE length(word) > 1) "
    "SELECT theme, first, second, count(*)::BIGINT AS n FROM two WHERE second IS NOT NULL AND first NOT IN (SELECT word FROM stop) AND second NOT IN (SELECT word FROM stop) GROUP BY ALL"
)
def cloud_bigrams(spark, d):
    return W.bigrams(classified(spark, d), table(spark, d, "stop_word"))


_LIKE = "({k} * ln(greatest({x}, 1e-10)) + ({m} - {k}) * ln(greatest(1 - {x}, 1e-10)))"


def _ratio() -> str:
    p, p1, p2 = "(c2 / N)", "(k / c1)", "((c2 - k) / greatest(N - c1, 1.0))"
    return f"-2 * ({_LIKE.format(k='k', m='c1', x=p)} + {_LIKE.format(k='(c2 - k)', m='(N - c1)', x=p)} - {_LIKE.format(k='k', m='c1', x=p1)} - {_LIKE.format(k='(c2 - k)', m='(N - c1)', x=p2)})"


@query(
    f"{CLS}, {TOKENS}, {STOP}, seq AS (SELECT theme, word, lead(word) OVER (PARTITION BY theme, id ORDER BY pos) AS second FROM tok WHERE length(word) > 1), "
    "single AS MATERIALIZED (SELECT theme, word, count(*) AS n FROM seq WHERE word NOT IN (SELECT word FROM stop) GROUP BY ALL), "
    "stem AS (SELECT *, CASE WHEN word LIKE '%s' AND word NOT LIKE '%ss' THEN left(word, length(word) - 1) END AS stem FROM single), form AS MATERIALIZED (SELECT a.theme, a.word, a.n, coalesce(b.word, a.word) AS target FROM stem a LEFT JOIN single b ON a.theme = b.theme AND b.word = a.stem), "
    "words AS MATERIALIZED (SELECT theme, target AS word, sum(n) AS n FROM form GROUP BY ALL), total AS (SELECT theme, sum(n) AS N FROM single GROUP BY ALL), "
    "pair AS MATERIALIZED (SELECT theme, word || ' ' || second AS p, count(*) AS n FROM seq WHERE second IS NOT NULL AND word NOT IN (SELECT word FROM stop) AND second NOT IN (SELECT word FROM stop) GROUP BY ALL), "
    "pstem AS (SELECT *, CASE WHEN p LIKE '%s' AND p NOT LIKE '%ss' THEN left(p, length(p) - 1) END AS stem FROM pair), folded AS MATERIALIZED (SELECT a.theme, coalesce(b.p, a.p) AS p, sum(a.n) AS k FROM pstem a LEFT JOIN pair b ON a.theme = b.theme AND b.p = a.stem GROUP BY ALL), "
    "fw AS MATERIALIZED (SELECT f.theme || '|' || f.word AS word, f.target, w.n FROM form f JOIN words w ON w.theme || '|' || w.word = f.theme || '|' || f.target), "
    "p1 AS MATERIALIZED (SELECT f.theme, f.p, f.k::DOUBLE AS k, x.target AS w1, x.n::DOUBLE AS c1 FROM folded f JOIN fw x ON x.word = f.theme || '|' || split_part(f.p, ' ', 1)), "
    "p2 AS MATERIALIZED (SELECT f.*, x.target AS w2, x.n::DOUBLE AS c2 FROM p1 f JOIN fw x ON x.word = f.theme || '|' || split_part(f.p, ' ', 2)), pc AS (SELECT f.*, t.N::DOUBLE AS N FROM p2 f JOIN total t USING (theme)), "
    f"likely AS (SELECT * FROM pc WHERE N > c1 AND N > c2 AND {_ratio()} > 30), off AS (SELECT theme, word, sum(k) AS k FROM (SELECT theme, w1 AS word, k FROM likely UNION ALL SELECT theme, w2, k FROM likely) GROUP BY ALL), "
    "term AS (SELECT w.theme, w.word AS term, (w.n - coalesce(o.k, 0))::BIGINT AS n FROM words w LEFT JOIN off o USING (theme, word) UNION ALL SELECT theme, p, k::BIGINT FROM likely), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY n DESC, term)::BIGINT AS rank FROM term WHERE n > 0 QUALIFY rank <= 100) SELECT theme, rank, term, n, n / max(n) OVER (PARTITION BY theme) AS share FROM ranked"
)
def cloud_frequencies(spark, d):
    return W.cloud_frequencies(classified(spark, d), table(spark, d, "stop_word"))


@query("SELECT DISTINCT lower(word) AS word FROM stop_word UNION SELECT 'ai'")
def stop_words(spark, d):
    return table(spark, d, "stop_word").select(F.lower("word").alias("word")).union(spark.createDataFrame([("ai",)], "word string")).distinct()


@query(f"SELECT strftime(TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY, '%B %d, %Y') || ' - ' || strftime(TIMESTAMP '{AS_OF}', '%B %d, %Y') AS label")
def date_range_label(spark, d):
    return spark.range(1).select(R.date_range(F.lit(AS_OF).cast("timestamp_ntz")).alias("label"))


@query(f"SELECT strftime(TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY, '%B %d') || ' - ' || strftime(TIMESTAMP '{AS_OF}', '%B %d, %Y') AS label")
def overview_date_label(spark, d):
    return spark.range(1).select(R.date_range(F.lit(AS_OF).cast("timestamp_ntz"), first_year=False).alias("label"))


@query(
    f"{CLS} SELECT d.theme_ord::BIGINT AS theme_ord, d.theme, count(c.id)::BIGINT AS n, CASE WHEN d.theme_ord % 2 = 0 THEN 'h ' || d.theme ELSE 'No analysis available.' END AS what_is_happening, "
    f"CASE WHEN d.theme_ord % 2 = 0 THEN 'w' ELSE 'No items to watch.' END AS what_to_watch, d.theme_ord % 2 = 0 AS has_summary FROM dim d LEFT JOIN cls c ON c.theme = d.theme GROUP BY ALL"
)
def overview_cards(spark, d):
    given = R.themes_of(table(spark, d, "theme_keyword")).where("theme_ord % 2 = 0").select("theme", F.concat(F.lit("h "), "theme").alias("what_is_happening"), F.lit("m").alias("why_it_matters"), F.lit("w").alias("what_to_watch"), F.lit("").alias("further_reading"))
    return R.overview_cards(classified(spark, d), table(spark, d, "theme_keyword"), given)


@query()
def feed_articles(spark, d):
    return A.from_feed(table(spark, d, "feed_entry"), table(spark, d, "sources"))


@query()
def html_text(spark, d):
    return table(spark, d, "feed_entry").select("source_name", "entry_ord", html_to_text(F.coalesce("summary", "description")).alias("text"))


# Pages made from the tables: 22 boxes each, of which the first 20 are looked at and every fifth has a title that is too short.
@query(f"WITH r AS ({_TEXT}), k AS (SELECT unnest(range(20))::INT AS k) SELECT s AS source_name, k AS entry_ord, 'Headline ' || id || ' ' || k AS title, 'http://a.com/' || e || '/' || k AS link FROM r, k WHERE k % 5 <> 4")
def web_scrape(spark, d):
    box = lambda k: F.concat(F.lit('<div class="PostCard"><h2>'), F.when(k % 5 == 4, F.lit("Short")).otherwise(F.concat(F.lit("Headline "), F.col("id"), F.lit(" "), k.cast("string"))), F.lit('</h2><a href="/'), F.col("e").cast("string"), F.lit("/"), k.cast("string"), F.lit('">x</a></div>'))
    html = F.concat(F.lit("<html><body>"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(21)), box), ""), F.lit("<article><h2>Without a class</h2></article></body></html>"))
    return scrape(_reply_rows(spark, d).select(F.col("s").alias("source_name"), F.lit("http://a.com/b/c").alias("url"), html.alias("html"))).drop("id")


@query(
    f"WITH r AS ({_TEXT}) SELECT s AS source_name, 'Title ' || id AS title, 'Text ' || t AS summary, 'http://a.com/' || id AS link, TIMESTAMP '2025-01-06 10:00:00' + to_minutes(e % 50) AS published_at FROM r"
)
def rss_parse(spark, d):
    minute = F.lpad((F.col("e") % 50).cast("string"), 2, "0")
    xml = F.concat(
        F.lit("<rss><channel><item><title>Title "), "id", F.lit("</title><description>&lt;p&gt;Text &lt;b&gt;"), "t", F.lit("&lt;/b&gt;&lt;/p&gt;</description><link>http://a.com/"), "id",
        F.lit("</link><pubDate>Mon, 06 Jan 2025 10:"), minute, F.lit(":00 GMT</pubDate></item><item><title/><link>u</link></item></channel></rss>"),
    )
    entries = parse_feeds(_reply_rows(spark, d).select(F.col("s").alias("source_name"), xml.alias("xml"))).where("error is null")
    return A.from_feed(entries, table(spark, d, "sources")).select("source_name", "title", "summary", "link", "published_at")


@query()
def p6_found(spark, d):
    """The dictionary is kept in the shared folder: later runs, over whatever articles, parse only texts that are new to it."""
    return found_instants(table(spark, d, "article"), table(spark, d, "sources"), f"{shared_dir(spark)}/instants-{VERSION}")
