import importlib.util
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsgrid import pipeline, schema
from newsgrid.model_client import Offline
from newsgrid.operators import articles as A, classify as C, reports as R, summarise as S, words as W
from newsgrid.operators.text import clean_text, html_text
from newsgrid.sources.feeds import parse_feed, read_feeds
from newsgrid.sources.web import headlines

KEYWORDS = [
    (0, "T0 first", "agents"), (0, "T0 first", "tool use"), (1, "T1 second", "model release"), (1, "T1 second", "model"), (1, "T1 second", "new model"), (1, "T1 second", "performance"),
    (2, "T2 third", "performance"), (2, "T2 third", "cost"), (2, "T2 third", "fine-tuning"), (3, "T3 fourth", " VC"), (3, "T3 fourth", "融资"), (3, "T3 fourth", "RAG"),
]


@pytest.fixture(scope="module")
def keywords(spark):
    rows = [(o, t, "c", "#0", "m", k, w) for k, (o, t, w) in enumerate(KEYWORDS)]
    return spark.createDataFrame(rows, schema.THEME_KEYWORD)


@pytest.mark.parametrize(
    ("title", "summary", "want"),
    [
        ("performance", "", ("T1 second", 1)), ("Models and agents", "", ("T0 first", 1)), ("New model release", "", ("T1 second", 3)), ("seed", "VC round", ("T3 fourth", 1)),
        ("VC", "fund", None), ("融资", "", ("T3 fourth", 1)), ("公司融资", "", None), ("RAG_x", "", None), ("éRAG", "", None), ("Fine-tuning cost", "lower cost", ("T2 third", 3)), (None, None, None),
    ],
)
def test_keywords(spark, keywords, title, summary, want):
    row = C.keyword_classify(spark.createDataFrame([("1", title, summary)], "id string, title string, summary string"), keywords).first()
    assert (None if row.theme is None else (row.theme, row.score)) == want


def test_window_and_first_copy(spark):
    rows = [("1", "A", datetime(2025, 1, 1), 0, 0), ("2", "", None, 0, 1), ("3", "A", datetime(2025, 1, 9), 1, 0), ("4", None, datetime(2030, 1, 1), 2, 0), ("5", "B", datetime(2024, 12, 31, 23, 59, 59), 2, 1), ("1", "A", datetime(2025, 1, 1), 0, 0)]
    df = spark.createDataFrame(rows, "id string, link string, published_at timestamp_ntz, source_ord int, entry_ord int")
    kept = A.lookback(df, "2025-01-15 00:00:00")
    assert sorted(r.id for r in kept.collect()) == ["1", "1", "2", "3", "4"]
    assert sorted(r.id for r in A.keep_first(kept).collect()) == ["1", "2"]
    assert A.keep_first(df.limit(0)).count() == 0


def test_sections_and_reading(spark):
    text = "preamble\n1. WHAT IS HAPPENING: a b\nmore\n\n**WHY IT MATTERS**\nx\n3. What to watch:\n- p\n- q\nsee further reading list: z\n- T | S | U | R"
    got = {r.theme: r for r in S.parse_sections(spark.createDataFrame([("a", text), ("b", "WHY IT MATTERS: m\nWHAT IS HAPPENING: h"), ("c", None)], "theme string, reply string")).collect()}
    assert tuple(got["a"])[1:] == ("a b more", "x", " - p - q", "z - T | S | U | R")
    assert (got["b"].what_is_happening, got["b"].why_it_matters) == ("h", "Unable to generate analysis.")
    assert got["c"].what_to_watch == "No specific items to watch."
    assert [tuple(r)[1:] for r in S.parse_further_reading(spark.createDataFrame([("a", "* A | B | C")], "theme string, text string")).collect()] == [(0, "A", "B", "C", "")]
    status = {r.theme: r.status for r in S.summary_status(spark.createDataFrame([("x", 0), ("y", 2), ("z", 3)], "theme string, n long")).collect()}
    assert status == {"x": "none", "y": "few", "z": "request"}


def test_words(spark):
    rows = [("t", 0, 0, k, str(k), "beta alpha", "beta alpha gamma ai it don't café") for k in range(1)]
    df = spark.createDataFrame(rows, "theme string, class_phase int, source_ord int, entry_ord int, id string, title string, summary string")
    stop = spark.createDataFrame([("ai",), (None,)], "word string")
    assert [(r.word, r.n) for r in W.top_words(df, stop, n=2).orderBy("rank").collect()] == [("beta", 2), ("alpha", 2)]
    assert spark.range(1).select(clean_text(F.lit("see https://x.y/z?q=1 wwwabc xhttpfoo end don't café 3d"))).first()[0] == "see x end don t caf d"
    assert W.cloud_frequencies(df.limit(0), stop).count() == 0


def test_cloud_pairs_fold_with_their_words(spark):
    schema_ = "theme string, title string, summary string, word string"
    texts = ["language models"] * 40 + ["language model"] + ["models grow"] * 5 + ["x language y"] * 3 + [None] + [f"other{chr(97 + k % 26)}word" for k in range(400)]
    df = spark.createDataFrame([("t", t, None, "clash") for t in texts], schema_)
    got = {r.term: r.n for r in W.cloud_frequencies(df, spark.createDataFrame([("grow",)], "word string")).collect()}
    assert got["language model"] == 41 and got["model"] == 5 and got["language"] == 3 and "models" not in got and "language models" not in got


def test_html_pages_feeds(spark, tmp_path):
    assert html_text("<p>a <b>b</b></p><script>x</script>&amp;c") == "a b &c"
    assert html_text(None) == "" and html_text("<<<p") is not None
    assert headlines("http://a.com/b/c", '<div class="PostCard"><h2>Ten chars ok</h2><a href="/d">x</a></div>') == [(0, "Ten chars ok", "http://a.com/d")]
    many = "".join(f'<li class="item"><a href="/{k}">A long headline {k}</a></li>' for k in range(25))
    assert len(headlines("http://a.com", many)) == 20
    xml = "<rss><channel><item><title>One</title><link>u</link></item></channel></rss>"
    assert [r[2] for r in parse_feed("a", xml)] == ["One"] and len(next(parse_feed("a", xml))) == 12
    assert list(parse_feed("a", "<rss><item>"))[-1][-1]
    (tmp_path / "f.xml").write_text(xml)
    rows = read_feeds(spark, [{"name": "a", "url": str(tmp_path / "f.xml")}, {"name": "b", "url": str(tmp_path / "none.xml")}]).collect()
    assert sorted((r.source_name, r.title) for r in rows) == [("a", "One"), ("b", None)] and any(r.error for r in rows)


def test_reports(spark):
    arts = spark.createDataFrame([("1", "Wired", 0, 0, "x"), ("2", "X", 1, 0, None), ("3", "Wired", 0, 1, "x")], "id string, source_name string, source_ord int, entry_ord int, theme string")
    src = spark.createDataFrame([(0, "Wired", "u", "rss", "news")], schema.SOURCE)
    got = {r.Name: tuple(r)[1:5] for r in R.source_overview(arts, src).collect()}
    assert got == {"Wired": ("RSS", "News", 2, "u"), "X": ("UNKNOWN", "Unknown", 1, "")}
    assert R.csv_name("AI Models") == "AI_Models_articles.csv"
    assert sorted(map(tuple, R.source_themes(arts).collect())) == [("Wired", "x", 2), ("X", "Unknown", 1)]


def test_pipeline(spark, keywords):
    rows = [(str(k), f"A longer title {k}", "model" if k % 2 else "nothing", f"l{k}", None, "Wired", 0, k, None, None) for k in range(6)]
    arts = spark.createDataFrame(rows, schema.ARTICLE)
    src = spark.createDataFrame([(0, "Wired", "u", "rss", "news")], schema.SOURCE)
    out = pipeline.run(arts, src, keywords, "2025-01-01 00:00:00", Offline("WHAT IS HAPPENING: h"), refresh=True)
    assert {r.theme: r.n for r in out.counts.collect()} == {"T0 first": 3, "T1 second": 3, "T2 third": 0, "T3 fourth": 0}
    assert {r.theme: r.what_is_happening for r in out.summaries.collect()}["T1 second"] == "h"


def test_pipeline_asks_once_and_keeps_inputs_apart(spark, keywords, tmp_path):
    class Counting(Offline):
        """Tells how often it was asked by a file that all workers append to."""

        def __init__(self, path, reply):
            Offline.__init__(self, reply)
            self.path = str(path)

        def complete(self, prompts, options=None):
            with open(self.path, "a") as f:
                f.write("".join(f"{options.tokens}\n" for _ in prompts))
            assert all("theme" in p for p in prompts)
            return Offline.complete(self, prompts)

    src = spark.createDataFrame([(0, "Wired", "u", "rss", "news")], schema.SOURCE)

    def articles(n):
        return spark.createDataFrame([(str(k), f"A longer title {k}", "nothing", f"l{k}", None, "Wired", 0, k, None, None) for k in range(n)], schema.ARTICLE)

    client = Counting(tmp_path / "asked", "T1 second")
    first = pipeline.run(articles(12), src, keywords, "2025-01-01 00:00:00", client)
    assert sorted(r.theme for r in first.articles.collect()) == ["T0 first"] * 10 + ["T1 second"] * 2
    assert {r.theme: r.what_is_happening for r in first.summaries.collect()}["T0 first"] == "Unable to generate summary."
    assert sorted((tmp_path / "asked").read_text().split()) == ["1500", "200", "200"]
    assert pipeline.run(articles(20), src, keywords, "2025-01-01 00:00:00", client).articles.count() == 20
    again = pipeline.run(articles(12), src, keywords, "2025-01-01 00:00:00", client)
    assert again.articles.count() == 12 and (tmp_path / "asked").read_text().split().count("200") == 4
    assert pipeline.cache_info()["ttl_seconds"] == 21600
    pipeline.clear_snapshots(spark)
    assert pipeline.run(articles(1), src, keywords, "2025-01-01 00:00:00", client).articles.count() == 1
    got = {r.id: r.theme for r in pipeline.classify_singly(articles(2), keywords, Offline("I say: t1 SECOND")).collect()}
    assert got == {"0": "T1 second", "1": "T1 second"}
    assert {r.theme for r in pipeline.classify_singly(articles(2), keywords, Offline("none of them")).collect()} == {None}


def test_http_client(monkeypatch):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from newsgrid.model_client import SUMMARY, Http

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200), self.end_headers()

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(500 if "bad" in body["prompt"] else 200), self.end_headers()
            self.wfile.write(json.dumps({"response": f"{body['options']['num_predict']} {self.headers['Authorization']}"}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("NEWSGRID_MODEL_URL", f"http://127.0.0.1:{server.server_port}/")
    monkeypatch.setenv("NEWSGRID_MODEL_KEY", "k")
    assert Http().available() and Http().complete(["ok", "bad"], SUMMARY) == [{"reply": "1500 Bearer k", "status": 200, "error": None}, {"reply": None, "status": 500, "error": None}]
    server.shutdown()
    server.server_close()
    assert Http().complete(["ok"])[0]["error"] and not Http().available()


def test_sources_from_files_to_articles(spark, tmp_path):
    from newsgrid.sources.gather import gather

    (tmp_path / "f.xml").write_text("<rss><channel><item><title>One</title><link>http://x/1</link><description>&lt;b&gt;a&lt;/b&gt;</description><pubDate>4 de septiembre de 2024 a las 05:23</pubDate></item><item><title>Two</title><link>http://x/2</link></item></channel></rss>")
    (tmp_path / "p.html").write_text('<a href="http://x/1">The same link as the feed has</a><a href="http://x/3">Another headline of the page</a>')
    rows = [(0, "feed", str(tmp_path / "f.xml"), "rss", "c", "America/Bogota", True), (1, "page", str(tmp_path / "p.html"), "web", "c", None, None), (2, "gone", str(tmp_path / "none"), "web", "c", None, None), (3, "lost", str(tmp_path / "none"), "rss", "c", None, None)]
    sources = spark.createDataFrame(rows, f"{schema.SOURCE}, zone_name string, day_first boolean")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = {r.link: (r.title, r.summary, r.source_name, r.source_ord, str(r.published_at)) for r in gather(spark, sources).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == {"http://x/1": ("One", "a", "feed", 0, "2024-09-04 10:23:00"), "http://x/2": ("Two", "", "feed", 0, "None"), "http://x/3": ("Another headline of the page", "", "page", 1, "None")}


def test_feed_dates_and_nulls(spark):
    rows = [("a", k, "t", None, None, f"l{k}", None, None, *d) for k, d in enumerate([("2025-01-06T10:00:00+02:00", None, None), (None, "not a date", "Mon, 06 Jan 2025 10:00:00 GMT"), (None, None, None), ("", "6 Jan 2025", None)])]
    out = A.from_feed(spark.createDataFrame(rows, schema.FEED_ENTRY), spark.createDataFrame([(0, "a", "u", "rss", "c")], schema.SOURCE)).collect()
    assert [str(r.published_at) for r in sorted(out, key=lambda r: r.entry_ord)] == ["2025-01-06 08:00:00", "2025-01-06 10:00:00", "None", "2025-01-06 00:00:00"]
    assert A.from_feed(spark.createDataFrame([], schema.FEED_ENTRY), spark.createDataFrame([], schema.SOURCE)).count() == 0


def test_csv_bullets_and_labels(spark, tmp_path):
    R.write_csv(spark.createDataFrame([('a "b"', "c,d"), ("é", None)], "Title string, Source string"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert text.startswith("Title,Source\n") and '"a ""b""","c,d"' in text
    df = spark.createDataFrame([("- a\n\n b ",), ("one",), (None,)], "t string")
    assert [r.b for r in df.select(S.watch_bullets(F.col("t")).alias("b")).collect()] == [["- a", "b"], ["one"], [None]]
    at = F.lit("2025-01-05 00:00:00").cast("timestamp_ntz")
    assert spark.range(1).select(R.date_range(at, first_year=False)).first()[0] == "December 22 - January 05, 2025"


def test_landing_streams(spark, tmp_path):
    from newsgrid.streaming import landing

    rows = [("l1", "a", datetime(2025, 1, 1, 1)), ("l1", "b", datetime(2025, 1, 1, 2)), ("l2", "a", datetime(2025, 1, 2, 1))]
    df = spark.createDataFrame(rows, "link string, source_name string, fetched_at timestamp_ntz")
    df.write.parquet(str(tmp_path / "in"))
    for name, stream, mode in (("links", landing.unique_links(landing.landed(spark, str(tmp_path / "in"), df.schema)), "append"), ("counts", landing.counts_by_window(landing.landed(spark, str(tmp_path / "in"), df.schema)), "complete")):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r.link for r in spark.table("links").collect()) == ["l1", "l2"]
    assert sorted((r.source_name, r.n) for r in spark.table("counts").collect()) == [("a", 1), ("a", 1), ("b", 1)]


def test_shared_folder(spark, tmp_path, monkeypatch):
    from newsgrid import session

    df = session.cut(spark.range(5))
    assert df.count() == 5
    session.clear_cuts()
    assert not list((__import__("pathlib").Path(session.shared_dir(spark)) / f"cuts-{spark.sparkContext.applicationId}").glob("*"))
    assert session.hash_sample(spark.range(1000), "id", 100).count() in range(60, 140) and session.hash_sample(spark.range(9), "id", 100).count() == 9

    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077", "getConf": lambda self: Conf()})()

    with pytest.raises(ValueError):
        session.shared_dir(Cluster())


def test_batches(spark):
    rows = [(str(k), k % 3, k, None) for k in range(25)]
    out = C.batches(spark.createDataFrame(rows, "id string, source_ord int, entry_ord int, published_at timestamp_ntz")).collect()
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    assert [r.id for r in sorted(out, key=lambda r: (r.batch_id, r.pos))] == [r[0] for r in order]


def test_plans(spark, keywords):
    from newsgrid.plans import catalogue as Q

    plan = Q.theme_top15(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    plan = Q.source_in_list_count(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(source_name" in plan


def test_entry_without_subpackage():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "theme_counts" in names and set(entry.oracle_sql()) <= names
    assert importlib.util.find_spec("newsgrid.llm") is None or "p2_found" in names


def test_entry_with_a_library_missing(monkeypatch):
    import __spark_entry__ as entry

    def missing(name):
        raise ImportError(name)

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    assert "theme_counts" in entry.queries() and "p2_found" not in entry.queries() and "theme_counts" in entry.oracle_sql()
