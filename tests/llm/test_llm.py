import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgrid.llm import encoding, mixing, neardup, packing, quality, residue, subject, tokens, truncated

ARTICLES = "id string, title string, summary string, source_name string, key int, fp string"


def articles(spark, rows):
    return spark.createDataFrame([(i, t, s, n, 1, "x") for i, t, s, n in rows], ARTICLES)


def text(rng, n):
    return " ".join("".join(rng.choices("abcdefghiklmnoprstu", k=7)) for _ in range(n))


def test_near_duplicates_equal_brute_force(spark):
    rng, rows = random.Random(1), []
    for k in range(40):
        own = text(rng, 40).split()
        rows.append((f"a{k}", "t", " ".join(own), "s"))
        for c in range(rng.randrange(3)):
            edited = [w if rng.random() > 0.12 else text(rng, 1) for w in own]
            rows.append((f"a{k}-{c}", "t", " ".join(edited), "s"))
    rows += [("copy", "t", rows[0][2], "s"), rows[0], ("short", "a b", None, None), (None, "x", "y", "z"), ("empty", "", "", "")]
    got = {tuple(r) for r in neardup.found(articles(spark, rows)).collect()}
    sets = {i: neardup.words_of(t, s) for i, t, s, _ in rows if i}
    want = {tuple(sorted((a, b))) for a, b in combinations(sets, 2) if min(len(sets[a]), len(sets[b])) >= 20 and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert got <= want and len(got) >= 0.95 * len(want)
    assert ("a0", "copy") in got
    assert neardup.found(articles(spark, []).limit(0)).count() == 0


def test_hot_keys_lose_no_link(spark, monkeypatch):
    rng = random.Random(2)
    own = text(rng, 60).split()
    rows = [(f"h{k:03d}", "t", " ".join([*own, f"edit{k}"]), "s") for k in range(60)]
    monkeypatch.setattr(neardup, "HOT", 16)
    linked, members = neardup.near_duplicates(articles(spark, rows))
    assert linked.count() == 60 * 59 // 2 and members.count() == 60


def test_copies_and_groups(spark):
    rng = random.Random(3)
    same = text(rng, 30)
    rows = [(f"c{k:03d}", "t", same, "s") for k in range(neardup.EXPAND + 6)] + [("d", "t", same + " more", "s")]
    linked, members = neardup.near_duplicates(articles(spark, rows))
    pairs = neardup.expand_pairs(linked, members)
    assert pairs.count() == neardup.EXPAND + 5 + 1
    assert {r.group_id for r in neardup.groups(linked, members).collect()} == {"c000"}


def test_tables_find_pairs_at_the_threshold():
    rng, hashes = random.Random(6), []
    for _ in range(3000):
        shared, p, q = ([rng.getrandbits(64) for _ in range(n)] for n in (70, 15, 15))
        hashes += [shared + p, shared + q]
    first, second, _, _ = neardup.signatures(hashes)
    met = (first[::2] == first[1::2]).any(1) & (second[::2] == second[1::2]).any(1)
    assert met.mean() >= 0.96


def test_large_classes_give_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    same = text(rng, 30)
    turned = " ".join(reversed(same.split()))
    rows = [(f"c{k:03d}", "t", same if k % 3 else turned, "s") for k in range(neardup.EXPAND + 16)] + [(f"d{k:03d}", "t", same + " more", "s") for k in range(20)] + [("e", "t", same + " other", "s")]
    monkeypatch.setattr(neardup, "BLOCK", 16)
    got = [tuple(r) for r in neardup.found(articles(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == set(combinations(sorted(r[0] for r in rows), 2))


def test_groups_of_a_long_path(spark, monkeypatch):
    rng, rounds = random.Random(4), []
    own = [f"{k:04d}" for k in range(400)]
    rng.shuffle(own)
    path = [(*sorted(p), 0.9) for p in zip(own, own[1:])]
    written = neardup.cut
    monkeypatch.setattr(neardup, "cut", lambda df, name: rounds.append(name) or written(df, name))
    linked = spark.createDataFrame(path, "rep_a string, rep_b string, similarity double")
    members = spark.createDataFrame([(i, i) for i in [*own, "alone"]], "rep string, id string")
    got = {r.id: (r.group_id, r.n_links) for r in neardup.groups(linked, members).collect()}
    assert got == {i: ("0000", 1 if i in (own[0], own[-1]) else 2) for i in own} | {"alone": ("alone", 0)}
    assert rounds.count("labels") <= 15


def test_encoding_round_trip(spark):
    clean = ["Die Müthren Works prüft täglich Anträge über Häuser in Köln", "L’été dernier, près de forêts brûlées à Orléans", "El señor Núñez pidió más atención aquí", "Город проверяет новые модели и школы", "A report – with “quotes” and Söhne"]
    weights = encoding.fit(clean * 20)
    for label in ("utf8>cp1252", "utf8>latin1", "utf8>mac", "utf8>cp437", "utf8>cp1250", "utf8>cp1252x2"):
        for t in clean[:3]:
            try:
                bad = encoding.garble(t, label)
            except UnicodeError:
                continue
            assert encoding.judge_all(weights, [bad])[0][1] == t, (label, t)
    assert encoding.judge_all(weights, ["зПТПД РТПЧЕТСЕФ ОПЧЩЕ НПДЕМЙ"])[0][1] == "Город проверяет новые модели"
    assert [c for c, _ in encoding.judge_all(weights, [*clean, "GROSSE FÄLLE ÜBER KÖLN", "", None, "plain? Yes", "a" * 50_000])] == ["clean"] * 10
    assert encoding.judge_all(weights, ["S�hne", "Sie pr?ft H?user"]) == [("replacement", None), ("question", None)]
    none = encoding.Model(np.zeros_like(weights.weights))
    assert encoding.judge_all(none, ["MÃ¼nchen", "S�hne"]) == [("clean", None)] * 2  # the classifier decides, patterns alone find nothing
    rows = [("1", "MÃ¼nchen", None, "s"), ("1", "MÃ¼nchen", None, "s"), ("2", "", "S�hne", "s"), (None, "MÃ¼nchen", "", "s"), ("3", "fine", "ok", None)]
    assert {tuple(r) for r in encoding.found(articles(spark, rows)).collect()} == {("1", "title"), ("2", "summary")}


@pytest.mark.parametrize(
    ("value", "kind"),
    [
        ("404 Not Found", "page"), ("Please enable JavaScript to view this page.", "page"), ("страница не найдена (id 55ce9906ce0)", "page"), ("Texto  de  ejemplo", "page"), ("{{ post.title }}", "slot"),
        ("Hi *|SUMMARY|*, a real report follows here.", "slot"), ("A guide shows how double braces such as {{ city }} mark a slot.", None), ("The firm explains why its site answered error 404 to readers on Monday.", None),
        ("Gone", None), ("The report goes on for long about rail and roads in the north of the city and its plans. Try again later.", None), ("410 Gone", "page"), ("author_name: undefined", "slot"),
        ("It now explains “502 Bad Gateway” messages to staff at the firm in town.", None), ("Dolet fugor labur prabore duior eliscing consnam lorbore fugor.", "filler"), ("", None), (None, None), ("Cookie banners annoy readers in the city.", None),
    ],
)
def test_residue(value, kind):
    assert residue.kind_of(residue.automaton(), value) == kind


@pytest.mark.parametrize("report", ["Die Stadt prüft neue Züge.", "Le conseil a décidé hier à Orléans.", "The firm’s plan is ready.", ""])
def test_filler_beside_other_letters(report):
    filler = "Dolet fugor labur prabore duior eliscing consnam lorbore fugor."
    assert residue.kind_of(residue.automaton(), f"{report} {filler}") == "filler"
    assert residue.kind_of(residue.automaton(), report) is None


def test_single_words_need_company():
    machine = residue.automaton()
    assert residue.kinds_of(machine, ("Gone", "A film about a town by the sea.")) == [None, None]
    assert residue.kinds_of(machine, ("Gone", "404 Not Found")) == ["page", "page"]
    assert residue.kinds_of(machine, ("Forbidden", None)) == ["page", None] and residue.kinds_of(machine, (None, "")) == [None, None]


def test_residue_rows(spark):
    rows = [("1", "404 Not Found", None, "s"), ("1", "404 Not Found", None, "s"), ("2", "A fine report", "", None), (None, "404 Not Found", "", "s")]
    assert [r.id for r in residue.found(articles(spark, rows)).collect()] == ["1"]
    assert sorted(str(r.id) for r in residue.exclude_residue(articles(spark, rows)).collect()) == ["2"]


def test_truncated(spark):
    body = "The firm tests new tools for teachers in the city. People close to the firm say the work is done in May."
    rows = [(f"n{k}", "t", f"{body} Report {k} tells more of it.", "a") for k in range(12)]
    rows += [("copy", "t", body[:70], "b"), ("mark", "t", "The firm tests new tools for teachers in… [more]", "b"), ("whole", "t", body, "b"), ("link", "t", body + " Read more", "b"), ("none", "t", None, "b"), ("blank", "t", "", "b"), (None, "t", body[:70], "b"), ("page", "t", "403 Forbidden", "b"), ("mark", "t", "The firm tests new tools for teachers in… [more]", "b")]
    assert {r.id for r in truncated.found(articles(spark, rows)).collect()} == {"copy", "mark"}
    share = {r.source_name: r.cut_share for r in truncated.truncation_by_source(articles(spark, rows)).collect()}
    assert share["a"] == 0 and share["b"] == pytest.approx(2 / 7)
    assert truncated.found(articles(spark, []).limit(0)).count() == 0


def test_prefixes_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    values = {"v", "v (see note)", "v zeta eta", "w", "w (x)", "", "same", "same…"}
    for _ in range(400):
        values.add("".join(rng.choice(["a", "b", " ", "ä", ", ", "("]) for _ in range(rng.randrange(1, 9))))
    values |= {"c" * 60 + " tail" + str(k) for k in range(200)} | {"c" * 60, "c" * 61}
    rows = [(v, rng.random() < 0.5 or v in ("v", "w", "c" * 60)) for v in sorted(values) for _ in range(1 + (len(v) == 2))]
    doubtful = {v for v, d in rows if d}
    want = {v for v in doubtful if any(w.startswith(v) and len(w) > len(v) and truncated._GOES_ON.match(w, len(v)) for w in values)}
    for parts in (1, 7, 60):
        monkeypatch.setattr(truncated, "task_slices", lambda _: parts)
        got = [r._core for r in truncated.prefixes_of_longer(spark.createDataFrame(rows, "_core string, _doubtful boolean")).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert "v" in want and "w" not in want


def test_limits_and_plain_ends(spark):
    rows = [(f"s{k % 2}", f"{k} ends here {k * 7919}", 280 if k < 12 else 100 + k) for k in range(60)] + [("s0", "copy of one text in all", 133)] * 40
    got = {tuple(r) for r in truncated.field_limits(spark.createDataFrame(rows, "_source string, _core string, _size int")).collect()}
    assert got == {("s0", 280), ("s1", 280)}
    texts = ["Done.", "Done. ", "by Dr.", "More. Read more.", "wait...", "?", "", "  ", "Yes!”", "ends", "et en savoir plus.", "см. подробнее."]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", truncated.ends_plainly(F.col("t")).alias("p"))
    assert {r.t: r.p for r in df.collect()} == {t: bool(t.strip()) and truncated.tail_of(t) is None for t in texts}


def test_subjects(spark):
    nouns = {"health": "nurses surgeons clinics vaccines".split(), "law": "judges courts lawyers appeals".split(), "arts": "painters operas galleries novels".split()}
    rng = random.Random(4)
    labels, rows, want, n = [], [], {}, 0
    for k in range(240):
        own = rng.sample(sorted(nouns), 2 if k % 4 == 0 else 1)
        summary = " ".join(f"The city of Xan{k} tries tools for {rng.choice(nouns[s])} and {rng.choice(nouns[s])} in May." for s in own)
        if k < 160:
            labels += [(k, "What the firm knows", summary, s) for s in own]
        else:
            rows.append((str(k), "What the firm knows", summary, "src"))
            want[str(k)] = set(own)
    got: dict = {}
    area = spark.createDataFrame([(k, s, "") for k, s in enumerate(sorted(nouns))], "subject_id int, subject string, note string")
    label = spark.createDataFrame(labels, "example_id int, title string, summary string, subject string")
    rows += [("null", None, None, None), ("page", "404 Not Found", "", None)]
    for r in subject.found(articles(spark, rows), label, area).collect():
        got.setdefault(r.id, set()).add(r.subject)
    assert "null" not in got and "page" not in got and set(got) == set(want)
    assert np.mean([got[k] == want[k] for k in want]) >= 0.9


def test_packing_whole_and_tight(spark):
    rng = random.Random(5)
    sizes = [(k, rng.choice([3, 17, 40, 90, 130, 260, 700, 1024, 5000])) for k in range(400)] + [(900, 0), (901, None)]
    packed = packing.pack_sizes(spark.createDataFrame(sizes, "doc_id bigint, tokens bigint"), [(1, 512), (2, 1024)]).collect()
    for pack, cap in ((1, 512), (2, 1024)):
        held, by_doc, pieces = {}, {}, {}
        for r in packed:
            if r.pack_id == pack:
                held[r.container_id] = held.get(r.container_id, 0) + r.tokens
                by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.tokens
                pieces[r.doc_id] = pieces.get(r.doc_id, 0) + 1
                assert r.capacity_tokens <= cap
        assert by_doc == {d: t for d, t in sizes if t} and max(held.values()) <= cap
        assert all(pieces[d] == 1 for d, t in sizes if t and t <= cap)
        assert sum(by_doc.values()) / (len(held) * cap) > 0.9
    assert packing.pack_sizes(spark.createDataFrame([], "doc_id bigint, tokens bigint"), [(1, 512)]).count() == 0


def test_packing_repeated_rows_and_shared_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 8)
    sizes = [(1, 512)] * 3 + [(2, 100)] * 20 + [(k, 64) for k in range(10, 40)] + [(3, 1300)] * 2
    packed = packing.pack_sizes(spark.createDataFrame(sizes, "doc_id bigint, tokens bigint"), [(1, 512), (1, 1024), (1, 512)]).collect()
    held = {}
    for r in packed:
        held.setdefault((r.container_id, r.capacity_tokens), []).append(r.tokens)
    assert all(sum(t) <= c for (_, c), t in held.items()) and len({c for c, _ in held}) == len(held)
    assert sum(r.tokens for r in packed) == 2 * sum(t for _, t in sizes)
    with pytest.raises(ValueError):
        packing.settings_of(spark.range(1001).selectExpr("cast(id as int) pack_id", "512 capacity_tokens"))


def test_packing_opens_the_cheapest_size():
    counts = {500: 3, 300: 40, 200: 40, 30: 5}
    joint, single = packing.fit_histogram(counts, [512, 1024, 4096]), packing.fit_histogram(counts, [4096])
    for plan in (joint, single):
        got = {}
        for n, c, contents in plan:
            assert sum(s * m for s, m in contents.items()) <= c
            for s, m in contents.items():
                got[s] = got.get(s, 0) + n * m
        assert got == counts
    assert sum(n * packing.price(c) for n, c, _ in joint) < sum(n * packing.price(c) for n, c, _ in single)
    square = packing.fit_histogram(counts, [512, 1024, 4096], lambda c: c + c * c / 1024)
    assert {c for _, c, _ in square} == {512}


def test_rounding_keeps_sums_and_expectations():
    rng = np.random.default_rng(1)
    long_, p0, total = np.array([900.0, 400.0, 90.0]), 0.3, 5000.0
    draws = [mixing.settle_long(p0, long_, total, s) for s in range(4000)]
    for p, rest in draws[:200]:
        assert abs((p * long_).sum() + rest * (total - long_.sum()) - p0 * total) < 1e-6 and set(p) <= {0.0, 1.0}
    assert np.abs(np.mean([p for p, _ in draws], 0) - p0).max() < 0.03 and abs(np.mean([r for _, r in draws]) - p0) < 0.01
    size = np.sort(rng.integers(5, 500, 60))[::-1].astype(float)
    many = np.array([mixing.pivot(np.full(60, 0.4), size, s) for s in range(3000)])
    assert np.abs(many.mean(0) - 0.4).max() < 0.04 and np.abs(many @ size - 0.4 * size.sum()).max() < 1e-6


def test_mixing(spark):
    rng = random.Random(6)
    docs = [(k, "ab"[k % 2] if k % 10 else "c", rng.randrange(20, 400)) for k in range(2000)] + [(5000, None, 10), (5001, "a", 0)]
    targets = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.3, 2), (1, "c", 0.2, 3), (2, "a", 0.6, 2), (2, "none", 0.4, 2)], "mix_id int, source string, weight double, max_repeats int")
    chosen = mixing.mix_sizes(spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint"), targets).collect()
    for r in chosen:
        if r.mix_id == 1:
            assert abs(r.actual_share - r.weight) < 0.003 and 1 <= r.n_copies <= {"a": 1, "b": 2, "c": 3}[r.source]
    small_ = mixing.mix_sizes(spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint"), targets, total_tokens=20_000).where("mix_id = 1").collect()
    assert abs(sum(r.n_copies * r.tokens for r in small_) - 20_000) < 900
    report = {(r.mix_id, r.source): r.actual_share for r in mixing.mix_report(spark.createDataFrame(chosen), targets).collect()}
    assert report[2, "none"] == 0 and report[2, "a"] == 1
    size, p = np.array([10.0] * 50), np.full(50, 0.3)
    assert abs((mixing.pivot(p, size, 1) * size).sum() - 150) < 1e-6


def test_quality(spark):
    stop = spark.createDataFrame([(w,) for w in "the of and to in for a is on with".split()], "word string")
    prose = "The firm tests a new tool for the teachers of the city.\nIn May the work is done and the city looks at it with care."
    kinds = {
        "prose": prose, "list": "Links\n" + "\n".join(f"- item {k}" for k in range(9)), "table": "a\tb\tc\n" + "\n".join(f"{k}\t{k * 2}\tx" for k in range(9)), "junk": "hfgdk " * 3 + "qwlkj fjdks owieu zmxnc lskdj qpwoe mvnbc lkjsd",
        "row": "Related: stack traces; unit tests; judges (12); code review; build logs; painters", "salad": "the of and to in for a is on with the and of to is in a for",
    }
    rows = [(k, t) for k, t in enumerate(kinds.values())] + [(98, ""), (99, None), (None, kinds["list"])]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, text_kind string")
    out = {r.doc_id: r for r in quality.text_statistics(docs, stop).collect()}
    assert [out[k].text_kind for k in range(6)] == ["prose", "list", "table", "junk", "list", "junk"]
    assert out[98].text_kind == "prose" and out[98].n_words == 0 and out[99].text_kind is None
    assert out[0].punctuated_line_share == 1 and out[0].common_word_share > 0.4
    assert {r.doc_id for r in quality.found(docs, stop).collect()} == {1, 2, 3, 4, 5}


def test_lines_are_fitted(spark):
    rng = np.random.default_rng(3)
    true = quality.first_model()
    stay = 0.97
    true.transition = np.where(np.eye(4, dtype=bool), stay, (1 - stay) / 3)
    codes = []
    for _ in range(300):
        state, out = rng.choice(4, p=true.start), []
        for _ in range(40):
            out.append(int((rng.random(len(quality.EMISSION)) < true.emission[:, state]) @ quality._BIT))
            state = rng.choice(4, p=true.transition[state])
        codes.append(np.array(out, np.uint16))
    model = begin = quality.first_model()
    for _ in range(5):
        model = quality.refit(quality.expected_counts(model, codes, np.ones(len(codes))), begin)
    assert np.abs(model.transition - true.transition).max() < np.abs(begin.transition - true.transition).max() / 2
    twice = quality.expected_counts(begin, codes[:20] * 2, np.ones(40))
    assert np.allclose(twice, quality.expected_counts(begin, codes[:20], np.full(20, 2.0)))
    assert abs(twice[len(quality.EMISSION) * 4 :][:4].sum() - 2 * 20 * 40) < 1e-6


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello <|endoftext|> world"), (2, ""), (3, None), (4, "word " * 20_000)], "doc_id int, text string")
    got = {r.doc_id: r.tokens for r in tokens.count_tokens(df, ("doc_id",)).collect()}
    encoding_ = tokens.tokenizer()
    assert encoding_.decode(encoding_.encode_ordinary("Hello <|endoftext|> world")) == "Hello <|endoftext|> world"
    assert got[1] > 3 and got[2] == 0 and got[3] is None and got[4] >= 20_000
