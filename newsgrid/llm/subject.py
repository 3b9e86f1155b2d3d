"""Subject areas of documents: classifier chains over term, source and structure features, decoded with a beam.

All records are cleaned and split into terms once and written; how common each word is in its language is counted over all of them.
The chain is fitted on labelled examples, then again with a bounded sample of records that it labelled itself with confidence: these
bring terms the examples lack, and the sources, which examples don't name. Calibration and cut-off come from examples that were held
out of the fit, in turn. A record gets every subject whose probability, summed over the label combinations of the beam, passes the cut-off.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsgrid.llm import encoding, residue
from newsgrid.session import cut, hash_sample, small

#: Labelled examples to fit on, at most, and records that join them under labels of the chain's own, about.
FIT_ROWS, SELF_ROWS = 20_000, 4000
BEAM = 6
#: Penalty and steps of the first fit, and steps of those that go on from an earlier one.
RIDGE, STEPS, MORE_STEPS = 0.02, 150, 30
#: Penalties of earlier subjects, and of sources and structure, as multiples of that of terms; chosen on held-out examples (README).
LINK, OUTER = 2000.0, 400.0
#: Weight of a record that has the subject against one that has not.
POSITIVE = 2.0
#: A word in a larger share of its language's records belongs to the way things are told, not to what is told.
TOO_COMMON = 0.09
#: Records of the fit that a term must be in, and the share of labelled examples with it that its subject must have.
LEAST_RECORDS, PURITY = 3, 0.6
#: Rounds in which records are labelled anew, and the probability of their labels from which on they take part.
ROUNDS, SURE = 3, 0.6
#: Parts of the examples that are held out in turn, and the cut-offs that are tried on them.
FOLDS = 3
CUT_OFFS = tuple(round(0.5 * 0.93**k, 4) for k in range(45))

# Words that tell the languages apart.
_LANGUAGE = {
    "de": "der die das und für über mit von aus bei im den zum wie was".split(),
    "fr": "le la les des une est dans pour avec sur du selon depuis à".split(),
    "es": "el los las del una con para por según desde y más".split(),
    "pt": "o os as da do na no uma com para por segundo desde e não à".split(),
    "ru": "и в на с по что город за из о как через".split(),
    "en": "the of and to in with for on by that from are is at".split(),
}

_TELLING = {lang: frozenset(words) for lang, words in _LANGUAGE.items()}
_TOKEN = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*|[.,;:!?()\"“”„«»…|]")
#: Words that tell German, which writes all nouns with a capital.
_NOUNS_WITH_CAPITALS = re.compile(r"\b(?:der|die|und|über|für|im|am|bei|von|nach|wie|mit|den|was|an|als|testet|bringt)\b")
_CLASS_BREAK = frozenset(".,;:!?()\"“”„«»…|")


def terms_of(text: str) -> list[str]:
    """Words in lower case; a word with a capital that follows another one is part of a name and left out. Marks stay as "."."""
    if text.isupper():
        text = text.lower()
    nouns = bool(_NOUNS_WITH_CAPITALS.search(text))
    out: list[str] = []
    run = True
    previous_capital = False
    for t in _TOKEN.findall(text):
        if t in _CLASS_BREAK:
            out.append(".")
            run, previous_capital = True, False
            continue
        capital = t[0].isupper()
        if capital and not run and (previous_capital or not nouns):
            out.append("~")
        else:
            out.append(t.lower())
        run = False
        previous_capital = capital
    return out


def grams_of(terms: list[str]) -> set[str]:
    """Sequences of one to three words that no mark or name interrupts."""
    out: set[str] = set()
    two = one = ""
    for t in terms:
        if t == "." or t == "~":
            two = one = ""
            continue
        out.add(t)
        if one:
            out.add(f"{one} {t}")
            if two:
                out.add(f"{two} {one} {t}")
        two, one = one, t
    return out


def structure_of(title: str, summary: str, source: str | None) -> list[str]:
    """Source and structure features, with a blank before so that they can't be words; a null source has none."""
    text = f"{title} {summary}"
    script = "cyrl" if re.search("[а-я]", text) else "latn"
    own = [f" script={script}", f" title={min(9, len(title) // 15)}", f" size={min(9, len(summary) // 80)}", f" marks={':' in title}{'?' in title}"]
    return [f" source={source}", *own] if source else own


@dataclass
class Chain:
    """A fitted chain: term weights (terms x subjects), weights of source and structure features, biases, weights of earlier subjects,
    the calibration of each link and the cut-off."""

    subjects: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray
    outer: dict[str, int]
    outer_weights: np.ndarray
    bias: np.ndarray
    links: np.ndarray
    slope: np.ndarray
    shift: np.ndarray
    cut_off: float


def _sparse(docs: list[set[str]], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    rows, cols = [], []
    for k, d in enumerate(docs):
        found = [vocabulary[g] for g in d if g in vocabulary]
        rows += [k] * len(found)
        cols += found
    return np.array(rows, np.int64), np.array(cols, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit_link(rows, cols, extra, penalty, y, weight, size, start=None):
    """(term weights, weights of `extra`, bias) of one link: accelerated projected gradient descent on the logistic loss.

    A term speaks for a subject or not at all: no other subject's terms speak against it, as a record is about all that its statements
    are about. `extra` (earlier subjects, then centred source and structure features) may speak for and against.
    """
    n, k = len(y), size + extra.shape[1]
    steps = STEPS if start is None else MORE_STEPS
    x = np.zeros(k + 1) if start is None else start.astype(float)
    if start is None:
        x[-1] = float(np.log((y @ weight + 1) / ((1 - y) @ weight + 1)))
    look = x.copy()
    common = np.r_[np.full(size, RIDGE), penalty, 0.0]
    balance = weight * np.where(y > 0, POSITIVE, 1.0)
    # Each coordinate's step is bounded by the features of the documents it stands in, which makes the descent safe at any size.
    across = (np.bincount(rows, minlength=n) + np.abs(extra).sum(1) + 1) * balance * 0.25
    bound = np.concatenate([np.bincount(cols, across[rows], size), np.abs(extra).T @ across, [across.sum()]]) + common + 1e-6
    for t in range(1, steps + 1):
        p = _sigmoid(np.bincount(rows, look[cols], n) + extra @ look[size:k] + look[k])
        r = (p - y) * balance
        step = look - (np.concatenate([np.bincount(cols, r[rows], size), extra.T @ r, [r.sum()]]) + common * look) / bound
        step[:size] = np.maximum(step[:size], 0)
        look = step + (t - 1) / (t + 2) * (step - x)
        x = step
    return x[:size], x[size:k], float(x[k])


def _calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make scores of held-out examples probabilities."""
    a, c = 1.0, 0.0
    for _ in range(400):
        p = _sigmoid(a * score + c)
        r = p - y
        a -= 0.5 * ((r * score).mean() + 0.02 * (a - 1))
        c -= 0.5 * (r.mean() + 0.02 * c)
    return float(np.clip(a, 0.5, 2.0)), float(np.clip(c, -3, 3))


def fit_chain(docs: list[set[str]], labels: np.ndarray, weight: np.ndarray, subjects: list[str], least: int = 1, start: Chain | None = None) -> Chain:
    """A chain, not yet calibrated, on documents given as sets of features; with `start` it goes on from that chain's weights."""
    counts = Counter(g for d in docs for g in d)
    vocabulary = {g: k for k, g in enumerate(sorted(g for g, c in counts.items() if c >= least and g[0] != " "))}
    outer = {g: k for k, g in enumerate(sorted(g for g in counts if g[0] == " "))}
    rows, cols = _sparse(docs, vocabulary)
    n, m, size = len(docs), len(subjects), len(vocabulary)
    told = np.zeros((n, len(outer)))
    told[_sparse(docs, outer)] = 1
    mean = told.mean(0) if n else np.zeros(len(outer))
    out = Chain(subjects, vocabulary, np.zeros((size, m), np.float32), outer, np.zeros((len(outer), m)), np.zeros(m), np.zeros((m, m)), np.ones(m), np.zeros(m), 0.5)
    for k in range(m):
        extra = np.concatenate([labels[:, :k].astype(float), told - mean], 1)
        penalty = np.r_[np.full(k, LINK * RIDGE), np.full(len(outer), OUTER * RIDGE)]
        begin = None
        if start is not None:
            terms = np.array([start.weights[start.vocabulary[g], k] if g in start.vocabulary else 0.0 for g in vocabulary])
            outside = np.array([start.outer_weights[start.outer[g], k] if g in start.outer else 0.0 for g in outer])
            begin = np.r_[terms, start.links[k, :k], outside, start.bias[k] + mean @ outside]
        w, v, b = _fit_link(rows, cols, extra, penalty, labels[:, k].astype(float), weight, size, begin)
        out.weights[:, k], out.links[k, :k], out.outer_weights[:, k], out.bias[k] = w, v[:k], v[k:], b - mean @ v[k:]
    return out


def base_scores(chain: Chain, docs: list[set[str]]) -> np.ndarray:
    """Scores (documents x subjects) of terms, source and structure, without earlier subjects."""
    n, m = len(docs), len(chain.subjects)
    out = np.tile(chain.bias, (n, 1))
    for vocabulary, weights in ((chain.vocabulary, chain.weights), (chain.outer, chain.outer_weights)):
        rows, cols = _sparse(docs, vocabulary)
        if len(rows):
            out += np.stack([np.bincount(rows, weights[cols, k], n) for k in range(m)], 1)
    return out


def decode(chain: Chain, docs: list[set[str]], beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(labels, probabilities) of documents x subjects.

    A beam search along the chain keeps the most probable combinations of subjects, at least one of them not empty; the probability of
    a subject is that of the non-empty combinations with it. Subjects that pass the cut-off are labels, and the most probable one is.
    """
    n, m = len(docs), len(chain.subjects)
    if not n:
        return np.zeros((0, m), bool), np.zeros((0, m))
    base = base_scores(chain, docs)
    paths = np.zeros((n, 1, m), np.int8)
    log = np.zeros((n, 1))
    for k in range(m):
        score = base[:, k, None] + paths[:, :, :k] @ chain.links[k, :k]
        p = np.clip(_sigmoid(chain.slope[k] * score + chain.shift[k]), 1e-9, 1 - 1e-9)
        both = np.concatenate([log + np.log1p(-p), log + np.log(p)], 1)
        grown = np.concatenate([paths, paths], 1)
        grown[:, paths.shape[1] :, k] = 1
        keep = np.argsort(-both, 1, kind="stable")[:, : beam + 1]
        log = np.take_along_axis(both, keep, 1)
        paths = np.take_along_axis(grown, keep[:, :, None], 1)
    share = np.where(paths.any(2), np.exp(log - log.max(1, keepdims=True)), 0.0)
    total = share.sum(1, keepdims=True)
    probability = np.where(total > 0, np.einsum("nb,nbm->nm", share, paths) / np.maximum(total, 1e-300), 0.0)
    labels = probability >= chain.cut_off
    top = np.where(total[:, 0] > 0, probability.argmax(1), base.argmax(1))
    labels[np.arange(n), top] = True
    return labels, probability


def clean_fields(titles: list[str | None], summaries: list[str | None], machine, wrong: encoding.Model | None) -> list[tuple[str, str]]:
    """Titles and summaries with wrong encodings undone and residue taken out; null counts as empty."""
    fields = [[t or "" for t in titles], [t or "" for t in summaries]]
    if wrong is not None:
        fields = [[back or t for t, (_, back) in zip(f, encoding.judge_all(wrong, f))] for f in fields]
    return [(_without_residue(t, machine), _without_residue(s, machine)) for t, s in zip(*fields)]


def _without_residue(text: str, machine) -> str:
    found = residue.kind_of(machine, text)
    if found == "slot":
        text = residue.SLOTS.sub(" ", text)
        found = residue.kind_of(machine, text)
    if found:
        text = " ".join(p for p in re.split(r"(?<=[.?!…])\s+|\s\|\s", text) if residue.kind_of(machine, p) is None)
    return text.strip()


def line_of(title: str, summary: str) -> str:
    """All terms of a record as one line of text."""
    return " ".join([*terms_of(title), ".", *terms_of(summary)])


def features_of(line: str, outer: Iterable[str]) -> set[str]:
    """All features of a record from its line of terms and its source and structure features."""
    return grams_of(line.split(" ")) | set(outer)


def language_of(words: set[str]) -> str:
    """The language whose telling words a set of words holds most of."""
    return max(_TELLING, key=lambda x: (len(words & _TELLING[x]) / len(_TELLING[x]), x == "en"))


def topical(docs: list[set[str]], labels: np.ndarray, others: list[set[str]], common: set[str]) -> set[str]:
    """Terms that may tell a subject: none of their words is in `common`, unless the examples tie it to one subject, they recur, and
    where examples have them they are pure."""
    total = Counter(g for d in (*docs, *others) for g in d)
    seen: Counter = Counter()
    own: dict[str, np.ndarray] = {}
    for d, y in zip(docs, labels):
        for g in d:
            if g[0] != " ":
                seen[g] += 1
                own[g] = own.get(g, 0) + y
    told = {w for w, k in seen.items() if k >= 4 and own[w].max() >= 0.8 * k}
    barred = common - told
    ok = {g for g, k in total.items() if k >= (LEAST_RECORDS if others else 1) and (g[0] == " " or barred.isdisjoint(g.split(" ")))}
    return {g for g in ok if g[0] == " " or seen[g] < 2 or own[g].max() >= PURITY * seen[g]}


def _fit_once(docs: list[set[str]], labels: np.ndarray, more: list[set[str]], subjects: list[str], common: set[str]) -> Chain:
    """Fit on examples, label the other records, and fit on both, `ROUNDS` times."""
    keep = topical(docs, labels, more, common)
    docs, more = [d & keep for d in docs], [d & keep for d in more]
    chain = fit_chain(docs, labels, np.ones(len(docs)), subjects)
    for _ in range(ROUNDS if more else 0):
        guessed, p = decode(chain, more)
        sure = np.where(guessed, p, 1 - p).prod(1)
        take = sure >= SURE
        chain = fit_chain(docs + [d for d, ok in zip(more, take) if ok], np.concatenate([labels, guessed[take]]), np.r_[np.full(len(docs), 1.5), sure[take]], subjects, start=chain)
    return chain


def fit(examples: list[set[str]], labels: np.ndarray, more: list[set[str]], subjects: list[str], common: set[str] = frozenset()) -> Chain:
    """The chain of examples and self-labelled records, both as sets of features.

    Every one of `FOLDS` parts of the examples is scored by a chain that was fitted without it; calibration and the cut-off come from
    these scores alone. The cut-off is the one that gives as many labels as the examples have, so that shares of subjects come out right.
    """
    chain = _fit_once(examples, labels, more, subjects, common)
    n, m = labels.shape
    if n < 10 * FOLDS:
        return chain
    parts = [(np.flatnonzero(np.arange(n) % FOLDS == f), _fit_once([examples[k] for k in range(n) if k % FOLDS != f], labels[np.arange(n) % FOLDS != f], more, subjects, common)) for f in range(FOLDS)]
    score = np.zeros((n, m))
    for rows, own in parts:
        score[rows] = base_scores(own, [examples[k] for k in rows]) + labels[rows] @ own.links.T
    for k in range(m):
        chain.slope[k], chain.shift[k] = _calibrate(score[:, k], labels[:, k].astype(float))
    p, best = np.zeros((n, m)), np.zeros((n, m), bool)
    for rows, own in parts:
        own.slope, own.shift = chain.slope, chain.shift
        _, p[rows] = decode(own, [examples[k] for k in rows])
    best[np.arange(n), p.argmax(1)] = True
    chain.cut_off = min((abs(int(((p >= c) | best).sum()) - int(labels.sum())), c) for c in CUT_OFFS)[1]
    return chain


_PREPARED = "source_name string, lang string, line string, outer string"


def prepare(articles: DataFrame, wrong: encoding.Model | None, key: str = "id") -> DataFrame:
    """(`key`, `source_name`, `lang`, `line`, `outer`) of the rows with any real text: language, terms, and source and structure features."""
    spark = articles.sparkSession
    shared = spark.sparkContext.broadcast(wrong)
    kind = articles.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = residue.automaton()
        for b in batches:
            at, lang, lines, outer = [], [], [], []
            titles, summaries, sources = (b.column(c).to_pylist() for c in (1, 2, 3))
            for k, ((t, s), source) in enumerate(zip(clean_fields(titles, summaries, machine, shared.value), sources)):
                if any(map(str.isalpha, t)) or any(map(str.isalpha, s)):
                    line = line_of(t, s)
                    at.append(k), lang.append(language_of(set(line.split(" ")))), lines.append(line), outer.append("\t".join(structure_of(t, s, source)))
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(3).take(rows), pa.array(lang, pa.string()), pa.array(lines, pa.string()), pa.array(outer, pa.string())], [key, "source_name", "lang", "line", "outer"])

    return articles.select(key, "title", "summary", "source_name").mapInArrow(run, f"`{key}` {kind}, {_PREPARED}")


def common_words(prepared: DataFrame, share: float = TOO_COMMON) -> set[str]:
    """Words that more than `share` of the records of a language have, counted over all records.

    A language can't have more such words than its records have words on average, divided by `share`.
    """
    sizes = prepared.groupBy("lang").agg(F.count("*").alias("size"))
    words = prepared.select("lang", F.explode(F.array_distinct(F.split("line", " "))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return {r.word for r in words.join(small(sizes), "lang").where(F.col("n") > F.greatest(F.lit(2.0), share * F.col("size"))).select("word").distinct().collect()}


def model_of(prepared: DataFrame, subject_label: DataFrame, subject_area: DataFrame, key: str = "id", fit_rows: int = FIT_ROWS, self_rows: int = SELF_ROWS) -> Chain:
    """The chain, from at most `fit_rows` label rows and about `self_rows` of the prepared records, those with the least hashes of their keys."""
    subjects = sorted({r.subject for r in subject_area.where("subject is not null").select("subject").distinct().limit(fit_rows).collect()})
    at = {s: k for k, s in enumerate(subjects)}
    grouped: dict = {}
    for r in subject_label.where("subject is not null").orderBy("example_id", "subject").limit(fit_rows).collect():
        grouped.setdefault(r.example_id, (r.title or "", r.summary or "", set()))[2].add(r.subject)
    labels = np.zeros((len(grouped), len(subjects)), bool)
    examples = []
    for k, (title, summary, own) in enumerate(grouped.values()):
        examples.append(features_of(line_of(title, summary), structure_of(title, summary, None)))
        labels[k, [at[s] for s in own if s in at]] = True
    picked = hash_sample(prepared, key, self_rows).dropDuplicates([key]).select("line", "outer").collect()
    more = sorted((r.line, r.outer) for r in picked)
    return fit(examples, labels, [features_of(line, outer.split("\t")) for line, outer in more], subjects, common_words(prepared))


def assign_subjects(articles: DataFrame, subject_label: DataFrame, subject_area: DataFrame, key: str = "id", wrong: encoding.Model | None = None) -> DataFrame:
    """(`key`, `subject`, `probability`): one row per row of `articles` and subject that it is about.

    A record with any real text gets one subject or more; one that is null, empty or only residue gets none. Whole texts are read.
    `wrong`: the encoding classifier, fitted on `articles` where none are given.
    """
    spark = articles.sparkSession
    kind = articles.schema[key].dataType.simpleString()
    prepared = cut(prepare(articles, encoding.fit_on(articles) if wrong is None else wrong, key), "terms")
    shared = spark.sparkContext.broadcast(model_of(prepared, subject_label, subject_area, key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for b in batches:
            docs = [features_of(line, outer.split("\t")) for line, outer in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            labels, p = decode(chain, docs)
            doc, subject = np.nonzero(labels)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int64())), pa.array([chain.subjects[j] for j in subject], pa.string()), pa.array(p[doc, subject], pa.float64())], [key, "subject", "probability"])

    return prepared.select(key, "line", "outer").mapInArrow(run, f"`{key}` {kind}, subject string, probability double")


def subject_shares(assigned: DataFrame, key: str = "id") -> DataFrame:
    """(`subject`, `n`, `share`): records of each subject and their share of all records with one."""
    each = assigned.select(key, "subject").distinct()
    total = each.select(key).distinct().agg(F.count("*").alias("_total"))
    return each.groupBy("subject").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("subject", "n", (F.col("n") / F.col("_total")).alias("share"))


def found(articles: DataFrame, subject_label: DataFrame, subject_area: DataFrame) -> DataFrame:
    """(`id`, `subject`) of all articles; an article in several rows counts once, a null id not at all."""
    return assign_subjects(articles.where(F.col("id").isNotNull()), subject_label, subject_area).select("id", "subject").distinct()
