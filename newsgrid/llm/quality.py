"""Text quality statistics, and lines labelled prose, list, table or junk by a hidden Markov model over line statistics.

Every line is described by yes-or-no features, packed into one number. The model is fitted to the lines of all documents by Baum-Welch:
each round is one pass over the distinct sequences of numbers, of which only sums of expected counts come back. What is known of the
states beforehand, `EMISSION`, is where the fit begins and weighs as much as `PRIOR` of the lines, which keeps each state's meaning.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsgrid.session import cut

STATES = ("prose", "list", "table", "junk")

#: Probability of each line feature in each state, in the order of `STATES`, before the fit.
EMISSION = {
    "bullet": (0.004, 0.55, 0.02, 0.02),
    "sentence_end": (0.65, 0.35, 0.02, 0.04),
    "common_words": (0.93, 0.50, 0.10, 0.04),
    "seven_words": (0.93, 0.30, 0.40, 0.55),
    "cells": (0.01, 0.02, 0.93, 0.08),
    "symbols": (0.02, 0.01, 0.04, 0.40),
    "few_letters": (0.02, 0.03, 0.55, 0.45),
    "long_token": (0.004, 0.004, 0.01, 0.35),
    "hex_tokens": (0.001, 0.002, 0.01, 0.25),
    "repeats": (0.004, 0.004, 0.03, 0.25),
    "only_common_words": (1e-5, 1e-5, 1e-5, 0.20),
    "unknown_words": (0.006, 0.006, 0.001, 0.30),
    "short_item": (0.06, 0.75, 0.05, 0.04),
    "code": (0.001, 0.001, 0.002, 0.22),
}
#: Probability that the next line has the same label before the fit; the others share the rest.
STAY = 0.9
START = (0.55, 0.2, 0.13, 0.12)
#: Rounds of the fit, and lines that the state's own probabilities stand for, as a multiple of a state's even part of all lines.
ROUNDS, PRIOR = 4, 1.0

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_BULLET = re.compile(r"\s*(?:[-*•–—·▪◦‣+]|\(?\d{1,3}[.)]|\(?[a-zа-я][.)]|\[[ xX✓]?\]|☐|☑|✓|→)\s+\S")
_END = re.compile(r"[.?!…:][\"”»’')\]]*\s*$")
_SENTENCE_END = re.compile(r"[.?!…][\"”»’')\]]*\s*$")
_INNER_STOP = re.compile(r"[^\W_][.?!][\"”»’')]*\s+[\"“„«‘'(]*[^\W\d_a-zà-öø-ÿа-я]")
_HEX = re.compile(r"(?=[0-9a-f]*\d)[0-9a-f]{5,}$")
_CODE = re.compile(r"&nbsp;|</?\w+>|\\u0|\\n|=>|null,|NaN|0x|\[\]|\{\}|;;|function\s*\(|var\s+\w+\s*=|<\?php|undefined|!important|\}\s*\}")
_CELLS = (re.compile(r"\t"), re.compile(r"\s*\|\s*"), re.compile(r"\"\s*[,;]\s*\""), re.compile(r"\S {2,}(?=\S)| {6,}"), re.compile(r"[;,]\s*(?=[^;,=]{1,30}=)"), re.compile(r";"), re.compile(r","))
_ROW = re.compile(r"\s*(?:;|·|\||•|▪)\s+")
_INLINE = re.compile(r"\s(?=(?:\d{1,2}[.)]|\(?[a-z]\)|[•▪*–])\s\S)")
_DIGITS = re.compile(r"\d+")


def units_of(text: str) -> list[tuple[str, bool]]:
    """The lines of a text that aren't blank, with whether they are items that stand in one row of it.

    A line that holds at least four short items between semicolons, dots, bars or commas, or numbered ones, counts as that many.
    """
    out: list[tuple[str, bool]] = []
    for line in text.split("\n"):
        if not line.strip():
            continue
        if "\t" not in line and not line.lstrip().startswith("|") and "=" not in line:
            parts = _INLINE.split(line)
            if len(parts) >= 4 and sum(bool(_BULLET.match(p)) for p in parts) >= 0.7 * len(parts):
                out += [(p, True) for p in parts]
                continue
            parts = _ROW.split(line)
            if len(parts) < 4 or '"' in line:
                parts = line.split(", ") if '"' not in line else [line]
            if len(parts) >= 5 and not _INNER_STOP.search(line):
                short = sum(len(p.split()) <= 5 for p in parts)
                if short >= 0.85 * len(parts):
                    out += [(p, True) for p in parts]
                    continue
        out.append((line, False))
    return out


def _cells(line: str) -> tuple[int, int]:
    """(number of cells, kind of delimiter) of a line, by the delimiter that gives most; kind 0 if there are fewer than three cells."""
    best, kind = 0, 0
    for k, pattern in enumerate(_CELLS, 1):
        if k >= 5 and best >= 3:
            break
        n = len(pattern.findall(line)) + (k not in (2,)) - (k == 2)
        if n > best:
            best, kind = n, k
    return (best, kind) if best >= 3 else (best, 0)


def line_features(units: list[tuple[str, bool]], common: frozenset[str]) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """(numbers of the lines, whose bits are the features, (words, common words, letters, symbols) of each)."""
    rows: list[tuple] = []
    sizes: list[tuple[int, int, int, int]] = []
    for line, in_row in units:
        words = _WORD.findall(line.lower())
        tokens = line.split()
        nw = len(words)
        nc = sum(map(common.__contains__, words))
        size = len(line)
        visible = sum(map(len, tokens))
        letters = sum(map(len, words))
        digits = len("".join(_DIGITS.findall(line)))
        symbols = max(0, visible - letters - digits)
        sizes.append((nw, nc, letters, symbols))
        ends = bool(_SENTENCE_END.search(line[-12:]))
        share = nc / nw if nw else 0.0
        distinct = len(set(words)) if nw >= 8 else nw
        # Cells are counted where the line doesn't read like a sentence; commas and the like make cells only of short parts.
        cells = _cells(line) if not in_row and (nw < 9 or share < 0.2) and not (ends and share > 0.1) else (0, 0)
        if cells[1] >= 6 and nw > 3 * cells[0]:
            cells = (0, 0)
        longest = max(map(len, tokens), default=0)
        hexes = sum(bool(_HEX.match(t)) for t in tokens) if digits >= 2 else 0
        only = nw >= 8 and share > 0.62 + nw**-0.5
        code = len(_CODE.findall(line)) if share < 0.1 else 0
        rows.append((
            bool(_BULLET.match(line)),
            ends,
            share >= 0.1 and nc > 0 and not only,
            nw >= 7,
            cells[1] > 0,
            symbols > 0.45 * max(1, size) and cells[1] == 0,
            letters < 0.45 * max(1, visible),
            longest > 45 and not tokens[0].startswith("http"),
            hexes >= 2 and hexes >= 0.5 * len(tokens),
            nw >= 12 and distinct <= 0.25 * min(nw, 200),
            only,
            nw >= 8 and nc <= 0.03 * nw and distinct > 0.6 * nw and not ends and line.islower() and cells[1] == 0,
            (nw <= 6 and nw > 0 and not ends and cells[1] == 0 and letters >= 0.4 * size) or in_row,
            code >= 3 or (code >= 1 and nw <= 6 and symbols > 0.2 * size),
        ))
    return (np.array(rows, np.int64).reshape(len(units), len(EMISSION)) @ _BIT).astype(np.uint16), sizes


_BIT = 1 << np.arange(len(EMISSION))
_SET = (np.arange(1 << len(EMISSION))[:, None] & _BIT > 0).astype(float)


@dataclass
class LineModel:
    """Probabilities of the features (features x states), of the next state and of the first one."""

    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray

    def likelihood(self) -> np.ndarray:
        """Probability of each number of a line in each state."""
        return np.exp(_SET @ np.log(self.emission) + (1 - _SET) @ np.log(1 - self.emission))


def first_model() -> LineModel:
    """The model before the fit."""
    n = len(STATES)
    return LineModel(np.array(list(EMISSION.values())), np.where(np.eye(n, dtype=bool), STAY, (1 - STAY) / (n - 1)), np.array(START))


def _blocks(codes: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Sequences of like length together: (their numbers, their sizes, numbers of lines padded with 0)."""
    order = sorted((k for k in range(len(codes)) if len(codes[k])), key=lambda k: len(codes[k]))
    at = 0
    while at < len(order):
        longest = len(codes[order[at]]) * 5 // 4 + 2
        group = []
        while at < len(order) and len(codes[order[at]]) <= longest and (len(group) + 1) * longest <= 200_000:
            group.append(order[at])
            at += 1
        if not group:
            group.append(order[at])
            at += 1
        sizes = np.array([len(codes[k]) for k in group])
        block = np.zeros((len(group), int(sizes.max())), np.int64)
        for r, k in enumerate(group):
            block[r, : sizes[r]] = codes[k]
        yield group, sizes, block


def expected_counts(model: LineModel, codes: list[np.ndarray], times: np.ndarray) -> np.ndarray:
    """Expected counts of features by state, lines by state, transitions and first states, one after the other, of sequences that
    occur so many `times`: the forward and backward passes of Baum-Welch for many sequences at once."""
    n, b = len(STATES), model.likelihood()
    by_code, moved, first = np.zeros((len(b), n)), np.zeros((n, n)), np.zeros(n)
    for group, sizes, block in _blocks(codes):
        top, w = block.shape[1], times[group].astype(float)
        forward, scale = np.zeros((top, len(group), n)), np.ones((top, len(group)))
        for t in range(top):
            inside = sizes > t
            a = (model.start if t == 0 else forward[t - 1] @ model.transition) * b[block[:, t]]
            s = np.where(inside, a.sum(1), 1.0)
            scale[t] = s
            forward[t] = np.where(inside[:, None], a / s[:, None], 0.0 if t == 0 else forward[t - 1])
        back = np.ones((len(group), n))
        for t in range(top - 1, -1, -1):
            if t + 1 < top:
                inside = sizes > t + 1
                ahead = b[block[:, t + 1]] * back / scale[t + 1][:, None]
                moved += np.einsum("gi,gj,g->ij", forward[t][inside], ahead[inside], w[inside]) * model.transition
                back = np.where(inside[:, None], ahead @ model.transition.T, 1.0)
            here = sizes > t
            state = forward[t] * back
            state = state / np.maximum(state.sum(1, keepdims=True), 1e-300) * w[:, None]
            for j in range(n):
                by_code[:, j] += np.bincount(block[here, t], state[here, j], len(b))
            if t == 0:
                first += state.sum(0)
    return np.concatenate([(_SET.T @ by_code).ravel(), by_code.sum(0), moved.ravel(), first])


def refit(counts: np.ndarray, begin: LineModel, prior: float = PRIOR) -> LineModel:
    """The most probable model of expected counts and of what is known beforehand."""
    n, f = len(STATES), len(EMISSION)
    told, lines, moved, first = np.split(counts, np.cumsum([n * f, n, n * n]))
    weight = prior * lines.sum() / n
    emission = np.clip((told.reshape(f, n) + weight * begin.emission) / np.maximum(lines + weight, 1e-9), 1e-7, 1 - 1e-7)
    moved = moved.reshape(n, n) + begin.transition
    first = first + begin.start
    return LineModel(emission, moved / moved.sum(1, keepdims=True), first / first.sum())


def viterbi(codes: list[np.ndarray], model: LineModel) -> list[np.ndarray]:
    """The most probable labels of each text's lines; texts of like length are decoded together."""
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(codes)
    b, a = np.log(model.likelihood()), np.log(model.transition)
    for group, sizes, block in _blocks(codes):
        top, rows = block.shape[1], np.arange(len(group))
        score = np.log(model.start) + b[block[:, 0]]
        back = np.zeros((top, len(group), len(STATES)), np.int8)
        final = score.copy()
        for t in range(1, top):
            step = score[:, :, None] + a
            back[t] = step.argmax(1)
            score = step.max(1) + b[block[:, t]]
            alive = sizes > t
            final[alive] = score[alive]
        state = final.argmax(1)
        path = np.zeros((len(group), top), np.int8)
        for t in range(top - 1, -1, -1):
            inside = sizes > t
            path[inside, t] = state[inside]
            state = np.where(inside & (t > 0), back[t, rows, state], state)
        for r, k in enumerate(group):
            out[k] = path[r, : sizes[r]]
    return out


#: Columns of the statistics.
STATISTICS = (
    "n_words bigint, mean_word_length double, symbol_share double, punctuated_line_share double, common_word_share double, "
    "n_lines bigint, prose_share double, list_share double, table_share double, junk_share double, text_kind string"
)


_COUNTS = STATISTICS.split(", prose_share")[0]


def describe(text: str | None, common: frozenset[str]) -> tuple:
    """The statistics of a text up to `n_lines`, the numbers of its lines and their sizes in characters; nulls for a null text."""
    if text is None:
        return (None,) * 8
    units = units_of(text)
    codes, sizes = line_features(units, common)
    n_words, n_common, letters, symbols = map(sum, zip(*sizes)) if sizes else (0, 0, 0, 0)
    visible = len("".join(text.split()))
    lines = [line for line in text.split("\n") if line.strip()]
    weight = np.array([len(line.strip()) for line, _ in units], np.uint32)
    return (
        n_words, letters / n_words if n_words else None, symbols / visible if visible else None, sum(bool(_END.search(x[-12:])) for x in lines) / len(lines) if lines else None,
        n_common / n_words if n_words else None, len(lines), codes.tobytes(), weight.tobytes(),
    )


def kind_of(path: np.ndarray, weight: np.ndarray) -> tuple:
    """(shares of the labels by characters, kind) of a text: prose if that has half or if there is no line, else the largest other share."""
    shares = np.bincount(path, weight, len(STATES)) / max(1.0, float(weight.sum())) if len(path) else np.zeros(len(STATES))
    kind = STATES[0] if shares[0] >= 0.5 or not len(path) else STATES[1 + int(shares[1:].argmax())]
    return (*map(float, shares), kind)


def fit_lines(described: DataFrame, rounds: int = ROUNDS, prior: float = PRIOR) -> LineModel:
    """The model fitted to all documents (`codes`) in so many rounds; equal sequences are counted first and looked at once."""
    spark = described.sparkSession
    sequences = cut(described.where(F.length("codes") > 0).groupBy("codes").agg(F.count("*").alias("n")), "sequences")
    begin = model = first_model()
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                got = expected_counts(shared.value, [np.frombuffer(c, np.uint16) for c in b.column(0).to_pylist()], b.column(1).to_numpy())
                total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

        rows = sequences.select("codes", "n").mapInArrow(run, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # one row a parameter
        if not rows:
            break
        model = refit(np.array([r.v for r in sorted(rows)]), begin, prior)
    return model


def text_statistics(documents: DataFrame, stop_words: DataFrame, key: str = "doc_id", text: str = "text", model: LineModel | None = None) -> DataFrame:
    """(`key`, statistics): one row per row of `documents`; the line model is fitted to them unless one is given.

    `stop_words` gives `word`; the list goes to the executors whole (a dimension, at most 100,000 rows, else an error). Empty texts
    have no words, null ratios and count as prose; null texts have null in every column but the key. Whole texts are read.
    """
    spark = documents.sparkSession
    words = [r.word for r in stop_words.select(F.lower("word").alias("word")).where("word is not null").distinct().limit(100_001).collect()]
    if len(words) > 100_000:
        raise ValueError("stop_words holds more than 100,000 words")
    common = spark.sparkContext.broadcast(frozenset(words))
    kind = documents.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in _COUNTS.split(", ")]
    types = [pa.int64(), *[pa.float64()] * 4, pa.int64(), pa.binary(), pa.binary()]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [describe(t, common.value) for t in b.column(1).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], [key, *names, "codes", "weights"])

    described = cut(documents.select(key, text).mapInArrow(look, f"`{key}` {kind}, {_COUNTS}, codes binary, weights binary"), "lines")
    shared = spark.sparkContext.broadcast(fit_lines(described) if model is None else model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, weights = b.column(len(names) + 1).to_pylist(), b.column(len(names) + 2).to_pylist()
            paths = viterbi([np.frombuffer(c or b"", np.uint16) for c in codes], shared.value)
            rows = [kind_of(p, np.frombuffer(w, np.uint32)) if w is not None else (None,) * 5 for p, w in zip(paths, weights)]
            if rows:
                shares = [pa.array(c, t) for c, t in zip(zip(*rows), [*[pa.float64()] * 4, pa.string()])]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names) + 1], *shares], [key, *[c.split()[0] for c in STATISTICS.split(", ")]])

    return described.mapInArrow(label, f"`{key}` {kind}, {STATISTICS}")


def found(documents: DataFrame, stop_words: DataFrame) -> DataFrame:
    """(`doc_id`, `text_kind`) of the documents that are for the most part not prose; null ids are left out."""
    return text_statistics(documents.where(F.col("doc_id").isNotNull()), stop_words).where(F.col("text_kind") != "prose").select("doc_id", "text_kind")
