"""Text decoded with the wrong encoding: the chain of encodings is predicted, inverted and verified.

A multinomial classifier over hashed byte bigrams is fitted on words of the corpus that are garbled with every known chain. It scores
every word of a field that holds a byte above 7F or a question mark. The chains of a word are tried from the most probable one down to
"clean"; the first whose inverse decodes strictly is taken. Loss of characters is a label of the classifier like any other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsgrid.session import hash_sample

#: Records to fit on, about; damaged ones among them are told by a first fit and left out of the second.
FIT_ROWS = 4000
BUCKETS = 1 << 15
#: What a bigram that was never seen counts for, and bigrams that each label is scaled to.
SMOOTH, SCALE = 0.05, 20_000.0
#: Log odds against "clean" from which on a word counts as damaged: damaged words are some hundred times rarer than clean ones. Chains
#: of single bytes, whose inverse always decodes, need more: their inverse must be likelier clean than the word by as much again.
MARGIN = 5.0
#: Share of texts that are taken to be written in capitals; such words are rare in the records to fit on.
CAPITALS = 0.05
#: Words whose labels a worker remembers.
REMEMBER = 200_000

#: Chains: the text is encoded with the first encoding, read with the second, and so on in pairs.
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {
    "clean": (),
    "utf8>cp1252": (("utf-8", "cp1252"),),
    "utf8>latin1": (("utf-8", "latin-1"),),
    "utf8>cp1250": (("utf-8", "cp1250"),),
    "utf8>cp1251": (("utf-8", "cp1251"),),
    "utf8>mac": (("utf-8", "mac_roman"),),
    "utf8>cp437": (("utf-8", "cp437"),),
    "utf8>cp850": (("utf-8", "cp850"),),
    "utf8>koi8r": (("utf-8", "koi8_r"),),
    "utf8>cp866": (("utf-8", "cp866"),),
    "utf8>cp1252x2": (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    "utf8>latin1x2": (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    "koi8r>cp1251": (("koi8_r", "cp1251"),),
    "cp1252>mac": (("cp1252", "mac_roman"),),
    "cp1251>koi8r": (("cp1251", "koi8_r"),),
    "cp1251>cp1252": (("cp1251", "cp1252"),),
    "koi8r>cp1252": (("koi8_r", "cp1252"),),
    "cp866>cp1251": (("cp866", "cp1251"),),
}
#: Chains that destroy characters: they can be recognised, not inverted.
LOSSY = ("question", "replacement")
LABELS = [*CHAINS, *LOSSY]
#: Single-byte readings of single-byte texts: every byte string decodes, so that the classifier is asked about the result too.
SINGLE = {"koi8r>cp1251", "cp1251>koi8r", "cp1251>cp1252", "koi8r>cp1252", "cp866>cp1251", "cp1252>mac"}

# Common words and marks beyond ASCII of the six languages, which small frames may lack.
COMMON = (
    "für über können müssen größe straße während später jährlich möglich München Köln Jahr, Söhne Ärzte Öl Übung heißt weiß "
    "été déjà français où très après année première être même système événement garçon à élève façon dès créé réseau "
    "año más también según después información niños está aquí día último país través español "
    "não são também informação você está até mês já ação três país público através avó lições "
    "и в на что это как для города также после года которые может первый новые время люди работы всё ещё "
    "“text” ‘text’ „Text“ «texte» it’s l’année — – … → €5 20°"
)

_HIGH = re.compile(r"[^\x00-\x7f]+")
#: Letters of two scripts side by side, as no restored word has them.
_MIXED = re.compile("[A-Za-zÀ-ɏ][Ѐ-џ]|[Ѐ-џ][A-Za-zÀ-ɏ]")
_PLAIN = re.compile("[ -ɏЀ-џҐґ‐-‧ ‰-›₠-₿№™←-⇿∀-⋿☀-➿️\U0001f000-\U0001faffẞ■-◿]+$")


def _to_bytes(text: str, encoding: str) -> bytes:
    """Encode as a lenient reader must have decoded: code points 80 to 9F that the encoding lacks stand for their byte."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        out = bytearray()
        for ch in text:
            try:
                out += ch.encode(encoding)
            except UnicodeEncodeError:
                if 0x80 <= ord(ch) <= 0x9F:
                    out.append(ord(ch))
                else:
                    raise
        return bytes(out)


def _to_text(data: bytes, encoding: str) -> str:
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in data)


def garble(text: str, label: str) -> str | None:
    """The text as the chain would have left it; None where the chain can't carry it."""
    if label == "question":
        return re.sub(r"[^\x00-\x7f]", "?", text)
    if label == "replacement":
        return re.sub(r"[^\x00-\x7f]", "�", text)
    for written, read in CHAINS[label]:
        data = text.encode(written, "ignore") if label in SINGLE else text.encode(written)
        text = _to_text(data, read)
    return text


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte bigrams that hold a byte above 7F or begin with a question mark, with the number of each text."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(parts) + b" ", np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    first, second = data[:-1], data[1:]
    keep = np.flatnonzero((first > 127) | (second > 127) | (first == 63) | (second == 63) | (second > 3) & (second < 7))
    key = first[keep].astype(np.uint32) << np.uint32(8) | second[keep]
    return (key * np.uint32(2654435761) >> np.uint32(17)) & np.uint32(BUCKETS - 1), owner[keep]


def words_of(text: str) -> list[str]:
    """The words of a field that the classifier looks at, each with a blank before it and a mark behind that tells whether the text goes
    on in lower case (1), goes on otherwise (2) or ends (3). The mark takes in a question mark at the end of the word (4, 5, 6)."""
    parts = text.split(" ")
    out = []
    for k, w in enumerate(parts):
        if w and (not w.isascii() or "?" in w):
            after = next((p for p in parts[k + 1 : k + 3] if p), "")
            out.append(_marked(w, chr(3) if not after else chr(1) if after[0].islower() else chr(2)))
    return out


def _marked(word: str, mark: str) -> str:
    return f" {word[:-1]}{chr(ord(mark) + 3)}" if word[-1:] == "?" else f" {word}{mark}"


def _bare(marked: str) -> tuple[str, str]:
    """The word itself, and its mark without a question mark."""
    mark = marked[-1]
    return (f"{marked[1:-1]}?", chr(ord(mark) - 3)) if mark > chr(3) else (marked[1:-1], mark)


class Model:
    """Log probabilities (buckets x labels) of the classifier. Labels of words are remembered while a worker runs."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights
        self.known: dict[str, tuple[str, str | None]] = {}

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "known": {}}

    def scores(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each label for each word."""
        out = np.zeros((len(words), len(LABELS)), np.float32)
        key, owner = _features(words)
        if len(key):
            at = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[owner[at]] = np.add.reduceat(self.weights[key], at, axis=0)
        return out

    def label(self, words: list[str]) -> dict[str, tuple[str, str | None]]:
        """(label, restored word) of each word; `clean` with None, a chain with what it restores, or a lossy label with None."""
        if len(self.known) > REMEMBER:
            self.known.clear()
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        for w, logs in zip(fresh, self.scores(fresh)):
            self.known[w] = self._judge(w, logs)
        return self.known

    def _judge(self, word: str, logs: np.ndarray) -> tuple[str, str | None]:
        (bare, mark), clean = _bare(word), logs[0]
        for k in np.argsort(-logs, kind="stable"):
            label = LABELS[k]
            if logs[k] < clean + MARGIN:
                break
            if label == "replacement":
                if "\ufffd" in bare:
                    return label, None
            elif label == "question":
                if "?" in bare:
                    return label, None
            elif (back := invert(bare, label, mark == chr(3))) is not None:
                if label in SINGLE and (self.scores([_marked(back, mark)])[0][0] < clean + MARGIN or _MIXED.search(back) and not _MIXED.search(bare)):
                    continue
                return label, back
        return "clean", None


def fit(texts: list[str]) -> Model:
    """The classifier of clean texts and of `COMMON`, garbled word by word."""
    times = Counter(w for t in (*texts, COMMON) for w in words_of(t))
    for w, n in list(times.items()):
        times[w.upper()] += CAPITALS * n
    counts = np.zeros((BUCKETS, len(LABELS)))
    for k, label in enumerate(LABELS):
        samples, weight = [], []
        for w, n in times.items():
            bare, mark = _bare(w)
            try:
                g = garble(bare, label)
            except UnicodeError:
                continue
            if g and (label == "clean" or g != bare):
                samples.append(_marked(g, mark)), weight.append(n)
        if samples:
            key, owner = _features(samples)
            counts[:, k] += np.bincount(key, np.array(weight, float)[owner], BUCKETS)
    total = counts.sum(0)
    counts = counts * np.where(total > 0, SCALE / np.maximum(total, 1), 0) + SMOOTH
    return Model(np.log(counts / counts.sum(0)).astype(np.float32))


def _invert_run(run: str, chain: tuple[tuple[str, str], ...], last: bool) -> str | None:
    """One run of characters beyond ASCII through the inverse chain, decoded strictly; a sequence cut at the text's end is left off."""
    for written, read in reversed(chain):
        data = _to_bytes(run, read)
        try:
            run = data.decode(written)
        except UnicodeDecodeError as e:
            if not (last and written == "utf-8" and e.end == len(data) and "unexpected end" in e.reason and e.start):
                raise
            run = data[: e.start].decode(written)
    return run


def invert(text: str, label: str, ends: bool = True) -> str | None:
    """The text with every run of characters beyond ASCII inverted that decodes strictly to plain characters; None if no run did.

    With `ends` a sequence of bytes that stops in the middle at the end of the text is left off.
    """
    chain, done = CHAINS[label], 0

    def one(m: re.Match) -> str:
        nonlocal done
        run = m[0]
        if label in SINGLE and any(map(str.isspace, run)):
            return run
        try:
            back = _invert_run(run, chain, ends and m.end() == len(text))
        except UnicodeError:
            return run
        if back is None or back == run or not _PLAIN.match(back):
            return run
        done += 1
        return back

    out = _HIGH.sub(one, text)
    return out if done else None


def judge_all(model: Model, texts: list[str | None]) -> list[tuple[str, str | None]]:
    """(chain, restored text) of each field: `clean` with None, the chain of most of its damaged words with the whole field restored, or
    a lossy label with None where characters are lost. Null, empty and plain fields are clean."""
    words = [words_of(t) if t and (not t.isascii() or "?" in t) else [] for t in texts]
    known = model.label([w for each in words for w in each])
    out: list[tuple[str, str | None]] = [("clean", None)] * len(texts)
    for k, each in enumerate(words):
        labels = Counter(known[w][0] for w in each if known[w][0] != "clean")
        if not labels:
            continue
        lost = [x for x in LOSSY if x in labels]
        if lost:
            out[k] = (lost[0], None)
            continue
        damaged = {_bare(w)[0]: known[w][1] for w in each if known[w][1]}
        chain = max(labels, key=lambda x: (sum(invert(w, x) == back for w, back in damaged.items()), labels[x], x))
        rest = iter(each)
        parts = []
        for w in texts[k].split(" "):
            label, back = known[next(rest)] if w and (not w.isascii() or "?" in w) else ("clean", None)
            if label == "clean" and chain in SINGLE and not w.isascii():
                back = invert(w, chain)  # a word too short to tell goes by the chain of the others
            parts.append(w if back is None else back)
        out[k] = (chain, " ".join(parts))
    return out


def fit_on(df: DataFrame, fields: tuple[str, ...] = ("title", "summary"), rows: int = FIT_ROWS) -> Model:
    """The classifier fitted on about `rows` of the frame's own records with characters beyond ASCII or question marks, chosen by hash.

    Records that a first fit finds damaged are left out of the second.
    """
    text = F.concat_ws(" ", *[F.col(f) for f in fields])
    texts = sorted({r.t for r in hash_sample(df.select(text.alias("t")).where(F.col("t").rlike("[^\\x00-\\x7f]|[?]")), "t", rows).collect()})
    first = fit(texts)
    return fit([t for t, (chain, _) in zip(texts, judge_all(first, texts)) if chain == "clean"])


def repair_encoding(df: DataFrame, key: str = "id", fields: tuple[str, ...] = ("title", "summary"), model: Model | None = None) -> DataFrame:
    """(`key`, `field_name`, `chain`, `restored`): one row per row of `df` and field with damage.

    `restored` is null where characters were lost ("question", "replacement"). Null and empty fields give no row, repeated
    rows repeat; columns besides the key and the fields are not read.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(fit_on(df, fields) if model is None else model)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, names, chains, texts = [], [], [], []
            for j, f in enumerate(fields, 1):
                for k, (chain, back) in enumerate(judge_all(shared.value, b.column(j).to_pylist())):
                    if chain != "clean":
                        ids.append(k), names.append(f), chains.append(chain), texts.append(back)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(names, pa.string()), pa.array(chains, pa.string()), pa.array(texts, pa.string())], [key, "field_name", "chain", "restored"])

    return df.select(key, *fields).mapInArrow(run, f"`{key}` {kind.simpleString()}, field_name string, chain string, restored string")


def found(articles: DataFrame) -> DataFrame:
    """(`id`, `field_name`) of the damaged fields; an article in several rows counts once, a null id not at all."""
    rows = articles.where(F.col("id").isNotNull())
    return repair_encoding(rows).select("id", "field_name").distinct()
