"""Text cut off by a field limit or a broken transfer.

All distinct values are sorted over the whole cluster, so that those that go on after a value stand right behind it, and each part of
the sorted values is walked once. The same question is put below the level of records: the end of each value is looked up among all word
sequences of the corpus, which tell whether such a sequence ends sentences or is the beginning of longer ones. Limits of fields are
lengths at which the doubtful ends of a source pile up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgrid.llm import residue
from newsgrid.session import cut, small, task_slices

#: Share of a sequence's occurrences that end sentences from which on a text may end with it. Complete texts without a stop are
#: about three times as many as cut ones and sentence ends 15 times as rare as other places between words: 1 / 45.
END_SHARE = 0.022
#: The same for the last three letters of a name against those letters inside names.
NAME_SHARE = 0.1
#: Occurrences from which on the letters of a name decide.
ENOUGH = 4
#: Weight, in occurrences, of what two words tell when three are looked up.
SMOOTH = 12
#: Share of the places one or two words further on that end sentences, from which on the place of the last words may end one.
AROUND = 0.2
#: Code points at the end of a text in which marks and remarks are looked for, and the rest of the word before them.
TAIL = 100
#: A length is a limit of a source's field, or of all, if at least so many more doubtful ends are there than at the lengths around it,
#: beyond what chance gives, and so many times as many.
PILE, PILE_TIMES, AROUND_LIMIT = 5, 4, 15
#: What a longer copy must go on with after a value: a word, with or without a mark and a blank before it.
_GOES_ON = re.compile(r"[,;:]? ?[^\W_]")

# What feeds put after a complete text, in six languages.
REMARKS = (
    r"read (?:more|on|the full (?:story|article))|continue reading|keep reading|more here|full story|mehr dazu|weiterlesen|mehr lesen|hier weiterlesen|lire la suite|en savoir plus|"
    r"leer más|seguir leyendo|sigue leyendo|más información|leia mais|ler mais|saiba mais|continue lendo|continuar lendo|читать далее|читать дальше|подробнее|далее"
)
_REMARK = re.compile(rf"\s*(?:\(?\b(?:{REMARKS})\b\)?\s*(?:→|»|›|>+|ÔÜÆ|\?|…|\.{{1,3}}|!)?|https?://\S+|www\.\S+|\(via [^()]*\)|[→»›✕⚠🙂😀☺️]+|(?<!&)#\w+)\s*$", re.I)
_REMARK_STOP = re.compile(rf"\b(?:{REMARKS})\)?\s*[.?!]{{1,3}}$", re.I)
#: Marks that stand only where text was taken away.
_MARK = re.compile(r"\s*(?:\[(?:…|\.\.\.)\]|\((?:…|\.\.\.)\)|\[\+\d+ chars?\]|\[(?:\d+ )?more\]|\((?:\d+ )?more\)|\[\d+ mots?\])\s*$", re.I)
#: A tag or a character entity that stops in the middle.
_BROKEN = re.compile(r"(?:<[a-z!/][^<>]{0,60}|&(?:#x?[0-9a-f]{0,6}|[a-z]{1,7}))$", re.I)
_DOTS = re.compile(r"\s*(?:…|\.\.\.+)\s*$")
_FINAL = re.compile(r"[.?!。](?:[\"”»’')\]]|&quot;)*$")
_ABBREVIATION = re.compile(r"(?:^|[\s(“\"])(?:dr|mr|mrs|ms|prof|no|nr|mio|mrd|inc|st|vs|z\.b|d\.h|г|т\.е|sr|sra|mme|m)\.$", re.I)
_WRONG_DOTS = re.compile("Ã¢â‚¬Â¦|â€¦|‚Ä¶|ÔÇª|ΓÇª|â\x80¦")
_WRONG_ARROW = re.compile("Ã¢â€\xa0â€™|Ã¢â€ â€™|â†’|‚Üí|ÔåÆ|ΓåÆ|â\x86\x92|â†")
_CAPITAL = re.compile(r"[^\W\d_a-zà-öø-ÿœßšžřșăłńа-яё]")
_EDGE = "\"“”„«»‘’'()[]{}<>*_"
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LEVELS = {"1": 11, "2": 23, "3": 37, "g": 53, "h": 71, "s": 97, "d": 113}


def _of_text(level: str, text: str) -> int:
    return xxhash.xxh64_intdigest(text, _LEVELS[level])


@lru_cache(maxsize=300_000)
def _word(token: str) -> tuple[int, bool, bool, bool, str]:
    """(mask, ends a sentence, stops a run of names, begins in lower case, name) of a token; mask 0 stands for no word.

    The mask is the same for all words with a capital, and for all with a digit.
    """
    bare = token.strip(_EDGE + ",;:.?!…–—-")
    if not bare:
        return 0, False, False, False, ""
    final = bool(_FINAL.search(token)) and not _ABBREVIATION.search(token)
    low = bare[0].islower()
    if any(c.isdigit() for c in bare):
        return 9, final, True, low, ""
    if _CAPITAL.match(bare):
        return 7, final, token[-1] in ",;:–—", False, bare.lower()
    return xxhash.xxh64_intdigest(bare) | 16, final, True, low, ""


def _encode(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple], np.ndarray]:
    """Masks, ends, sentence numbers of all kept words (mask 1 stands between texts), the distinct tokens and their counts."""
    codes: dict[str, int] = {}
    flat = [codes.setdefault(t, len(codes)) for words in texts for t in (*words, "\n")]
    known = [_word(t) if t != "\n" else (1, False, True, False, "") for t in codes]
    if not flat:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64), [], np.zeros(0, np.int64)
    idx = np.array(flat, np.int64)
    mask = np.array([k[0] for k in known], np.uint64)[idx]
    final = np.array([k[1] for k in known], bool)[idx]
    stops = np.array([k[2] for k in known], bool)[idx]
    lower = np.array([k[3] for k in known], bool)[idx]
    kept = np.flatnonzero(mask != 0)
    mask, final, stops, lower = mask[kept], final[kept], stops[kept], lower[kept]
    ends = final & ~np.r_[lower[1:], False]
    merged = np.r_[(mask[:-1] == 7) & (mask[1:] == 7) & ~stops[:-1] & ~ends[:-1], False]
    mask, ends = mask[~merged], ends[~merged]
    border = ends | (mask == 1)
    sentence = np.cumsum(np.r_[0, border[:-1]]) if len(border) else np.zeros(0, np.int64)
    return mask, ends, sentence, known, np.bincount(idx, minlength=len(known))


def _mix(level: str, *parts: np.ndarray) -> np.ndarray:
    key = np.full(parts[0].shape, _LEVELS[level], np.uint64)
    for p in parts:
        key = (key * _P1 ^ p) * _P2
        key ^= key >> np.uint64(29)
    return key


def sequence_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, times at the end of a sentence, other times): sequences of one to three masked words, the places one and two words
    after pairs of words, and the letters of names.

    The last word of a text counts only if a sentence ends with it; ends in dots count under keys of their own.
    """
    split = [t.split() for t in texts if t]
    mask, ends, sentence, known, times = _encode(split)
    keys, is_end = [], []
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        last = np.r_[mask[1:] == 1, True] & ~ends
        usable = (mask != 1) & ~last
        for level, back in (("1", (0,)), ("2", (1, 0)), ("3", (2, 1, 0)), ("g", (2, 1)), ("h", (3, 2))):
            n = max(back)
            if len(mask) <= n:
                continue
            ok = usable[n:] & (sentence[n:] == sentence[: len(sentence) - n])
            parts = [mask[n - k : len(mask) - k][ok] for k in back]
            keys.append(_mix(level, *parts)), is_end.append(ends[n:][ok])
    extra: Counter = Counter()
    for (_, _, _, _, name), k in zip(known, times.tolist()):
        if len(name) > 2:
            extra[_of_text("s", name[-3:]), True] += k
            for j in range(len(name) - 3):
                extra[_of_text("s", name[j : j + 3]), False] += k
    for words in split:
        if words and words[-1].endswith(("…", "...")):
            extra[_of_text("d", " ".join(w.strip(".…").lower() for w in words[-3:])), True] += 1
    key = np.concatenate([*keys, np.array([k for k, _ in extra], np.uint64)])
    end = np.concatenate([*is_end, np.array([e for _, e in extra], bool)])
    weight = np.concatenate([np.ones(sum(map(len, keys)), np.int64), np.array(list(extra.values()), np.int64)])
    distinct, where = np.unique(key, return_inverse=True)
    n_end = np.bincount(where[end], weight[end], minlength=len(distinct)).astype(np.int64)
    n_mid = np.bincount(where[~end], weight[~end], minlength=len(distinct)).astype(np.int64)
    return distinct.view(np.int64), n_end, n_mid


def tail_keys(cores: list[str], dots: list[bool]) -> list[list[tuple[str, int]]]:
    """(level, key) under which the corpus counts the end of each text, as `sequence_counts` forms them."""
    split = [c.rsplit(None, 6)[-6:] for c in cores]
    mask, ends, sentence, _, _ = _encode(split)
    stops = np.flatnonzero(mask == 1)
    out = []
    with np.errstate(over="ignore"):
        for words, stop, dotted in zip(split, stops.tolist(), dots):
            run = [mask[k] for k in range(max(0, stop - 4), stop) if mask[k] != 1 and (sentence[k] == sentence[stop - 1])]
            keys = []
            for level, back in (("1", (0,)), ("2", (1, 0)), ("3", (2, 1, 0)), ("g", (2, 1)), ("h", (3, 2))):
                if len(run) > max(back):
                    k = _mix(level, *[np.array([run[-1 - b]], np.uint64) for b in back])
                    keys.append((level, int(k.view(np.int64)[0])))
            name = _word(words[-1])[4] if words else ""
            if len(name) > 2:
                keys.append(("s", _signed(_of_text("s", name[-3:]))))
            if dotted:
                keys.append(("d", _signed(_of_text("d", " ".join(w.strip(".…").lower() for w in words[-3:])))))
            out.append(keys)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def ends_plainly(text: Column) -> Column:
    """Whether a text plainly ends a sentence: with a stop that is no abbreviation's, no dots and no remark's. `tail_of` asks the same; the
    last `TAIL` characters hold all that is asked for, and a text with more blanks than that at its end is left to `tail_of`."""
    bare = F.regexp_replace(F.right(text, F.lit(TAIL)), r"(?U)\s+$", "")
    stop = F.right(bare, F.lit(1)).isin(".", "?", "!") & ~bare.endswith("...")
    return F.when(stop, ~bare.rlike(f"(?i){_ABBREVIATION.pattern}") & ~bare.rlike(f"(?iU){_REMARK_STOP.pattern}")).otherwise(F.lit(False))


def tail_of(text: str | None) -> tuple[str, str | None] | None:
    """(core, mark) of a text, None of one that is null or blank or plainly ends.

    `core` is the text without remarks and marks; `mark` is "mark", "broken", "dots", "open" or "", or None if what is left plainly ends.
    """
    if not text or not (text := text.rstrip()):
        return None
    at = max(text.rfind(" ", 0, max(0, len(text) - TAIL)), 0)
    head, text = text[:at], text[at:]
    if text[-1:] in ".?!" and text[-3:] != "..." and not _ABBREVIATION.search(text) and not _REMARK_STOP.search(text):
        return None
    text = _WRONG_ARROW.sub("→", _WRONG_DOTS.sub("…", text)).rstrip()
    while (m := _REMARK.search(text)) and m[0].strip():
        text = text[: m.start()].rstrip()
    mark = ""
    if m := _MARK.search(text):
        text, mark = text[: m.start()].rstrip(), "mark"
        text = _MARK.sub("", text).rstrip()
        text = _DOTS.sub("", text).rstrip()
    elif m := _BROKEN.search(text):
        text, mark = text[: m.start()].rstrip(), "broken"
    elif m := _DOTS.search(text):
        text, mark = text[: m.start()].rstrip(), "dots"
    whole = head + text
    if not whole.strip():
        return None
    if not mark and _FINAL.search(text) and not _ABBREVIATION.search(text):
        return whole, None
    if not mark and whole[-1] in ",;:–—-(“„«&":
        mark = "open"
    return whole, mark


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, n_end, n_mid = sequence_counts(b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n_end), pa.array(n_mid)], ["key", "n_end", "n_mid"])


def corpus_sequences(df: DataFrame, text: str = "summary") -> DataFrame:
    """(`key`, `n_end`, `n_mid`): how often each masked sequence of the texts ends a sentence and how often it doesn't."""
    counted = df.select(text).where(F.length(text) > 0).mapInArrow(_count_batches, "key bigint, n_end bigint, n_mid bigint")
    return counted.groupBy("key").agg(F.sum("n_end").alias("n_end"), F.sum("n_mid").alias("n_mid"))


_TAIL_SCHEMA = "_source string, _core string, _mark string, _keys array<struct<l:string,k:bigint>>, _whole boolean, _edge boolean, _size int"


def _is_residue(machine, text: str) -> bool:
    """Whether a text is residue rather than a text with residue in it."""
    kind = residue.kind_of(machine, text, alone=True)
    rest = residue.SLOTS.sub("", text) if kind == "slot" else text
    return kind in ("page", "filler") or sum(map(str.isalnum, rest)) < residue.COVERAGE * sum(map(str.isalnum, text))


def tails(df: DataFrame, key: str = "id", text: str = "summary", source: str = "source_name") -> DataFrame:
    """(`key`, `_source`, `_core`, `_mark`, ...) of the texts that don't plainly end; `_mark` is null where they end all the same once
    remarks are taken off. Residue, null and blank texts are left out."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = residue.automaton()
        for b in batches:
            at, core, mark, whole, edge, size = [], [], [], [], [], []
            for k, t in enumerate(b.column(2).to_pylist()):
                text_, mark_ = tail_of(t) or (t, None)
                if not t.strip() or _is_residue(machine, t):
                    continue
                at.append(k), core.append(" ".join(text_.split())), mark.append(mark_), size.append(len(t))
                whole.append(bool(_FINAL.search(text_[-TAIL:]) and not _ABBREVIATION.search(text_[-TAIL:])))
                edge.append(text_[-1] in ",;“„«(&")
            keys = [[{"l": x, "k": y} for x, y in each] if m is not None else None for m, each in zip(mark, tail_keys(core, [m == "dots" for m in mark]))]
            columns = [pa.array(core, pa.string()), pa.array(mark, pa.string()), pa.array(keys, pa.list_(pa.struct([("l", pa.string()), ("k", pa.int64())]))), pa.array(whole, pa.bool_()), pa.array(edge, pa.bool_()), pa.array(size, pa.int32())]
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), *columns], [key, "_source", "_core", "_mark", "_keys", "_whole", "_edge", "_size"])

    name = F.col(source).cast("string") if source in df.columns else F.lit(None).cast("string")
    return df.where((F.length(text) > 0) & ~ends_plainly(F.col(text))).select(key, name.alias("_source"), text).mapInArrow(run, f"`{key}` {kind}, {_TAIL_SCHEMA}")


class _Walk:
    """One part of the sorted distinct values, walked from first to last.

    Values that may still be gone on with lie on a stack, each a prefix of the next. Where parts meet, what lies on the stack at the end
    of one may be gone on with in the next: a part tells its first value, and after how many characters of that a value of the part goes
    on with a word where the first value itself doesn't.
    """

    def __init__(self) -> None:
        self.stack: list[str] = []
        self.first: str | None = None
        self.shared = 0
        self.more: set[int] = set()

    def step(self, value: str, doubtful: bool) -> list[str]:
        """The values on the stack that this one goes on after, now settled."""
        if self.first is None:
            self.first, self.shared = value, len(value)
        elif self.shared:
            n = min(self.shared, len(value))
            if not value.startswith(self.first[:n]):
                low, high = 0, n
                while low < high:
                    middle = (low + high + 1) // 2
                    low, high = (middle, high) if value.startswith(self.first[:middle]) else (low, middle - 1)
                n = low
            self.shared = n
            for k in range(max(1, n - 2), n + 1):
                if k < len(value) and _GOES_ON.match(value, k) and not _GOES_ON.match(self.first, k):
                    self.more.add(k)
        while self.stack and not value.startswith(self.stack[-1]):
            self.stack.pop()
        settled = [v for v in self.stack if len(v) < len(value) and _GOES_ON.match(value, len(v))]
        if settled:
            self.stack = [v for v in self.stack if v not in settled]
        if doubtful:
            self.stack.append(value)
        return settled


def prefixes_of_longer(values: DataFrame) -> DataFrame:
    """(`_core`) of the doubtful values of (`_core`, `_doubtful`) that are a strict prefix of a longer value which goes on in the midst of
    a word or sentence, at any length.

    Values are made distinct and sorted by range, so that no group of values with a common beginning has to be in one task. What crosses
    the borders of the parts, one value a part and the prefixes that are open there, is settled on the driver.
    """
    spark = values.sparkSession
    distinct = cut(values.groupBy("_core").agg(F.max("_doubtful").alias("_doubtful")), "values")
    ordered = distinct.repartitionByRange(task_slices(spark), "_core").sortWithinPartitions("_core").withColumn("_part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: int, kind: str, found: list[str], at: list[int]) -> pa.RecordBatch:
            n = len(found)
            return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([kind] * n), pa.array(found, pa.string()), pa.array([at] * n, pa.list_(pa.int32()))], ["part", "kind", "value", "at"])

        walk, part = _Walk(), None
        for b in batches:
            hits = []
            for value, doubtful, part in zip(*[c.to_pylist() for c in b.columns]):
                hits += walk.step(value, doubtful)
            if hits:
                yield out(part, "hit", hits, [])
        if part is not None:
            yield out(part, "first", [walk.first], sorted(walk.more))
            if walk.stack:
                yield out(part, "open", walk.stack, [])

    walked = cut(ordered.mapInArrow(run, "part int, kind string, value string, at array<int>"), "prefixes")
    firsts: list = []
    opened: list = []
    for r in sorted(walked.where("kind != 'hit'").collect(), key=lambda r: r.part):  # a value a part, and the prefixes of one value
        (firsts if r.kind == "first" else opened).append(r)
    across = set()
    for o in opened:
        for f in firsts:
            if f.part > o.part:
                if not f.value.startswith(o.value):
                    break
                if len(f.value) > len(o.value) and (_GOES_ON.match(f.value, len(o.value)) or len(o.value) in f.at):
                    across.add((o.value,))
                    break
    hits = walked.where("kind = 'hit'").select(F.col("value").alias("_core"))
    return hits.unionByName(spark.createDataFrame(sorted(across), "_core string")).distinct()


def field_limits(doubtful: DataFrame, by: str | None = "_source") -> DataFrame:
    """(`_s`, `_z`): sources and lengths at which their doubtful ends (`_source`, `_core`, `_size`) pile up, a null source being one too;
    without `by` over all sources, `_s` being null. Ends with the same last words count once, as copies of a report have equal lengths."""
    own = F.col(by) if by else F.lit(None).cast("string")
    ends = doubtful.select(own.alias("_s"), F.col("_size").alias("_z"), F.expr("right(_core, 20)").alias("_end")).distinct()
    counts = ends.groupBy("_s", "_z").agg(F.count("*").alias("_n"))
    near = Window.partitionBy("_s").orderBy("_z").rangeBetween(-AROUND_LIMIT, AROUND_LIMIT)
    around = (F.sum("_n").over(near) - F.col("_n")) / (2 * AROUND_LIMIT)
    piled = (F.col("_n") >= F.col("_around") + PILE + 3 * F.sqrt("_around")) & (F.col("_n") >= PILE_TIMES * F.col("_around"))
    return counts.withColumn("_around", around).where(piled).select("_s", "_z")


def judge_tails(doubtful: DataFrame, sequences: DataFrame, longer: DataFrame, key: str = "id") -> DataFrame:
    """(`key`, `cut`, `by`) of doubtful ends: `by` tells what decided (copy, mark, limit, word, name, sequence)."""
    looked = (
        doubtful.select(key, F.explode("_keys").alias("_x"))
        .select(key, F.col("_x.l").alias("_l"), F.col("_x.k").alias("_k"))
        .join(sequences.withColumnRenamed("key", "_k"), "_k", "left")
        .select(key, "_l", F.coalesce("n_end", F.lit(0)).alias("e"), F.coalesce("n_mid", F.lit(0)).alias("m"))
        .groupBy(key)
        .agg(*[F.max(F.when(F.col("_l") == n, F.struct("e", "m"))).alias(f"k{n}") for n in ("1", "2", "3", "g", "h", "s", "d")])
    )

    def total(c: str) -> Column:
        return F.coalesce(F.col(f"{c}.e") + F.col(f"{c}.m"), F.lit(0))

    def share(c: str) -> Column:
        return F.col(f"{c}.e") / F.greatest(total(c), F.lit(1))

    level = F.when(total("k3") + total("k2") == 0, share("k1")).otherwise((F.coalesce(F.col("k3.e"), F.lit(0)) + SMOOTH * share("k2")) / (total("k3") + SMOOTH))
    around = F.greatest(*[F.when(total(c) >= 8, share(c)).otherwise(0.0) for c in ("kg", "kh")])
    middle = F.coalesce(F.col("k3.m"), F.col("k2.m"), F.col("k1.m"), F.lit(0))
    remark = F.coalesce(F.col("kd.e"), F.lit(0))
    by = (
        F.when(F.col("_copy"), "copy")
        .when(F.col("_mark").isin("mark", "broken") & ~F.col("_whole"), "mark")
        .when((F.col("_mark") == "dots") & ~F.col("_whole") & ~((remark >= 3) & (middle * 4 <= remark)), "mark")
        .when(F.col("_mark").isin("mark", "broken", "dots"), None)
        .when(F.col("_edge"), "open")
        .when(F.col("_limit"), "limit")
        .when(total("k1") == 0, "word")
        .when((total("ks") >= ENOUGH) & (share("ks") < NAME_SHARE), "name")
        .when((level < END_SHARE) & ~((around >= AROUND) & (F.coalesce(F.col("k1.e"), F.lit(0)) > 0)), "sequence")
    )
    marked = doubtful.join(longer.withColumn("_c", F.lit(True)), "_core", "left").withColumn("_copy", F.coalesce("_c", F.lit(False)))
    return marked.join(looked, key, "left").select(key, by.isNotNull().alias("cut"), by.alias("by"))


def find_truncated(df: DataFrame, key: str = "id", text: str = "summary", source: str = "source_name") -> DataFrame:
    """(`key`, `by`) of the records whose text was cut inside a word or sentence, each key once.

    Null and blank texts, residue, complete texts without a stop or with a link or remark after them are no cases; repeated rows
    count once; null keys are left out. Very long texts are looked at whole. A frame without the column `source` is one source.
    """
    rows = df.select(key, text, *([source] if source in df.columns else [])).where(F.col(key).isNotNull())
    ended = cut(tails(rows, key, text, source), "tails")
    doubtful = ended.where("_mark is not null").dropDuplicates([key])
    squeezed = F.trim(F.regexp_replace(F.col(text), r"(?U)\s+", " "))
    plain = rows.where((F.length(text) > 0) & ends_plainly(F.col(text))).select(squeezed.alias("_core"), F.lit(False).alias("_doubtful"))
    values = plain.unionByName(ended.select("_core", F.col("_mark").isNotNull().alias("_doubtful")))
    limits = small(cut(field_limits(doubtful), "limits").withColumn("_l", F.lit(True)))
    overall = small(cut(field_limits(doubtful, None), "limits").select(F.col("_z").alias("_a"), F.lit(True).alias("_all")))
    known = doubtful.join(limits, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")), "left").join(overall, F.col("_size") == F.col("_a"), "left")
    known = known.withColumn("_limit", F.coalesce("_l", "_all", F.lit(False))).drop("_s", "_z", "_l", "_a", "_all")
    judged = judge_tails(known, corpus_sequences(rows, text), prefixes_of_longer(values), key)
    return judged.where("cut").select(key, "by")


def truncation_by_source(articles: DataFrame) -> DataFrame:
    """(`source_name`, `n_articles`, `n_cut`, `cut_share`): how often each source cuts its summaries; null names are one group."""
    each = articles.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("source_name").alias("source_name"))
    cut_ids = find_truncated(articles).select("id", F.lit(1).alias("_cut"))
    return each.join(cut_ids, "id", "left").groupBy("source_name").agg(F.count("*").alias("n_articles"), F.count("_cut").alias("n_cut")).withColumn("cut_share", F.col("n_cut") / F.col("n_articles"))


def found(articles: DataFrame) -> DataFrame:
    """(`id`) of the articles whose summary is cut."""
    return find_truncated(articles).select("id")
