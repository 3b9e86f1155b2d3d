"""Near-duplicate records by tensored banding of minhashes, with every candidate verified.

A record has two small collections of sub-keys, each of a few minhashes. A table key is a pair of one sub-key of either collection,
so that m + m sub-keys stand for m x m tables. Rows travel by the first sub-key alone and carry the second ones; the pairing takes
place where rows with the same first sub-key have met. Records with the same words are one class from the start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsgrid.session import cut, small, task_slices

#: Similarity of the distinct words, and words that a record needs.
THRESHOLD, LEAST_WORDS = 0.7, 20
#: Sub-keys per collection, an even number, and minhashes per sub-key: 100 tables of 6 minhashes from 60 minhashes. A pair of similarity
#: s meets with (1 - (1 - s^3)^10)^2: 0.97 at the threshold, 0.99 at 0.75.
SUB_KEYS, WIDTH = 10, 3
#: Further minhashes, a byte each, of which a pair must share so many to be verified at all. Of pairs at the threshold fewer than 1 in
#: 300 share less, of pairs with a similarity of 0.24 more than 98 in 100 do.
SKETCH, SKETCH_LEAST = 24, 11
#: Rows with one key that are compared in one place; more are split by the second sub-key, and then into blocks.
HOT = 20_000
#: Copies with the same words up to which `expand_pairs` gives every pair where no other limit is named.
EXPAND = 64
#: Places over which the members of a class are spread when they look up their representative.
SALT = 16
#: Members of a class that are paired in one place; larger classes are split into blocks.
BLOCK = 2_000

_WORDS = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(title: str | None, summary: str | None) -> set[str]:
    """Distinct runs of letters and digits of both fields, in lower case."""
    return set(_WORDS.findall(f"{title or ''} {summary or ''}".lower()))


def _constants(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240903)
    return rng.integers(1, 2**63, count, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)


def _fmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Hasher:
    """64-bit hashes of words, remembered while a task runs."""

    def __init__(self, limit: int = 500_000) -> None:
        import xxhash

        self.of, self.known, self.limit = xxhash.xxh64_intdigest, {}, limit

    def __call__(self, words: set[str]) -> list[int]:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = self.of(w)
            out.append(h)
        return out


def signatures(hashes: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(first sub-keys, second sub-keys, sketches, fingerprints of the word sets) of records given as hashed words, none of them empty."""
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    flat = np.fromiter((h for each in hashes for h in each), np.uint64, int(sizes.sum()))
    at = np.r_[0, np.cumsum(sizes)[:-1]]
    mul, add = _constants(2 * SUB_KEYS * WIDTH + SKETCH)
    subs = np.zeros((2 * SUB_KEYS, len(hashes)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(2 * SUB_KEYS):
            key = np.full(len(hashes), k + 1, np.uint64)
            for j in range(WIDTH):
                f = k * WIDTH + j
                key = (key * _MIX) ^ np.minimum.reduceat((flat * mul[f] + add[f]) >> np.uint64(20), at)
            subs[k] = _fmix(key)
        sketch = np.zeros((len(hashes), SKETCH), np.uint8)
        for k in range(SKETCH):
            f = 2 * SUB_KEYS * WIDTH + k
            sketch[:, k] = (_fmix(np.minimum.reduceat((flat * mul[f] + add[f]) >> np.uint64(20), at)) & np.uint64(255)).astype(np.uint8)
        one, two = np.add.reduceat(_fmix(flat), at), np.bitwise_xor.reduceat(_fmix(flat * _MIX), at)
    prints = np.stack([one, two], 1)
    return subs[:SUB_KEYS].T.view(np.int64), (subs[SUB_KEYS:].T >> np.uint64(48)).astype(np.uint16, order="C"), sketch.view(np.uint32), [p.tobytes() for p in prints]


def sign(df: DataFrame, key: str = "id", title: str = "title", summary: str = "summary", least: int = LEAST_WORDS) -> DataFrame:
    """(`id`, `fp`, `a`, `b`) of the records with `least` words or more: fingerprint of the word set, first sub-keys, and second
    sub-keys, sketch and number of words as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for whole in batches:
            for s in range(0, whole.num_rows, 4000):
                b = whole.slice(s, 4000)
                at, hashes = [], []
                for k, (t, u) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                    w = words_of(t, u)
                    if len(w) >= least:
                        at.append(k), hashes.append(hasher(w))
                if not at:
                    continue
                first, second, sketch, prints = signatures(hashes)
                sizes = np.minimum(np.fromiter(map(len, hashes), np.int64, len(hashes)), 2**32 - 1).astype(np.uint32)
                packed = np.concatenate([second.view(np.uint32), sketch, sizes[:, None]], 1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), pa.array(prints, pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(first.ravel()), SUB_KEYS).cast(pa.list_(pa.int64())), pa.array([p.tobytes() for p in packed], pa.binary())],
                    ["id", "fp", "a", "b"],
                )

    return df.select(F.col(key).cast("string").alias("id"), title, summary).where(F.col("id").isNotNull()).mapInArrow(run, "id string, fp binary, a array<bigint>, b binary")


_BLOCK_SCHEMA = "x bigint, y bigint, late boolean, key bigint, b binary"


def _block(threshold: float, paired: bool):
    """The comparison of rows (`key`, `rid`, `b`) sorted by key: pairs (x, y), or the rows of keys with more than `HOT` rows as late.

    With `paired` the key is a whole table key already.
    """

    def out(x, y, late, key, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(late, pa.bool_()), pa.array(key, pa.int64()), pa.array(b, pa.binary())], ["x", "y", "late", "key", "b"])

    def pairs(key: np.ndarray, rid: np.ndarray, payload: np.ndarray) -> np.ndarray:
        """Distinct (x, y), x < y, of rows that share a table key and are near in size."""
        found = []
        size = payload[:, -1].astype(np.float64)
        second = np.ascontiguousarray(payload[:, : SUB_KEYS // 2]).view(np.uint16)
        sketch = np.ascontiguousarray(payload[:, SUB_KEYS // 2 : -1]).view(np.uint8)
        with np.errstate(over="ignore"):
            for j in range(1 if paired else SUB_KEYS):
                table = key if paired else (key.view(np.uint64) * _MIX ^ second[:, j].astype(np.uint64)) * _MIX
                order = np.argsort(table, kind="stable")
                sorted_ = table[order]
                left = np.flatnonzero(sorted_[1:] == sorted_[:-1])
                step = 1
                while len(left):
                    p, q = order[left], order[left + step]
                    near = np.minimum(size[p], size[q]) >= threshold * np.maximum(size[p], size[q])
                    p, q = p[near], q[near]
                    alike = (sketch[p] == sketch[q]).sum(1) >= SKETCH_LEAST
                    x, y = rid[p[alike]], rid[q[alike]]
                    found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y])
                    step += 1
                    left = left[left + step < len(sorted_)]
                    left = left[sorted_[left] == sorted_[left + step]]
                    if sum(map(len, found)) > 2_000_000:
                        found = [np.unique(np.concatenate(found), axis=0)]
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def work(key, rid, payload, raw) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        runs = np.diff(edges)
        hot = np.repeat(runs > HOT, runs)
        if hot.any():
            where = np.flatnonzero(hot)
            yield out(rid[where], np.zeros(len(where), np.int64), np.ones(len(where), bool), key[where], [raw[k] for k in where])
        single = np.repeat(runs == 1, runs)
        use = ~hot & ~single
        if use.any():
            got = pairs(key[use], rid[use], payload[use])
            if len(got):
                none = np.zeros(len(got), np.int64)
                yield out(got[:, 0], got[:, 1], np.zeros(len(got), bool), none, [None] * len(got))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rids, raws, held, hot_key = [], [], [], 0, None
        for batch in batches:
            key, rid, raw = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            if hot_key is not None and len(key):
                n = int(np.searchsorted(key, hot_key, side="right")) if key[0] == hot_key else 0
                if n:
                    yield out(rid[:n], np.zeros(n, np.int64), np.ones(n, bool), key[:n], raw[:n])
                key, rid, raw = key[n:], rid[n:], raw[n:]
                if len(key):
                    hot_key = None
            if not len(key):
                continue
            keys.append(key), rids.append(rid), raws.extend(raw)
            held += len(key)
            if held < 3 * HOT:
                continue
            key, rid = np.concatenate(keys), np.concatenate(rids)
            split = int(np.searchsorted(key, key[-1]))
            tail = len(key) - split
            if tail > HOT:
                hot_key, split = int(key[-1]), len(key)
            if split:
                payload = np.frombuffer(b"".join(raws[:split]), np.uint32).reshape(split, -1)
                yield from work(key[:split], rid[:split], payload, raws[:split])
            keys, rids, raws, held = [key[split:]], [rid[split:]], raws[split:], len(key) - split
        if held:
            key, rid = np.concatenate(keys), np.concatenate(rids)
            yield from work(key, rid, np.frombuffer(b"".join(raws), np.uint32).reshape(len(key), -1), raws)

    return run


def _met(rows: DataFrame, threshold: float, paired: bool) -> DataFrame:
    slices = task_slices(rows.sparkSession)
    return rows.select("key", "rid", "b").repartition(slices, "key").sortWithinPartitions("key").mapInArrow(_block(threshold, paired), _BLOCK_SCHEMA)


def candidates(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct (`x`, `y`), x < y, of classes (`rid`, `a`, `b`) that share a table key.

    Rows of a first sub-key that more than `HOT` classes have go on by whole table keys; those of a table key that more have are
    compared block by block, each pair of blocks in one place, so that none is left out and no task takes an unbounded group.
    """
    rows = classes.select(F.explode("a").alias("key"), "rid", "b")
    first = cut(_met(rows, threshold, False), "banding")
    found = first.where(~F.col("late")).select("x", "y")
    late = first.where("late").select("key", F.col("x").alias("rid"), "b")
    if late.limit(1).count():
        at = [F.xxhash64("key", F.lit(j), F.expr(f"substring(b, {2 * j + 1}, 2)")) for j in range(SUB_KEYS)]
        second = cut(_met(late.select(F.explode(F.array(*at)).alias("key"), "rid", "b"), threshold, True), "banding")
        found = found.unionByName(second.where(~F.col("late")).select("x", "y"))
        last = second.where("late").select("key", F.col("x").alias("rid"), "b")
        if last.limit(1).count():
            blocks = last.groupBy("key").agg(F.ceil(F.count("*") / (HOT // 4)).cast("int").alias("n"))
            part = last.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("rid"), F.col("n")).cast("int"))
            spread = part.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
            spread = spread.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "rid", "b")
            third = cut(_met(spread, threshold, True), "banding")
            if third.where("late").limit(1).count():
                raise RuntimeError("a pair of blocks holds more rows than are compared in one place")
            found = found.unionByName(third.select("x", "y"))
    return found.distinct()


def _hashed(texts: DataFrame) -> DataFrame:
    """(`rid`, `rep`, `w`): hashes of the distinct words of (`rid`, `rep`, `title`, `summary`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for b in batches:
            each = [sorted(hasher(words_of(t, s))) for t, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            flat = np.fromiter((h for x in each for h in x), np.uint64).view(np.int64)
            offsets = np.r_[0, np.cumsum(np.fromiter(map(len, each), np.int32, len(each)))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["rid", "rep", "w"])

    return texts.select("rid", "rep", "title", "summary").mapInArrow(run, "rid bigint, rep string, w array<bigint>")


def near_duplicates(df: DataFrame, key: str = "id", title: str = "title", summary: str = "summary", threshold: float = THRESHOLD, least: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes, members): `rep_a`, `rep_b`, `similarity` of classes of records with the same words, and `rep`, `id` of every
    record with enough words.

    Each similarity is that of the distinct words, computed from the texts. Null texts count as empty; records in several rows count
    once; null keys are left out; an empty frame gives empty results.
    """
    signed = cut(sign(df, key, title, summary, least), "signatures")
    classes = signed.groupBy("fp").agg(F.min("id").alias("rep"), F.max("id").alias("_last"), F.first("a").alias("a"), F.first("b").alias("b")).withColumn("rid", F.xxhash64("rep"))
    classes = cut(classes, "classes")
    pairs = candidates(classes.select("rid", "a", "b"), threshold)
    pairs = cut(pairs, "candidates")
    needed = cut(pairs.select(F.explode(F.array("x", "y")).alias("rid")).distinct(), "needed")
    wanted = cut(classes.select("rid", "rep").join(small(needed, 300_000), "rid", "left_semi"), "needed")
    texts = df.select(F.col(key).cast("string").alias("rep"), F.col(title).alias("title"), F.col(summary).alias("summary")).join(small(wanted, 300_000), "rep").dropDuplicates(["rep"])
    words = cut(_hashed(texts), "words")
    # Representatives travel with the words: where two hash alike, both are compared and each pair keeps its own names.
    x, y = (words.select(F.col("rid").alias(k), F.col("rep").alias(f"r{k}"), F.col("w").alias(f"w{k}")) for k in "xy")
    both = pairs.join(x, "x").join(y, "y")
    shared = F.size(F.array_intersect("wx", "wy"))
    scored = both.select("rx", "ry", (shared / (F.size("wx") + F.size("wy") - shared)).alias("similarity")).where((F.col("similarity") >= threshold) & (F.col("rx") != F.col("ry")))
    linked = scored.select(F.least("rx", "ry").alias("rep_a"), F.greatest("rx", "ry").alias("rep_b"), "similarity").dropDuplicates(["rep_a", "rep_b"])
    several = classes.where(F.col("rep") != F.col("_last")).select("fp", "rep")
    # A class may hold a third of all records: its row goes to `SALT` places, and its records are spread over them.
    spread = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    members = signed.select("fp", "id", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int").alias("salt")).join(spread, ["fp", "salt"]).select("rep", "id").distinct()
    alone = classes.where(F.col("rep") == F.col("_last")).select("rep", F.col("rep").alias("id"))
    return linked, members.unionByName(alone)


def expand_pairs(linked: DataFrame, members: DataFrame, limit: int | None = EXPAND) -> DataFrame:
    """Distinct (`id_a`, `id_b`), id_a < id_b, of records from pairs of classes and members.

    With `limit` None every pair of records is given, however many a class has: members go in blocks, and each pair of blocks meets in
    one place. With a number, only classes of at most so many copies give all their pairs; in a larger one each copy is paired with
    its representative, which alone stands in the pairs with other classes.
    """
    several = cut(members.where(F.col("rep") != F.col("id")).unionByName(members.where(F.col("rep") != F.col("id")).select("rep", F.col("rep").alias("id")).distinct()), "members")
    sizes = several.groupBy("rep").agg(F.count("*").alias("n"))
    many = None
    if limit is not None:
        many = several.join(sizes.where(F.col("n") > limit), "rep", "left_semi")
        sizes = sizes.where(F.col("n") <= limit)
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    few = cut(several.join(sizes, "rep").select("rep", "id", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")), "members")
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    p = few.select("rep", F.col("block").alias("at"), each.alias("to"), F.col("id").alias("p"))
    q = few.select("rep", each.alias("at"), F.col("block").alias("to"), F.col("id").alias("q"))
    pairs = p.join(q, ["rep", "at", "to"]).select("p", "q").where("p < q")
    if many is not None:
        pairs = pairs.unionByName(many.where("id != rep").select(F.col("id").alias("p"), F.col("rep").alias("q")))
    large = small(sizes.where(F.col("blocks") > 1).select("rep", "blocks"))
    across = linked.select("rep_a", "rep_b")
    for side in ("a", "b"):
        across = across.join(large.select(F.col("rep").alias(f"rep_{side}"), "blocks"), f"rep_{side}", "left")
        across = across.withColumn(f"at_{side}", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    for side in ("a", "b"):
        across = across.join(few.select(F.col("rep").alias(f"rep_{side}"), F.col("block").alias(f"at_{side}"), F.col("id").alias(f"id_{side}")), [f"rep_{side}", f"at_{side}"], "left")
    pairs = pairs.unionByName(across.select(F.coalesce("id_a", "rep_a").alias("p"), F.coalesce("id_b", "rep_b").alias("q")))
    return pairs.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b")).where("id_a < id_b").distinct()


def groups(linked: DataFrame, members: DataFrame) -> DataFrame:
    """(`id`, `group_id`, `n_links`): one row per record with enough words, its group and the links of its class to other classes.

    The groups are the connected components of the links; `group_id` is the least id of a group. In each round every class, and the
    class that is its label, take the least label of a label among its neighbours, so that whole trees move over a link at once and
    rounds grow with the logarithm of a path. Rounds go on until no label changes; labels only ever fall, so that this is reached.
    Each round is written, so that lost executors cost one round.
    """
    links = cut(linked.select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v")).unionByName(linked.select(F.col("rep_b").alias("u"), F.col("rep_a").alias("v"))), "links")
    label = cut(links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        jump = label.join(label.select(F.col("u").alias("label"), F.col("label").alias("beyond")), "label")
        near = links.join(jump.select(F.col("u").alias("v"), "beyond"), "v").groupBy("u").agg(F.min("beyond").alias("other"))
        both = jump.join(near, "u")
        own = F.struct("u", F.least("beyond", "other").alias("new"), F.col("label").alias("old"))
        root = F.struct(F.col("label").alias("u"), F.col("other").alias("new"), F.lit(None).cast("string").alias("old"))
        step = both.select(F.explode(F.array(own, root)).alias("s")).groupBy("s.u").agg(F.min("s.new").alias("new"), F.max("s.old").alias("old"))
        step = cut(step, "labels")
        label = step.select("u", F.col("new").alias("label"))
        if not step.where(F.col("new") != F.col("old")).limit(1).count():
            break
    counts = links.groupBy("u").agg(F.count("*").alias("n_links"))
    found = label.join(counts, "u").withColumnRenamed("u", "rep")
    return members.join(found, "rep", "left").select("id", F.coalesce("label", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def found(articles: DataFrame) -> DataFrame:
    """(`id_a`, `id_b`), id_a < id_b: pairs of articles with at least 20 distinct words each of which 0.7 are in both."""
    return expand_pairs(*near_duplicates(articles), limit=None)
