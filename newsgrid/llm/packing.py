"""Filling containers of fixed capacity with texts: variable-capacity best fit over the histogram of sizes.

How many items there are of each size is all that the fit needs, so that it works on at most as many numbers as the largest capacity
has tokens, whatever the number of texts; the texts are then given their places by rank within their size.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from newsgrid.llm.tokens import VOCABULARY, count_tokens
from newsgrid.session import cut, small

#: Items of one size that are ranked in one place; more are ranked in parts.
RANKED = 200_000
#: Cost of a container besides its capacity, in tokens: it makes one full container cheaper than two of half the size.
OVERHEAD = 16
#: Rows of a table of settings; more are an error.
MOST_SETTINGS = 1000


def price(capacity: int) -> float:
    """Cost of a container: its capacity and a fixed part. Any other growing function may be given where a cost is asked for, for
    instance one with a square term for attention."""
    return capacity + OVERHEAD


def fit_histogram(counts: dict[int, int], capacities: list[int], cost: Callable[[int], float] = price) -> list[tuple[int, int, dict[int, int]]]:
    """(containers, capacity, {size: items in each}) that hold all items of a histogram, sizes at most the largest capacity.

    The largest item left opens the next container. Each permitted capacity that takes it is tried: filled with what is left, always
    with the largest item that fits, and made as small as its contents permit. The capacity with the least cost per token held is
    opened, as many times as the items left permit the same contents. Work follows the number of sizes, not that of items.
    """
    capacities = sorted(set(capacities))
    left = {s: n for s, n in counts.items() if s > 0 and n > 0}
    sizes = sorted(left)
    out = []

    def filled(capacity: int) -> tuple[int, dict[int, int]]:
        contents: dict[int, int] = {}
        room, at = capacity, len(sizes)
        while at and room >= sizes[0]:
            at = bisect.bisect_right(sizes, room, 0, at)
            if not at:
                break
            s = sizes[at - 1]
            m = min(room // s, left[s])
            contents[s] = m
            room -= m * s
            at -= 1
        return capacity - room, contents

    while sizes:
        best = None
        for c in capacities[bisect.bisect_left(capacities, sizes[-1]) :]:
            held, contents = filled(c)
            own = capacities[bisect.bisect_left(capacities, held)]
            rank = (cost(own) / held, -own)
            if best is None or rank < best[0]:
                best = (rank, own, contents)
        _, own, contents = best
        n = min(left[s] // m for s, m in contents.items())
        out.append((n, own, contents))
        for s, m in contents.items():
            left[s] -= n * m
            if not left[s]:
                del left[s]
                sizes.pop(bisect.bisect_left(sizes, s))
    return out


def _places(plan: list[tuple[int, int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """size -> (first rank, items per container, first container, capacity, tokens held) of the groups that hold it, by rank."""
    out: dict[int, list] = {}
    seen: dict[int, int] = {}
    container = 0
    for n, capacity, contents in plan:
        held = sum(s * m for s, m in contents.items())
        for size, each in contents.items():
            start = seen.get(size, 0)
            out.setdefault(size, []).append((start, each, container, capacity, held))
            seen[size] = start + n * each
        container += n
    return {s: tuple(np.array(c, np.int64) for c in zip(*rows)) for s, rows in out.items()}


def rank_within(df: DataFrame, by: list[str], order: list[str], parts: DataFrame | None = None) -> DataFrame:
    """The frame with `rank`, from 0 within the columns `by`. `parts` (`by`, `_parts`) names the groups that are ranked in so many parts,
    so that a size that a third of all texts have goes to as many tasks as it needs. `order` must tell rows apart."""
    if parts is None:
        return df.withColumn("rank", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("bigint"))
    parted = df.join(parts, by, "left").withColumn("_part", F.pmod(F.xxhash64(*order), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    sizes = parted.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = parted.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1)
    return inside.join(starts, [*by, "_part"]).withColumn("rank", (F.col("_start") + F.col("_rank")).cast("bigint")).drop("_part", "_start", "_rank")


_PACKED = "pack_id int, container_id string, capacity_tokens int, doc_id bigint, piece int, tokens bigint, fill double"


def pack_sizes(sizes: DataFrame, settings: list[tuple[int, int]], cost: Callable[[int], float] = price, largest_only: bool = False) -> DataFrame:
    """(`pack_id`, `container_id`, `capacity_tokens`, `doc_id`, `piece`, `tokens`, `fill`) from (`doc_id`, `tokens`).

    One packing for each (pack_id, capacity) of `settings`; its containers may be of any capacity of the settings up to its own, or of
    its own alone with `largest_only`. A text beyond the capacity is split into full containers and a rest, any other is whole. `fill`
    is the share of the container's tokens in use. Texts that are null or have no tokens take no place; of repeated rows each is packed.
    """
    spark = sizes.sparkSession
    items = sizes.where((F.col("tokens") > 0) & F.col("doc_id").isNotNull()).groupBy("doc_id", "tokens").agg(F.count("*").alias("n"))
    items = items.select("doc_id", "tokens", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    settings = sorted({(p, c) for p, c in settings if p is not None and c and c > 0})
    if not settings:
        return spark.createDataFrame([], _PACKED)
    table = F.array(*[F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("bigint").alias("cap")) for p, c in settings])
    each = items.select("doc_id", "tokens", "copy", F.explode(table).alias("s")).select("doc_id", "tokens", "copy", "s.pack_id", "s.cap")
    full = (
        each.where(F.col("tokens") >= F.col("cap"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), (F.col("tokens") / F.col("cap")).cast("int") - 1)))
        .select("pack_id", F.concat_ws("-", F.lit("d"), "cap", "doc_id", "copy", "piece").alias("container_id"), F.col("cap").cast("int").alias("capacity_tokens"), "doc_id", "piece", F.col("cap").alias("tokens"), F.lit(1.0).alias("fill"))
    )
    rest = each.withColumn("piece", (F.col("tokens") / F.col("cap")).cast("int")).withColumn("size", F.col("tokens") % F.col("cap")).where("size > 0").select("pack_id", "cap", "doc_id", "piece", "size", "copy")
    counted: dict[tuple[int, int], dict[int, int]] = {s: {} for s in settings}
    for r in rest.groupBy("pack_id", "cap", "size").agg(F.count("*").alias("n")).collect():  # at most as many rows as the capacities have tokens
        counted[r.pack_id, r.cap][r["size"]] = r.n
    places = {s: _places(fit_histogram(counted[s], [s[1]] if largest_only else [c for _, c in settings if c <= s[1]], cost)) for s in settings}
    shared = spark.sparkContext.broadcast(places)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pack, cap, size, rank = (b.column(k).to_numpy() for k in (0, 1, 4, 5))
            container, capacity, held = (np.zeros(len(pack), np.int64) for _ in range(3))
            order = np.lexsort((size, cap, pack))
            p, c, s = pack[order], cap[order], size[order]
            for rows in np.split(order, np.flatnonzero((p[1:] != p[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1])) + 1):
                if len(rows):
                    start, many, first, own, used = shared.value[int(pack[rows[0]]), int(cap[rows[0]])][int(size[rows[0]])]
                    g = np.searchsorted(start, rank[rows], side="right") - 1
                    container[rows], capacity[rows], held[rows] = first[g] + (rank[rows] - start[g]) // many[g], own[g], used[g]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f"b-{x}-{k}" for x, k in zip(cap, container)], pa.string()), pa.array(capacity.astype(np.int32)), b.column(2), b.column(3), b.column(4), pa.array(held / np.maximum(capacity, 1))],
                ["pack_id", "container_id", "capacity_tokens", "doc_id", "piece", "tokens", "fill"],
            )

    hot = [(p, c, size, -(-n // RANKED)) for (p, c), sizes_ in counted.items() for size, n in sizes_.items() if n > RANKED]
    parts = small(spark.createDataFrame(hot, "pack_id int, cap bigint, size bigint, _parts int")) if hot else None
    ranked = rank_within(rest, ["pack_id", "cap", "size"], ["doc_id", "copy"], parts)
    return full.unionByName(ranked.select("pack_id", "cap", "doc_id", "piece", "size", "rank").mapInArrow(place, _PACKED))


def settings_of(pack_setting: DataFrame) -> list[tuple[int, int]]:
    """(pack_id, capacity) of a table of settings, a dimension: more than `MOST_SETTINGS` rows are an error, none is left out."""
    rows = pack_setting.select("pack_id", "capacity_tokens").distinct().limit(MOST_SETTINGS + 1).collect()
    if len(rows) > MOST_SETTINGS:
        raise ValueError(f"there are more than {MOST_SETTINGS} settings of containers")
    return [(r.pack_id, r.capacity_tokens) for r in rows]


def pack_documents(documents: DataFrame, pack_setting: DataFrame, path: str = VOCABULARY, cost: Callable[[int], float] = price, largest_only: bool = False) -> DataFrame:
    """`pack_sizes` of the texts of `documents` for the rows of `pack_setting`."""
    sized = cut(count_tokens(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ("doc_id",), path=path), "sizes")
    return pack_sizes(sized, settings_of(pack_setting), cost, largest_only)


def fill_report(packed: DataFrame) -> DataFrame:
    """(`pack_id`, `capacity_tokens`, `n_containers`, `n_texts`, `n_tokens`, `room_left`, `mean_fill`) of a packing: `room_left` is the
    number of tokens that stay unused, `n_tokens` the least capacity that any packing needs."""
    each = packed.groupBy("pack_id", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("held"), F.count("*").alias("n"))
    room = F.sum(F.col("capacity_tokens").cast("bigint"))
    return each.groupBy("pack_id", "capacity_tokens").agg(
        F.count("*").alias("n_containers"), F.sum("n").alias("n_texts"), F.sum("held").alias("n_tokens"), (room - F.sum("held")).alias("room_left"), (F.sum("held") / room).alias("mean_fill")
    )
