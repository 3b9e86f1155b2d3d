"""Mixing sources to target weights: fractional copies of texts are rounded pairwise, and what is left over goes up a tree.

Long texts are settled first, each paired with all shorter ones of its source as one, and then the others from long to short, so that
what is still open at the end of a step is a short text. The last open text of a source, whose fate is drawn, moves its share by a few
tokens. Every text keeps its due number of copies in expectation.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from newsgrid.llm.tokens import VOCABULARY, count_tokens
from newsgrid.session import cut, small

#: Texts rounded in one place, and left-over texts that meet in one place on the way up.
LEAF, FAN = 20_000, 64
SEED = 7
#: Share of its source's tokens from which on a text is long: a source has at most 1 / LONG of them.
LONG = 0.002
#: Rows of a table of targets; more are an error.
MOST_TARGETS = 20_000


def pivot(p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities rounded to 0 or 1 but for one at most, with the sum of p x size kept exactly and each p kept in expectation.

    Two open texts exchange mass until one of them is decided; which way it goes is drawn so that neither gains on average.
    """
    p = p.astype(float).copy()
    draw = np.random.default_rng(seed).random(len(p))
    open_ = -1
    for k in range(len(p)):
        if not 1e-12 < p[k] < 1 - 1e-12:
            p[k] = round(p[k])
            continue
        if open_ < 0:
            open_ = k
            continue
        i, j = open_, k
        ratio = size[j] / size[i]
        up, down = min(1 - p[i], p[j] * ratio), min(p[i], (1 - p[j]) * ratio)
        move = up if draw[k] * (up + down) < down else -down
        p[i] += move
        p[j] -= move / ratio
        for x in (i, j):
            if p[x] < 1e-12:
                p[x] = 0.0
            elif p[x] > 1 - 1e-12:
                p[x] = 1.0
        open_ = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    return p


def settle_long(p: float, sizes: np.ndarray, total: float, seed: int) -> tuple[np.ndarray, float]:
    """(probabilities of the long texts, probability of all others) of a source whose texts all begin with `p`.

    Each text, from the longest on, exchanges mass with all that come after it, which share one probability: pivotal rounding of a pair
    whose second part is a group. The text is decided, or the whole group is, and p x size keeps its sum.
    """
    draw = np.random.default_rng(seed).random(len(sizes))
    out, rest = np.full(len(sizes), p), float(total)
    for k, size in enumerate(sizes):
        rest -= size
        out[k] = p
        if not 1e-12 < p < 1 - 1e-12:
            out[k] = round(p)
            continue
        if rest <= 0:
            continue
        up, down = min(1 - p, p * rest / size), min(p, (1 - p) * rest / size)
        move = up if draw[k] * (up + down) < down else -down
        out[k] = p + move
        p = min(1.0, max(0.0, p - move * size / rest))
    out[np.abs(out) < 1e-12], out[np.abs(1 - out) < 1e-12] = 0.0, 1.0
    return out, p


def _round_groups(rows: DataFrame, seed: int) -> DataFrame:
    schema = "mix_id int, source string, part bigint, doc_id bigint, tokens bigint, whole bigint, p double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        pdf["p"] = pivot(pdf.p.to_numpy(), pdf.tokens.to_numpy(), (seed + int(pdf.mix_id.iloc[0]) * 1009 + int(pdf.part.iloc[0])) % 2**32)
        return pdf

    return rows.groupBy("mix_id", "source", "part").applyInPandas(one, schema)


def mix_sizes(sizes: DataFrame, targets: DataFrame, seed: int = SEED, total_tokens: float | None = None) -> DataFrame:
    """(`mix_id`, `source`, `doc_id`, `n_copies`, `tokens`, `weight`, `actual_share`) from (`doc_id`, `source`, `tokens`).

    Each mix has about `total_tokens` tokens, or where that is None as many as its scarcest source allows at its `max_repeats`. A source
    that can't give its part of `total_tokens` gives all that it has at `max_repeats`, one without tokens nothing; the others keep their
    parts, and `actual_share`, the source's share of the tokens chosen for the mix, tells. Every text of a source is due the same number
    of copies; rounding keeps the source's tokens but for a part of its last open text, whose copy is drawn. Texts without tokens, of no
    source or of none that a mix names are left out; of repeated rows each is a text of its own; of repeated targets one counts.
    """
    spark = sizes.sparkSession
    texts = sizes.where((F.col("tokens") > 0) & F.col("source").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "source", "tokens")
    targets = targets.where((F.col("weight") > 0) & (F.col("max_repeats") > 0)).groupBy("mix_id", "source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    have = texts.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("n"))
    due = targets.join(have, "source")
    wanted = F.min(F.col("max_repeats") * F.col("have") / F.col("weight")) if total_tokens is None else F.lit(float(total_tokens))
    size = due.groupBy("mix_id").agg(wanted.alias("size"))
    due = due.join(size, "mix_id").withColumn("rate", F.least(F.col("weight") * F.col("size") / F.col("have"), F.col("max_repeats").cast("double")))
    due = due.withColumn("parts", F.ceil(F.col("n") / LEAF))
    rates = cut(due.select(F.col("mix_id").cast("int").alias("mix_id"), "source", "weight", "rate", "have", "parts"), "rates")
    long_ = texts.join(small(rates), "source").where(F.col("tokens") > LONG * F.col("have")).select("mix_id", "source", "doc_id", "tokens")
    grouped: dict[tuple, list] = {}
    for r in long_.collect():  # at most 1 / LONG texts a target
        grouped.setdefault((r.mix_id, r.source), []).append((r.tokens, r.doc_id))
    targets_ = rates.limit(MOST_TARGETS + 1).collect()
    if len(targets_) > MOST_TARGETS:
        raise ValueError(f"there are more than {MOST_TARGETS} targets of mixes")
    decided, others = [], []
    for r in targets_:
        whole = int(r.rate + 1e-9)
        own = sorted(grouped.get((r.mix_id, r.source), []), reverse=True)
        p, rest = settle_long(max(0.0, r.rate - whole), np.array([t for t, _ in own], float), r.have, zlib.crc32(f"{seed} {r.mix_id} {r.source}".encode()))
        decided += [(r.mix_id, r.source, 0, d, t, whole, float(x)) for (t, d), x in zip(own, p)]
        others.append((r.mix_id, r.source, r.have, r.parts, whole, float(rest)))
    shape = "mix_id int, source string, part bigint, doc_id bigint, tokens bigint, whole bigint, p double"
    longs = spark.createDataFrame(decided, shape)
    short = small(spark.createDataFrame(others, "mix_id int, source string, have bigint, parts bigint, whole bigint, p double"), MOST_TARGETS)
    rows = texts.join(short, "source").where(F.col("tokens") <= LONG * F.col("have")).select("mix_id", "source", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"), "doc_id", "tokens", "whole", "p")
    rows = rows.unionByName(longs)
    done = cut(_round_groups(rows, seed), "rounded")
    parts = rates.agg(F.max("parts").alias("m")).first().m or 0
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    settled, left, level = done.where(~open_), done.where(open_), 1
    while parts > 1:
        parts = -(-parts // FAN)
        step = cut(_round_groups(left.withColumn("part", F.floor(F.col("part") / FAN)), seed + level), "rounded")
        settled, left, level = settled.unionByName(step.where(~open_)), step.where(open_), level + 1
    # One open text a source and mix is left: its copy is drawn, so that it too keeps its due number in expectation.
    drawn = left.withColumn("p", (F.pmod(F.xxhash64("mix_id", "source", "doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < F.col("p")).cast("double"))
    chosen = settled.unionByName(drawn).select("mix_id", "source", "doc_id", (F.col("whole") + F.col("p")).cast("bigint").alias("n_copies"), "tokens").where("n_copies > 0")
    return chosen.join(small(cut(actual_shares(chosen, rates), "shares").select("mix_id", "source", "weight", "actual_share")), ["mix_id", "source"])


def actual_shares(chosen: DataFrame, rates: DataFrame) -> DataFrame:
    """(`mix_id`, `source`, `weight`, `tokens`, `actual_share`) of what was chosen, sources of which nothing was chosen with 0."""
    held = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("n_copies") * F.col("tokens")).alias("tokens"))
    total = held.groupBy("mix_id").agg(F.sum("tokens").alias("_all"))
    out = rates.select("mix_id", "source", "weight").join(held, ["mix_id", "source"], "left").join(total, "mix_id", "left")
    return out.select("mix_id", "source", "weight", F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.coalesce("tokens", F.lit(0)) / F.col("_all")).alias("actual_share"))


def mix_documents(documents: DataFrame, mix_target: DataFrame, path: str = VOCABULARY, seed: int = SEED, total_tokens: float | None = None) -> DataFrame:
    """`mix_sizes` of the texts of `documents` for the mixes of `mix_target`."""
    sized = cut(count_tokens(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text"), ("doc_id", "source"), path=path), "sizes")
    return mix_sizes(sized, mix_target, seed, total_tokens)


def mix_report(chosen: DataFrame, mix_target: DataFrame) -> DataFrame:
    """(`mix_id`, `source`, `weight`, `tokens`, `actual_share`) for every target, sources without texts included."""
    rates = mix_target.where("weight is not null").groupBy(F.col("mix_id").cast("int").alias("mix_id"), "source").agg(F.max("weight").alias("weight"))
    return actual_shares(chosen.select("mix_id", "source", "doc_id", "n_copies", "tokens"), rates)
