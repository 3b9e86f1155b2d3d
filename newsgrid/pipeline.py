"""From articles to themes, summaries and reports in one call, with a snapshot that expires."""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from newsgrid.model_client import BATCH, SINGLE, SUMMARY, Client, Offline, Options
from newsgrid.operators import articles as A, classify as C, reports as R, summarise as S
from newsgrid.session import cut, shared_dir, small

#: Seconds for which a snapshot is used again.
TTL = 6 * 3600


@dataclass
class Result:
    articles: DataFrame
    summaries: DataFrame
    counts: DataFrame


def fingerprint(*frames: DataFrame) -> str:
    """A name for the rows of some frames, whatever their order: counts and sums of row hashes, one aggregate a frame."""
    parts = []
    for df in frames:
        hashes = [F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), F.lit(seed)).cast("decimal(38,0)") for seed in (1, 2)]
        row = df.agg(F.count("*").alias("n"), *[F.sum(h).alias(f"h{k}") for k, h in enumerate(hashes)]).first()
        parts.append(f"{','.join(df.columns)}:{row.n}:{row.h0}:{row.h1}")
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:24]


def snapshot(df: DataFrame, name: str, bucket: str, refresh: bool = False, ttl: int = TTL) -> DataFrame:
    """The frame as written under a name and bucket in the shared folder, written anew when asked or when it is older than `ttl`.

    The bucket must stand for all that the frame is made from.
    """
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/snapshots/{name}/{bucket}")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = spark._jvm.org.apache.hadoop.fs.Path(fs_path, "_SUCCESS")
    fresh = fs.exists(done) and time.time() * 1000 - fs.getFileStatus(done).getModificationTime() < ttl * 1000
    if refresh or not fresh:
        df.write.mode("overwrite").parquet(str(fs_path))
    return spark.read.schema(df.schema).parquet(str(fs_path))


def clear_snapshots(spark) -> None:
    """Remove all snapshots of this session's folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/snapshots")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cache_info() -> dict:
    return {"ttl_seconds": TTL, "ttl_hours": TTL / 3600}


def ask(prompts: DataFrame, key: str, client: Client, options: Options) -> DataFrame:
    """(`key`, `reply`, `status`, `error`) of prompts (`key`, `prompt`): each is sent once, the answers are written."""
    kind = prompts.schema[key].dataType.simpleString()

    def answer(batches):
        for pdf in batches:
            got = client.complete(list(pdf["prompt"]), options)
            pdf["reply"], pdf["status"], pdf["error"] = [g["reply"] for g in got], [g["status"] for g in got], [g["error"] for g in got]
            pdf["status"] = pdf["status"].astype("Int32")
            yield pdf[[key, "reply", "status", "error"]]

    return cut(prompts.select(key, "prompt").mapInPandas(answer, f"`{key}` {kind}, reply string, status int, error string"), "replies")


def classify_singly(articles: DataFrame, keywords: DataFrame, client: Client) -> DataFrame:
    """(`id`, `theme`) of articles asked about one by one; null where the answer names no theme or there is none."""
    themes = [t for _, t, _ in C.dictionary(keywords)]
    return C.match_single(ask(articles.select("id", C.single_prompt(themes).alias("prompt")), "id", client, SINGLE), themes)


def summaries_of(classified: DataFrame, counts: DataFrame, client: Client) -> DataFrame:
    """The four sections of every theme: of a reply, of a failure, or standing texts where a theme has too few articles to ask."""
    status = S.summary_status(counts)
    asked = small(status.where("status = 'request'").select("theme")).join(S.prompts(classified), "theme").select("theme", S.summary_prompt().alias("prompt"))
    replies = ask(asked, "theme", client, SUMMARY)
    return S.parse_sections(S.answered(replies)).unionByName(S.failed_summaries(replies)).unionByName(S.standing_summaries(status))


def run(articles: DataFrame, sources: DataFrame, keywords: DataFrame, as_of: str, client: Client | None = None, refresh: bool = False, bucket: str | None = None) -> Result:
    """Window, de-duplicate, classify, summarise. Only prompts, one per theme and one per ten unmatched articles, leave the cluster.

    The snapshot of the classified articles is named by `as_of` and all rows of the inputs, or by `bucket` where one is given.
    """
    client = client or Offline()
    recent = A.keep_first(A.lookback(A.with_title(articles, sources), as_of))
    themes = [t for _, t, _ in C.dictionary(keywords)]
    name = bucket or f"{as_of.replace(':', '').replace(' ', 'T')}-{fingerprint(articles, sources, keywords)}"

    def replies() -> DataFrame:
        rest = C.batches(C.keyword_classify(recent, keywords).where("theme is null"))
        return ask(C.batch_prompts(rest, themes), "batch_id", client, BATCH)

    spark = articles.sparkSession
    done = None if refresh else kept(spark, "classified", name)
    classified = done if done is not None else snapshot(C.classify_articles(recent, keywords, replies()), "classified", name, True)
    counts = R.theme_counts(classified, keywords)
    return Result(classified, summaries_of(classified, counts, client), counts)


def kept(spark, name: str, bucket: str, ttl: int = TTL) -> DataFrame | None:
    """The snapshot of a name and bucket if there is one that hasn't expired, so that nothing need be asked to find that out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/snapshots/{name}/{bucket}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if fs.exists(done) and time.time() * 1000 - fs.getFileStatus(done).getModificationTime() < ttl * 1000:
        return spark.read.parquet(str(path))
    return None
