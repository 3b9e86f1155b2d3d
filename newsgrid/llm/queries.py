"""Queries of the training-text operators, and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgrid.llm import encoding, mixing, neardup, packing, quality, residue, subject, truncated
from newsgrid.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return subject.found(table(spark, d, "article"), table(spark, d, "subject_label"), table(spark, d, "subject_area"))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    return subject.subject_shares(p1_found(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.found(table(spark, d, "article"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(*neardup.near_duplicates(table(spark, d, "article")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated.found(table(spark, d, "article"))


def p3_share_by_source(spark: SparkSession, d: str) -> DataFrame:
    return truncated.truncation_by_source(table(spark, d, "article"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.found(table(spark, d, "article"))


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "article").where("id is not null")
    return encoding.repair_encoding(rows).groupBy("id", "field_name").agg(F.min(F.struct("chain", "restored")).alias("r")).select("id", "field_name", "r.chain", "r.restored")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.found(table(spark, d, "article"))


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    kept = residue.exclude_residue(table(spark, d, "article").select("id", "title", "summary", "source_name"))
    return kept.groupBy("source_name").agg(F.count("*").alias("n_rows"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_setting"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_pack(spark, d))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(p8_mix(spark, d), table(spark, d, "mix_target"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.found(table(spark, d, "documents"), table(spark, d, "stop_word"))


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(table(spark, d, "documents"), table(spark, d, "stop_word"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_shares, p2_found, p2_groups, p3_found, p3_share_by_source, p4_found, p4_restored, p5_found, p5_kept, p7_pack, p7_fill, p8_mix, p8_shares, p9_found, p9_statistics)
}

#: SQL that gives the same rows; none where SQL can't express the operator or is too slow on whole tables.
SQL: dict[str, str] = {}
