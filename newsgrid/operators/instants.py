"""Mixed timestamp texts to one instant in UTC.

The texts are gathered into a dictionary of distinct (text, zone, day order), each entry is parsed once, the result may be
kept and only new entries parsed later, and instants are joined back to the rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from newsgrid.session import cut, small

#: Raised whenever texts are read differently, so that dictionaries kept before aren't used.
VERSION = 1
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

# Month names and their common short forms in the six languages, by month.
MONTHS = (
    "january jan januar jänner janvier janv enero ene janeiro январь января янв",
    "february feb februar février févr fév febrero fevereiro fev февраль февраля фев",
    "march mar märz mär mrz mars marzo março март марта мар",
    "april apr avril avr abril abr апрель апреля апр",
    "may mai mayo maio май мая",
    "june jun juni juin junio junho июнь июня июн",
    "july jul juli juillet juil julio julho июль июля июл",
    "august aug août aout agosto ago август августа авг",
    "september sep sept septembre septiembre setiembre setembro set сентябрь сентября сен",
    "october oct oktober okt octobre octubre outubro out октябрь октября окт",
    "november nov novembre noviembre novembro ноябрь ноября ноя",
    "december dec dezember dez décembre déc diciembre dic dezembro декабрь декабря дек",
)
# Zone abbreviations with their usual meaning in the US or in Europe, as minutes from UTC.
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "ist": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}
MONTH = {name: k for k, names in enumerate(MONTHS, 1) for name in names.split()}

_CLOCK = r"(?P<h>\d{1,2})[:h](?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?\s*(?P<ap>[ap]\.?m\.?(?![^\W\d_]))?(?:\s*(?:uhr|h|ч\.?))?"
_ZONE = r"(?:\s*(?:(?:utc|gmt)?(?P<sg>[+-])(?P<zh>\d{1,2}):?(?P<zm>\d{2})?|\[?(?P<region>[a-z]+(?:/[a-z_+\-0-9]+)+)\]?|\[?(?P<ab>[a-z]{1,5})\]?))?"
_JOIN = r"(?:\s*,?\s*(?:at|à|a las|às|um|в)?\s*|t)"
_PATTERNS = [
    re.compile(p + r"\s*$", re.UNICODE)
    for p in (
        rf"(?P<y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}})(?:(?:t|\s+|,\s*){_CLOCK}{_ZONE})?",
        rf"(?:[^\W\d]+\.?,?\s+)?(?P<d>\d{{1,2}})\.?(?:\s+de)?[\s-]+(?P<mon>[^\W\d]+)\.?(?:\s+de)?,?[\s-]+(?P<y>\d{{4}}|\d{{2}})(?:\s*г\.?)?(?:{_JOIN}{_CLOCK}{_ZONE})?",
        rf"(?P<a>\d{{1,2}})(?P<sep>[/.])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}|\d{{2}})(?:{_JOIN}{_CLOCK}{_ZONE})?",
        rf"(?:[^\W\d]+\.?,?\s+)?(?P<mon>[^\W\d]+)\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})(?:{_JOIN}{_CLOCK}{_ZONE})?",
        rf"[^\W\d]+\.?,?\s+(?P<mon>[^\W\d]+)\s+(?P<d>\d{{1,2}})\s+{_CLOCK}{_ZONE}\s+(?P<y>\d{{4}})",
        r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?:t?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,](?P<f>\d+))?" + _ZONE + r")?",
        rf"(?P<y>\d{{4}})[/.](?P<m>\d{{1,2}})[/.](?P<d>\d{{1,2}})(?:{_JOIN}{_CLOCK}{_ZONE})?",
    )
]
_NUMBER = re.compile(r"(-?\d{9,10})(?:\.(\d+))?$|(-?\d{12,13})$|(-?\d{15,16})$|(-?\d{18,19})$")


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    for form in (name, name.title(), "/".join(p.title() for p in name.split("/")), name.upper()):
        try:
            return ZoneInfo(form)
        except (KeyError, ValueError, OSError):
            continue
    return None


def parse_instant(text: str | None, zone: str | None = None, day_first: bool | None = None) -> int | None:
    """Microseconds since 1970 in UTC of one text, or None where it denotes no moment.

    A text without a zone counts in `zone` (UTC where that is null or unknown). A local time that occurs twice is the
    earlier one, a skipped one counts with the offset before the change. All-digit dates with slashes follow
    `day_first` (null: day first), those with dots are day first. Two-digit years are 20xx; missing parts of the time
    are zero; digits below a microsecond are dropped. Numbers are seconds, milli-, micro- or nanoseconds by length.
    """
    if not text or not (raw := " ".join(text.split())):
        return None
    if m := _NUMBER.match(raw):
        if m[1]:
            us = int(m[1]) * 1_000_000
            part = int((m[2] or "").ljust(6, "0")[:6] or 0)
            return us - part if m[1].startswith("-") else us + part
        return int(m[3]) * 1000 if m[3] else int(m[4]) if m[4] else int(m[5]) // 1000
    low = raw.lower()
    for pattern in _PATTERNS:
        if m := pattern.match(low):
            break
    else:
        return None
    g = m.groupdict()
    try:
        year = int(g["y"])
        year += 2000 if len(g["y"]) == 2 else 0
        if g.get("mon"):
            month, day = MONTH[g["mon"]], int(g["d"])
        elif g.get("a"):
            first, second = int(g["a"]), int(g["b"])
            by_day = g["sep"] == "." or day_first is None or bool(day_first)
            month, day = (second, first) if by_day else (first, second)
        else:
            month, day = int(g["m"]), int(g["d"])
        hour = int(g["h"] or 0)
        if half := g.get("ap"):
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + (12 if half[0] == "p" else 0)
        local = datetime(year, month, day, hour, int(g["mi"] or 0), int(g.get("s") or 0), int((g.get("f") or "").ljust(6, "0")[:6]))
    except (KeyError, ValueError):
        return None
    if g.get("sg"):
        hours, minutes = int(g["zh"]), int(g["zm"] or 0)
        if hours > 18 or minutes > 59:
            return None
        offset = timedelta(hours=hours, minutes=minutes) * (-1 if g["sg"] == "-" else 1)
    elif g.get("ab"):
        if g["ab"] not in ABBREVIATIONS:
            return None
        offset = timedelta(minutes=ABBREVIATIONS[g["ab"]])
    else:
        if g.get("region") and _zone(g["region"]) is None:
            return None
        own = _zone(g["region"]) if g.get("region") else _zone(zone) if zone else None
        try:
            offset = local.replace(tzinfo=own).utcoffset() if own else timedelta(0)
        except (OverflowError, ValueError):
            return None
    return (local.replace(tzinfo=timezone.utc) - EPOCH) // timedelta(microseconds=1) - offset // timedelta(microseconds=1)


@pandas_udf(LongType())
def first_instant(one: pd.Series, two: pd.Series, three: pd.Series, zone: pd.Series, day_first: pd.Series) -> pd.Series:
    """The first of three texts that denotes a moment, as `parse_instant` reads it; null where none does."""
    out = []
    for *texts, z, f in zip(one, two, three, zone, day_first):
        out.append(next((us for t in texts if t and (us := parse_instant(t, z or None, None if pd.isna(f) else bool(f))) is not None), None))
    return pd.Series(out, dtype="Int64")


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, zone, first = (batch.column(k).to_pylist() for k in range(3))
        found = [parse_instant(*x) for x in zip(raw, zone, first)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.int64())], ["_raw", "_zone", "_first", "_utc_us"])


def date_dictionary(df: DataFrame, text: str, zone: str, day_first: str, known: DataFrame | None = None) -> DataFrame:
    """Distinct (`_raw`, `_zone`, `_first`) of a frame with `_utc_us`, each parsed once.

    With `known`, a dictionary made before, only entries not in it are parsed and the union comes back. Null texts have no
    entry. An empty frame gives an empty dictionary.
    """
    keys = df.select(F.col(text).alias("_raw"), F.col(zone).alias("_zone"), F.col(day_first).alias("_first")).where(F.col("_raw").isNotNull()).distinct()
    if known is not None:
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"k.{k}")) for k in ("_raw", "_zone", "_first")]
        keys = keys.alias("n").join(known.alias("k"), same[0] & same[1] & same[2], "left_anti")
    parsed = keys.mapInArrow(_parse_batches, _ENTRY)
    return parsed if known is None else known.select("_raw", "_zone", "_first", "_utc_us").unionByName(parsed)


def load_dictionary(spark: SparkSession, path: str) -> DataFrame | None:
    """A dictionary kept at `path` (one Parquet folder per addition), each entry once, or None where there is none yet.

    Two runs that add the same entries at the same time may both write them; a text always denotes the same moment, so that one counts.
    """
    try:
        kept = spark.read.schema(_ENTRY).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return kept.groupBy("_raw", "_zone", "_first").agg(F.min("_utc_us").alias("_utc_us"))


_ENTRY = "_raw string, _zone string, _first boolean, _utc_us bigint"


def extend_dictionary(df: DataFrame, text: str, zone: str, day_first: str, path: str) -> DataFrame:
    """Parse what the dictionary kept at `path` lacks, append it there, and return the whole dictionary, each entry once."""
    spark = df.sparkSession
    keys = df.select(F.col(text).alias("_raw"), F.col(zone).alias("_zone"), F.col(day_first).alias("_first")).where(F.col("_raw").isNotNull()).distinct()
    known = load_dictionary(spark, path)
    if known is not None:
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"k.{k}")) for k in ("_raw", "_zone", "_first")]
        keys = keys.alias("n").join(known.alias("k"), same[0] & same[1] & same[2], "left_anti")
    keys.mapInArrow(_parse_batches, _ENTRY).write.mode("append").parquet(path)
    return load_dictionary(spark, path)


def normalise_instants(
    articles: DataFrame,
    sources: DataFrame,
    text: str = "published_date",
    source: str = "source_name",
    path: str | None = None,
) -> DataFrame:
    """All columns of `articles` with `utc_us bigint`, null where the text denotes no moment.

    `sources` gives `name`, `zone_name` and `day_first`; of several rows of a name the first by zone counts; a source that
    is not there counts as UTC, day first. Row count is kept, repeated rows included; a clash with a column named `utc_us`
    replaces it. `path` keeps the dictionary between runs.
    """
    dim = sources.groupBy(F.col("name").alias("_src")).agg(F.min(F.struct("zone_name", "day_first")).alias("_z")).select("_src", F.col("_z.zone_name").alias("_zone"), F.col("_z.day_first").alias("_first"))
    rows = articles.drop("utc_us").join(small(dim), F.col(source).eqNullSafe(F.col("_src")), "left").drop("_src")
    words = extend_dictionary(rows, text, "_zone", "_first", path) if path else cut(date_dictionary(rows, text, "_zone", "_first"), "instants")
    words = words.select(F.col("_raw").alias("_r"), F.col("_zone").alias("_z2"), F.col("_first").alias("_f2"), F.col("_utc_us").alias("utc_us"))
    match = (F.col(text) == F.col("_r")) & F.col("_zone").eqNullSafe(F.col("_z2")) & F.col("_first").eqNullSafe(F.col("_f2"))
    return rows.join(words, match, "left").drop("_r", "_z2", "_f2", "_zone", "_first")


def found_instants(articles: DataFrame, sources: DataFrame, path: str | None = None) -> DataFrame:
    """(`id`, `utc_us`): one row per article whose `published_date` denotes a moment. Rows without an id are left out."""
    slim = articles.select("id", "published_date", "source_name").where(F.col("id").isNotNull() & F.col("published_date").isNotNull())
    return normalise_instants(slim, sources, path=path).where(F.col("utc_us").isNotNull()).groupBy("id").agg(F.min("utc_us").alias("utc_us"))
