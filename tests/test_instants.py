from datetime import datetime, timezone

import pytest

from newsgrid.operators.instants import extend_dictionary, found_instants, normalise_instants, parse_instant

SOURCES = "name string, zone_name string, day_first boolean"
ARTICLES = "id string, published_date string, source_name string, utc_us string, _raw int"


def us(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    ("text", "zone", "first", "want"),
    [
        ("2024-09-04T12:30:11Z", "Asia/Tokyo", None, us(2024, 9, 4, 12, 30, 11)),
        ("2024-09-03", "America/New_York", None, us(2024, 9, 3, 4)),
        ("9/12/2024 6:11 PM", "America/New_York", False, us(2024, 9, 12, 22, 11)),
        ("09/12/2024 18:11", "Europe/London", True, us(2024, 12, 9, 18, 11)),
        ("12 septembre 2024 à 20h57", "Europe/Paris", True, us(2024, 9, 12, 18, 57)),
        ("10. März 2025, 11:20 Uhr", "Europe/Berlin", True, us(2025, 3, 10, 10, 20)),
        ("4 de septiembre de 2024 a las 05:23", "America/Bogota", True, us(2024, 9, 4, 10, 23)),
        ("25 октября 2024 г., 05:21", "Europe/Moscow", True, us(2024, 10, 25, 2, 21)),
        ("Tue Oct  1 02:56:57 CDT 2024", None, None, us(2024, 10, 1, 7, 56, 57)),
        ("2025-08-09T02:29:25[Asia/Tokyo]", "UTC", None, us(2025, 8, 8, 17, 29, 25)),
        ("2024-09-02T10:24:17 America/Bogota", "UTC", None, us(2024, 9, 2, 15, 24, 17)),
        ("1726134152.422854", None, None, 1726134152422854),
        ("1725989514593", None, None, 1725989514593000),
        ("2024-09-01T12:28:21.190239378Z", None, None, us(2024, 9, 1, 12, 28, 21) + 190239),
        # twice: the earlier; skipped: the offset before the change
        ("2024-11-03T01:30:00", "America/New_York", False, us(2024, 11, 3, 5, 30)),
        ("2025-03-09T02:30:00", "America/New_York", False, us(2025, 3, 9, 7, 30)),
        ("24/09/24 05:43", "UTC", True, us(2024, 9, 24, 5, 43)),
        *[(t, "UTC", True, None) for t in ("", "  ", "TBD", "2024-02-30T01:10:00Z", "32/11/2025", "2024-04-18T27:61:00", "Tue, 15 Dienstag", "x" * 5000)],
        (None, "UTC", True, None),
    ],
)
def test_parse(text, zone, first, want):
    assert parse_instant(text, zone, first) == want


def test_rows_kept_and_clashes(spark, tmp_path):
    src = spark.createDataFrame([("a", "Europe/Paris", True), ("a", "Europe/Paris", True)], SOURCES)
    rows = [("1", "2024-01-01 10:00", "a", "old", 1), ("1", "2024-01-01 10:00", "a", "old", 1), ("2", None, "a", None, 2), ("3", "2024-01-01 10:00", "none", None, 3), (None, "2024-01-01", None, None, 4)]
    out = normalise_instants(spark.createDataFrame(rows, ARTICLES), src)
    assert sorted((r.id or "", r.utc_us or 0) for r in out.collect()) == [("", us(2024, 1, 1)), ("1", us(2024, 1, 1, 9)), ("1", us(2024, 1, 1, 9)), ("2", 0), ("3", us(2024, 1, 1, 10))]
    assert sorted(map(tuple, found_instants(spark.createDataFrame(rows, ARTICLES), src).collect())) == [("1", us(2024, 1, 1, 9)), ("3", us(2024, 1, 1, 10))]
    assert found_instants(spark.createDataFrame([], ARTICLES), src).count() == 0


def test_dictionary_grows(spark, tmp_path):
    schema, path = "t string, z string, f boolean", str(tmp_path / "dict")
    assert extend_dictionary(spark.createDataFrame([("2024-01-01", None, None)], schema), "t", "z", "f", path).count() == 1
    assert extend_dictionary(spark.createDataFrame([("2024-01-01", None, None), ("2024-01-02", None, None)], schema), "t", "z", "f", path).count() == 2


def test_dictionary_with_repeated_entries(spark, tmp_path):
    src = spark.createDataFrame([("a", "Europe/Paris", True)], SOURCES)
    arts = spark.createDataFrame([("1", "2024-01-01 10:00", "a", None, 1), ("2", "no date", "a", None, 1)], ARTICLES)
    path = str(tmp_path / "kept")
    assert normalise_instants(arts, src, path=path).count() == 2
    spark.read.parquet(path).write.mode("append").parquet(path)  # another run appended the same entries
    assert normalise_instants(arts, src, path=path).count() == 2
    assert found_instants(arts, src, path).count() == 1
