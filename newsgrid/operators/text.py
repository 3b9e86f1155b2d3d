"""Text of HTML fragments, truncation and cleaning for word counts."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Code points that a stored summary has at most.
SUMMARY_LIMIT = 500
_SILENT = {"script", "style", "template"}


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs) -> None:
        self.silent += tag in _SILENT

    def handle_endtag(self, tag) -> None:
        self.silent = max(0, self.silent - (tag in _SILENT))

    def handle_data(self, data) -> None:
        if not self.silent:
            self.parts.append(data)


def html_text(fragment: str | None, separator: str = " ") -> str:
    """The text of an HTML fragment: its pieces stripped, empty ones dropped, the rest joined. Null gives ''; bad markup never fails."""
    if not fragment:
        return ""
    if "<" not in fragment and "&" not in fragment:
        return fragment.strip()
    parser = _Text()
    try:
        parser.feed(fragment)
        parser.close()
    except (AssertionError, ValueError):
        pass
    return separator.join(p.strip() for p in parser.parts if p.strip())


@pandas_udf(StringType())
def _html_to_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(html_text)


def html_to_text(column: Column) -> Column:
    """Text of an HTML column; plain text keeps out of Python."""
    plain = ~F.contains(column, F.lit("<")) & ~F.contains(column, F.lit("&"))
    return F.when(column.isNull(), "").when(plain, F.trim(column)).otherwise(_html_to_text(column))


def stored_summary(summary: Column, description: Column) -> Column:
    """Summary if there is one, even empty, else description, else ''; as text and at most `SUMMARY_LIMIT` code points."""
    return F.substring(html_to_text(F.coalesce(summary, description, F.lit(""))), 1, SUMMARY_LIMIT)


def clean_text(column: Column) -> Column:
    """Lower case, without links, all but Latin letters blank, white space squeezed and trimmed."""
    text = F.regexp_replace(F.lower(column), r"http\S+|www\S+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^a-zA-Z\s]", " "), r"\s+", " "))
