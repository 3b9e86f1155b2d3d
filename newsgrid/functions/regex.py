"""Whole-word patterns and Unicode-aware trimming as Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Characters of a word.
WORD = r"[\p{L}\p{N}_]"


def word_pattern(keyword: str) -> str:
    """A Java pattern for a keyword in lower case that starts and ends at a change between word and other characters."""
    low = keyword.lower()
    is_word = re.compile(r"\w")
    before = f"(?<!{WORD})" if is_word.match(low[0]) else f"(?<={WORD})"
    after = f"(?!{WORD})" if is_word.match(low[-1]) else f"(?={WORD})"
    return f"{before}\\Q{low}\\E{after}"


def strip(text: Column) -> Column:
    """Text without white space at either end, of any kind."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")
