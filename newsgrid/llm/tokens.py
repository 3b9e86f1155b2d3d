"""Sizes of texts in tokens of a public tokenizer, read from a vocabulary file of ranks."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Vocabulary file: one token in base 64 and its rank a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How text is split before pairs of bytes are merged: the published pattern of byte-level vocabularies of this kind.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=4)
def tokenizer(path: str = VOCABULARY):
    """The tokenizer of a vocabulary file; kept for the life of a Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(encoding, text: str | None) -> int | None:
    if text is None:
        return None
    try:
        return len(encoding.encode_ordinary(text))
    except UnicodeEncodeError:
        return len(encoding.encode_ordinary(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")))


def count_tokens(df: DataFrame, keep: tuple[str, ...], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The columns `keep` with `tokens bigint`: the size of the whole text; null for a null text, 0 for an empty one.

    Strings that are special tokens elsewhere are ordinary text.
    """
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(path)
        for b in batches:
            sizes = [_count(encoding, t) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(sizes, pa.int64())], [*keep, "tokens"])

    return df.select(*keep, text).mapInArrow(run, f"{fields}, tokens bigint")
