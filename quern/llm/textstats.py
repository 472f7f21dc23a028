"""Statistics of one text, which the quality operators share."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

SYMBOLS = "#*$%&|<>"
WINDOW = 5
NAMES = ("n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_adjacent", "n_upper", "n_digits", "n_bangs", "n_pipes", "n_stops")
PREFIX = "_stat_"


def repeated(words: list) -> int:
    """Words that lie in a window of WINDOW words which is found twice or more, its first place included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k : k + n] for k in range(WINDOW)), strict=True))
    if len(set(windows)) == n:
        return 0
    found = Counter(windows)
    again = np.fromiter((found[w] > 1 for w in windows), dtype=bool, count=n)
    covered = np.zeros(len(words), dtype=bool)
    for k in range(WINDOW):
        covered[k : k + n] |= again
    return int(covered.sum())


def stats(text: str | None) -> tuple[int, ...]:
    """NAMES of a text; a null text counts as empty, and an empty text has one line and no word."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at ASCII white space
    n = len(words)
    lines = data.split(b"\n")
    dup = 0
    if len(lines) > 1:
        seen: set[bytes] = set()
        for line in lines:
            if line in seen:
                dup += 1
            elif line and not line.isspace():
                seen.add(line)
    gone = lambda chars: len(data) - len(data.translate(None, chars))
    return (
        len(text), n, len(text) - gone(common.SPACES.encode()), gone(SYMBOLS.encode()), len(lines), dup, repeated(words), len(set(words)), sum(map(eq, words, words[1:])),
        gone(common.UPPER.encode()), gone(b"0123456789"), data.count(b"!"), data.count(b"|"), gone(b".,;:?"),
    )


def with_stats(docs: DataFrame, *, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The kept columns (all, if none are named) and the statistics of each row's whole text, under PREFIX. No shuffle."""
    docs = common.giving_way(docs, *(PREFIX + n for n in NAMES))
    keep = docs.columns if keep is None else keep
    docs = docs.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(PREFIX + n, T.LongType()) for n in NAMES])
    names = schema.names

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index = {n: i for i, n in enumerate(b.schema.names)}
            found = np.array([stats(t) for t in b.column(index[text]).to_pylist()], dtype=np.int64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*(b.column(index[c]) for c in keep), *(pa.array(found[:, k]) for k in range(len(NAMES)))], names=names)

    return docs.mapInArrow(each, schema)
