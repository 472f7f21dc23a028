"""Keyword dictionaries of any size in one pass: texts meet keywords in an equi-join on windows."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import runtime
from ..functions import text as X

#: Bits of the filter that a text's windows pass before the join: 128 KB whatever the dictionary's size.
BITS = 1 << 20
#: Windows of a text that are made different at once.
TOGETHER = 1 << 14
WORD = re.compile("[a-z0-9]+")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def shape(keyword: str = "keyword") -> Column:
    """What windows of a text may equal a lower-cased keyword: kind, and three numbers. Kind w: so many words, characters before the first and after the last; s: signs alone, so many; c: so many characters, of which the first outside ASCII stands there."""
    k = F.col(keyword)
    count = lambda pattern: F.length(F.regexp_extract(k, pattern, 0))
    words = F.size(F.regexp_extract_all(k, F.lit("[a-z0-9]+"), F.lit(0)))
    of = lambda kind, *n: F.struct(F.lit(kind).alias("kind"), *(x.cast("int").alias(f"n{i}") for i, x in enumerate(n)))
    zero = F.lit(0)
    return F.when(~k.rlike(r"\A[\x00-\x7F]*\z"), of("c", F.length(k), count(r"\A[\x00-\x7F]*"), zero)).when(words == 0, of("s", F.length(k), zero, zero)).otherwise(of("w", words, count(r"\A[^a-z0-9]*"), count(r"[^a-z0-9]*\z")))


def spans(text: str, words: list[tuple[int, int]], kind: str, a: int, b: int, c: int) -> Iterator[tuple[int, int]]:
    """The windows of one shape."""
    if kind == "w":
        yield from ((words[i][0] - b, words[i + a - 1][1] + c) for i in range(len(words) - a + 1))
    elif kind == "s":
        yield from ((i, i + a) for i in range(len(text) - a + 1))
    else:
        yield from ((m.start() - b, m.start() - b + a) for m in re.finditer(r"[^\x00-\x7F]", text))


def windows(text: str, shapes: Sequence[tuple[str, int, int, int]], bits: bytes) -> set[str]:
    """The different windows of a lower-cased text that have one of the shapes, stand between no letters or digits (kind c: anywhere) and pass the filter."""
    words, out = [m.span() for m in WORD.finditer(text)], set()
    for kind, *n in shapes:
        places = spans(text, words, kind, *n)
        alone = kind == "c" or (kind == "w" and n[1:] == [0, 0])  # a run of whole words always stands alone
        while some := list(islice(places, TOGETHER)):
            if alone:
                different = {text[lo:hi] for lo, hi in some if 0 <= lo and hi <= len(text)}
            else:
                different = {text[lo:hi] for lo, hi in some if 0 <= lo and hi <= len(text) and not ((lo and text[lo - 1] in LETTERS) or text[hi : hi + 1] in LETTERS)}
            for w in different - out:
                at = crc32(w.encode("utf-8", "surrogatepass")) % BITS
                if bits[at >> 3] >> (at & 7) & 1:
                    out.add(w)
    return out


def hits(docs: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """key, keyword, label: for each row of docs every dictionary keyword that its whole text has, once, letter case aside: ASCII ones between characters that are no letters or digits, others anywhere. A row without any has one row of nulls. dictionary: keyword, label; a keyword may have several labels; null and empty keywords are in no text, as nothing is in a null text.

    A text's windows are cut in one pass for the shapes that the dictionary's keywords have (few: numbers of words and of signs around them), and those that pass a filter of fixed size meet the keywords in an equi-join: ten thousand keywords cost about what ten do. To the driver come the shapes and the filter's set bits."""
    words = runtime.written(dictionary.select(F.lower("keyword").alias("keyword"), "label").filter("keyword <> ''").distinct(), "dictionary")
    shapes = [tuple(r[0]) for r in words.select(shape().alias("s")).distinct().collect()]
    bits = np.zeros(BITS // 8, dtype=np.uint8)
    at = np.array([r[0] for r in words.select((F.crc32(F.encode("keyword", "UTF-8")) % BITS).cast("int")).distinct().collect()], dtype=np.int64)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    mask = bits.tobytes()
    runtime.prepare(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for i, t in enumerate(b.column(1)):
                some = windows(t.as_py() or "", shapes, mask) or [None]
                rows += [i] * len(some)
                found += some
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=["_key", "_w"])

    schema = T.StructType([T.StructField("_key", docs.schema[key].dataType), T.StructField("_w", T.StringType())])
    met = docs.select(F.col(key).alias("_key"), F.lower(F.col(text)).alias("_t")).mapInArrow(cut, schema).join(words, F.col("_w") == F.col("keyword"), "left")
    return met.select(F.col("_key").alias(key), "keyword", "label")


def tagged_by(docs: DataFrame, key: str, text: str, dictionary: DataFrame, priority: Sequence[str] = ()) -> DataFrame:
    """key, labels (all of its hits, sorted), primary (the first by priority, else the first of the rest, else other) and n_keywords (different keywords found), one row a key."""
    by = hits(docs, key, text, dictionary).groupBy(key).agg(F.sort_array(F.collect_set("label")).alias("labels"), F.count_distinct("keyword").alias("n_keywords"))
    first = F.get(F.filter(X.words_of(priority), lambda p: F.array_contains("labels", p)), F.lit(0)) if priority else F.lit(None).cast("string")
    return by.select(key, "labels", F.coalesce(first, F.get("labels", F.lit(0)), F.lit("other")).alias("primary"), "n_keywords")
