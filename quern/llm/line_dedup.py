"""Line dedup: hashes of lines, range-partitioned and sorted by document and position, streamed.

A line becomes two 64-bit hashes, its document and its position. The range partitioning is by hashes
and document, so a line found everywhere spreads over many partitions, and no document's places of one
line are parted. A stream over a partition sees the largest document of a line first; later ones are
dropped once enough documents hold it. Lines at either end of a partition may go on in the next:
their places wait for totals, of which each partition gives two at most. Out come compressed keep
bitmaps, a few bytes for each document that loses a line.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LEAST_CHARS, LEAST_DOCS = 40, 5
#: _kind of what the stream gives: a place to drop, a place that waits, a total.
DROP, WAIT, TOTAL = 0, 1, 2


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(common.SPACES)), common.UPPER, common.LOWER)


def places(docs: DataFrame, *, least_chars: int = LEAST_CHARS) -> DataFrame:
    """_h1, _h2, _doc, _row, _pos of every line whose key has least_chars code points at least. _row tells rows of one id apart by their text; null ids come before all others."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_doc"), F.xxhash64(text).alias("_row"), F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line"))
    keyed = lines.withColumn("_key", line_key(F.col("_line"))).filter(F.char_length("_key") >= least_chars)
    return keyed.select(F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), "_key").alias("_h2"), "_doc", "_row", "_pos")


class _Stream:
    """The run that goes on from one batch to the next. Held back are its places in the largest document and, until enough documents hold the line, those in the others."""

    def __init__(self, least_docs: int):
        self.least, self.first, self.key = least_docs, True, None

    def add(self, doc: np.ndarray, row: np.ndarray, pos: np.ndarray, key: tuple[int, int]) -> Iterator[pa.RecordBatch]:
        if key != self.key:
            yield from self.close(False)
            self.key, self.top, self.docs, self.last = key, int(doc[0]), 1, int(doc[0])
            self.held: list[tuple[np.ndarray, ...]] = []
            self.kept: list[tuple[np.ndarray, ...]] = []
        self.docs += int(np.count_nonzero(np.diff(doc))) + int(doc[0] != self.last)
        self.last = int(doc[-1])
        for to, which in ((self.kept, doc == self.top), (self.held, doc != self.top)):
            if which.any():
                to.append((doc[which], row[which], pos[which]))
        if self.docs >= self.least and self.held:  # a larger document and enough others hold it, whatever follows
            yield _told(DROP, *map(np.concatenate, zip(*self.held, strict=True)), self.key, 0)
            self.held = []

    def close(self, end: bool) -> Iterator[pa.RecordBatch]:
        """end: the partition ends here."""
        if self.key is not None and (self.first or end):
            yield _told(WAIT, *map(np.concatenate, zip(*self.held, *self.kept, strict=True)), self.key, 0)
            yield _told(TOTAL, np.array([self.top]), np.array([0]), np.array([0]), self.key, self.docs)
        if self.key is not None:
            self.first = False


SCHEMA = "_kind int, _h1 long, _h2 long, _doc long, _row long, _pos int, _docs long"


def _told(kind: int, doc: np.ndarray, row: np.ndarray, pos: np.ndarray, key: tuple[int, int], docs: int) -> pa.RecordBatch:
    n = len(doc)
    of = lambda v, t: pa.array(np.full(n, v), t)
    return pa.RecordBatch.from_arrays([of(kind, pa.int32()), of(key[0], pa.int64()), of(key[1], pa.int64()), pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(pos, pa.int32()), of(docs, pa.int64())], names=["_kind", "_h1", "_h2", "_doc", "_row", "_pos", "_docs"])


def streamed(sorted_places: DataFrame, least_docs: int) -> DataFrame:
    """What a stream over each partition tells. The runs inside a batch are told together; only its last goes on in the next."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _Stream(least_docs)
        for b in batches:
            if not b.num_rows:
                continue
            h1, h2, doc, row, pos = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            change = np.flatnonzero((np.diff(h1) != 0) | (np.diff(h2) != 0)) + 1
            starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(h1)]])
            yield from s.add(doc[: ends[0]], row[: ends[0]], pos[: ends[0]], (int(h1[0]), int(h2[0])))
            if len(starts) > 1:
                lo, hi = starts[1], starts[-1]
                if hi > lo:  # whole runs, all at once
                    run = np.repeat(np.arange(len(starts) - 2), ends[1:-1] - starts[1:-1])
                    d = doc[lo:hi]
                    fresh = np.concatenate([[True], (np.diff(d) != 0) | (np.diff(run) != 0)])
                    docs = np.bincount(run, weights=fresh).astype(np.int64)
                    go = (docs[run] >= least_docs) & (d != doc[starts[1:-1]][run])
                    if go.any():
                        n = int(go.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, DROP), pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(d[go]), pa.array(row[lo:hi][go]), pa.array(pos[lo:hi][go], pa.int32()), pa.nulls(n, pa.int64())], names=["_kind", "_h1", "_h2", "_doc", "_row", "_pos", "_docs"])
                yield from s.add(doc[hi:], row[hi:], pos[hi:], (int(h1[hi]), int(h2[hi])))
        yield from s.close(True)

    return sorted_places.mapInArrow(each, SCHEMA)


def bitmap(places_: np.ndarray) -> bytes:
    """Keep bits, the first line's highest in the first byte, up to the last dropped line (lines after it are kept), packed and compressed."""
    keep = np.ones(int(places_.max()) + 1, dtype=bool)
    keep[places_] = False
    return zlib.compress(np.packbits(keep).tobytes() + bytes([len(keep) % 8]), 6)


def kept_lines(text: str, packed: bytes) -> tuple[str, int]:
    """The text without the lines that a bitmap drops, and their number."""
    raw = zlib.decompress(packed)
    keep = np.unpackbits(np.frombuffer(raw[:-1], dtype=np.uint8))
    if raw[-1]:
        keep = keep[: len(keep) - 8 + raw[-1]]
    lines = text.split("\n")
    return "\n".join([x for x, k in zip(lines, keep, strict=False) if k] + lines[len(keep) :]), int(len(keep) - keep.sum())


def bitmaps(docs: DataFrame, *, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """_doc, _row, _bitmap of every document that loses a line."""
    found = common.materialize(places(docs, least_chars=least_chars), "places")  # range partitioning reads its input twice
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = found.repartitionByRange(n, "_h1", "_h2", "_doc").sortWithinPartitions("_h1", "_h2", F.desc("_doc"), "_row", "_pos")
    told = common.materialize(streamed(ordered, least_docs), "lines")
    totals = told.filter(F.col("_kind") == TOTAL).groupBy("_h1", "_h2").agg(F.sum("_docs").alias("_n"), F.max("_doc").alias("_top")).filter(F.col("_n") >= least_docs)
    late = told.filter(F.col("_kind") == WAIT).drop("_docs").join(F.broadcast(totals), ["_h1", "_h2"]).filter(F.col("_doc") < F.col("_top"))
    gone = told.filter(F.col("_kind") == DROP).select("_doc", "_row", "_pos").unionByName(late.select("_doc", "_row", "_pos"))

    @F.pandas_udf("binary")
    def packed(pos: pd.Series) -> pd.Series:
        return pos.map(bitmap)

    return gone.groupBy("_doc", "_row").agg(F.collect_set("_pos").alias("_at")).select("_doc", "_row", packed("_at").alias("_bitmap"))


def dedup(docs: DataFrame, *, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The columns of docs, with _text (without the dropped lines), _n_lines (before) and _n_dropped. Null and empty texts have one empty line. Rows that repeat stay; rows of one id count as one document, each with its own lines; columns with a name that is used here give way."""
    docs = common.giving_way(docs, "_text", "_n_lines", "_n_dropped", "_doc", "_row", "_bitmap", "_kept")
    text = F.coalesce("text", F.lit(""))
    marks = bitmaps(docs, least_chars=least_chars, least_docs=least_docs)
    tagged = docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_row": F.xxhash64(text)})

    @F.pandas_udf("struct<text: string, n: int>")
    def applied(texts: pd.Series, packed: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, 0) if p is None else kept_lines(t, p) for t, p in zip(texts, packed, strict=True)], columns=["text", "n"])

    joined = tagged.join(marks, ["_doc", "_row"], "left")
    touched = F.when(F.col("_bitmap").isNotNull(), text)  # other texts stay in the JVM
    joined = joined.withColumn("_kept", applied(touched, F.col("_bitmap")))
    lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return joined.select(*docs.columns, F.coalesce(F.col("_kept.text"), text).alias("_text"), lines.cast("long").alias("_n_lines"), F.col("_kept.n").cast("long").alias("_n_dropped"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_text", 256).alias("kept_sha256"))


OP3_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.*, frequent.top IS NOT NULL AND keyed.doc_id <> frequent.top AS gone FROM keyed LEFT JOIN frequent ON keyed.k = frequent.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
