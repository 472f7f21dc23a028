"""Best-fit-decreasing packing of token sequences, over all documents at once.

Best fit decreasing looks at lengths alone, and equal lengths are interchangeable. So the whole
packing follows from how many pieces there are of each length: at most `capacity` counts, however
many documents. A segment tree over remaining capacities finds the tightest class of open bins in
logarithmic time; bins of one class are placed together. The layout that comes out, a list of runs of
equal pieces, is applied to the pieces by their rank among those of their length.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, common

CAPACITY, END_ID = 4096, 1
#: Pieces of one length are ranked in so many hashed buckets at least, and in one for so many pieces at least.
BUCKETS, BUCKET_ROWS = 64, 1_000_000


class CapacityTree:
    """A segment tree over remaining capacities 0..size: which of them have open bins."""

    def __init__(self, size: int):
        self.half = 1 << size.bit_length()
        self.has = [False] * (2 * self.half)

    def put(self, at: int, value: bool) -> None:
        i = at + self.half
        self.has[i] = value
        while (i := i >> 1) and self.has[i] != (now := self.has[2 * i] or self.has[2 * i + 1]):
            self.has[i] = now

    def tightest(self, least: int) -> int:
        """The smallest remaining capacity of at least `least` with an open bin; -1 if there is none."""
        i = least + self.half
        if self.has[i]:
            return least
        while i > 1:
            if not i & 1 and self.has[i + 1]:
                i += 1
                while i < self.half:
                    i = 2 * i if self.has[2 * i] else 2 * i + 1
                return i - self.half
            i >>= 1
        return -1


def layout(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, pieces, first bin, pieces a bin, first offset) and the number of bins, from the number of pieces by length.

    Pieces go longest first, each into the tightest open bin it fits, else into a new one. A bin of the
    tightest class that got a piece is tighter still, so it takes pieces until none fits: whole
    intervals of equal bins are filled at once."""
    tree, bins = CapacityTree(capacity), 0
    open_: dict[int, list[tuple[int, int]]] = {}
    runs = []

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_.setdefault(room, []).append((first, n))
            tree.put(room, True)

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_[room].pop()
                if not open_[room]:
                    tree.put(room, False)
            per = room // length
            took = min(left, n * per)
            full, rest = divmod(took, per)
            runs.append((length, rank, took, first, per, capacity - room))
            put(room - per * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), n - full - bool(rest))
            left, rank = left - took, rank + took
    return np.array(runs, dtype=np.int64).reshape(-1, 6), bins


class Tokens:
    """The ids of the tokenizers library: texts are split into words as bpe has it, and the library's model gives the ids of each word, which are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model
        self.own = bpe.WordBPE(path)
        self.own.make = self.word
        self.symbols = dict(enumerate(bpe.byte_symbols()))

    def word(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.symbols))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        return self.own.encode(text)


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    """One for each Python worker."""
    return Tokens(path)


def pieces(docs: DataFrame, path: str, *, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids and its end id. Null texts count as empty: one piece that holds the end id alone."""
    common.prepare(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens(path).encode
        end = np.array([END_ID], dtype="<u4").tobytes()
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(t or "") + end
                for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo : lo + 4 * capacity]
                    for to, x in zip(out, (doc, k, lo // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(cut: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with a length of 1 to capacity. Gives as many sequences as best fit decreasing over all pieces does; an empty table gives none.

    To the driver go the counts by length (at most `capacity` rows); back go the runs of the layout, whose number depends on the lengths, not on the rows."""
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    runs, _ = layout(counts, capacity)
    buckets = max(BUCKETS, -(-sum(counts.values()) // BUCKET_ROWS))
    tagged = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = tagged.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_b", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    ranked = tagged.withColumn("_r", F.row_number().over(inside) - 1).join(before, ["length", "_b"]).withColumn("_r", F.col("_r") + F.col("_before"))
    keep = [*cut.columns]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    span = int(max(counts.values(), default=0)) + 1
    keys = runs[:, 0] * span + runs[:, 1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_r"))
            run = runs[np.searchsorted(keys, length * span + rank, side="right") - 1]
            bin_, at = np.divmod(rank - run[:, 1], run[:, 4])
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(run[:, 3] + bin_), pa.array(run[:, 5] + at * length)], names=[*keep, "sequence_id", "offset"])

    return ranked.select(*keep, "_r").mapInArrow(each, schema)


def pack(docs: DataFrame, path: str, *, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Documents longer than capacity alone are cut. Null and empty texts are one piece with the end id alone; rows that repeat are packed as often as they come; which of equally long pieces takes which place is settled by their ids; an empty table gives none; other columns don't matter."""
    return place(common.materialize(pieces(docs, path, capacity=capacity), "pieces"), capacity=capacity)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), common.tokenizer_path())
