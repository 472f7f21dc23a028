"""Hard-negative mining: product quantisation with stored residual norms, bounds that hold, exact rerank.

Vectors of whole numbers are cut into parts of few components, and each part is stored as the number of
its nearest centroid, with the norm of what is left. A lookup table of an anchor's products with all
centroids gives any row's score up to the products of the parts' norms with the rows' residual norms.
So a row whose upper bound is below what enough rows reach for certain, or whose bounds lie outside the
window of an anchor's positive, is left out rigorously; the rest are scored exactly. Anchors are a stated
query set: rows are an index of packed blocks, which every chunk of anchors meets once for the positives
and once for the windows. Blocks give a bounded number of rows for each anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

EVERY, POSITIVES, NEGATIVES = 100, 5, 10
#: A negative's score is this share of its positive's, at least and at most, in hundredths.
LEAST, MOST = 30, 90
SCALE = 256
#: Components of a part, centroids of a part, rows of the sample on which they are fitted, rounds of the fit.
PART, CENTROIDS, FIT_ROWS, ROUNDS = 2, 256, 16_384, 8
#: Rows of a block of the index, anchors of a chunk, anchors that meet a block at once.
BLOCK_ROWS, CHUNK_ANCHORS, AT_ONCE = 8192, 4096, 64
#: Largest product sum that floating point holds exactly.
EXACT = 2.0**53


class Quantiser:
    """Centroids by part, fitted by k-means on a sample; equal samples give equal centroids."""

    def __init__(self, sample: np.ndarray, part: int = PART, centroids: int = CENTROIDS):
        dims = sample.shape[1]
        self.cuts = [(lo, min(lo + part, dims)) for lo in range(0, dims, part)]
        self.centroids = [self._fitted(sample[:, lo:hi], centroids) for lo, hi in self.cuts]

    @staticmethod
    def _fitted(x: np.ndarray, n: int) -> np.ndarray:
        unique = np.unique(x, axis=0)
        if len(unique) <= n:
            return unique.astype(np.float64)
        c = unique[np.linspace(0, len(unique) - 1, n).astype(int)].astype(np.float64)
        for _ in range(ROUNDS):
            near = Quantiser._nearest(x, c)
            count = np.bincount(near, minlength=n)
            sums = np.stack([np.bincount(near, weights=x[:, d], minlength=n) for d in range(x.shape[1])], axis=1)
            c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
        return c

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), dtype=np.int64)
        half = (c * c).sum(axis=1) / 2
        for lo in range(0, len(x), 4096):
            out[lo : lo + 4096] = (x[lo : lo + 4096] @ c.T - half).argmax(axis=1)
        return out

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and residual norms, a row each and a column for each part."""
        codes, norms = np.zeros((len(x), len(self.cuts)), np.uint8), np.zeros((len(x), len(self.cuts)), np.float32)
        for k, ((lo, hi), c) in enumerate(zip(self.cuts, self.centroids, strict=True)):
            codes[:, k] = self._nearest(x[:, lo:hi], c)
            left = np.sqrt(((x[:, lo:hi] - c[codes[:, k]]) ** 2).sum(axis=1))
            norms[:, k] = np.nextafter(left.astype(np.float32), np.float32(np.inf))  # never below the norm
        return codes, norms

    def bounds(self, anchors: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the products of anchors with coded rows."""
        middle = np.zeros((len(anchors), len(codes)))
        lengths = np.zeros((len(anchors), len(self.cuts)))
        for k, ((lo, hi), c) in enumerate(zip(self.cuts, self.centroids, strict=True)):
            middle += (anchors[:, lo:hi] @ c.T)[:, codes[:, k]]  # the lookup table
            lengths[:, k] = np.sqrt((anchors[:, lo:hi] ** 2).sum(axis=1))
        room = lengths @ norms.T.astype(np.float64)
        room += 1e-9 * (np.abs(middle) + room) + 1e-6  # of rounding
        return middle - room, middle + room


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of each row of a with the same row of b."""
    if not a.size or np.abs(a).max(initial=0).astype(float) * np.abs(b).max(initial=0).astype(float) * a.shape[1] < EXACT:
        return (a * b).sum(axis=1)
    return np.array([sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for p, q in zip(a, b, strict=True)], dtype=np.int64).reshape(len(a))


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, _label, _x (whole numbers), _dims of the rows that take part."""
    v = F.col("embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(True)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.transform(v, lambda x: F.floor(SCALE * x.cast("double")).cast("long")).alias("x"), F.col("label").cast("long").alias("label")).alias("_r"))
    rows = rows.groupBy("vec_id").agg(F.min("_r").alias("_r"))
    return rows.select("vec_id", F.col("_r.label").alias("_label"), F.col("_r.x").alias("_x"), F.size("_r.x").alias("_dims"))


def matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.array(column.to_list(), dtype=np.int64).reshape(len(column), dims)


def sampled(base: DataFrame, n: int, dims: int) -> np.ndarray:
    """About FIT_ROWS of base's n vectors, chosen by a hash where they lie: an ordered limit would bring FIT_ROWS rows of every partition to the driver."""
    order = F.xxhash64("vec_id")
    some = base.select("vec_id", "_x") if n <= FIT_ROWS else base.filter(F.pmod(order, F.lit(n)) < FIT_ROWS).select("vec_id", "_x")
    told = some.toArrow()
    x = told["_x"].combine_chunks().flatten().to_numpy().reshape(len(told), dims) if len(told) else np.zeros((0, dims), dtype=np.int64)
    return x[np.argsort(told["vec_id"].to_numpy(), kind="stable")].astype(np.float64)


INDEX = "_block int, _n int, _ids binary, _labels binary, _codes binary, _norms binary, _x binary"


def index(rows: DataFrame, quantiser: Quantiser, dims: int, blocks: int) -> DataFrame:
    """INDEX: each block of rows packed in one row."""

    def packed(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("vec_id")
        x = matrix(g["_x"], dims)
        codes, norms = quantiser.encode(x.astype(np.float64))
        return pd.DataFrame([(int(g["_block"].iloc[0]), len(g), g["vec_id"].to_numpy("<i8").tobytes(), g["_label"].to_numpy("<i8").tobytes(), codes.tobytes(), norms.tobytes(), x.astype("<i8").tobytes())], columns=["_block", "_n", "_ids", "_labels", "_codes", "_norms", "_x"])

    return rows.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("_block").applyInPandas(packed, INDEX)


class Block:
    def __init__(self, row: dict, dims: int, parts: int):
        n = row["_n"]
        self.ids, self.labels = np.frombuffer(row["_ids"], "<i8"), np.frombuffer(row["_labels"], "<i8")
        self.codes, self.norms = np.frombuffer(row["_codes"], np.uint8).reshape(n, parts), np.frombuffer(row["_norms"], np.float32).reshape(n, parts)
        self.x = np.frombuffer(row["_x"], "<i8").reshape(n, dims)


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value; none: no bound."""
    return float(np.partition(values, -k)[-k]) if len(values) >= k else -np.inf


def positives_in(b: Block, q: Quantiser, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, k: int) -> list[tuple]:
    """(anchor, row, score): of each anchor the first k other rows of its label in the block."""
    out = []
    for lo in range(0, len(ids), AT_ONCE):
        low, high = q.bounds(x[lo : lo + AT_ONCE].astype(np.float64), b.codes, b.norms)
        for j in range(len(low)):
            own = np.flatnonzero((b.labels == labels[lo + j]) & (b.ids != ids[lo + j]))
            can = own[high[j, own] >= kth(low[j, own], k)]
            score = products(np.broadcast_to(x[lo + j], (len(can), x.shape[1])), b.x[can])
            out += [(int(ids[lo + j]), int(b.ids[can[i]]), int(score[i])) for i in first(score, b.ids[can], k)]
    return out


def negatives_in(b: Block, q: Quantiser, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, wanted: list[list[tuple]], k: int, least: int, most: int) -> list[tuple]:
    """(anchor, positive, positive's score, row, score): of each anchor's positive the first k rows of other labels in its window, within the block."""
    out = []
    for lo in range(0, len(ids), AT_ONCE):
        low, high = q.bounds(x[lo : lo + AT_ONCE].astype(np.float64), b.codes, b.norms)
        for j in range(len(low)):
            other = np.flatnonzero(b.labels != labels[lo + j])
            below, above = low[j, other], high[j, other]
            for positive, score in wanted[lo + j]:
                bottom, top = least * score / 100, most * score / 100
                sure = below[(below >= bottom + 1) & (above <= top - 1)]  # inside the window for certain
                can = other[(above >= max(bottom - 1, kth(sure, k))) & (below <= top + 1)]
                exact = products(np.broadcast_to(x[lo + j], (len(can), x.shape[1])), b.x[can])
                inside = np.array([least * score <= 100 * s <= most * score for s in exact.tolist()], dtype=bool)
                can, exact = can[inside], exact[inside]
                out += [(int(ids[lo + j]), positive, score, int(b.ids[can[i]]), int(exact[i])) for i in first(exact, b.ids[can], k)]
    return out


def met(blocks: DataFrame, asked: DataFrame, n_blocks: int, n_anchors: int, each, schema: str) -> DataFrame:
    """Every block with every chunk of anchors: asked (vec_id, _label, _x, ...) is packed by chunks, which are dealt to all blocks by key. each(block row, chunk's columns) gives rows.

    Both sides are shuffled to the join: a plan takes the chunks' copies for as small as the chunks, and would gather them all on the driver for a broadcast."""
    chunks = max(1, -(-n_anchors // CHUNK_ANCHORS))
    columns = [c for c in asked.columns if c != "_dims"]
    packed = asked.withColumn("_chunk", F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(chunks)).cast("int")).groupBy("_chunk").agg(F.collect_list(F.struct(*columns)).alias("_asked"))
    dealt = packed.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    parts = min(n_blocks * chunks, max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * blocks.sparkSession.sparkContext.defaultParallelism))
    placed = lambda df: df.repartition(parts, "_block", "_chunk").hint("merge")
    both = placed(blocks.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))).join(placed(dealt), ["_block", "_chunk"])
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if rows := each(row):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return both.mapInArrow(run, schema)


def mine(rows: DataFrame, *, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, part: int = PART, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id is divisible by `every`; a positive is one of an anchor's first `positives` other rows of its label, and its negatives are the first `negatives` rows of other labels whose score is from `least` to `most` hundredths of the positive's. First: larger integer product, ties to the smaller vec_id. Rows with a null id, label, vector or component, or one that is not finite, take no part; zero vectors do. Of rows that repeat a vec_id that with the smallest vector, then label, stays. Vectors of several lengths are as many searches, a product being one of vectors of the same length; an empty table gives none; other columns don't matter. Scores are exact as long as they fit a long."""
    spark = common.prepare(rows.sparkSession)
    base = common.materialize(usable(rows), "vectors")
    told = base.groupBy("_dims").agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("anchors")).filter("anchors > 0").orderBy("_dims").collect()
    found = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for t in told:  # mostly one length
        found = found.unionByName(_mined(base.filter(F.col("_dims") == t["_dims"]), t["_dims"], t["n"], t["anchors"], every, positives, negatives, least, most, part, block_rows))
    return found


def _mined(base: DataFrame, dims: int, n: int, n_anchors: int, every: int, positives: int, negatives: int, least: int, most: int, part: int, block_rows: int) -> DataFrame:
    quantiser = Quantiser(sampled(base, n, dims), part)
    parts, n_blocks = len(quantiser.cuts), max(1, -(-n // block_rows))
    blocks = common.materialize(index(base, quantiser, dims, n_blocks), "index")
    anchors = base.filter(F.col("vec_id") % every == 0).select("vec_id", "_label", "_x")

    def columns(asked: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array([a["vec_id"] for a in asked]), np.array([a["_label"] for a in asked]), np.array([a["_x"] for a in asked], dtype=np.int64).reshape(len(asked), dims)

    near = met(blocks, anchors, n_blocks, n_anchors, lambda row: positives_in(Block(row, dims, parts), quantiser, *columns(row["_asked"]), positives), "anchor_id long, positive_id long, score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    near = near.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= positives)
    wanted = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "score")).alias("_wanted"))  # few for each anchor
    asked = common.materialize(anchors.join(wanted, "vec_id"), "positives")

    def windows(row: dict) -> list[tuple]:
        w = [[(p["positive_id"], p["score"]) for p in a["_wanted"]] for a in row["_asked"]]
        return negatives_in(Block(row, dims, parts), quantiser, *columns(row["_asked"]), w, negatives, least, most)

    far = met(blocks, asked, n_blocks, n_anchors, windows, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """mine() over embeddings, after each seventh label has moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")))


OP11_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(CAST(a.x AS DOUBLE[]), CAST(b.x AS DOUBLE[])) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""
