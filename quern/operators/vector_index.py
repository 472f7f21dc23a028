"""A maintained vector index: inverted lists with product-quantised codes, searched approximately and scored exactly.

Cells come from a distributed k-means, and the parts of what is left after a cell's centre from one
more for each part. A row is stored in its cell's list with a byte for each part, its metadata and its
vector. A search takes the nearest lists of each query, keeps rows by their metadata, scores codes from
tables of products, and scores the vectors of the best exactly. How many lists and how many vectors
that takes is measured on a sample of stored rows when the index is built.

Upserts append rows to the lists under a new version, and note which ids they replace; older rows of
those are left out by a join on the id until compact() writes the lists anew.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import runtime
from . import vector as V

#: Lists at most; rows of a sample on which centres are fitted, for each list and at least; rounds of a fit.
MOST_LISTS, LIST_FIT_ROWS, FIT_ROWS, ROUNDS = 16_384, 64, 32_768, 6
#: Components of a part, centres of a part.
PART, CENTRES = 4, 256
#: Rows of a piece of a list, queries that meet a piece at once, rows of the sample on which a search is measured.
PIECE_ROWS, QUERY_ROWS, MEASURED = 32_768, 2048, 128
#: Cells whose sums travel together.
TOGETHER = 256


@dataclass(frozen=True)
class Index:
    """Where an index lies, and its model: centres of the cells (a row each) and of the parts, lists and vectors to look at."""

    path: str
    dims: int
    cells: np.ndarray
    parts: list[np.ndarray]
    probes: int = 1
    rescored: int = 100
    meta: tuple[str, ...] = ()

    def cuts(self) -> list[tuple[int, int]]:
        return [(lo, min(lo + PART, self.dims)) for lo in range(0, self.dims, PART)]


def matrix(column: pd.Series, dims: int) -> np.ndarray:
    """Unit vectors, a row each."""
    m = np.array(column.to_list(), dtype=np.float64).reshape(len(column), dims)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    out = np.empty(len(x), dtype=np.int64)
    at_once = max(1, V.SCORES // max(1, len(centres)))
    for lo in range(0, len(x), at_once):
        out[lo : lo + at_once] = (x[lo : lo + at_once] @ centres.T - half).argmax(axis=1)
    return out


def summed(rows: DataFrame, assign, spaces: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """One round of k-means in several spaces at once: counts and sums by centre. assign(vectors) gives for each space its vectors, their centres and the number of centres.

    Tasks add up their rows first; sums travel by TOGETHER centres, are added by key, and what comes to the driver is the size of the model."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: list[np.ndarray] | None = None
        for b in batches:
            for k, (x, at, n) in enumerate(assign(b["embedding"])):
                if total is None:
                    total = []
                if len(total) <= k:
                    total.append(np.zeros((n, x.shape[1] + 1)))
                np.add.at(total[k], at, np.concatenate([np.ones((len(x), 1)), x], axis=1))
        for k, t in enumerate(total or []):
            for lo in range(0, len(t), TOGETHER):
                yield pd.DataFrame([(k, lo, t[lo : lo + TOGETHER].tobytes(), t.shape[1])], columns=["_space", "_lo", "_sums", "_width"])

    def added(g: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in g["_sums"])
        return g.iloc[:1].assign(_sums=total.tobytes())

    schema = "_space int, _lo int, _sums binary, _width int"
    told = rows.select("embedding").mapInPandas(each, schema).groupBy("_space", "_lo").applyInPandas(added, schema).collect()
    out = []
    for k in range(spaces):
        own = sorted((r["_lo"], np.frombuffer(r["_sums"]).reshape(-1, r["_width"])) for r in told if r["_space"] == k)
        t = np.concatenate([x for _, x in own])
        out.append((t[:, 0], t[:, 1:]))
    return out


def moved(centres: np.ndarray, count: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Centres without rows stay where they are."""
    return np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)


def fitted(sample: DataFrame, dims: int, lists: int, rounds: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Centres of the cells and of the parts of what they leave, over a written sample."""
    start = matrix(sample.orderBy("_order").limit(max(lists, CENTRES)).select("embedding").toPandas()["embedding"], dims)
    cells = start[:lists]
    for _ in range(rounds):
        (count, sums), = summed(sample, lambda v, c=cells: [(x := matrix(v, dims), nearest(x, c), len(c))], 1)
        cells = moved(cells, count, sums)
    cuts = [(lo, min(lo + PART, dims)) for lo in range(0, dims, PART)]
    left = start[:CENTRES] - cells[nearest(start[:CENTRES], cells)]
    parts = [left[:, lo:hi] for lo, hi in cuts]

    def by_part(v: pd.Series, p: list[np.ndarray]) -> list[tuple]:
        x = matrix(v, dims)
        x = x - cells[nearest(x, cells)]
        return [(x[:, lo:hi], nearest(x[:, lo:hi], c), len(c)) for (lo, hi), c in zip(cuts, p, strict=True)]

    for _ in range(rounds):
        told = summed(sample, lambda v, p=parts: by_part(v, p), len(parts))
        parts = [moved(c, n, s) for c, (n, s) in zip(parts, told, strict=True)]
    return cells, parts


def coded(rows: DataFrame, index: Index, version: int) -> DataFrame:
    """The rows with _list, _code and _version."""

    @F.pandas_udf("struct<list: int, code: binary>")
    def code(v: pd.Series) -> pd.DataFrame:
        x = matrix(v, index.dims)
        at = nearest(x, index.cells)
        left = x - index.cells[at]
        codes = np.stack([nearest(left[:, lo:hi], c).astype(np.uint8) for (lo, hi), c in zip(index.cuts(), index.parts, strict=True)], axis=1)
        return pd.DataFrame({"list": at.astype(np.int32), "code": [c.tobytes() for c in codes]})

    return rows.withColumn("_c", code("embedding")).select("vec_id", "embedding", *index.meta, F.col("_c.list").alias("_list"), F.col("_c.code").alias("_code"), F.lit(version).alias("_version"))


def appended(rows: DataFrame, index: Index, version: int) -> None:
    """Rows go to their lists: a few files for each list, sorted by id."""
    coded(rows, index, version).repartition("_list").sortWithinPartitions("_list", "vec_id").write.partitionBy("_list").mode("append").parquet(f"{index.path}/lists")


def build(vectors: DataFrame, *, path: str | None = None, meta: tuple[str, ...] = (), lists: int | None = None, k: int = 10, recall: float = 0.95, rounds: int = ROUNDS) -> Index:
    """An index of vectors (vec_id, embedding and metadata columns) of one length. Rows without an id, and vectors that are null, zero or not finite, are left out; of rows that repeat an id that with the smallest vector stays. An empty table cannot be indexed: there is no length.

    Centres are fitted on a sample of FIT_ROWS rows or LIST_FIT_ROWS for each list, whichever is more; every row is indexed. Lists and vectors to look at are the fewest that reach the recall on a sample of MEASURED rows."""
    spark = runtime.prepare(vectors.sparkSession)
    rows = V.usable(vectors.select("vec_id", "embedding", *meta)).filter("vec_id IS NOT NULL")
    rows = rows.groupBy("vec_id").agg(F.min_by(F.struct("embedding", *meta), F.col("embedding")).alias("_r")).select("vec_id", "_r.*")
    rows = runtime.written(rows, "vectors")
    told = rows.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("d"), F.max(F.size("embedding")).alias("most")).first()
    if not told["n"] or told["d"] != told["most"]:
        raise ValueError("an index needs vectors, all of one length")
    lists = min(MOST_LISTS, told["n"], lists or max(1, math.isqrt(told["n"])))
    order = F.xxhash64(F.lit(5), "vec_id")
    size = max(FIT_ROWS, LIST_FIT_ROWS * lists)
    sample = rows.select("embedding", order.alias("_order"))
    sample = runtime.written(sample.filter(F.pmod(order, F.lit(told["n"])) < 2 * size) if told["n"] > 2 * size else sample, "sample")
    cells, parts = fitted(sample, told["d"], lists, rounds)
    index = Index(path or runtime.new_path(spark, "index"), told["d"], cells, parts, meta=meta)
    appended(rows, index, 0)
    spark.createDataFrame([], "vec_id long, version int").write.parquet(f"{index.path}/replaced")
    index = measured(index, rows, k, recall)
    saved = {"dims": index.dims, "cells": cells.tolist(), "parts": [p.tolist() for p in parts], "probes": index.probes, "rescored": index.rescored, "meta": list(meta)}
    spark.createDataFrame([(json.dumps(saved),)], "model string").write.parquet(f"{index.path}/model")
    return index


def opened(spark: SparkSession, path: str) -> Index:
    """An index that was built at a path."""
    m = json.loads(runtime.prepare(spark).read.parquet(f"{path}/model").first()[0])
    return Index(path, m["dims"], np.array(m["cells"]).reshape(-1, m["dims"]), [np.array(p) for p in m["parts"]], m["probes"], m["rescored"], tuple(m["meta"]))


def ranked_lists(index: Index, q: np.ndarray) -> np.ndarray:
    """Lists of each query, the most promising first: by the product with their centres."""
    return np.argsort(-(q @ index.cells.T), axis=1, kind="stable")


def measured(index: Index, rows: DataFrame, k: int, recall: float) -> Index:
    """index with the fewest lists, and the fewest vectors scored exactly, that hold so much of the exact neighbours of a sample: half of what may be lost is left to either."""
    share = (1 + recall) / 2
    asked = rows.orderBy(F.xxhash64(F.lit(9), "vec_id")).limit(MEASURED).select(F.col("vec_id").alias("query_id"), "embedding")
    asked = runtime.written(asked, "asked")
    truth = runtime.written(V.exact_knn(asked, rows, k).select("query_id", "vec_id"), "exact")
    held = stored(rows.sparkSession, index).join(truth.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "_list")
    told = truth.join(held, "vec_id").groupBy("query_id").agg(F.collect_list("_list").alias("_lists")).join(asked, "query_id").toPandas()
    if not len(told):
        return replace(index, probes=len(index.cells), rescored=k)
    order = ranked_lists(index, matrix(told["embedding"], index.dims))
    places = np.empty_like(order)
    np.put_along_axis(places, order, np.arange(order.shape[1])[None, :], axis=1)
    at = np.concatenate([p[x] for p, x in zip(places, told["_lists"], strict=True)])
    index = replace(index, probes=int(np.sort(at)[min(len(at) - 1, math.ceil(share * len(at)) - 1)]) + 1)
    near = candidates(index, asked, 50 * k)
    w = Window.partitionBy("query_id").orderBy(F.desc("approx"), "vec_id")
    found = near.withColumn("_place", F.row_number().over(w)).join(truth, ["query_id", "vec_id"]).select("_place").toPandas()["_place"].to_numpy()
    if not len(found):
        return replace(index, rescored=50 * k)
    return replace(index, rescored=max(2 * k, int(np.sort(found)[math.ceil(share * len(found)) - 1])))


def stored(spark: SparkSession, index: Index) -> DataFrame:
    """The rows of the lists that no later upsert replaced."""
    rows, over = spark.read.parquet(f"{index.path}/lists"), spark.read.parquet(f"{index.path}/replaced")
    over = over.groupBy("vec_id").agg(F.max("version").alias("_latest"))
    return rows.join(over, "vec_id", "left").filter("_latest IS NULL OR _version >= _latest").drop("_latest")


def candidates(index: Index, queries: DataFrame, most: int, where: Column | None = None) -> DataFrame:
    """query_id, vec_id, _list, approx: up to `most` rows of each query in each piece of its lists, by their codes; where keeps rows by their metadata before any is scored. A query's own id is left out."""
    spark = queries.sparkSession
    rows = stored(spark, index)
    rows = (rows if where is None else rows.filter(where)).select("_list", "vec_id", "_code")
    probes = min(index.probes, len(index.cells))

    @F.pandas_udf("array<int>")
    def lists_of(v: pd.Series) -> pd.Series:
        return pd.Series(list(ranked_lists(index, matrix(v, index.dims))[:, :probes].astype(np.int32)))

    asked = V.usable(queries.select("query_id", "embedding")).filter((F.col("_dims") == index.dims) & F.col("query_id").isNotNull())
    asked = asked.withColumn("_list", F.explode(lists_of("embedding"))).drop("_dims")
    sizes = rows.groupBy("_list").agg(F.ceil(F.count("*") / PIECE_ROWS).cast("int").alias("_pieces"))
    turns = asked.groupBy("_list").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("_turns"))
    both = sizes.join(turns, "_list")  # lists that are asked for and have rows
    data = rows.join(both, "_list").select("_list", F.pmod(F.xxhash64("vec_id"), F.col("_pieces")).cast("int").alias("_piece"), F.explode(F.sequence(F.lit(0), F.col("_turns") - 1)).alias("_turn"), "vec_id", "_code")
    asked = asked.join(both, "_list").select(F.col("_list").alias("_ql"), F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("_qp"), F.pmod(F.xxhash64("query_id"), F.col("_turns")).cast("int").alias("_qt"), "query_id", "embedding")
    schema = "query_id long, vec_id long, _list int, approx double"

    def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "_list": pd.Series(dtype="int32"), "approx": pd.Series(dtype="float64")})
        at, parts = int(key[0]), []
        codes = np.frombuffer(b"".join(left["_code"]), np.uint8).reshape(len(left), -1)
        ids, n, at_once = left["vec_id"].to_numpy(), min(most, len(left)), max(1, V.SCORES // len(left))
        for begin in range(0, len(right), at_once):
            some = right.iloc[begin : begin + at_once]
            q, own = matrix(some["embedding"], index.dims), some["query_id"].to_numpy()
            approx = np.repeat((q @ index.cells[at])[:, None], len(ids), axis=1)
            for k, ((lo, hi), c) in enumerate(zip(index.cuts(), index.parts, strict=True)):
                approx += (q[:, lo:hi] @ c.T)[:, codes[:, k]]  # the table of products
            approx[own[:, None] == ids[None, :]] = -np.inf
            best = np.argpartition(-approx, n - 1, axis=1)[:, :n]
            parts.append(pd.DataFrame({"query_id": np.repeat(own, n), "vec_id": ids[best].reshape(-1), "_list": at, "approx": np.take_along_axis(approx, best, axis=1).reshape(-1)}))
        out = pd.concat(parts, ignore_index=True)
        return out[np.isfinite(out["approx"])]

    return data.groupBy("_list", "_piece", "_turn").cogroup(asked.groupBy("_ql", "_qp", "_qt")).applyInPandas(one, schema)


def copies(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, _list: of the stored rows (_list, vec_id, _v) whose vector is equal to a query's (query_id, _q) the k with the smallest ids, but not its own id. A vector's rows are cut to k + 1 before they meet its queries."""
    least = Window.partitionBy("_h", "_v").orderBy("vec_id")
    asked = queries.select(F.xxhash64("_q").alias("_h"), "_q", "query_id")
    same = rows.withColumn("_h", F.xxhash64("_v")).join(asked.select("_h").distinct(), "_h", "left_semi")
    same = same.withColumn("_n", F.row_number().over(least)).filter(F.col("_n") <= k + 1)
    met = asked.join(same, "_h").filter((F.col("_q") == F.col("_v")) & (F.col("query_id") != F.col("vec_id")))
    return met.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("vec_id"))).filter(F.col("_n") <= k).select("query_id", "vec_id", "_list")


def search(index: Index, queries: DataFrame, k: int, *, where: Column | None = None, digits: int = 6) -> DataFrame:
    """query_id, vec_id, score, rank: approximately the k nearest of each query (query_id, embedding) by cosine, as exact_knn() gives them; scores are exact. where: a predicate on metadata. Queries of another length than the index's find nothing.

    Codes tell vectors of a dense cluster badly apart, so rows whose vector is equal to the query's are looked up by its hash as well, and always found."""
    spark = runtime.prepare(queries.sparkSession)
    best = Window.partitionBy("query_id").orderBy(F.desc("approx"), "vec_id")
    near = candidates(index, queries, index.rescored, where).withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= index.rescored).drop("_place", "approx")
    vectors = stored(spark, index)
    vectors = (vectors if where is None else vectors.filter(where)).select("_list", "vec_id", F.col("embedding").alias("_v"))
    asked = V.usable(queries.select("query_id", "embedding")).filter(F.col("query_id").isNotNull()).select("query_id", F.col("embedding").alias("_q"))
    near = near.select("query_id", "vec_id", "_list").unionByName(copies(vectors, asked, k)).distinct()
    both = near.join(vectors, ["_list", "vec_id"]).join(asked, "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cosine = dot(F.col("_q"), F.col("_v")) / F.sqrt(dot(F.col("_q"), F.col("_q"))) / F.sqrt(dot(F.col("_v"), F.col("_v")))
    found = both.select("query_id", "vec_id", F.round(cosine, digits).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def upsert(index: Index, rows: DataFrame) -> int:
    """Appends rows (vec_id, embedding and metadata) to the lists; ids that are there already have the new vector and metadata from then on. Gives the version. Rows that build() would leave out, and vectors of another length, leave the index as it is; of rows that repeat an id one stays.

    The note of what is replaced is written last: before it, a search sees old rows and new ones of those ids, and never none."""
    spark = runtime.prepare(rows.sparkSession)
    over = spark.read.parquet(f"{index.path}/replaced")
    version = 1 + (over.agg(F.max("version")).first()[0] or 0)
    new = V.usable(rows.select("vec_id", "embedding", *index.meta)).filter((F.col("_dims") == index.dims) & F.col("vec_id").isNotNull()).drop("_dims")
    new = new.groupBy("vec_id").agg(F.min_by(F.struct("embedding", *index.meta), F.col("embedding")).alias("_r")).select("vec_id", "_r.*")
    new = runtime.written(new, "upserts")
    appended(new, index, version)
    new.select("vec_id", F.lit(version).alias("version")).write.mode("append").parquet(f"{index.path}/replaced")
    return version


def compact(index: Index, path: str | None = None) -> Index:
    """The index at another path, without replaced rows and with the files of each list joined."""
    spark = SparkSession.active()
    to = replace(index, path=path or runtime.new_path(spark, "index"))
    stored(spark, index).withColumn("_version", F.lit(0)).repartition("_list").sortWithinPartitions("_list", "vec_id").write.partitionBy("_list").parquet(f"{to.path}/lists")
    spark.createDataFrame([], "vec_id long, version int").write.parquet(f"{to.path}/replaced")
    spark.read.parquet(f"{index.path}/model").write.parquet(f"{to.path}/model")
    return to
