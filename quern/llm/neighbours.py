"""Approximate nearest neighbours by stable projections: few dimensions, a kd-tree, a chi-square stopping test.

Largest inner products are nearest neighbours after one more coordinate makes all vectors equally
long. Projections on Gaussian directions keep distances: the squared projected distance over the
squared true one is chi-square with as many degrees of freedom as projections. So points are verified
in the order of their projected distance, and a search ends when a point still to come would be nearer
than the worst neighbour found only with a small chance.

The projected points are cut into cells by a kd-tree, and each cell has a kd-tree of its own. A query
first searches the cell it falls in; then, with the distance it has reached, all cells that the stopping
test does not rule out. Both passes are joins on the cell, in pieces of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chi2, common

#: Projections; chance of a nearer point at which the search ends; neighbours.
PROJECTIONS, MISS, K = 8, 0.01, 20
#: Rows of a cell, of a cell's piece, of a leaf; queries searched in a piece at once.
CELL_ROWS, PIECE_ROWS, LEAF_ROWS, QUERY_ROWS = 16_384, 32_768, 128, 4096
#: Cells at most (larger tables have larger cells, in more pieces), and rows of the sample on which they are fitted: at least so many, and so many for each cell. The sample's projections are all that comes to the driver: 21 MB at most.
CELLS, FIT_ROWS, CELL_FIT_ROWS = 16_384, 20_000, 20
#: Distances to cells that are held at once.
HELD = 1 << 22
EVERY = 20
SEED = 11


def usable(vector: Column) -> Column:
    """Not null, not zero, every component a finite number."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64) if len(column) else np.zeros((0, 1))


class Space:
    """Projection of vectors that one more coordinate makes as long as `longest`, and the cells of the projected space."""

    def __init__(self, dims: int, longest: float, m: int = PROJECTIONS):
        self.longest, self.m = longest, m
        self.directions = np.random.default_rng(SEED).standard_normal((dims + 1, m))
        self.cuts: list[tuple[int, float]] = []
        self.depth = 0

    def project(self, v: np.ndarray, query: bool) -> np.ndarray:
        more = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.longest**2 - np.einsum("ij,ij->i", v, v), 0))
        return v @ self.directions[:-1] + more[:, None] * self.directions[-1]

    def fit_cells(self, projected: np.ndarray, cells: int) -> None:
        """A balanced kd-tree of at least so many cells, each cut at the median of the widest side of a sample."""
        self.depth = max(0, int(np.ceil(np.log2(max(cells, 1)))))
        groups = [projected]
        for _ in range(self.depth):
            following = []
            for g in groups:
                side = int(g.std(axis=0).argmax()) if len(g) else 0
                at = float(np.median(g[:, side])) if len(g) else 0.0
                self.cuts.append((side, at))
                following += [g[g[:, side] <= at], g[g[:, side] > at]]
            groups = following

    def cell(self, projected: np.ndarray) -> np.ndarray:
        node = np.zeros(len(projected), dtype=np.int64)
        if self.cuts:
            side, at = (np.array(x) for x in zip(*self.cuts, strict=True))
            for _ in range(self.depth):
                node = 2 * node + 1 + (projected[np.arange(len(node)), side[node]] > at[node])
        return node - (2**self.depth - 1)

    def near(self, projected: np.ndarray, reach: np.ndarray) -> list[list[int]]:
        """For each point the cells within a squared distance, found by a descent of the tree that leaves out what is too far; few points at a time, so that what is held is bounded."""
        out: list[list[int]] = []
        side, at = (np.array(x) for x in zip(*self.cuts, strict=True)) if self.cuts else (np.zeros(0, dtype=int), np.zeros(0))
        step = max(1, HELD // (2**self.depth * (self.m + 2)))
        for lo in range(0, len(projected), step):
            p, r = projected[lo : lo + step], reach[lo : lo + step]
            who, node = np.arange(len(p)), np.zeros(len(p), dtype=np.int64)
            gaps = np.zeros((len(p), self.m))  # to the node's box, by coordinate
            for _ in range(self.depth):
                d = p[who, side[node]] - at[node]
                beyond = np.abs(d)
                left, right = gaps.copy(), gaps.copy()
                rows = np.arange(len(who))
                left[rows, side[node]] = np.where(d > 0, np.maximum(beyond, gaps[rows, side[node]]), gaps[rows, side[node]])
                right[rows, side[node]] = np.where(d > 0, gaps[rows, side[node]], np.maximum(beyond, gaps[rows, side[node]]))
                who, node, gaps = np.concatenate([who, who]), np.concatenate([2 * node + 1, 2 * node + 2]), np.concatenate([left, right])
                keep = np.einsum("ij,ij->i", gaps, gaps) <= r[who]
                who, node, gaps = who[keep], node[keep], gaps[keep]
            cell = node - (2**self.depth - 1)
            order = np.lexsort((cell, who))
            found = np.split(cell[order], np.searchsorted(who[order], np.arange(1, len(p))))
            out += [x.tolist() for x in found]
        return out


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    out = np.zeros((len(q), len(low)))
    for d in range(q.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, d] - q[:, d, None], q[:, d, None] - high[None, :, d]), 0)
        out += gap * gap
    return out


def leaves(p: np.ndarray, size: int) -> list[np.ndarray]:
    """The kd-tree's leaves: rows, cut at the median of the widest side."""
    todo, out = [np.arange(len(p))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        side = int(np.ptp(p[rows], axis=0).argmax())
        order = rows[np.argpartition(p[rows, side], len(rows) // 2)]
        todo += [order[len(rows) // 2 :], order[: len(rows) // 2]]
    return out


def search(space: Space, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, worst: np.ndarray, *, k: int = K, miss: float = MISS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of up to k candidates of each query. worst: a squared distance that a neighbour need not exceed (inf: none yet).

    Equal vectors stand together as one, with their k + 1 smallest ids. Leaves come in the order of
    their projected distance; a query stops when the test rules out what is left."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    new = np.concatenate([[True], (np.diff(vectors, axis=0) != 0).any(axis=1)])
    first = np.flatnonzero(new)
    count = np.minimum(np.diff(np.append(first, len(ids))), k + 1)
    unique = vectors[first]
    tree = leaves(space.project(unique, False), LEAF_ROWS)
    p = space.project(unique, False)
    low, high = np.array([p[r].min(axis=0) for r in tree]), np.array([p[r].max(axis=0) for r in tree])
    limit = chi2.quantile(1 - miss, space.m)
    gaps = box_distance(space.project(queries, True), low, high)
    visit = np.argsort(gaps, axis=1, kind="stable")
    length = np.einsum("ij,ij->i", queries, queries) + space.longest**2
    top = k + 1  # the query itself can be among them
    best = np.full((len(queries), top), -np.inf)
    alive = np.arange(len(queries))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for step in range(len(tree)):
        kth = np.minimum(length[alive] - 2 * best[alive, 0], worst[alive])  # best[:, 0] is the worst of the best
        alive = alive[gaps[alive, visit[alive, step]] <= limit * np.maximum(kth, 0) * (1 + 1e-12)]
        if not len(alive):
            break
        leaf = visit[alive, step]
        for at in np.unique(leaf):
            rows, who = tree[at], alive[leaf == at]
            near = queries[who] @ unique[rows].T
            keep = near >= best[who, :1] - 1e-9
            a, b = np.nonzero(keep)
            found.append((who[a], rows[b], near[a, b]))
            several = np.repeat(near, count[rows], axis=1) if (count[rows] > 1).any() else near
            merged = np.concatenate([best[who], several], axis=1)
            best[who] = np.sort(np.partition(merged, -top, axis=1)[:, -top:], axis=1)
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0)
    who, row, near = (np.concatenate(x) for x in zip(*found, strict=True))
    good = near >= best[who, 0] - 1e-9
    who, row = who[good], row[good]
    exact = (queries[who] * unique[row]).sum(axis=1)
    times = count[row]
    at = np.repeat(first[row], times) + np.arange(times.sum()) - np.repeat(times.cumsum() - times, times)
    who, exact, cand = np.repeat(who, times), np.repeat(exact, times), ids[at]
    other = cand != query_ids[who]
    who, exact, cand = who[other], exact[other], cand[other]
    order = np.lexsort((cand, -exact, who))
    who, exact, cand = who[order], exact[order], cand[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    return who[rank < k], cand[rank < k], exact[rank < k]


def neighbours(vectors: DataFrame, *, every: int = EVERY, k: int = K, miss: float = MISS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, its k nearest of all other rows by inner product, nearest first, ties to the smaller vec_id; all of them, if there are fewer. Rows whose vector is null, zero or not finite, or whose vec_id is null, take no part; of rows that repeat a vec_id the one with the smallest vector (in the order of arrays) stays; an empty table, and a table of one row, give none. Vectors of several lengths are as many searches: an inner product is one of vectors of the same length. Other columns don't matter."""
    spark = common.prepare(vectors.sparkSession)
    base = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("_v"))
    base = common.materialize(base.groupBy("vec_id").agg(F.min("_v").alias("_v")).withColumn("_dims", F.size("_v")), "vectors")
    told = base.groupBy("_dims").agg(F.count("*").alias("n"), F.max(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")).orderBy("_dims").collect()
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for t in told:  # mostly one length
        found = found.unionByName(nearest(base.filter(F.col("_dims") == t["_dims"]).drop("_dims"), t["_dims"], t["n"], float(np.sqrt(t["longest"])), every, k, miss))
    return found


def nearest(base: DataFrame, dims: int, n: int, longest: float, every: int, k: int, miss: float) -> DataFrame:
    """neighbours() among n vectors (vec_id, _v) of one length, the longest of the given norm."""
    space = Space(dims, longest)

    @F.pandas_udf("array<double>")
    def projection(v: pd.Series) -> pd.Series:
        return pd.Series(list(space.project(matrix(v), False)))

    cells = min(CELLS, -(-n // CELL_ROWS))
    if cells > 1:
        sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(FIT_ROWS, CELL_FIT_ROWS * cells))
        space.fit_cells(matrix(sample.select(projection("_v").alias("_p")).toPandas()["_p"]), cells)

    @F.pandas_udf("long")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(space.cell(space.project(matrix(v), False)))

    placed = common.materialize(base.withColumn("_cell", cell_of("_v")), "cells")
    sizes = placed.groupBy("_cell").agg(F.count("*").alias("_n"))
    sizes = F.broadcast(sizes.select("_cell", F.ceil(F.col("_n") / PIECE_ROWS).cast("int").alias("_pieces")))  # a row for each of at most CELLS cells
    data = placed.join(sizes, "_cell").withColumn("_piece", F.pmod(F.xxhash64("vec_id"), F.col("_pieces").cast("long")).cast("int")).drop("_pieces")
    asked = placed.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("_v").alias("_qv"), "_cell")

    first = common.materialize(searched(space, data, spread(asked.withColumn("_worst", F.lit(float("inf"))), sizes), k, miss), "found")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if cells > 1:
        reached = first.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), k, 1).alias("_s")).select("query_id", F.get("_s", F.lit(0)).alias("_kth"))
        limit = chi2.quantile(1 - miss, space.m)

        @F.pandas_udf("array<long>")
        def cells_near(v: pd.Series, worst: pd.Series) -> pd.Series:
            return pd.Series(space.near(space.project(matrix(v), True), limit * np.maximum(worst.to_numpy(), 0) * (1 + 1e-12)))

        length = F.aggregate("_qv", F.lit(longest**2), lambda a, x: a + x * x)
        again = asked.join(reached, "query_id", "left").withColumn("_worst", F.coalesce(length - 2 * F.col("_kth"), F.lit(float("inf"))))
        again = again.withColumn("_to", F.explode(cells_near("_qv", "_worst"))).filter(F.col("_to") != F.col("_cell")).select("query_id", "_qv", F.col("_to").alias("_cell"), "_worst")
        first = first.unionByName(searched(space, data, spread(again, sizes), k, miss))
    return first.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def spread(asked: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each query once for each piece of its cell."""
    return asked.join(sizes, "_cell").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces")


def searched(space: Space, data: DataFrame, asked: DataFrame, k: int, miss: float) -> DataFrame:
    """Candidates of the queries in each piece, at most k for a query and piece. Where more than QUERY_ROWS ask one piece, it is read once for each so many."""
    counts = asked.groupBy("_cell", "_piece").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("_turns"))
    asked = asked.join(counts, ["_cell", "_piece"]).withColumn("_turn", F.pmod(F.xxhash64("query_id"), F.col("_turns").cast("long")).cast("int"))
    data = data.join(counts, ["_cell", "_piece"]).withColumn("_turn", F.explode(F.sequence(F.lit(0), F.col("_turns") - 1)))

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        ids = right["query_id"].to_numpy()
        who, cand, score = search(space, left["vec_id"].to_numpy(), matrix(left["_v"]), ids, matrix(right["_qv"]), right["_worst"].to_numpy(), k=k, miss=miss)
        return pd.DataFrame({"query_id": ids[who], "vec_id": cand, "score": score})

    keys = ["_cell", "_piece", "_turn"]
    return data.select(*keys, "vec_id", "_v").groupBy(*keys).cogroup(asked.select(*(F.col(c).alias(f"_q{c}") for c in keys), "query_id", "_qv", "_worst").groupBy(*(f"_q{c}" for c in keys))).applyInPandas(one, "query_id long, vec_id long, score double")


def op2_stable_projections(spark, sf_dir: str) -> DataFrame:
    return neighbours(common.table(spark, sf_dir, "embeddings"))
