"""Exact vector search in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block, and queries that visit a block at once.
BLOCK_ROWS, QUERY_ROWS = 16_384, 4_096
#: Scores that a task holds at once; a query's scores with a block are never cut.
SCORES = 1 << 20


def usable(df: DataFrame) -> DataFrame:
    """Rows whose embedding points somewhere: not null, not zero, every component a finite number. _dims is its length."""
    v = F.col("embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return df.filter(v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(True)) & F.exists(v, lambda x: x != 0)).withColumn("_dims", F.size(v))


def best_in(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of each row, largest first, ties to the first place; without a sort of all of them."""
    k = min(k, scores.shape[1])
    out = np.empty((len(scores), k), dtype=np.int64)
    for i, s in enumerate(scores):
        at = np.flatnonzero(s >= np.partition(s, -k)[-k])  # in order of places, with all that tie with the last
        out[i] = at[np.argsort(-s[at], kind="stable")[:k]]
    return out


def nearest_in(left: pd.DataFrame, right: pd.DataFrame, k: int, digits: int, own: bool) -> pd.DataFrame:
    """query_id, vec_id, score: the k nearest of a block (left: vec_id, embedding) for each query (right: query_id, embedding), SCORES scores at once."""
    if not len(left) or not len(right):
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    left = left.sort_values("vec_id")
    unit = lambda c: (m := np.stack(c.to_list()).astype(np.float64)) / np.sqrt((m * m).sum(axis=1, keepdims=True))
    ids, queries, v = left["vec_id"].to_numpy(), right["query_id"].to_numpy(), unit(left["embedding"]).T
    at_once, parts = max(1, SCORES // len(ids)), []
    for lo in range(0, len(queries), at_once):
        q = queries[lo : lo + at_once]
        score = unit(right["embedding"].iloc[lo : lo + at_once]) @ v
        np.round(score, digits, out=score)
        if not own:
            score[q[:, None] == ids[None, :]] = -np.inf
        best = best_in(score, k)
        parts.append(pd.DataFrame({"query_id": np.repeat(q, best.shape[1]), "vec_id": ids[best].reshape(-1), "score": np.take_along_axis(score, best, axis=1).reshape(-1)}))
    out = pd.concat(parts, ignore_index=True)
    return out[np.isfinite(out["score"])]


def exact_knn(queries: DataFrame, vectors: DataFrame, k: int, *, digits: int = 6, by: str | None = None, own: bool = False) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest vectors of each query by cosine in double precision, rounded; ties to the smaller id; a query's own id is left out, unless own is set. by: a column of both tables; a query meets only vectors with its value there, null ones none. A query meets vectors of its own length; those that are null, zero, or hold a null or non-finite component take no part.

    Vectors are cut into blocks, queries visit each block in turns of bounded size, SCORES scores at once, and a block gives at most k rows for each query."""
    same = [by] if by else []
    queries, vectors = (usable(df.select(key, "embedding", *same)).dropna(subset=[key, *same]) for df, key in ((queries, "query_id"), (vectors, "vec_id")))
    same = [*same, "_dims"]
    counts = vectors.agg(F.count("*")).crossJoin(queries.agg(F.count("*"))).first()
    blocks, turns = max(1, -(-counts[0] // BLOCK_ROWS)), max(1, -(-counts[1] // QUERY_ROWS))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = vectors.withColumn("_b", part("vec_id", blocks)).withColumn("_t", every(turns))
    asked = queries.withColumn("_qt", part("query_id", turns)).withColumn("_qb", every(blocks))

    one = lambda left, right: nearest_in(left, right, k, digits, own)
    found = data.groupBy("_b", "_t", *same).cogroup(asked.groupBy("_qb", "_qt", *same)).applyInPandas(one, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def with_fallback(filtered: DataFrame, everything: DataFrame, key: str) -> DataFrame:
    """Filtered rows of each query; where a query has none, its unfiltered ones, flagged."""
    have = filtered.select(key).distinct()
    return filtered.withColumn("fallback", F.lit(False)).unionByName(everything.join(have, key, "left_anti").withColumn("fallback", F.lit(True)))


def neighbours_join(queries: DataFrame, vectors: DataFrame, k: int, *, keep=None) -> DataFrame:
    """exact_knn over vectors that a predicate keeps."""
    return exact_knn(queries, vectors if keep is None else vectors.filter(keep), k)
