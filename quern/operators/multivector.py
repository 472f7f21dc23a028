"""Retrieval with several vectors for a query and for a document: candidates by vector, late fusion by document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from ..functions import scores as S
from . import vector as V


def nearest_parents(asked: DataFrame, vectors: DataFrame, k: int, *, digits: int = 6, recall=None) -> DataFrame:
    """query_id, parent_id, score, vec_id, chunk_type: documents that any vector of a query recalls, by late fusion.

    asked: query_id, number (0: the query itself, others: variants), embedding. vectors: vec_id, parent_id, chunk_type, embedding. Each query vector recalls its k nearest vectors; their documents are the candidates. A candidate's score is the mean over the query's vectors of the largest cosine with any of the document's vectors, recalled or not; vec_id and chunk_type tell which vector is nearest to the query itself (to its first variant, if it has no vector 0; ties to the smaller id). recall(queries, k) replaces the exact search, by an index's for instance. Vectors that are null, zero or not finite take no part; a document that all its usable vectors miss is none of the candidates."""
    asked = runtime.written(V.usable(asked.select("query_id", "number", "embedding")), "asked").withColumn("_key", F.concat_ws(":", "query_id", "number"))
    keyed = asked.withColumn("_k", F.xxhash64("_key"))
    search = recall or (lambda q, n: V.exact_knn(q, vectors, n, own=True))
    found = search(keyed.select(F.col("_k").alias("query_id"), "embedding"), k).select(F.col("query_id").alias("_k"), "vec_id")
    near = found.join(keyed.select("_k", "query_id"), "_k").join(vectors.select("vec_id", "parent_id"), "vec_id").select("query_id", "parent_id").distinct()
    ours = V.usable(vectors.select("vec_id", "parent_id", "chunk_type", F.col("embedding").alias("embedding"))).withColumnRenamed("embedding", "_v")
    both = near.join(ours, "parent_id").join(asked.select("query_id", "number", F.col("embedding").alias("_q"), F.col("_dims").alias("_qd")), "query_id").filter(F.col("_dims") == F.col("_qd"))
    each = both.select("query_id", "parent_id", "number", "vec_id", "chunk_type", S.cosine(F.col("_q"), F.col("_v")).alias("_s"))
    best = each.groupBy("query_id", "parent_id", "number").agg(F.max("_s").alias("_m"), F.min(F.struct((-F.round("_s", digits)).alias("s"), "vec_id", "chunk_type")).alias("_b"))
    fused = best.groupBy("query_id", "parent_id").agg(F.round(F.avg("_m"), digits).alias("score"), F.min(F.struct("number", F.col("_b.vec_id").alias("vec_id"), F.col("_b.chunk_type").alias("chunk_type"))).alias("_f"))
    return fused.select("query_id", "parent_id", "score", "_f.vec_id", "_f.chunk_type")
