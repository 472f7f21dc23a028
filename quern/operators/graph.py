"""Connected components by stars that are drawn together; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) of every node with an edge; edges with a null end are left out, a node that is linked to itself alone is its own component.

    Large stars and small stars in turn: each node links its larger neighbours, and then its smaller ones and itself, to the smallest of its neighbourhood, until nothing changes. Neither a node of many edges nor a long chain is slow: links of a node are folded before the shuffle, and the rounds grow as the logarithm of the largest component."""
    known = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    given = runtime.written(known.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    now, seen = given.filter("a <> b"), None
    while True:
        every = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = every.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        far = every.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        far = runtime.written(far.filter("a <> b").distinct(), "edges")
        down = far.groupBy("a").agg(F.min("b").alias("m"))
        near = far.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = runtime.written(near.filter("a <> b").distinct(), "edges")
        told = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if told == seen:
            break
        seen = told
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    alone = given.filter("a = b").select(F.col("a").alias("node")).join(stars.select("node").unionByName(roots.select("node")), "node", "left_anti").distinct()
    return stars.unionByName(roots).unionByName(alone.select("node", F.col("node").alias("component")))


def groups_by_token(rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """Rows that share a token, directly or by others, are one group, named by its smallest token; a row without tokens is its own. The bipartite graph is joined through each token, so a token of many rows gives as many edges, not pairs."""
    long = rows.select(F.col(key).cast("string").alias("row"), F.explode_outer(tokens).alias("token"))
    long = long.select("row", F.coalesce(F.concat(F.lit("t:"), "token"), F.concat(F.lit("r:"), "row")).alias("token"))
    edges = long.select(F.concat(F.lit("row:"), "row").alias("a"), F.col("token").alias("b"))
    found = components(edges)
    ours = F.col("node").startswith("row:")
    named = found.filter(~ours).groupBy(F.col("component").alias("_c")).agg(F.min("node").alias("group_key"))
    return found.filter(ours).select(F.substring("node", 5, 1 << 20).alias(key), F.col("component").alias("_c")).join(named, "_c").select(key, "group_key")
