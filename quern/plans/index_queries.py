"""Queries of the maintained indexes: vectors and substrings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as K
from ..operators import relational as R
from ..operators import substring_index as T
from ..operators import vector as V
from ..operators import vector_index as I
from ..sources.tables import NEWS, news, table
from .registry import query
from .relational_queries import SEARCH_SQL


def every(e, n, rest=0):
    return e.filter(F.col("vec_id") % n == rest).select(F.col("vec_id").alias("query_id"), "embedding")


@query("index_recall", """SELECT * FROM (SELECT FALSE AS filtered UNION ALL SELECT TRUE), (SELECT count(*) AS n_rows, count(*) FILTER (WHERE vec_id % 50 = 0) AS n_queries, TRUE AS recall_reached, TRUE AS few_vectors FROM embeddings)""")
def index_recall(spark, d):
    """Whether a search of the index finds nine of ten exact neighbours, among all vectors and among those of three labels, with a tenth of the vectors at most scored for a query."""
    e = table(spark, d, "embeddings")
    n, index = e.count(), I.build(e, meta=("label",))
    few = F.lit(index.rescored * 10 <= n)
    out = None
    for filtered, where in ((False, None), (True, F.col("label").isin(1, 2, 3))):
        truth = V.exact_knn(every(e, 50), e if where is None else e.filter(where), 10).select("query_id", "vec_id")
        found = I.search(index, every(e, 50), 10, where=where).select("query_id", "vec_id", F.lit(1).alias("_hit"))
        told = truth.join(found, ["query_id", "vec_id"], "left").agg((F.count("_hit") >= 0.9 * F.count("*")).alias("recall_reached"), F.count_distinct("query_id").alias("n_queries"))
        told = told.select(F.lit(filtered).alias("filtered"), F.lit(n).cast("long").alias("n_rows"), "n_queries", "recall_reached", few.alias("few_vectors"))
        out = told if out is None else out.unionByName(told)
    return out


@query("index_upserts", "SELECT vec_id AS query_id, vec_id - 1 AS vec_id, 1.0::DOUBLE AS score, 1 AS rank FROM embeddings WHERE vec_id % 40 = 1")
def index_upserts(spark, d):
    """Each fortieth vector is replaced by its successor's; a search for the successor then finds it first."""
    e = table(spark, d, "embeddings")
    index = I.build(e, meta=("label",))
    I.upsert(index, e.filter("vec_id % 40 = 1").select((F.col("vec_id") - 1).alias("vec_id"), "embedding", "label"))
    return I.search(index, every(e, 40, 1), 1)


@query("substring_search", "SELECT item_id, doc_id FROM (SELECT item_id, lower(substr(text, 11, 12)) AS term FROM benchmark) b JOIN documents d ON term <> '' AND contains(lower(d.text), term)")
def substring_search(spark, d):
    """Twelve characters of each benchmark passage in all texts, by the index."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    asked = table(spark, d, "benchmark").select("item_id", F.substring("text", 11, 12).alias("term"))
    found = T.search(T.build(docs, "doc_id", "text"), docs, "text", asked)
    return found.join(asked.select("item_id", F.lower("term").alias("term")), "term").select("item_id", "doc_id")


@query("keyword_search_indexed", SEARCH_SQL)
def keyword_search_indexed(spark, d):
    """The keyword search over rows that the index leaves: both pools hold their terms in title or content, and a title is the content's first line."""
    n = news(spark, d)
    index = T.build(n, "doc_id", "content")
    return R.keyword_search(T.holding_any(index, n, ["the", "tion"]), ["the", "tion"], "the tion", limit=20).select("doc_id", F.col("relevance").cast("int").alias("relevance"), "publish_ts")


@query("must_should_indexed", f"WITH {NEWS} SELECT doc_id, publish_ts FROM news WHERE category = 'en' AND (contains(title, 'ingth') OR contains(title, 'tioned')) ORDER BY publish_ts DESC, doc_id LIMIT 20")
def must_should_indexed(spark, d):
    n = news(spark, d)
    index = T.build(n, "doc_id", "title")
    return K.must_should(T.holding_any(index, n, ["ingth", "tioned"]), {"category": "en"}, "title", ["ingth", "tioned"]).select("doc_id", "publish_ts")
