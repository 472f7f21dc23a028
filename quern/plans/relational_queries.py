"""Queries of browsing, lookups, joins, upserts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import runtime
from ..functions import text as X
from ..operators import relational as R
from ..sources import merge_tables as M
from ..sources.tables import EVENTS, NEWS, item_events, news, table
from .registry import query



def newest():
    return [F.desc("publish_ts"), F.desc("views"), F.asc("doc_id")]


@query("browse_page", f"WITH {NEWS} SELECT doc_id, title, source FROM news WHERE category = 'en' ORDER BY doc_id LIMIT 10 OFFSET 20")
def browse_page(spark, d):
    return R.page(news(spark, d).filter("category = 'en'"), [F.asc("doc_id")], 20, 10).select("doc_id", "title", "source")


@query("page_envelope", f"WITH {NEWS} SELECT doc_id, title, (SELECT count(*) FROM news WHERE category = 'fr') AS total, (SELECT count(*) FROM news WHERE category = 'fr') > 2 * 10 AS has_more FROM news WHERE category = 'fr' ORDER BY doc_id LIMIT 10 OFFSET 10")
def page_envelope(spark, d):
    return R.page_envelope(news(spark, d).filter("category = 'fr'"), [F.asc("doc_id")], 2, 10).select("doc_id", "title", "total", "has_more")


@query("category_list", "SELECT lang AS category, count(*) AS n FROM documents GROUP BY lang ORDER BY lang LIMIT 100")
def category_list(spark, d):
    return R.page(table(spark, d, "documents").groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n")), [F.asc("category")], 0, 100)


@query("point_lookup", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 77 LIMIT 1")
def point_lookup(spark, d):
    return R.lookup(table(spark, d, "customer"), c_custkey=77).select("c_custkey", "c_name", "c_mktsegment")


@query("latest_top_n", f"WITH {NEWS} SELECT doc_id, publish_ts, views FROM news ORDER BY publish_ts DESC, views DESC, doc_id LIMIT 20")
def latest_top_n(spark, d):
    return news(spark, d).orderBy(*newest()).limit(20).select("doc_id", "publish_ts", "views")


@query("popular_top_n", f"WITH {NEWS} SELECT doc_id, views, publish_ts FROM news ORDER BY views DESC, publish_ts DESC, doc_id LIMIT 8")
def popular_top_n(spark, d):
    return R.recommended(news(spark, d), [F.desc("views"), F.desc("publish_ts"), F.asc("doc_id")], 30).select("doc_id", "views", "publish_ts")


@query("related_top_n", f"WITH {NEWS} SELECT category, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY views DESC, publish_ts DESC, doc_id) AS rank FROM news) WHERE rank <= 5")
def related_top_n(spark, d):
    return R.top_per(news(spark, d), ["category"], [F.desc("views"), F.desc("publish_ts"), F.asc("doc_id")], 5).select("category", "doc_id", "rank")


@query("related_excluding_self", f"WITH {NEWS}, t AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY views DESC, publish_ts DESC, doc_id) AS r FROM news), j AS (SELECT n.doc_id, t.doc_id AS related, row_number() OVER (PARTITION BY n.doc_id ORDER BY t.r) AS rank FROM news n JOIN t ON t.category = n.category AND t.r <= 6 AND t.doc_id <> n.doc_id) SELECT doc_id, related, rank FROM j WHERE rank <= 5")
def related_excluding_self(spark, d):
    return R.related(news(spark, d), "doc_id", "category", [F.desc("views"), F.desc("publish_ts"), F.asc("doc_id")], 5)


SEARCH_SQL = f"""WITH {NEWS},
hit AS (SELECT *, contains(lower(title), 'the') AS t1, contains(lower(title), 'tion') AS t2, contains(lower(content), 'the') AS b1, contains(lower(content), 'tion') AS b2 FROM news),
titles AS (SELECT *, 0 AS p FROM hit WHERE t1 OR t2 ORDER BY publish_ts DESC, doc_id LIMIT 200),
broad AS (SELECT *, 1 AS p FROM hit WHERE t1 OR t2 OR b1 OR b2 ORDER BY publish_ts DESC, doc_id LIMIT 400),
pool AS (SELECT DISTINCT ON (doc_id) * FROM (SELECT * FROM titles UNION ALL SELECT * FROM broad) ORDER BY doc_id, p)
SELECT doc_id, CAST(5 * t1::INT + 5 * t2::INT + b1::INT + b2::INT + 8 * contains(lower(title), 'the tion')::INT AS INT) AS relevance, publish_ts
FROM pool ORDER BY relevance DESC, publish_ts DESC, doc_id LIMIT 8"""


@query("keyword_search_scored", SEARCH_SQL)
def keyword_search_scored(spark, d):
    return R.keyword_search(news(spark, d), ["the", "tion"], "the tion", limit=20).select("doc_id", F.col("relevance").cast("int").alias("relevance"), "publish_ts")


@query("user_history_latest", f"WITH {EVENTS} SELECT user_id, item, max(ts) AS view_time FROM ev WHERE event_type = 'view' GROUP BY user_id, item")
def user_history_latest(spark, d):
    return R.latest(item_events(spark, d).filter("event_type = 'view'"), ["user_id", "item"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "item", F.col("ts").alias("view_time"))


@query("view_counters", f"WITH {EVENTS} SELECT item, count(*) AS n FROM ev WHERE event_type = 'view' GROUP BY item")
def view_counters(spark, d):
    return R.counter(item_events(spark, d).filter("event_type = 'view'"), "item")


HISTORY_SQL = f"""WITH {EVENTS}, {NEWS}, h AS (SELECT user_id, item, max(ts) AS seen FROM ev WHERE event_type = '{{kind}}' GROUP BY user_id, item),
j AS (SELECT h.user_id, h.seen, news.doc_id, news.title FROM h JOIN news ON news.doc_id = h.item),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, doc_id DESC) AS rank, count(*) OVER (PARTITION BY user_id) AS total FROM j)
SELECT user_id, rank, doc_id, title, seen, total FROM r WHERE rank <= 10"""


def joined_page(spark, d, kind):
    """The first page of every user at once, with the total."""
    last = R.latest(item_events(spark, d).filter(F.col("event_type") == kind), ["user_id", "item"], [F.desc("ts"), F.desc("event_id")])
    j = last.select("user_id", F.col("item").alias("doc_id"), F.col("ts").alias("seen")).join(news(spark, d).select("doc_id", "title"), "doc_id")
    from pyspark.sql import Window

    return R.top_per(j.withColumn("total", F.count("*").over(Window.partitionBy("user_id"))), ["user_id"], [F.desc("seen"), F.desc("doc_id")], 10).select("user_id", "rank", "doc_id", "title", "seen", "total")


@query("history_join_page", HISTORY_SQL.format(kind="view"))
def history_join_page(spark, d):
    return joined_page(spark, d, "view")


@query("favourite_join_page", HISTORY_SQL.format(kind="click"))
def favourite_join_page(spark, d):
    return joined_page(spark, d, "click")


@query("left_join_names", "SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def left_join_names(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").select("s_suppkey", "s_name", "n_name")


@query("left_join_category_counts", "SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_name")
def left_join_category_counts(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer").filter("c_acctbal > 9000")
    return n.join(c, c["c_nationkey"] == n["n_nationkey"], "left").groupBy("n_name").agg(F.count("c_custkey").alias("n"))


@query("semi_anti_labels", "SELECT d.doc_id, (EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS labelled, (NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)) AS not_toxic FROM documents d")
def semi_anti_labels(spark, d):
    docs, lab = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    flags = lab.groupBy("doc_id").agg(F.bool_or(F.col("toxic") == 1).alias("_t"))
    return docs.join(flags, "doc_id", "left").select("doc_id", F.col("_t").isNotNull().alias("labelled"), (~F.coalesce("_t", F.lit(False))).alias("not_toxic"))


@query("multi_key_lookup", """WITH w AS (SELECT item_id AS request, 0 AS kr, CAST(item_id AS VARCHAR) AS key FROM benchmark UNION ALL SELECT item_id, 1, 'src' || (item_id % 20) FROM benchmark),
hits AS (SELECT CAST(vec_id AS VARCHAR) AS key, 0 AS s, 'vectors' AS store, 'v' || vec_id AS payload FROM embeddings UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, 'documents', 'd' || doc_id FROM documents UNION ALL SELECT source, 1, 'documents', 'd' || doc_id FROM documents)
SELECT request, key, store FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY s, kr, payload) AS n FROM w JOIN hits USING (key)) WHERE n = 1""")
def multi_key_lookup(spark, d):
    b = table(spark, d, "benchmark")
    wanted = b.select(F.col("item_id").alias("request"), F.lit(0).alias("key_rank"), F.col("item_id").cast("string").alias("key")).unionByName(b.select(F.col("item_id").alias("request"), F.lit(1).alias("key_rank"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("key")))
    stores = {"vectors": table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), "documents": table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("alias"))}
    return R.multi_key(wanted, stores, ["id", "alias"]).select("request", "key", "store")


@query("lateral_top_chunks", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders JOIN customer ON c_custkey = o_custkey) WHERE rank <= 2")
def lateral_top_chunks(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return R.top_per(o.join(c, "o_custkey"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], 2).select("o_custkey", "o_orderkey", "rank")


@query("upsert_parents", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || ' (new)' ELSE text END AS content, source FROM documents""")
def upsert_parents(spark, d):
    """Every second row comes again with new content and another source; content is overwritten, the source is not."""
    old = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"), "source")
    new = old.filter("doc_id % 2 = 0").select("doc_id", F.concat("content", F.lit(" (new)")).alias("content"), F.lit("other").alias("source"))
    return R.merge_into(old, new, "doc_id", ["content"])


@query("merged_upserts", """WITH a AS (SELECT doc_id, text AS content, source FROM documents UNION ALL SELECT 1000000000 + item_id, text, 'benchmark' FROM benchmark), b AS (SELECT doc_id, CASE WHEN doc_id < 1000000000 AND doc_id % 50 = 0 THEN content || ' (new)' ELSE content END AS content, source FROM a)
SELECT doc_id, sha256(content) AS content_sha256, source FROM b WHERE doc_id % 64 <> 3""")
def merged_upserts(spark, d):
    """A table that takes a merge and a delete: every fiftieth document comes again with new content (which is overwritten) and another source (which is not), benchmark items come as new rows, and each key that leaves 3 when divided by 64 goes."""
    docs, path = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"), "source"), runtime.new_path(spark, "merged")
    again = docs.filter("doc_id % 50 = 0").select("doc_id", F.concat("content", F.lit(" (new)")).alias("content"), F.lit("other").alias("source"))
    items = table(spark, d, "benchmark").select((F.lit(1_000_000_000) + F.col("item_id")).alias("doc_id"), F.col("text").alias("content"), F.lit("benchmark").alias("source"))
    M.create(docs, path, "doc_id", slots=4, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    M.merge(path, again.unionByName(items), ["content"])
    M.delete(path, M.read(spark, path).filter("doc_id % 64 = 3").select("doc_id"))
    M.forget(spark, path)
    return M.read(spark, path).select("doc_id", F.sha2("content", 256).alias("content_sha256"), "source")


@query("partial_update", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS c_name, c_mktsegment FROM customer")
def partial_update(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = old.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.upper("c_name")).alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"))
    return R.patch(old, new, "c_custkey")


@query("delete_by_key", f"WITH {EVENTS} SELECT event_id, user_id, item FROM ev e WHERE NOT EXISTS (SELECT 1 FROM ev g WHERE g.event_type = 'error' AND g.user_id = e.user_id AND g.item = e.item)")
def delete_by_key(spark, d):
    e = item_events(spark, d)
    return R.without(e, e.filter("event_type = 'error'"), ["user_id", "item"]).select("event_id", "user_id", "item")


@query("insert_if_absent", f"WITH {NEWS}, old AS (SELECT title, min(doc_id) AS doc_id FROM news WHERE source = 'src1' GROUP BY title), new AS (SELECT title, min(doc_id) AS doc_id FROM news WHERE source <> 'src1' AND title NOT IN (SELECT title FROM old) GROUP BY title) SELECT doc_id, title FROM old UNION ALL SELECT doc_id, title FROM new")
def insert_if_absent(spark, d):
    n = news(spark, d).select("doc_id", "title", "source")
    old = n.filter("source = 'src1'").groupBy("title").agg(F.min("doc_id").alias("doc_id"))
    return R.insert_absent(old, n.filter("source <> 'src1'").select("doc_id", "title"), "title").select("doc_id", "title")


@query("requested_order", "SELECT pos, o.key AS c_custkey, c_name FROM (SELECT unnest([42, 7, 1300, 3, 42]) AS key, unnest([0, 1, 2, 3, 4]) AS pos) o LEFT JOIN customer ON c_custkey = o.key ORDER BY pos")
def requested_order(spark, d):
    wanted = spark.range(1).select(F.posexplode(F.array(*(F.lit(x).cast("long") for x in (42, 7, 1300, 3, 42)))).alias("pos", "c_custkey"))
    return R.in_requested_order(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", wanted, "pos").select("pos", F.col("c_custkey").cast("int").alias("c_custkey"), "c_name")


@query("two_way_contains", "SELECT p_partkey, term FROM part, (SELECT unnest(['red', 'brass large', 'blue', 'a']) AS term) t WHERE contains(lower(p_name), term) OR contains(term, lower(p_name))")
def two_way_contains(spark, d):
    terms = spark.createDataFrame([("red",), ("brass large",), ("blue",), ("a",)], "term string")
    return R.two_way_contains(table(spark, d, "part"), terms, "p_name", "term").select("p_partkey", "term")


@query("set_algebra", """WITH a AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), b AS (SELECT DISTINCT vec_id AS doc_id FROM embeddings)
SELECT 'except' AS op, doc_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'intersect', doc_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'union', doc_id FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def set_algebra(spark, d):
    a, b = table(spark, d, "labels").filter("quality = 1").select("doc_id"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    tag = lambda op, df: df.select(F.lit(op).alias("op"), "doc_id")
    return tag("except", a.subtract(b)).unionByName(tag("intersect", a.intersect(b))).unionByName(tag("union", a.union(b).distinct()))


@query("leakage_counts", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1)) AS shared, (SELECT count(*) FROM (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1)) AS either")
def leakage_counts(spark, d):
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("a"), F.bool_or(F.col("toxic") == 1).alias("b"))
    return lab.agg(F.count_if(F.col("a") & F.col("b")).alias("shared"), F.count_if(F.col("a") | F.col("b")).alias("either"))


@query("bag_union_counts", "SELECT k, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n_name AS k, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT n_name, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) GROUP BY k")
def bag_union_counts(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("k"))
    one = lambda t, c: R.counter(table(spark, d, t).join(n, F.col(c) == F.col("n_nationkey")), "k")
    return R.counter(table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")), "k", one("supplier", "s_nationkey"))


@query("clipped_projection", "SELECT doc_id, CASE WHEN length(f) > 220 THEN rtrim(substr(f, 1, 220)) || '...' ELSE f END AS summary, n_chars AS nChars FROM (SELECT doc_id, n_chars, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)")
def clipped_projection(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clip(F.col("text"), 220).alias("summary"), F.col("n_chars").alias("nChars"))


@query("expiry_lookup", "SELECT user_id, count(*) AS live FROM events WHERE ts + INTERVAL 7 DAY >= TIMESTAMP '2024-01-25' GROUP BY user_id")
def expiry_lookup(spark, d):
    return table(spark, d, "events").filter(F.expr("ts + INTERVAL 7 DAY >= timestamp_ntz'2024-01-25 00:00:00'")).groupBy("user_id").agg(F.count("*").alias("live"))


@query("scalar_subquery_counts", "SELECT (SELECT count(*) FROM documents) AS parents, (SELECT count(*) FROM embeddings) AS points, round((SELECT count(*) FROM embeddings) / (SELECT count(*) FROM documents), 4) AS ratio")
def scalar_subquery_counts(spark, d):
    a = table(spark, d, "documents").agg(F.count("*").alias("parents"))
    b = table(spark, d, "embeddings").agg(F.count("*").alias("points"))
    return a.crossJoin(b).withColumn("ratio", F.round(F.col("points") / F.col("parents"), 4))  # one row each


@query("filtered_counts", "SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS n_views, count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS buyers FROM events")
def filtered_counts(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("n_views"), F.count_distinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("buyers"))
