"""Queries of filters by metadata, carried evidence, gold sets, coverage, readability, gates, loads and routed retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import table_functions
from ..functions import text as X
from ..operators import corpus as C
from ..operators import evaluation as E
from ..operators import ranking as K
from ..operators import relational as R
from ..sources.tables import EVENTS, NEWS, news, over, table
from . import retrieval as P
from .corpus_queries import IS_GARBLED, ODD
from .ranking_queries import CAND, KNN
from .registry import query

CHUNKS = """f AS (SELECT doc_id, source, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), b AS (SELECT doc_id, source, t, unnest(range(0, least(8, greatest(CAST(ceil((length(t) - 600) / 480.0) AS INT), 0) + 1))) AS i FROM f WHERE t <> ''),
c AS (SELECT doc_id, source, 'summary' AS chunk_type, 0 AS chunk_index, length(substr(t, 1, 200)) AS n FROM f UNION ALL SELECT doc_id, source, 'body', CAST(i AS INT), length(substr(t, i * 480 + 1, 600)) FROM b)"""


@query("metadata_filtered_chunks", f"WITH {CHUNKS} SELECT 'source' AS given, doc_id, chunk_index, n AS chunk_chars FROM c WHERE chunk_type = 'body' AND source = 'src1' UNION ALL SELECT 'parent', doc_id, chunk_index, n FROM c WHERE chunk_type = 'body' AND doc_id = 77")
def metadata_filtered_chunks(spark, d):
    """Body chunks of a source's first alias, and those of one parent."""
    c = C.document_chunks(news(spark, d))
    told = lambda name, df: df.select(F.lit(name).alias("given"), "doc_id", "chunk_index", F.length("chunk_text").alias("chunk_chars"))
    return told("source", K.metadata_filter(c, chunk_type="body", sources=["src1", "src2"])).unionByName(told("parent", K.metadata_filter(c, chunk_type="body", parent=77)))


@query("carried_evidence", f"""WITH {CHUNKS}, m AS (SELECT conv_id, turn, (conv_id * 10 + turn % 3) AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
i AS (SELECT conv_id, doc_id, min(p) AS first FROM m WHERE p <= 8 GROUP BY 1, 2), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY first) - 1 AS INT) AS pos FROM i), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, chunk_type DESC) AS r FROM c)
SELECT conv_id AS query_id, doc_id, pos, chunk_type, chunk_index, greatest(1.0, n / 150.0)::DOUBLE AS score FROM k JOIN t USING (doc_id) WHERE r <= 2""")
def carried_evidence(spark, d):
    """Each talk carries one of three documents a turn; chunks score by their length."""
    m = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", (F.col("conv_id") * 10 + F.col("turn") % 3).alias("ref")))), lambda x: x["ref"]).alias("ids"))
    c = C.document_chunks(news(spark, d)).select("doc_id", "chunk_type", "chunk_index", (F.length("chunk_text") / 150.0).alias("score"))
    return K.carried(m, c).select("query_id", "doc_id", "pos", "chunk_type", "chunk_index", "score")


@query("keyword_gold_sets", f"WITH {NEWS}, w AS (SELECT item_id, unnest([lower(split_part(text, ' ', 1)), lower(split_part(text, ' ', 3))]) AS k FROM benchmark) SELECT DISTINCT item_id, doc_id FROM w JOIN news ON contains(lower(title), k) WHERE k <> ''")
def keyword_gold_sets(spark, d):
    words = F.split("text", " ")
    b = table(spark, d, "benchmark").select("item_id", F.array(F.get(words, F.lit(0)), F.get(words, F.lit(2))).alias("keywords"))
    return E.keyword_gold(b, news(spark, d), "item_id", "keywords", "title", "doc_id")


@query("case_diagnostics", "WITH g AS (SELECT doc_id, quality, toxic FROM labels) SELECT vec_id AS doc_id, coalesce(quality, -1) AS diag_quality, coalesce(toxic, -1) AS diag_toxic, g.doc_id IS NOT NULL AS has_diagnosis FROM embeddings LEFT JOIN g ON g.doc_id = vec_id")
def case_diagnostics(spark, d):
    return E.diagnosed(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id").na.fill(-1)


@query("gold_existence_summary", """WITH p AS (SELECT DISTINCT doc_id, doc_id IN (SELECT vec_id FROM embeddings) AS v, doc_id IN (SELECT doc_id FROM labels) AS l FROM documents)
SELECT 'status' AS section, CASE v::INT + l::INT WHEN 2 THEN 'everywhere' WHEN 1 THEN 'partly' ELSE 'missing' END AS name, count(*) AS n FROM p GROUP BY 2 UNION ALL SELECT 'store', 'vectors', count(*) FROM p WHERE v HAVING count(*) > 0 UNION ALL SELECT 'store', 'labels', count(*) FROM p WHERE l HAVING count(*) > 0""")
def gold_existence_summary(spark, d):
    return E.existence_summary(E.presence(table(spark, d, "documents"), "doc_id", {"vectors": (table(spark, d, "embeddings"), "vec_id"), "labels": (table(spark, d, "labels"), "doc_id")}))


@query("scenario_coverage", "WITH h AS (SELECT coalesce(lang, '') AS scenario, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT unnest(['en', 'de', 'it']) AS scenario) SELECT coalesce(h.scenario, r.scenario) AS scenario, coalesce(n, 0) AS n, r.scenario IS NOT NULL AS required, r.scenario IS NOT NULL AND coalesce(n, 0) = 0 AS missing FROM h FULL JOIN r USING (scenario)")
def scenario_coverage(spark, d):
    return E.scenario_coverage(table(spark, d, "documents"), "lang", ["en", "de", "it"])


_ROWS = "SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN ' ' WHEN 1 THEN chr(65533) || text WHEN 2 THEN 'what ????' WHEN 3 THEN repeat('12345 67890 ', 20) WHEN 4 THEN '新闻 ' || text ELSE text END AS text FROM documents"
_SPARE = "SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0"


@query("readability_summary", f"""WITH x AS ({_ROWS}), s AS ({_SPARE}), j AS (SELECT regexp_replace(CASE WHEN trim(x.text) = '' THEN coalesce(s.text, '') ELSE x.text END, '^\\s+|\\s+$', '', 'g') AS t FROM x LEFT JOIN s USING (doc_id)),
h AS (SELECT t, substr(t, 1, 1000) AS h FROM j), o AS (SELECT *, {ODD.format("h")} AS odd FROM h), q AS (SELECT *, t = '' AS nil, contains(t, chr(65533)) AS lost, contains(t, '????') AS marks, t <> '' AND {IS_GARBLED.format("h", "odd")} AS bad FROM o)
SELECT count(*) AS rows, count(*) FILTER (WHERE NOT nil) AS with_text, count(*) FILTER (WHERE nil) AS without_text, count(*) FILTER (WHERE regexp_matches(t, '[\\x{{4e00}}-\\x{{9fff}}]')) AS with_cjk, count(*) FILTER (WHERE lost) AS replacement_char, count(*) FILTER (WHERE marks) AS question_marks,
 count(*) FILTER (WHERE bad) AS garbled, count(*) FILTER (WHERE nil OR lost OR marks) AS blocking, count(*) FILTER (WHERE bad AND NOT (nil OR lost OR marks)) AS noted FROM q""")
def readability_summary(spark, d):
    """Documents, some of them blank, broken or in other scripts; every second one has a spare text."""
    docs = table(spark, d, "documents")
    return E.readability(over(spark, _ROWS.replace("chr(65533)", "'�'"), documents=docs), over(spark, _SPARE, documents=docs), "doc_id", "text")


@query("sample_gate", """WITH c AS (SELECT count(*) AS n, count(DISTINCT nullif(source, '')) AS sources, count(*) FILTER (WHERE trim(coalesce(text, '')) <> '') + count(*) FILTER (WHERE coalesce(lang, '') <> '') + count(*) FILTER (WHERE coalesce(source, '') <> '') AS filled,
 avg(regexp_matches(coalesce(text, ''), 'https?://')::INT) AS url, avg((coalesce(lang, '') <> '')::INT) AS domain, avg(contains(coalesce(text, ''), 'tion')::INT) AS tags, count(*) FILTER (WHERE n_chars < 0) AS errors FROM documents), s AS (SELECT n, sources, round(filled / (3.0 * n), 4) AS r, round(url, 4) AS u, round(domain, 4) AS p, round(tags, 4) AS t, errors FROM c),
g AS (SELECT n >= 30 AS a, sources >= 4 AS b, r >= 0.95 AS c, u >= 0.95 AS d, p >= 0.9 AS e, t >= 0.7 AS f, errors <= 0 AS h FROM s)
SELECT unnest(['samples_at_least', 'sources_at_least', 'required_rate_at_least', 'url_rate_at_least', 'domain_rate_at_least', 'tag_rate_at_least', 'errors_at_most', 'ready']) AS condition, unnest([a, b, c, d, e, f, h, a AND b AND c AND d AND e AND f AND h]) AS passed FROM g""")
def sample_gate(spark, d):
    """Seven conditions: samples, sources, required fields, links, domains, tags and errors."""
    t = X.text(F.col("text"))
    rates = {"url_rate": t.rlike("https?://"), "domain_rate": X.text(F.col("lang")) != "", "tag_rate": F.contains(t, F.lit("tion"))}
    done = E.completeness(table(spark, d, "documents"), ["text", "lang", "source"], rates, F.col("n_chars") < 0, source="source")
    return E.gated(done, {"samples": 30, "sources": 4, "required_rate": 0.95, "url_rate": 0.95, "domain_rate": 0.9, "tag_rate": 0.7}, {"errors": 0})


@query("four_channel_union", f"""WITH {CAND}, k AS (SELECT query_id, doc_id, pos FROM cand), a AS (SELECT *, 0 AS p, 'dense' AS channel FROM k WHERE pos <= 5 UNION ALL SELECT *, 1, 'title' FROM k WHERE pos % 2 = 0 AND pos <= 12 UNION ALL SELECT *, 2, 'chunk' FROM k WHERE pos % 3 = 0 AND pos <= 18 UNION ALL SELECT *, 3, 'carried' FROM k WHERE pos % 5 = 0),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY p, pos) AS n FROM a) SELECT query_id, doc_id, channel, row_number() OVER (PARTITION BY query_id ORDER BY p, pos, doc_id) AS merged_pos FROM w WHERE n = 1""")
def four_channel_union(spark, d):
    k = P.recalled(spark, d).select("query_id", "doc_id", "pos")
    channels = [("dense", k.filter("pos <= 5")), ("title", k.filter("pos % 2 = 0 AND pos <= 12")), ("chunk", k.filter("pos % 3 = 0 AND pos <= 18")), ("carried", k.filter("pos % 5 = 0"))]
    return K.merged(channels).select("query_id", "doc_id", "channel", "merged_pos")


@query("leakage_evidence", """WITH s AS (SELECT doc_id, quality = 1 AS heldout, sha1(text) AS token FROM labels JOIN documents USING (doc_id)), k AS (SELECT 'id' AS kind, CAST(doc_id AS VARCHAR) AS v, heldout FROM s UNION ALL SELECT 'evidence', token, heldout FROM s),
g AS (SELECT kind, v, bool_or(heldout) AS h, bool_or(NOT heldout) AS t FROM k GROUP BY 1, 2) SELECT kind, count(*) FILTER (WHERE h AND t) AS shared, count(*) AS either FROM g GROUP BY kind""")
def leakage_evidence(spark, d):
    """Ids and texts that both sides of a split have, and all that either has."""
    s = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.sha1("text").alias("token")), "doc_id").withColumn("heldout", F.col("quality") == 1)
    k = s.select(F.explode(F.array(F.struct(F.lit("id").alias("kind"), F.col("doc_id").cast("string").alias("v")), F.struct(F.lit("evidence").alias("kind"), F.col("token").alias("v")))).alias("_x"), "heldout")
    g = k.groupBy("_x.kind", "_x.v").agg(F.bool_or("heldout").alias("h"), F.bool_or(~F.col("heldout")).alias("t"))
    return g.groupBy("kind").agg(F.count_if(F.col("h") & F.col("t")).alias("shared"), F.count("*").alias("either"))


@query("token_owners", "WITH t AS (SELECT event_id AS token, user_id AS c_custkey, ts + INTERVAL 7 DAY AS until FROM events) SELECT token, c_custkey, c_name FROM t JOIN customer USING (c_custkey) WHERE until >= TIMESTAMP '2024-01-25'")
def token_owners(spark, d):
    t = table(spark, d, "events").select(F.col("event_id").alias("token"), F.col("user_id").alias("c_custkey"), F.expr("ts + INTERVAL 7 DAY").alias("until"))
    return R.live_owner(t, table(spark, d, "customer").select("c_custkey", "c_name"), "token", "c_custkey", "until", F.expr("timestamp_ntz'2024-01-25 00:00:00'"))


@query("incremental_load", f"WITH {NEWS}, n AS (SELECT title, min((doc_id, category)) AS x FROM news WHERE source <> 'src1' AND title NOT IN (SELECT title FROM news WHERE source = 'src1') GROUP BY title) SELECT title, x[1] AS doc_id, CASE x[2] WHEN 'en' THEN 2 WHEN 'de' THEN 3 ELSE 1 END AS category_id FROM n")
def incremental_load(spark, d):
    n = news(spark, d)
    fresh = R.incremental(n.filter("source = 'src1'"), n.filter("source <> 'src1'").select("doc_id", "title", "category"), {"en": 2, "de": 3}, kind="category", key="title", default=1)
    return fresh.select("title", "doc_id", "category_id")


@query("tool_functions", f"""WITH {NEWS}, {EVENTS} SELECT 'detail' AS tool, doc_id FROM news WHERE doc_id = 77 UNION ALL SELECT * FROM (SELECT 'search', doc_id FROM news WHERE contains(lower(title), 'the') ORDER BY publish_ts DESC, doc_id LIMIT 8)
UNION ALL SELECT * FROM (SELECT 'related', doc_id FROM news WHERE category = (SELECT category FROM news WHERE doc_id = 77) AND doc_id <> 77 ORDER BY views DESC, publish_ts DESC, doc_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'recommend', doc_id FROM news WHERE doc_id NOT IN (SELECT item FROM ev WHERE user_id = 7 AND event_type = 'view' AND item IS NOT NULL) ORDER BY views DESC, publish_ts DESC, doc_id LIMIT 5)""")
def tool_functions(spark, d):
    """Searches as SQL table functions."""
    table_functions.register(spark, d)
    return spark.sql("SELECT 'detail' AS tool, doc_id FROM news_detail(77) UNION ALL SELECT 'search', doc_id FROM news_search('the') UNION ALL SELECT 'related', doc_id FROM related_news(77) UNION ALL SELECT 'recommend', doc_id FROM recommend_news(7)")


_WISH = "CASE (query_id // 50) % 4 WHEN 0 THEN ' in 2020-07' WHEN 1 THEN ' from the first wire' WHEN 2 THEN ' the latest' ELSE '' END"
_ROUTED = f"""asked AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 50 = 0),
a AS (SELECT query_id, qe, title AS query, lower(title || {_WISH}) AS ask FROM asked JOIN news ON doc_id = query_id),
s AS (SELECT *, contains(ask, 'src1') OR contains(ask, 'first wire') AS s1, contains(ask, 'src2') OR contains(ask, 'second wire') AS s2 FROM a),
rt AS (SELECT *, CASE WHEN s1 OR s2 THEN 'source' WHEN contains(ask, 'latest') THEN 'timeline' WHEN contains(ask, 'detail') OR contains(ask, 'full text') OR contains(ask, 'what does it say') THEN 'detail' ELSE 'title' END AS route,
 CASE WHEN NOT (s1 OR s2) AND contains(ask, 'tion') THEN 'topic' ELSE 'default' END AS collection, CASE WHEN s1 AND NOT s2 THEN 'src1' WHEN s2 AND NOT s1 THEN 'src2' END AS wanted FROM s),
p AS (SELECT query_id, query, route, collection, wanted, vec_id, round(list_cosine_similarity(qe, embedding::DOUBLE[]), 6) AS score FROM rt JOIN embeddings ON vec_id <> query_id AND (collection = 'default' OR vec_id IN (SELECT doc_id FROM news WHERE category = 'en'))),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS pos FROM p) WHERE pos <= 50),
all0 AS (SELECT query_id, n.doc_id, score, pos, n.title, n.content AS text, n.source, n.category, n.publish_ts, query, route, collection, wanted FROM near JOIN news n ON n.doc_id = vec_id),
cand AS (SELECT * FROM (SELECT *, bool_or(source = wanted) OVER (PARTITION BY query_id) AS found FROM all0) WHERE wanted IS NULL OR NOT found OR source = wanted), """
assert KNN in CAND


@query("retrieval_routed", f"""WITH {NEWS}, {_ROUTED} {CAND[CAND.index("lex0 AS"):]}, h AS (SELECT *, round(0.7 * nv + 0.3 * nl, 6) AS hybrid_score FROM norm), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, score DESC, doc_id) AS r FROM h),
g AS (SELECT *, count(*) FILTER (WHERE quality_score > 0.35) OVER (PARTITION BY query_id) < 5 AS fallback FROM r), t AS (SELECT * FROM g WHERE (quality_score > 0.35 OR fallback) AND (route <> 'timeline' OR recency_score >= 0.45)),
p2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(source = wanted, FALSE) DESC, r) AS rank FROM t) SELECT query_id, doc_id, route, collection, hybrid_score, rank FROM p2 WHERE rank <= 5""")
def retrieval_routed(spark, d):
    return P.v1_routed(spark, d).select("query_id", "doc_id", "route", "collection", "hybrid_score", "rank")
