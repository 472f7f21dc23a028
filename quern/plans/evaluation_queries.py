"""Queries of retrieval evaluation, validation, gates and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import runtime
from ..functions import dates as D
from ..functions import text as X
from ..operators import corpus as C
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import splits as S
from ..operators import vector as V
from ..sources.tables import over, table
from .ranking_queries import KNN
from .registry import query

CASES = f"""{KNN}, gold AS (SELECT a.vec_id AS query_id, list(b.vec_id) AS gold FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND b.vec_id % 7 = 0 WHERE a.vec_id % 50 = 0 GROUP BY 1),
ret AS (SELECT query_id, list(vec_id ORDER BY pos) AS retrieved FROM knn WHERE pos <= 20 GROUP BY 1),
c0 AS (SELECT query_id, retrieved, coalesce(gold, []) AS gold FROM ret LEFT JOIN gold USING (query_id)),
c AS (SELECT *, len(list_intersect(retrieved[1:5], gold)) AS hits, list_position(list_transform(retrieved[1:5], lambda x: list_contains(gold, x)), true) AS rk, list_position(list_transform(retrieved, lambda x: list_contains(gold, x)), true) AS ra FROM c0)"""


def cases(spark, d):
    """Queries with what was retrieved for them and what counts as gold: vectors of the same label whose id is divisible by seven."""
    e = table(spark, d, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("_l"))
    is_gold = (F.col("label") == F.col("_l")) & (F.col("vec_id") % 7 == 0)
    found = V.exact_knn(asked, e, 20).join(e.select("vec_id", "label"), "vec_id").join(asked.select("query_id", "_l"), "query_id").select("query_id", "_l", "rank", is_gold.alias("g"))
    found = found.groupBy("query_id", "_l").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "g"))), lambda x: x["g"]).alias("flags"))
    gold = e.filter("vec_id % 7 = 0").groupBy(F.col("label").alias("_l")).agg(F.count("*").alias("_n"))
    df = found.join(gold, "_l", "left").withColumn("n_gold", (F.coalesce("_n", F.lit(0)) - (F.col("query_id") % 7 == 0).cast("int")).cast("int"))
    return E.case_metrics(df.withColumns({"route": F.when(F.col("query_id") % 3 == 0, "title").otherwise("detail"), "expected_route": F.when(F.col("query_id") % 4 == 0, "title").otherwise("detail")}))


@query("retrieval_metrics_a", f"WITH {CASES} SELECT count(*) AS n, round(avg((hits > 0)::INT), 6) AS recall_at_k, round(avg(CASE WHEN rk > 0 THEN 1.0 / rk ELSE 0.0 END), 6) AS mrr, round(sum(hits) / sum(len(gold)), 6) AS evidence_recall FROM c")
def retrieval_metrics_a(spark, d):
    return E.metrics_a(cases(spark, d))


@query("retrieval_metrics_b", f"WITH {CASES} SELECT count(*) FILTER (WHERE len(gold) > 0) AS evaluated, count(*) FILTER (WHERE len(gold) = 0) AS skipped, round(avg((hits > 0)::INT) FILTER (WHERE len(gold) > 0), 6) AS hit_at_k, round(avg(CASE WHEN ra > 0 THEN 1.0 / ra ELSE 0.0 END) FILTER (WHERE len(gold) > 0), 6) AS mrr_full, round(avg(hits / least(len(gold), 5)) FILTER (WHERE len(gold) > 0), 6) AS recall_min_k FROM c")
def retrieval_metrics_b(spark, d):
    return E.metrics_b(cases(spark, d))


@query("gold_ranks", f"WITH {CASES} SELECT query_id, CAST(coalesce(ra, 0) AS INT) AS first_rank FROM c")
def gold_ranks(spark, d):
    return cases(spark, d).select("query_id", F.coalesce("first_rank", F.lit(0)).alias("first_rank"))


@query("failure_buckets", f"""WITH {CASES}, b AS (SELECT query_id, concat_ws(',', CASE WHEN len(gold) = 0 THEN 'no_gold' END, CASE WHEN len(gold) > 0 AND coalesce(ra, 0) = 0 THEN 'gold_not_retrieved' END, CASE WHEN ra > 5 THEN 'gold_ranked_low' END, CASE WHEN (query_id % 3 = 0) <> (query_id % 4 = 0) THEN 'route_mismatch' END) AS buckets FROM c) SELECT * FROM b WHERE buckets <> ''""")
def failure_buckets(spark, d):
    return E.failures(cases(spark, d)).select("query_id", F.array_join("buckets", ",").alias("buckets"))


@query("failure_classes", f"""WITH {CASES}, b AS (SELECT query_id, CASE WHEN len(gold) = 0 THEN 'A' WHEN coalesce(ra, 0) = 0 THEN 'B' WHEN ra > 5 THEN 'C' WHEN (query_id % 3 = 0) <> (query_id % 4 = 0) THEN 'D' END AS failure_class FROM c) SELECT failure_class, count(*) AS n FROM b WHERE failure_class IS NOT NULL GROUP BY 1""")
def failure_classes(spark, d):
    return E.attributed(E.failures(cases(spark, d)), [("no_gold", "A"), ("gold_not_retrieved", "B"), ("gold_ranked_low", "C"), ("route_mismatch", "D")])


@query("ab_gate", """WITH o AS (SELECT unnest(['recall', 'latency_p95', 'route']) AS metric, unnest([(SELECT avg((quality = 1)::INT) FROM labels), (SELECT quantile_cont(value, 0.95) FROM events), 0.9]) AS v), n AS (SELECT unnest(['recall', 'latency_p95', 'route']) AS metric, unnest([(SELECT avg((toxic = 0)::INT) FROM labels), (SELECT quantile_cont(value, 0.9) FROM events), 0.95]) AS v)
SELECT metric, round(o.v, 6) AS old_value, round(n.v, 6) AS new_value, round(round(n.v, 6) - round(o.v, 6), 6) AS delta, CASE metric WHEN 'recall' THEN round(n.v, 6) >= 0.65 WHEN 'latency_p95' THEN round(n.v, 6) <= 1200 ELSE round(n.v, 6) >= 0.94 END AS passed FROM o JOIN n USING (metric)""")
def ab_gate(spark, d):
    lab = table(spark, d, "labels").agg(F.avg((F.col("quality") == 1).cast("int")).alias("a"), F.avg((F.col("toxic") == 0).cast("int")).alias("b"))
    ev = C.percentiles(table(spark, d, "events").select("value", F.lit(0).alias("_k")), "value", ["_k"], points=(90, 95)).select(F.col("linear_95").alias("a"), F.col("linear_90").alias("b"))
    long = lambda c, route: lab.select(F.lit("recall").alias("metric"), F.round(c, 6).alias("value")).unionByName(ev.select(F.lit("latency_p95").alias("metric"), F.round(c, 6).alias("value"))).unionByName(spark.range(1).select(F.lit("route").alias("metric"), F.lit(route).alias("value")))
    return E.gate(long("a", 0.9), long("b", 0.95), {"recall": 0.65, "latency_p95": 1200, "route": 0.94})


@query("class_coverage_deficits", "WITH a AS (SELECT lang, count(*) AS have FROM documents JOIN labels USING (doc_id) GROUP BY lang), b AS (SELECT lang, count(*) AS coming FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND n_chars > 5000 GROUP BY lang) SELECT lang, coalesce(have, 0) AS have, coalesce(coming, 0) AS coming, coalesce(have, 0) + coalesce(coming, 0) AS projected, greatest(0, 150 - coalesce(have, 0) - coalesce(coming, 0)) AS deficit FROM a FULL JOIN b USING (lang)")
def class_coverage_deficits(spark, d):
    docs, lab = table(spark, d, "documents").select("doc_id", "lang", "n_chars"), table(spark, d, "labels").select("doc_id")
    return E.deficits(docs.join(lab, "doc_id"), docs.join(lab, "doc_id", "left_anti").filter("n_chars > 5000"), "lang", 150)


@query("label_validation_errors", "SELECT doc_id, 'toxic_not_good' AS error FROM labels WHERE NOT (toxic = 0 OR quality = 0) UNION ALL SELECT doc_id, 'known_decision' FROM labels WHERE quality NOT IN (0, 1) UNION ALL SELECT doc_id, 'duplicate_key' FROM labels GROUP BY doc_id HAVING count(*) > 1")
def label_validation_errors(spark, d):
    return E.validated(table(spark, d, "labels"), "doc_id", [("toxic_not_good", (F.col("toxic") == 0) | (F.col("quality") == 0)), ("known_decision", F.col("quality").isin(0, 1))])


@query("orphan_rows", "SELECT vec_id AS doc_id, 'missing_parent' AS error FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def orphan_rows(spark, d):
    return E.orphans(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", table(spark, d, "labels"), "doc_id")


@query("store_presence", "SELECT doc_id, concat_ws(',', CASE WHEN doc_id IN (SELECT vec_id FROM embeddings) THEN 'vectors' END, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'labels' END) AS present_in, CASE (doc_id IN (SELECT vec_id FROM embeddings))::INT + (doc_id IN (SELECT doc_id FROM labels))::INT WHEN 2 THEN 'everywhere' WHEN 0 THEN 'missing' ELSE 'partly' END AS status FROM documents")
def store_presence(spark, d):
    return E.presence(table(spark, d, "documents"), "doc_id", {"vectors": (table(spark, d, "embeddings"), "vec_id"), "labels": (table(spark, d, "labels"), "doc_id")})


@query("gold_evidence_coverage", "WITH g AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) SELECT item_id, count(doc_id) AS n_docs FROM benchmark LEFT JOIN g USING (item_id) GROUP BY item_id")
def gold_evidence_coverage(spark, d):
    """Documents that hold a whole passage."""
    b, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    pairs = E.containing(docs, "text", b, "text")
    n = pairs.join(docs.groupBy("text").agg(F.count("*").alias("_n")), "text").groupBy(F.col("passage").alias("text")).agg(F.sum("_n").alias("_n"))
    return b.join(n, "text", "left").select("item_id", F.coalesce("_n", F.lit(0)).alias("n_docs"))


@query("gold_ids_in_corpus", "SELECT item_id, item_id IN (SELECT doc_id FROM documents) AS in_corpus FROM benchmark")
def gold_ids_in_corpus(spark, d):
    """Gold ids that the corpus has (semi join) and lacks (anti join)."""
    b, docs = table(spark, d, "benchmark").select("item_id"), table(spark, d, "documents").select(F.col("doc_id").alias("item_id"))
    return b.join(docs, "item_id", "left_semi").withColumn("in_corpus", F.lit(True)).unionByName(b.join(docs, "item_id", "left_anti").withColumn("in_corpus", F.lit(False)))


WINDOWS = "CASE doc_id % 4 WHEN 0 THEN '2021-05 early' WHEN 1 THEN '2020-11 mid' WHEN 2 THEN '2019-02 late' ELSE '2018-07' END"


@query("time_sensitive_labels", """WITH e AS (SELECT doc_id, CAST(to_timestamp(1704067200 - (doc_id * 7919 % 4000) * 86400) AS DATE) AS day FROM documents JOIN labels USING (doc_id)),
w AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN DATE '2021-05-01' WHEN 1 THEN DATE '2020-11-11' WHEN 2 THEN DATE '2019-02-21' ELSE DATE '2018-07-01' END AS lo, CASE doc_id % 4 WHEN 0 THEN DATE '2021-05-10' WHEN 1 THEN DATE '2020-11-20' WHEN 2 THEN DATE '2019-02-28' ELSE DATE '2018-07-31' END AS hi FROM e)
SELECT doc_id, CAST(lo AS VARCHAR) AS "first", CAST(hi AS VARCHAR) AS "last", day BETWEEN lo AND hi AS inside FROM w""")
def time_sensitive_labels(spark, d):
    """Whether the evidence's date lies in the window that a label's text names."""
    from ..sources.tables import news

    lab = table(spark, d, "labels").select("doc_id", F.expr(WINDOWS).alias("_w"))
    j = lab.join(news(spark, d).select("doc_id", F.to_date(F.timestamp_seconds("publish_ts")).alias("_day")), "doc_id").withColumn("_i", D.third_of_month(F.col("_w")))
    return j.select("doc_id", F.col("_i.first").cast("string").alias("first"), F.col("_i.last").cast("string").alias("last"), F.col("_day").between(F.col("_i.first"), F.col("_i.last")).alias("inside"))


ANSWERS = """SELECT conv_id, turn, text || CASE conv_id % 4 WHEN 0 THEN ' [news:' || conv_id || ']' WHEN 1 THEN ' [news:x' || conv_id || ']' ELSE '' END || CASE turn % 3 WHEN 1 THEN ' in 2023' ELSE '' END || CASE conv_id % 9 WHEN 2 THEN ' sorry' ELSE '' END AS answer,
 CASE WHEN conv_id % 5 = 0 THEN 'tell of "the"' ELSE 'tell me' END || CASE WHEN conv_id % 7 = 0 THEN ' will it rise' ELSE '' END AS query, conv_id % 3 AS kind FROM conversations WHERE role = 'assistant'"""


@query("answer_contract_checks", f"""WITH a AS ({ANSWERS}), e AS (SELECT *, CASE kind WHEN 0 THEN '' WHEN 1 THEN answer ELSE 'other 1999' END AS evidence_text, contains(lower(answer), 'sorry') AS refused, list_filter(regexp_extract_all(answer, '\\[(news:[A-Za-z0-9_:.-]+)\\]', 1), lambda x: x <> 'news:' || conv_id OR kind = 0) AS strange, len(regexp_extract_all(answer, '\\[(news:[A-Za-z0-9_:.-]+)\\]', 1)) AS cited, contains(query, 'will it rise') AS asks, contains(lower(answer), 'guarantee') AS unsafe, contains(lower(answer), 'risk') AS guard FROM a),
v AS (SELECT *, kind = 0 AND refused AS free, len(list_filter(regexp_extract_all(regexp_replace(answer, '\\[[^\\]]*\\]', '', 'g'), '\\d+(?:\\.\\d+)?%?'), lambda x: NOT list_contains(regexp_extract_all(evidence_text, '\\d+(?:\\.\\d+)?%?'), x))) > 0 AS numbers FROM e),
w AS (SELECT conv_id, turn, CASE WHEN free THEN '' ELSE concat_ws(',', CASE WHEN kind = 0 THEN 'no_evidence_fact_answer' END, CASE WHEN len(strange) > 0 THEN 'invalid_citation' END, CASE WHEN kind <> 0 AND cited = 0 AND NOT refused THEN 'missing_citation' END, CASE WHEN length(answer) > 315 THEN 'max_chars_exceeded' END, CASE WHEN NOT refused AND contains(query, '"the"') AND NOT contains(evidence_text, 'the') THEN 'evidence_not_support_query' END, CASE WHEN asks AND NOT refused AND unsafe AND NOT guard THEN 'certainty' END, CASE WHEN asks AND NOT refused AND NOT unsafe AND NOT guard THEN 'missing_guard' END) END AS violations, CASE WHEN NOT free AND numbers THEN 'unsupported_number' ELSE '' END AS warnings FROM v)
SELECT conv_id, turn, violations, warnings, violations = '' AS passed, CASE WHEN violations <> '' THEN 'high' WHEN warnings <> '' THEN 'medium' ELSE 'low' END AS risk FROM w""")
def answer_contract_checks(spark, d):
    """Answers with known and unknown citations, numbers, refusals and questions with quoted terms, against no evidence, the answer's own text, or another one."""
    a = over(spark, ANSWERS, conversations=table(spark, d, "conversations"))
    ref = F.concat(F.lit("news:"), F.col("conv_id").cast("string"))
    a = a.withColumns({"citations": X.citations(F.col("answer")), "evidence": F.when(F.col("kind") == 0, F.array().cast("array<string>")).otherwise(F.array(ref)), "evidence_text": F.when(F.col("kind") == 0, "").when(F.col("kind") == 1, F.col("answer")).otherwise("other 1999"), "needs_evidence": F.lit(True), "must_cite": F.lit(True)})
    done = E.answer_checks(a, longest=300, refusals=["sorry"], unsafe=["guarantee"], guards=["risk"], asks=["will it rise"])
    return done.select("conv_id", "turn", F.array_join("violations", ",").alias("violations"), F.array_join("warnings", ",").alias("warnings"), "passed", "risk")


@query("citation_anti_join", "WITH c AS (SELECT doc_id, 'news:' || doc_id AS ref, 'news:' || (doc_id * 2) AS other FROM documents) SELECT doc_id, other AS unknown FROM c WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)")
def citation_anti_join(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    answer = F.format_string("see [news:%d] and [news:%d]", F.col("doc_id"), F.col("doc_id") * 2)
    cited = docs.select("doc_id", F.explode(X.citations(answer)).alias("unknown"))
    return cited.join(docs.select(F.concat(F.lit("news:"), F.col("doc_id").cast("string")).alias("unknown")), "unknown", "left_anti").select("doc_id", "unknown")


@query("large_copy", "WITH a AS (SELECT DISTINCT doc_id, substr(text, i, 50) AS w FROM (SELECT doc_id, text, unnest(range(1, length(text) - 48)) AS i FROM documents WHERE length(text) >= 50)), e AS (SELECT DISTINCT item_id, substr(text, i, 50) AS w FROM (SELECT item_id, text, unnest(range(1, length(text) - 48)) AS i FROM benchmark WHERE length(text) >= 50)) SELECT DISTINCT doc_id AS answer_id, item_id AS evidence_id FROM a JOIN e USING (w)")
def large_copy(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("answer_id"), F.col("text").alias("answer"))
    return E.large_copies(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("evidence_id"), F.col("text").alias("evidence")))


@query("group_split", """WITH RECURSIVE d AS (SELECT doc_id, lang, 't:' || sha1(text) AS a, 't:line ' || sha1(split_part(text, chr(10), 1)) AS b FROM documents JOIN labels USING (doc_id)),
t AS (SELECT doc_id, a AS tok FROM d UNION SELECT doc_id, b FROM d),
reach(doc_id, tok) AS (SELECT doc_id, tok FROM t UNION SELECT r.doc_id, t2.tok FROM reach r JOIN t t1 ON t1.tok = r.tok JOIN t t2 ON t2.doc_id = t1.doc_id),
g AS (SELECT doc_id, min(tok) AS k FROM reach GROUP BY doc_id), n AS (SELECT k, lang, count(*) AS n FROM g JOIN d USING (doc_id) GROUP BY k, lang),
c AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n, CAST(sum(sum(n)) OVER () AS BIGINT) AS every FROM n GROUP BY lang), x AS (SELECT *, least(CAST(ceil(every * CAST(0.3 AS DOUBLE)) AS BIGINT), every - 1) AS goal FROM c),
y AS (SELECT *, n * goal % every AS rest, least(n * goal // every, n - 1) AS base FROM x),
q AS (SELECT lang, goal, base + CASE WHEN row_number() OVER (ORDER BY base < n - 1 DESC, rest DESC, n DESC, lang) <= goal - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM y),
w AS (SELECT k, '[' || string_agg('{"class":"' || lang || '","n":' || n || '}', ',' ORDER BY lang) || ']' AS kind, CAST(sum(n) AS BIGINT) AS size FROM n GROUP BY k),
o AS (SELECT kind, size, count(*) AS copies, min(k) AS one, row_number() OVER (ORDER BY size, sha256('0:' || kind)) AS j FROM w GROUP BY kind, size),
z AS (SELECT o.j, list(coalesce(n.n, 0) ORDER BY q.lang) AS v FROM o CROSS JOIN q LEFT JOIN n ON n.k = o.one AND n.lang = q.lang GROUP BY o.j),
l AS (SELECT list(v ORDER BY j) AS v, list(size ORDER BY j) AS size, list(copies ORDER BY j) AS copies FROM o JOIN z USING (j)), m AS (SELECT list(CAST(quota AS BIGINT) ORDER BY lang) AS lack, max(goal) AS goal FROM q),
b AS (SELECT copies AS own, lack, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS pick FROM l, m UNION ALL
SELECT list_transform(own, lambda c, i: CASE WHEN i = best THEN c - 1 ELSE c END), list_transform(lack, lambda d, i: greatest(0, d - v[best][i])), total + size[best], best
FROM (SELECT *, list_position(gains, list_max(gains)) AS best FROM (SELECT b.*, l.v, l.size, list_transform(own, lambda c, i: CASE WHEN c > 0 AND total + l.size[i] <= m.goal THEN greatest(CAST(list_sum(list_transform(b.lack, lambda d, j: least(d, l.v[i][j]))) AS DOUBLE), 0.01) ELSE -1 END) AS gains FROM b, l, m) WHERE list_max(gains) > 0)),
e AS (SELECT * FROM b ORDER BY total DESC LIMIT 1), v AS (SELECT o.*, e.own[j] AS rest, e.total, m.goal FROM o, e, m),
f AS (SELECT j FROM v WHERE rest > 0 AND abs(goal - total - size) < goal - total ORDER BY abs(goal - total - size), j LIMIT 1), g2 AS (SELECT kind, copies - rest + CASE WHEN j IN (SELECT j FROM f) THEN 1 ELSE 0 END AS held FROM v),
h AS (SELECT k, CASE WHEN row_number() OVER (PARTITION BY kind ORDER BY sha256('0:' || k), k) <= held THEN 'heldout' ELSE 'train' END AS side FROM w JOIN g2 USING (kind))
SELECT side, lang, CAST(sum(n) AS BIGINT) AS n FROM n JOIN h USING (k) GROUP BY side, lang""")
def group_split(spark, d):
    """Labelled documents that share a text or a first line stay on one side."""
    tokens = F.array(F.sha1("text"), F.concat(F.lit("line "), F.sha1(F.substring_index("text", "\n", 1))))
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id").select("doc_id", "lang", tokens.alias("tokens"))
    g = G.groups_by_token(docs, "doc_id", "tokens").join(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "lang"), "doc_id")
    counted = runtime.written(g.groupBy("group_key", F.col("lang").alias("class")).agg(F.count("*").alias("n")), "groups")
    return counted.join(S.split_groups(counted), "group_key").groupBy("side", F.col("class").alias("lang")).agg(F.sum("n").alias("n"))


@query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    e = table(spark, d, "events")
    p = C.percentiles(e, "value", ["event_type"], points=(50, 95)).select("event_type", F.round("linear_50", 6).alias("p50"), F.round("linear_95", 6).alias("p95"))
    return p.join(e.groupBy("event_type").agg(F.count("*").alias("n")), "event_type")


@query("status_histogram", "SELECT role, count(*) AS n, count(*) FILTER (WHERE length(text) > 200) AS n_long FROM conversations GROUP BY role")
def status_histogram(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.length("text") > 200).alias("n_long"))


@query("promotion_gate", "WITH c AS (SELECT count(*) AS accepted, count(*) FILTER (WHERE quality = 0) AS rejected, count(*) FILTER (WHERE toxic = 1) AS toxic FROM labels) SELECT accepted, concat_ws(',', CASE WHEN accepted < 100 THEN 'too_few' END, CASE WHEN toxic > 0 THEN 'toxic_rows' END) AS blockers, CASE WHEN accepted >= 100 AND toxic = 0 THEN 'ready' ELSE 'blocked' END AS stage FROM c")
def promotion_gate(spark, d):
    c = table(spark, d, "labels").agg(F.count("*").alias("accepted"), F.count_if(F.col("toxic") == 1).alias("_t"))
    b = F.array_compact(F.array(F.when(F.col("accepted") < 100, F.lit("too_few")), F.when(F.col("_t") > 0, F.lit("toxic_rows"))))
    return c.select("accepted", F.array_join(b, ",").alias("blockers"), F.when(F.size(b) == 0, "ready").otherwise("blocked").alias("stage"))


@query("confirmation_pivot", "SELECT lang, count(*) FILTER (WHERE quality = 1) AS accept, count(*) FILTER (WHERE quality = 0) AS reject, count(*) FILTER (WHERE quality IS NULL) AS open FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def confirmation_pivot(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("decision", F.when(F.col("quality") == 1, "accept").when(F.col("quality") == 0, "reject").otherwise("open"))
    return j.groupBy("lang").pivot("decision", ["accept", "reject", "open"]).agg(F.count(F.lit(1))).na.fill(0)


@query("expanded_union", "SELECT doc_id, 'gold' AS origin FROM labels WHERE quality = 1 AND toxic = 0 UNION ALL SELECT vec_id, 'accepted' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")
def expanded_union(spark, d):
    gold = table(spark, d, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    more = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")).join(gold, "doc_id", "left_anti")
    return gold.withColumn("origin", F.lit("gold")).unionByName(more.withColumn("origin", F.lit("accepted")))


SPLIT = "CASE query_id % 3 WHEN 0 THEN 'heldout' ELSE 'train' END"
_CHECK_SQL = ", ".join(f"round(avg(CASE (query_id // 50) % {i + 2} WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 END), 6) AS {name}" for i, name in enumerate(E.CHECKS.values()))


@query("evaluation_report", f"""WITH {CASES}, r AS (SELECT *, {SPLIT} AS split, query_id % 4 <> 0 AS should_answer, query_id % 12 = 0 AS should_refuse, CASE WHEN query_id % 11 <> 0 THEN CASE WHEN query_id % 8 = 0 THEN 'sorry' ELSE 'yes' END END AS answer, query_id % 5 AS cite, query_id % 9 AS m9, query_id * 37 % 1000 / 7.0 AS latency FROM c),
m AS (SELECT *, NOT should_answer OR should_refuse AS no_answer FROM r), w AS (SELECT *, NOT no_answer AND len(gold) > 0 AS answerable FROM m)
SELECT split, count(*) AS cases, count(*) FILTER (WHERE answerable) AS answerable, round(avg((hits > 0)::INT) FILTER (WHERE answerable), 6) AS recall_at_k, round(avg(CASE WHEN rk > 0 THEN 1.0 / rk ELSE 0.0 END) FILTER (WHERE answerable), 6) AS mrr, round(avg(hits / len(gold)) FILTER (WHERE answerable), 6) AS evidence_recall,
 round(avg((cite = 1)::INT) FILTER (WHERE answer IS NOT NULL AND query_id % 2 = 0), 6) AS citation_valid_rate, round(avg((answer = 'sorry')::INT) FILTER (WHERE no_answer AND answer IS NOT NULL), 6) AS no_answer_accuracy, round(avg((answer = 'sorry')::INT) FILTER (WHERE should_refuse AND answer IS NOT NULL), 6) AS refusal_correctness,
 round(avg(((query_id % 3 = 0) = (query_id % 4 = 0))::INT), 6) AS route_accuracy, round(avg(CASE m9 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1 END) FILTER (WHERE answer IS NOT NULL), 6) AS validation_pass_rate, round(avg((m9 IN (1, 2))::INT) FILTER (WHERE answer IS NOT NULL AND m9 <> 0), 6) AS hallucination_risk_rate, {_CHECK_SQL},
 round(avg((query_id % 13 = 0)::INT), 6) AS timeout_rate, round(avg((query_id % 13 <> 0)::INT), 6) AS done_rate, round(avg(latency), 6) AS latency_mean, round(quantile_cont(latency, 0.5), 6) AS latency_p50, round(quantile_cont(latency, 0.95), 6) AS latency_p95 FROM w GROUP BY split""")
def evaluation_report(spark, d):
    """All rates, a row for each split. Answers, citations, verdicts and checks follow from the query's id."""
    q = F.col("query_id")
    ref = lambda n: F.array(F.lit(n))
    made = cases(spark, d).withColumns({
        "split": F.when(q % 3 == 0, "heldout").otherwise("train"), "should_answer": q % 4 != 0, "should_refuse": q % 12 == 0, "answer": F.when(q % 11 != 0, F.when(q % 8 == 0, "sorry").otherwise("yes")),
        "citations": F.when(q % 5 == 1, ref("a")).when(q % 5 == 2, ref("x")).otherwise(F.array().cast("array<string>")), "evidence": ref("a"), "must_cite": q % 2 == 0, "validated": F.when(q % 9 != 0, q % 9 != 1), "risk": F.when((q % 9).isin(1, 2), "high").otherwise("low"),
        "latency_ms": q * 37 % 1000 / 7.0, "error": q % 13 == 0, "done": q % 13 != 0, **{c: F.when(F.floor(q / 50) % (i + 2) == 0, True).when(F.floor(q / 50) % (i + 2) == 1, False) for i, c in enumerate(E.CHECKS)},
    })
    return E.report(made, ["split"], refusal=F.contains(F.col("answer"), F.lit("sorry")))
