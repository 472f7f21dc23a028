"""Queries of vector search, ranking, merging and composed retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..operators import ranking as K
from ..operators import scorers as Z
from ..operators import vector as V
from ..sources.tables import NEWS, NOW, news, table
from . import retrieval as P
from . import retrieval_sql as W
from .registry import query

KNN = """asked AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 50 = 0),
scored AS (SELECT query_id, vec_id, label, round(list_cosine_similarity(qe, embedding::DOUBLE[]), 6) AS score FROM asked, embeddings WHERE vec_id <> query_id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS pos FROM scored) WHERE pos <= 50)"""
TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
CAND = f"""{NEWS}, {KNN},
cand AS (SELECT query_id, n.doc_id, score, pos, n.title, n.content AS text, n.source, n.category, n.publish_ts, q.title AS query FROM knn JOIN news n ON n.doc_id = vec_id JOIN news q ON q.doc_id = query_id),
lex0 AS (SELECT *, {TOKENS.format("query")} AS qt, {TOKENS.format("title || ' ' || text || ' ' || source")} AS dt FROM cand),
lex AS (SELECT *, CASE WHEN len(qt) = 0 OR len(dt) = 0 THEN 0.0 ELSE len(list_intersect(qt, dt)) / len(qt) END AS lexical_score,
 round(greatest(0.05, least(1.0, 1.0 - CASE WHEN trim(title) = '' THEN 0.55 ELSE 0 END - CASE WHEN length(trim(text)) < 12 THEN 0.20 ELSE 0 END
  - CASE WHEN contains(lower(title || ' ' || substr(text, 1, 160)), 'lorem') OR contains(lower(title || ' ' || substr(text, 1, 160)), '###') THEN 0.85 ELSE 0 END
  - least(0.75, 0.25 * (contains(title, '!!')::INT + contains(title, '***')::INT)))), 6) AS quality_score,
 CASE WHEN (1704067200 - publish_ts) / 86400.0 <= 7 THEN 1.0 WHEN (1704067200 - publish_ts) / 86400.0 <= 30 THEN 0.95 WHEN (1704067200 - publish_ts) / 86400.0 <= 90 THEN 0.80 WHEN (1704067200 - publish_ts) / 86400.0 <= 180 THEN 0.60 WHEN (1704067200 - publish_ts) / 86400.0 <= 365 THEN 0.45 WHEN (1704067200 - publish_ts) / 86400.0 <= 1095 THEN 0.20 WHEN (1704067200 - publish_ts) / 86400.0 <= 3650 THEN 0.05 ELSE 0.0 END AS recency_score FROM lex0),
norm AS (SELECT *, CASE WHEN min(score) OVER w = max(score) OVER w THEN CASE WHEN max(score) OVER w > 0 THEN 1.0 ELSE 0.0 END ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS nv,
 CASE WHEN min(lexical_score) OVER w = max(lexical_score) OVER w THEN CASE WHEN max(lexical_score) OVER w > 0 THEN 1.0 ELSE 0.0 END ELSE (lexical_score - min(lexical_score) OVER w) / (max(lexical_score) OVER w - min(lexical_score) OVER w) END AS nl FROM lex WINDOW w AS (PARTITION BY query_id))"""


def rank_sql(expr: str, ties: str, limit: int = 5) -> str:
    return f"WITH {CAND}, h AS (SELECT *, round({expr}, 6) AS hybrid_score FROM norm) SELECT query_id, doc_id, hybrid_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, {ties}) AS rank FROM h) WHERE rank <= {limit}"


def top(df, n=5):
    return df.filter(F.col("rank") <= n).select("query_id", "doc_id", "hybrid_score", "rank")


@query("knn_exact", f"WITH {KNN} SELECT query_id, vec_id, score, pos AS rank FROM knn WHERE pos <= 10")
def knn_exact(spark, d):
    e = table(spark, d, "embeddings")
    return V.exact_knn(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, 10)


@query("knn_filtered_fallback", f"""WITH {KNN.split("knn AS")[0].rstrip().rstrip(",")},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored),
filt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM scored WHERE label = query_id // 50 % 10 + 5),
hit AS (SELECT query_id, vec_id, score, rk AS rank, FALSE AS fallback FROM filt WHERE rk <= 5)
SELECT * FROM hit UNION ALL SELECT query_id, vec_id, score, r, TRUE FROM ranked WHERE r <= 5 AND query_id NOT IN (SELECT query_id FROM hit)""")
def knn_filtered_fallback(spark, d):
    """Each query asks for one label; half of the labels asked for do not exist, so those queries fall back to all vectors."""
    e = table(spark, d, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    wanted = asked.withColumn("label", (F.floor(F.col("query_id") / 50) % 10 + 5).cast("int"))
    by_label = V.exact_knn(wanted, e.withColumn("label", F.col("label").cast("int")), 5, by="label")
    return V.with_fallback(by_label, V.exact_knn(asked, e, 5), "query_id")


@query("lexical_score", f"WITH {CAND} SELECT query_id, doc_id, round(lexical_score, 6) AS lexical_score FROM lex")
def lexical_score(spark, d):
    return K.lexical(P.recalled(spark, d)).select("query_id", "doc_id", F.round("lexical_score", 6).alias("lexical_score"))


@query("hybrid_rank", rank_sql("0.7 * nv + 0.3 * nl", "score DESC, doc_id"))
def hybrid_rank(spark, d):
    return top(K.hybrid(P.scored(P.recalled(spark, d))))


@query("quality_rank", rank_sql("0.62 * nv + 0.28 * nl + 0.10 * quality_score", "score DESC, doc_id"))
def quality_rank(spark, d):
    return top(K.quality_aware(P.scored(P.recalled(spark, d))))


@query("time_rank", rank_sql("0.24 * nv + 0.10 * nl + 0.58 * recency_score + 0.08 * quality_score", "recency_score DESC, score DESC, doc_id"))
def time_rank(spark, d):
    return top(K.time_aware(P.scored(P.recalled(spark, d))))


@query("fusion_rank", f"""WITH {CAND}, x AS (SELECT *, round((doc_id * 31 % 97) / 97.0, 6) AS cs, CAST(contains(title, 'the') AS INT) * 1.0 AS rb FROM norm),
y AS (SELECT *, min(cs) OVER w AS c0, max(cs) OVER w AS c1, min(rb) OVER w AS r0, max(rb) OVER w AS r1 FROM x WINDOW w AS (PARTITION BY query_id)),
h AS (SELECT *, round(0.4 * CASE WHEN c0 = c1 THEN CASE WHEN c1 > 0 THEN 1.0 ELSE 0.0 END ELSE (cs - c0) / (c1 - c0) END + 0.4 * nv + 0.2 * CASE WHEN r0 = r1 THEN CASE WHEN r1 > 0 THEN 1.0 ELSE 0.0 END ELSE (rb - r0) / (r1 - r0) END, 6) AS hybrid_score FROM y)
SELECT query_id, doc_id, hybrid_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, score DESC, doc_id) AS rank FROM h) WHERE rank <= 5""")
def fusion_rank(spark, d):
    """The cross-encoder's score is a column that the caller supplies."""
    df = P.recalled(spark, d).withColumns({"cross_score": F.round((F.col("doc_id") * 31 % 97) / 97.0, 6), "rule_bonus": F.contains(F.col("title"), F.lit("the")).cast("double")})
    return top(K.fusion(df))


@query("remote_rank", f"WITH {CAND} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN doc_id % 3 = 0 THEN doc_id * 31 % 97 END DESC NULLS LAST, pos) AS rank FROM cand")
def remote_rank(spark, d):
    return K.scored_first(P.recalled(spark, d).withColumn("remote_score", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") * 31 % 97))).select("query_id", "doc_id", "rank")


def _lengths():
    """A scorer that stands for a remote one: it scores by length, and refuses calls with a length that 11 divides."""

    def score(query, texts):
        if any(len(t) % 11 == 0 for t in texts):
            raise ConnectionError("refused")
        return [len(t) * 31 % 97 for t in texts]

    return score


@query("transport_rank", f"""WITH {CAND}, c AS (SELECT *, bool_or(length(text) % 11 = 0) OVER (PARTITION BY query_id, (pos - 1) // 5) AS failed FROM cand), s AS (SELECT *, CASE WHEN NOT failed THEN CAST(length(text) * 31 % 97 AS DOUBLE) END AS remote_score FROM c)
SELECT query_id, doc_id, remote_score, failed, row_number() OVER (PARTITION BY query_id ORDER BY remote_score DESC NULLS LAST, pos) AS rank FROM s""")
def transport_rank(spark, d):
    """Candidates by an injected scorer that fails on some calls of five; those stay behind in recall order."""
    df = Z.scored(P.recalled(spark, d), _lengths, batch=5, attempts=1)
    return K.scored_first(df).select("query_id", "doc_id", "remote_score", F.col("score_error").isNotNull().alias("failed"), "rank")


@query("source_preference", f"WITH {CAND} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY source IN ('src1', 'src2') DESC, pos) AS rank FROM cand")
def source_preference(spark, d):
    return K.preferred_first(P.recalled(spark, d), F.col("source").isin("src1", "src2")).select("query_id", "doc_id", "rank")


@query("carryover_boost", f"WITH {CAND}, b AS (SELECT *, round(score + CASE WHEN doc_id % 7 = 0 THEN 0.08 ELSE 0 END, 6) AS boosted_score FROM cand) SELECT query_id, doc_id, boosted_score, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS original_rank, row_number() OVER (PARTITION BY query_id ORDER BY boosted_score DESC, pos) AS rank FROM b")
def carryover_boost(spark, d):
    return K.boosted(P.recalled(spark, d), F.col("doc_id") % 7 == 0).select("query_id", "doc_id", "boosted_score", "original_rank", "rank")


@query("guarded_quality_filter", f"WITH {CAND}, g AS (SELECT *, count(*) FILTER (WHERE quality_score > 0.9) OVER (PARTITION BY query_id) AS n FROM lex) SELECT query_id, doc_id, n < 5 AS fallback FROM g WHERE quality_score > 0.9 OR n < 5")
def guarded_quality_filter(spark, d):
    return K.guarded(P.scored(P.recalled(spark, d)), F.col("quality_score") > 0.9, 5).select("query_id", "doc_id", "fallback")


@query("guarded_date_filter", f"WITH {CAND}, g AS (SELECT *, year(to_timestamp(publish_ts)) = 2020 AS ok FROM cand), c AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY query_id) AS n FROM g) SELECT query_id, doc_id, n < 5 AS fallback FROM c WHERE ok OR n < 5")
def guarded_date_filter(spark, d):
    return K.guarded(P.recalled(spark, d), F.year(F.timestamp_seconds("publish_ts")) == 2020, 5).select("query_id", "doc_id", "fallback")


@query("must_should_filter", f"WITH {NEWS} SELECT doc_id, publish_ts FROM news WHERE category = 'en' AND source = 'src1' AND (contains(title, 'the') OR contains(title, 'tion')) ORDER BY publish_ts DESC, doc_id LIMIT 20")
def must_should_filter(spark, d):
    return K.must_should(news(spark, d), {"category": "en", "source": "src1"}, "title", ["the", "tion"]).select("doc_id", "publish_ts")


ASKED_DATES = "CASE doc_id % 4 WHEN 0 THEN 'news of 2020-07-15' WHEN 1 THEN 'in 2021-03' WHEN 2 THEN 'since 4' ELSE 'of 2019' END"


@query("date_match_scores", f"WITH {NEWS}, d AS (SELECT doc_id, doc_id % 4 AS k, strftime(to_timestamp(publish_ts), '%Y-%m-%d') AS day FROM news) SELECT doc_id, CASE k WHEN 0 THEN 2.0 * (day[1:4] = '2020')::INT + 3.0 * (day[6:7] = '07')::INT + 2.0 * (day[9:10] = '15')::INT WHEN 1 THEN 2.0 * (day[1:4] = '2021')::INT + 3.0 * (day[6:7] = '03')::INT WHEN 2 THEN 2.0 * (day[6:7] = '04')::INT ELSE 2.0 * (day[1:4] = '2019')::INT END::DOUBLE AS score, CASE k WHEN 0 THEN day[1:7] = '2020-07' WHEN 1 THEN day[1:7] = '2021-03' WHEN 2 THEN day[6:7] = '04' ELSE day[1:4] = '2019' END AS meets FROM d")
def date_match_scores(spark, d):
    """How well publication days match what a request asks for: a day, a month, a month since which, a year."""
    n = news(spark, d).select("doc_id", F.date_format(F.timestamp_seconds("publish_ts"), "yyyy-MM-dd").alias("day"), D.constraint(F.expr(ASKED_DATES)).alias("c"))
    return n.select("doc_id", D.match_score(F.col("c"), F.col("day")).alias("score"), D.meets(F.col("c"), F.col("day")).alias("meets"))


@query("stale_filter", f"WITH {CAND} SELECT query_id, doc_id, recency_score FROM lex WHERE recency_score >= 0.45")
def stale_filter(spark, d):
    return K.stale(P.scored(P.recalled(spark, d)), 0.45, F.lit(0)).select("query_id", "doc_id", "recency_score")


@query("channel_merge_first_wins", f"""WITH {CAND}, a AS (SELECT query_id, doc_id, 'dense' AS channel, 0 AS p, pos FROM cand WHERE pos <= 10), b AS (SELECT query_id, doc_id, 'recent' AS channel, 1 AS p, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY publish_ts DESC, doc_id) AS pos FROM (SELECT * EXCLUDE (pos) FROM cand)) WHERE pos <= 10),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY p, pos) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT query_id, doc_id, channel, row_number() OVER (PARTITION BY query_id ORDER BY p, pos, doc_id) AS merged_pos FROM u WHERE n = 1""")
def channel_merge_first_wins(spark, d):
    c = P.recalled(spark, d)
    recent = K.ranked(c.drop("pos"), F.desc("publish_ts"), F.asc("doc_id"), name="pos").filter("pos <= 10")
    return K.merged([("dense", c.filter("pos <= 10")), ("recent", recent)]).select("query_id", "doc_id", "channel", "merged_pos")


@query("best_score_merge", f"WITH {CAND}, t AS (SELECT query_id, source, doc_id, score, pos, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, pos) AS n, min(pos) OVER (PARTITION BY query_id, source) AS first_pos FROM cand) SELECT query_id, source, doc_id, score, first_pos FROM t WHERE n = 1")
def best_score_merge(spark, d):
    return K.best_score(P.recalled(spark, d), "source").select("query_id", "source", "doc_id", "score", "first_pos")


@query("parent_best_chunk", f"""WITH {CAND}, f AS (SELECT query_id, source AS parent_id, title, pos, doc_id, round(score * greatest(0.85, 1.0 - greatest(0, (1704067200 - publish_ts) / 86400.0) / 3650.0), 6) AS final_score FROM cand),
b AS (SELECT *, substr(regexp_replace(title, '[0-9\\s]+', '', 'g'), 1, 20) AS k FROM (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY final_score DESC, pos) AS n FROM f) WHERE n = 1),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY final_score DESC, pos) AS m FROM b) WHERE m = 1 OR k = '')
SELECT query_id, parent_id, doc_id, final_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, pos) AS rank FROM u) WHERE rank <= 5""")
def parent_best_chunk(spark, d):
    return K.parents(P.recalled(spark, d).withColumn("parent_id", F.col("source")), NOW, 5).select("query_id", "parent_id", "doc_id", "final_score", "rank")


@query("body_slots_merge", f"""WITH {CAND}, s AS (SELECT query_id, source AS parent_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS r FROM cand WHERE pos % 2 = 1), head AS (SELECT *, 'summary' AS kind, 0 AS s FROM s WHERE r <= 6),
b0 AS (SELECT query_id, source AS parent_id, doc_id, pos FROM cand c WHERE pos % 2 = 0 AND NOT EXISTS (SELECT 1 FROM head h WHERE h.query_id = c.query_id AND h.parent_id = c.source)),
b1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY pos) AS f FROM b0), b AS (SELECT * FROM (SELECT query_id, parent_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS r, 'body' AS kind, 1 AS s FROM b1 WHERE f = 1) WHERE r <= 2),
rest AS (SELECT *, 'summary' AS kind, 2 AS s FROM s WHERE r > 6 AND NOT EXISTS (SELECT 1 FROM b WHERE b.query_id = s.query_id AND b.parent_id = s.parent_id)),
u AS (SELECT query_id, parent_id, doc_id, r, kind, s FROM head UNION ALL SELECT query_id, parent_id, doc_id, r, kind, s FROM b UNION ALL SELECT query_id, parent_id, doc_id, r, kind, s FROM rest)
SELECT query_id, doc_id, kind, slot FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, r) AS slot FROM u) WHERE slot <= 8""")
def body_slots_merge(spark, d):
    c = P.recalled(spark, d).withColumn("parent_id", F.col("source"))
    return K.slots(c.filter("pos % 2 = 1"), c.filter("pos % 2 = 0"), 8, 2).select("query_id", "doc_id", "kind", "slot")


@query("source_quota_top_k", f"WITH RECURSIVE {CAND}, f AS (SELECT *, 10 * score AS final_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS INTEGER) AS rank FROM cand), {W.diversified('f', 'spread')} SELECT query_id, doc_id, final_rank, rank FROM spread")
def source_quota_top_k(spark, d):
    df = K.ranked(P.recalled(spark, d).withColumn("final_score", 10 * F.col("score")), F.desc("final_score"), F.asc("pos"))
    return K.diversified(df).select("query_id", "doc_id", "final_rank", "rank")


LIGHT = f"""{CAND}, {W.lcs("cand", "shared")}, ready AS (SELECT *, list_filter({W.ENTITIES}, lambda x: contains(query, x)) AS entities, 'dense' AS channel, 'summary' AS chunk_type, 0.0 AS date_score, CASE WHEN source = 'src1' THEN 3.0 ELSE 0.0 END AS source_score, 0.0 AS analysis_score FROM shared)"""


@query("light_rule_rank", f"WITH RECURSIVE {LIGHT}, {W.rules('ready', 'ruled')}, {W.diversified('ruled', 'spread')} SELECT query_id, doc_id, final_score, rank, final_rank FROM spread WHERE final_rank <= 10")
def light_rule_rank(spark, d):
    return P.limited(P.recalled(spark, d).withColumn("channel", F.lit("dense")), 10).select("query_id", "doc_id", "final_score", "rank", "final_rank")


@query("rule_rerank", f"""WITH {LIGHT}, s AS (SELECT *, 3 * len(list_filter(entities, lambda x: contains(title, x))) + len(list_filter(entities, lambda x: contains(text, x))) + CASE WHEN common >= 8 THEN common ELSE 0 END + CASE WHEN title <> '' AND contains(query, title) THEN 8 ELSE 0 END AS rule_score FROM ready)
SELECT query_id, doc_id, rule_score, row_number() OVER (PARTITION BY query_id ORDER BY rule_score DESC, pos) AS rank FROM s""")
def rule_rerank(spark, d):
    c = P.recalled(spark, d).withColumns({"entities": X.vocabulary_hits(F.col("query"), P.ENTITIES), "chunk": F.col("text"), "common": X.longest_common(F.col("title"), F.col("query")), "source_score": F.lit(0.0)})
    return K.rule_rerank(c).select("query_id", "doc_id", "rule_score", "rank")


@query("lcs_bonus", f"WITH {CAND}, {W.lcs('cand', 'shared')} SELECT query_id, doc_id, common FROM shared")
def lcs_bonus(spark, d):
    c = P.recalled(spark, d)
    return c.select("query_id", "doc_id", X.longest_common(F.col("title"), F.col("query")).alias("common"))


@query("kw_overlap", f"WITH {CAND}, t AS (SELECT *, list_filter(['the', 'tion', 'and', 'thing', 'ment', 'heit'], lambda x: contains(query, x)) AS e FROM cand) SELECT query_id, doc_id, len(e) AS n_terms, round(CASE WHEN len(e) = 0 OR length(text) = 0 THEN 0.0 ELSE len(list_filter(e, lambda x: contains(text, x))) / len(e) END, 6) AS overlap FROM t")
def kw_overlap(spark, d):
    c = P.recalled(spark, d).withColumn("_e", X.vocabulary_hits(F.col("query"), P.ENTITIES))
    return c.select("query_id", "doc_id", F.size("_e").alias("n_terms"), F.round(X.contained(F.col("_e"), F.col("text")), 6).alias("overlap"))


@query("no_answer_signs", f"""WITH {CAND}, e AS (SELECT *, list_filter(['the', 'tion', 'and', 'thing', 'ment', 'heit'], lambda x: contains(query, x)) AS en FROM cand),
s AS (SELECT *, 0.6 * CASE WHEN len(en) = 0 OR length(title) = 0 THEN 0 ELSE len(list_filter(en, lambda x: contains(title, x))) / len(en) END + 0.4 * CASE WHEN len(en) = 0 OR length(text) = 0 THEN 0 ELSE len(list_filter(en, lambda x: contains(text, x))) / len(en) END AS lexical,
 CASE WHEN title <> '' AND contains(query, title) THEN 10.0 ELSE 0.0 END AS title_score, coalesce(list_sum(list_transform(list_filter(en, lambda x: contains(title, x)), lambda x: CASE WHEN length(x) >= 4 THEN 3.0 ELSE 1.5 END)), 0) AS bonus,
 CASE WHEN length(text) < 30 THEN -3.0 WHEN length(text) < 60 THEN -1.0 ELSE 0.0 END AS pen, 0.5 * len(list_filter(en, lambda x: NOT contains(title, x) AND contains(title || ' ' || text, x))) AS only_text FROM e),
f AS (SELECT *, round(10 * score + 5 * lexical + title_score + bonus + pen + only_text, 6) AS final FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, pos) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM f),
a AS (SELECT query_id, max(score) FILTER (WHERE rank = 1) AS top1, round(avg(score), 4) AS top5_avg, (max(score) FILTER (WHERE rank = 1) < 0.55)::INT + (max(lexical) < 0.05)::INT + (max(title_score) < 2)::INT + 1 AS signs, max(n) AS n FROM r WHERE rank <= 5 GROUP BY query_id)
SELECT query_id, top1, top5_avg, round(signs / 4.0, 4) AS no_answer_score, signs >= 4 AND n < 2 AS should_no_answer FROM a""")
def no_answer_signs(spark, d):
    c = P.recalled(spark, d).withColumns({"entities": X.vocabulary_hits(F.col("query"), P.ENTITIES), "chunk": F.col("text"), "common": F.lit(0), "date_score": F.lit(0.0), "source_score": F.lit(0.0), "analysis_score": F.lit(0.0), "chunk_type": F.lit("summary"), "channel": F.lit("dense")})
    return K.no_answer(K.light_rules(c))


@query("anchor_candidates", f"""WITH {CAND}, s AS (SELECT *, 3 * (source = 'src1')::INT + 2 * contains(text, 'tion')::INT + 2 * (publish_ts > 1600000000)::INT + 2 * contains(query, title)::INT + contains(text, '|')::INT + (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))::INT AS points FROM cand),
k AS (SELECT *, CASE WHEN points >= 5 THEN 'high' WHEN points >= 3 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN points < 3 THEN 'lead' ELSE 'candidate' END AS kind FROM s)
SELECT query_id, doc_id, CAST(points AS INT) AS points, confidence, kind, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY points DESC, doc_id) AS rank FROM k) WHERE rank <= CASE WHEN kind = 'lead' THEN 8 ELSE 5 END""")
def anchor_candidates(spark, d):
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id", F.lit(True).alias("verified")).distinct()
    c = P.recalled(spark, d).join(good, "doc_id", "left").withColumns({"verified": F.coalesce("verified", F.lit(False)), "source_hit": F.col("source") == "src1", "topic_hit": F.contains(F.col("text"), F.lit("tion")), "date_hit": F.col("publish_ts") > 1600000000, "title_hit": F.contains(F.col("query"), F.col("title")), "ocr_hit": F.contains(F.col("text"), F.lit("|"))})
    return K.anchors(c).select("query_id", "doc_id", "points", "confidence", "kind", "rank")


@query("retrieval_v1", f"""WITH {CAND}, h AS (SELECT *, round(0.7 * nv + 0.3 * nl, 6) AS hybrid_score FROM norm), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, score DESC, doc_id) AS r FROM h),
g AS (SELECT *, count(*) FILTER (WHERE quality_score > 0.35) OVER (PARTITION BY query_id) < 5 AS fallback FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source = 'src1' DESC, r) AS rank FROM g WHERE quality_score > 0.35 OR fallback)
SELECT query_id, doc_id, hybrid_score, rank, fallback FROM p WHERE rank <= 5""")
def retrieval_v1(spark, d):
    return P.v1(spark, d).select("query_id", "doc_id", "hybrid_score", "rank", "fallback")


@query("retrieval_v1_time")
def retrieval_v1_time(spark, d):
    return P.v1(spark, d, strategy="time").select("query_id", "doc_id", "hybrid_score", "rank", "fallback")


@query("multi_vector_recall", f"WITH {NEWS}, {W.ASKED}, {W.MULTI} SELECT query_id, doc_id, score, chunk_type, pos FROM recalled")
def multi_vector_recall(spark, d):
    """Documents by late fusion over several vectors of a query and of a document."""
    return P.multi_recalled(spark, d, P.requests(spark, d))


@query("retrieval_v2", W.V2)
def retrieval_v2(spark, d):
    return P.v2(spark, d).select("query_id", "doc_id", "channel", "chunk_type", "final_score", "final_rank")


@query("recency_steps", f"WITH {NEWS} SELECT recency, count(*) AS n FROM (SELECT CASE WHEN a <= 7 THEN 1.0 WHEN a <= 30 THEN 0.95 WHEN a <= 90 THEN 0.80 WHEN a <= 180 THEN 0.60 WHEN a <= 365 THEN 0.45 WHEN a <= 1095 THEN 0.20 WHEN a <= 3650 THEN 0.05 ELSE 0.0 END::DOUBLE AS recency FROM (SELECT (1704067200 - publish_ts) / 86400.0 AS a FROM news)) GROUP BY recency")
def recency_steps(spark, d):
    return news(spark, d).groupBy(D.recency(F.col("publish_ts"), F.lit(NOW)).alias("recency")).agg(F.count("*").alias("n"))
