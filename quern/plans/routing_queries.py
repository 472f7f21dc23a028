"""Queries of classifiers, normalisation and table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import table_functions
from ..functions import text as X
from ..operators import normalise as N
from ..operators import nested as J
from ..operators import routing as R
from ..sources.tables import NEWS, news, over, table
from .registry import query

V = R.Vocabulary(news=("tion",), recommend=("recommend", "suggest"), timeline=("latest", "and"), detail=("detail", "ing"), lists=("list",), topics=("the",), explain=("why", "how"), entities=("the", "tion", "heit"), sources={"wire": ("agency",), "paper": ("daily",)})


def users(spark, d):
    return table(spark, d, "conversations").filter("role = 'user'")


@query("intent_classes", "SELECT conv_id, turn, CASE WHEN regexp_matches(text, 'https?://\\S+') OR contains(lower(text), 'search the web') OR contains(lower(text), 'look up online') THEN 'web_research' WHEN contains(lower(text), 'recommend') OR contains(lower(text), 'suggest') THEN 'recommendation' WHEN contains(lower(text), 'tion') OR contains(lower(text), 'guarantee') OR contains(lower(text), 'will it rise') THEN 'news_qa' ELSE 'general_chat' END AS intent FROM conversations WHERE role = 'user'")
def intent_classes(spark, d):
    return users(spark, d).select("conv_id", "turn", R.intent(F.col("text"), V).alias("intent"))


@query("query_routes", "WITH u AS (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'user'), r AS (SELECT conv_id, turn, CASE WHEN contains(t, 'wire') OR contains(t, 'agency') OR contains(t, 'paper') OR contains(t, 'daily') THEN 'source' WHEN contains(t, 'latest') OR contains(t, 'and') THEN 'timeline' WHEN contains(t, 'detail') OR contains(t, 'ing') THEN 'detail' ELSE 'title' END AS route FROM u) SELECT conv_id, turn, route, CASE WHEN route = 'detail' THEN 1 ELSE 0 END AS body_slots FROM r")
def query_routes(spark, d):
    return users(spark, d).select("conv_id", "turn", R.route(F.col("text"), V).alias("r")).select("conv_id", "turn", "r.route", "r.body_slots")


ASKED = "SELECT conv_id, turn, text || CASE turn % 5 WHEN 0 THEN ' in 2021-03' WHEN 1 THEN ' from the wire' WHEN 2 THEN ' of late: the latest' WHEN 3 THEN ' since 4' ELSE ' list' END AS text FROM conversations WHERE role = 'user'"
_DATE = """CASE WHEN regexp_matches(text, '[0-9]{4}[-/年][0-9]{1,2}[-/月][0-9]{1,2}') THEN 'day' WHEN regexp_matches(text, '(?:年|[0-9]{4}[-/])\\s*[0-9]{1,2}') THEN 'month' WHEN regexp_matches(text, '[0-9]{4}') THEN 'year' WHEN regexp_matches(text, '(?i)since\\s+[0-9]{1,2}|[0-9]{1,2}月以来') THEN 'since' WHEN contains(lower(text), 'recent') OR contains(lower(text), 'latest') THEN 'recent' ELSE 'none' END"""


@query("structured_intents", f"""WITH a AS ({ASKED}), s AS (SELECT conv_id, turn, {_DATE} AS date_kind, list_filter(['the', 'tion', 'heit'], lambda x: contains(lower(text), x)) AS e, contains(lower(text), 'wire') OR contains(lower(text), 'agency') OR contains(lower(text), 'paper') OR contains(lower(text), 'daily') AS named, contains(lower(text), 'list') AS lists, contains(lower(text), 'why') OR contains(lower(text), 'how') AS explains FROM a)
SELECT conv_id, turn, CASE WHEN named THEN 'source_constrained' WHEN date_kind IN ('day', 'month', 'year') THEN 'dated' WHEN lists THEN 'list' WHEN explains THEN 'explain' WHEN len(e) > 0 THEN 'entity' ELSE 'semantic' END AS query_type, array_to_string(e, ',') AS entities, concat_ws(',', 'dense', CASE WHEN len(e) > 0 OR named THEN 'title_keyword' END, CASE WHEN len(e) > 0 OR named THEN 'chunk_keyword' END, CASE WHEN date_kind = 'recent' THEN 'recent' END) AS plan, date_kind FROM s""")
def structured_intents(spark, d):
    """Requests with a month, a source, a wish for the latest, a month since which, or for a list."""
    return over(spark, ASKED, conversations=table(spark, d, "conversations")).select("conv_id", "turn", R.structured(F.col("text"), V).alias("x")).select("conv_id", "turn", "x.query_type", F.array_join("x.entities", ",").alias("entities"), F.array_join("x.plan", ",").alias("plan"), F.col("x.date.kind").alias("date_kind"))


@query("collection_routes", "SELECT conv_id, turn, CASE WHEN NOT (contains(lower(text), 'wire') OR contains(lower(text), 'agency') OR contains(lower(text), 'paper') OR contains(lower(text), 'daily')) AND contains(lower(text), 'the') THEN 'topic' ELSE 'default' END AS collection FROM conversations WHERE role = 'user'")
def collection_routes(spark, d):
    return users(spark, d).select("conv_id", "turn", R.collection(F.col("text"), V).alias("collection"))


@query("answer_constraints", "SELECT conv_id, turn, contains(lower(text), 'list') OR contains(lower(text), 'bullets') AS as_list, contains(lower(text), 'source') OR contains(lower(text), 'cite') AS wants_sources FROM conversations WHERE role = 'user'")
def answer_constraints(spark, d):
    return users(spark, d).select("conv_id", "turn", R.answer_constraints(F.col("text")).alias("c")).select("conv_id", "turn", "c.as_list", "c.wants_sources")


CALLS = "SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN ' see news 42' WHEN 1 THEN ' at https://a.example/x' WHEN 2 THEN ' please recommend' ELSE '' END AS text FROM conversations WHERE role = 'user'"


@query("fallback_plans", f"WITH a AS ({CALLS}), n AS (SELECT *, regexp_extract(text, '(?i)(?:news|id|#)\\s*(\\d+)', 1) AS num, regexp_extract(text, '(https?://[^\\s]+)', 1) AS url FROM a) SELECT conv_id, turn, CASE WHEN num <> '' THEN 'news_detail' WHEN url <> '' THEN 'web_fetch' WHEN contains(lower(text), 'recommend') OR contains(lower(text), 'suggest') THEN 'recommend_news' ELSE 'news_search' END AS tool, CASE WHEN num <> '' THEN num WHEN url <> '' THEN url ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS argument FROM n")
def fallback_plans(spark, d):
    return over(spark, CALLS, conversations=table(spark, d, "conversations")).select("conv_id", "turn", R.fallback_plan(F.col("text"), V).alias("p")).select("conv_id", "turn", "p.tool", "p.argument")


@query("next_actions", "WITH l AS (SELECT doc_id, quality, toxic FROM labels) SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'ask_confirmation' WHEN quality IS NULL THEN 'search' WHEN quality = 0 THEN 'ask_clarification' ELSE 'answer' END AS action FROM documents d LEFT JOIN l USING (doc_id)")
def next_actions(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    anchor = F.when(F.col("toxic") == 1, "needs_confirmation").when(F.col("quality") == 0, "ambiguous").otherwise("none")
    return j.select("doc_id", R.next_action(anchor, F.when(F.col("quality").isNull(), 0).otherwise(1), F.array(F.lit("news_search"))).alias("action"))


@query("tri_state_checks", "SELECT avg(CASE WHEN toxic = 1 THEN (quality = 0)::INT::DOUBLE END) AS toxic_rejected, avg(CASE WHEN n_chars > 1000 THEN (quality = 1)::INT::DOUBLE END) AS long_accepted FROM documents JOIN labels USING (doc_id)")
def tri_state_checks(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return j.agg(F.avg(R.check(F.col("toxic") == 1, F.col("quality") == 0)).alias("toxic_rejected"), F.avg(R.check(F.col("n_chars") > 1000, F.col("quality") == 1)).alias("long_accepted"))


@query("policy_counts", "WITH t AS (SELECT CASE WHEN contains(url, '.org') THEN 'high' WHEN contains(url, 'blog.') THEN 'low' ELSE 'medium' END AS tier, page_id % 2 = 0 AS verified FROM pages), p AS (SELECT unnest(['strict', 'balanced', 'open']) AS policy) SELECT policy, count(*) AS n FROM t, p WHERE CASE policy WHEN 'strict' THEN tier = 'high' AND verified WHEN 'balanced' THEN tier <> 'low' OR verified ELSE TRUE END GROUP BY policy")
def policy_counts(spark, d):
    t = table(spark, d, "pages").select(X.credibility(F.col("url"), [".org"], ["blog."]).alias("tier"), (F.col("page_id") % 2 == 0).alias("verified"), F.explode(F.array(F.lit("strict"), F.lit("balanced"), F.lit("open"))).alias("policy"))
    return t.filter(R.policy_allows(F.col("policy"), F.col("tier"), F.col("verified"))).groupBy("policy").agg(F.count("*").alias("n"))


@query("triage_decisions", "SELECT decision, count(*) AS n FROM (SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'merge_with_existing' WHEN lang = 'en' OR n_chars > 5000 THEN 'accept_as_gold' ELSE 'needs_evidence_lookup' END AS decision FROM documents) GROUP BY decision")
def triage_decisions(spark, d):
    c = table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("n_chars") > 5000, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("evidence"))
    return R.triage(table(spark, d, "labels").filter("quality = 1"), c, "doc_id", ["en"], "lang").groupBy("decision").agg(F.count("*").alias("n"))


@query("capture_statuses", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN doc_id % 10 / 10.0 < 0.35 THEN 'rejected_low_confidence' WHEN n_chars < 40 THEN 'rejected_low_signal' ELSE 'staged' END AS status FROM documents) GROUP BY status")
def capture_statuses(spark, d):
    return table(spark, d, "documents").groupBy(R.capture_status(F.col("doc_id") % 10 / 10.0, F.col("n_chars"), least_signal=40).alias("status")).agg(F.count("*").alias("n"))


@query("candidate_schema", "SELECT CAST(vec_id AS VARCHAR) AS id, 'news:' || vec_id AS evidence_id, 'label ' || label AS title, round(vec_id / 7.0, 4) AS score FROM embeddings")
def candidate_schema(spark, d):
    e = table(spark, d, "embeddings")
    payload = F.to_json(F.struct(F.lit(" ").alias("id"), F.col("vec_id").alias("news_id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("headline")))
    return N.candidates(e.select(payload.alias("payload"), (F.col("vec_id") / 7.0).alias("score")), "payload", "score").select("id", "evidence_id", "title", "score")


@query("corpus_keys", "SELECT source || ':' || doc_id AS doc_id, 'news:' || source || ':' || doc_id AS evidence_id FROM documents")
def corpus_keys(spark, d):
    return table(spark, d, "documents").select(*N.corpus_keys(F.col("source"), F.col("doc_id").cast("string")))


@query("detail_rows", "SELECT doc_id, CASE WHEN length(f) > 260 THEN rtrim(substr(f, 1, 260)) || '…' ELSE f END AS brief, CASE WHEN source = 'src1' THEN 'Source One' ELSE source END AS source_label FROM (SELECT doc_id, source, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)")
def detail_rows(spark, d):
    df = news(spark, d).withColumn("text", F.lit(None).cast("string"))
    return N.detail(df, {"src1": "Source One"}).select("doc_id", "brief", "source_label")


@query("nested_lines", "SELECT doc_id, 2 AS n FROM documents")
def nested_lines(spark, d):
    """Both shapes of recognised lines, made from the id; the blank line is dropped."""
    one = F.to_json(F.array(*(F.struct(F.lit(t).alias("text"), F.lit(0.9).alias("confidence")) for t in ("a", " ", "b"))))
    two = F.to_json(F.struct(F.array(F.lit("a"), F.lit(""), F.lit("b")).alias("rec_texts"), F.array(F.lit(0.5), F.lit(0.6), F.lit(0.7)).alias("rec_scores")))
    return table(spark, d, "documents").select("doc_id", F.size(N.nested_lines(F.when(F.col("doc_id") % 2 == 0, one).otherwise(two))).alias("n"))


@query("merged_parents", f"WITH {NEWS} SELECT source, max(n_chars) AS n_chars, min(doc_id) AS doc_id FROM news GROUP BY source")
def merged_parents(spark, d):
    df = news(spark, d).select("source", "content", "doc_id")
    return N.merged_rows(df, ["source"], "content").select("source", F.length("content").cast("long").alias("n_chars"), "doc_id")


@query("evidence_packs", "WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings) SELECT label, count(*) AS n FROM r WHERE rank <= 8 GROUP BY label")
def evidence_packs(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "embeddings").select("label", F.concat(F.lit("news:"), F.col("vec_id").cast("string")).alias("evidence_id"), (F.col("vec_id") % 3 / 3.0).alias("score"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("rank"))
    return N.evidence_pack(e, "label").select("label", F.json_array_length("evidence").cast("long").alias("n"))


@query("rendered_lists", "WITH r AS (SELECT lang, doc_id, split_part(text, chr(10), 1) AS title, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) SELECT lang, string_agg(n || '. ' || title, chr(10) ORDER BY n) AS text FROM r WHERE n <= 5 GROUP BY lang")
def rendered_lists(spark, d):
    from ..operators import relational as REL

    return N.rendered(REL.top_per(news(spark, d), ["category"], [F.asc("doc_id")], 5), "category", "rank", "title").withColumnRenamed("category", "lang")


@query("trace_rows", "SELECT 'run-1' AS run_id, conv_id, count(*) AS n FROM conversations GROUP BY conv_id")
def trace_rows(spark, d):
    from ..operators import sessions as M

    return N.traces(M.ordered(table(spark, d, "conversations")), "run-1", ["messages"]).select("run_id", "conv_id", F.json_array_length("messages").cast("long").alias("n"))


@query("sliding_chunks_function", "SELECT item_id, count(*) AS n FROM (SELECT item_id, unnest(range(0, greatest(length(text) - 20, 1), 80)) FROM benchmark) GROUP BY item_id")
def sliding_chunks_function(spark, d):
    table_functions.register(spark, d)
    table(spark, d, "benchmark").createOrReplaceTempView("quern_benchmark")
    return spark.sql("SELECT item_id, count(*) AS n FROM quern_benchmark, LATERAL sliding_chunks(text, 100, 20) GROUP BY item_id")


@query("recent_history_function", "WITH ev AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS item FROM events) SELECT item, max(ts) AS seen FROM ev WHERE user_id = 7 AND event_type = 'view' GROUP BY item ORDER BY seen DESC, item LIMIT 5")
def recent_history_function(spark, d):
    table_functions.register(spark, d)
    return spark.sql("SELECT * FROM recent_history(7)")


_TALK = "SELECT conv_id, to_json({'id': conv_id, 'turns': list({'role': role, 'text': text, 'more': {'n': [turn, length(text)], 'last': turn > 2}} ORDER BY turn)}) AS j FROM conversations GROUP BY conv_id"


@query("nested_leaves", f"SELECT conv_id, fullkey AS path, json_extract_string(j, fullkey) AS value FROM (SELECT conv_id, j, unnest(list_filter(json_tree_rows, lambda r: r.a IS NOT NULL)).k AS fullkey FROM (SELECT conv_id, j, (SELECT list({{'k': fullkey, 'a': atom}}) FROM json_tree(j)) AS json_tree_rows FROM ({_TALK})))")
def nested_leaves(spark, d):
    """Every leaf of conversations that are written as nested JSON, by its path."""
    m = table(spark, d, "conversations")
    turn = F.struct("role", "text", F.struct(F.array(F.col("turn"), F.char_length("text").cast("long")).alias("n"), (F.col("turn") > 2).alias("last")).alias("more"))
    talks = m.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]).alias("turns"))
    talks = talks.select("conv_id", F.to_json(F.struct(F.col("conv_id").alias("id"), "turns")).alias("j"))
    return J.leaves(talks, "conv_id", "j").select("conv_id", "path", "value")
