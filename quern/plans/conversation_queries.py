"""Queries of conversation state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import replay as Y
from ..operators import sessions as M
from ..sources.tables import NEWS, news, over, table
from .registry import query

TOPICS = ("the", "and", "tion", "with", "from")
TOPIC_LIST = "['the', 'and', 'tion', 'with', 'from']"
LEDGER = f"h AS (SELECT conv_id, turn, unnest(list_filter({TOPIC_LIST}, lambda x: contains(lower(text), x))) AS topic FROM conversations WHERE role = 'user'), g AS (SELECT conv_id, topic, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM h GROUP BY 1, 2)"


def messages(spark, d):
    return table(spark, d, "conversations")


@query("session_topics", f"WITH {LEDGER} SELECT *, 'topic:' || row_number() OVER (PARTITION BY conv_id ORDER BY first_turn, topic) AS entry FROM g")
def session_topics(spark, d):
    return M.ledger(messages(spark, d), TOPICS)


@query("ledger_merge", f"WITH {LEDGER}, p AS (SELECT conv_id, topic, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM h WHERE turn < 4 GROUP BY 1, 2), q AS (SELECT conv_id, topic, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM h WHERE turn >= 4 GROUP BY 1, 2), u AS (SELECT * FROM p UNION ALL SELECT * FROM q), m AS (SELECT conv_id, topic, min(first_turn) AS first_turn, max(last_turn) AS last_turn, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY 1, 2) SELECT conv_id, topic, first_turn, last_turn, n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY last_turn DESC, topic) AS r FROM m) WHERE r <= 3")
def ledger_merge(spark, d):
    m = messages(spark, d)
    return M.merged_ledgers(M.ledger(m.filter("turn < 4"), TOPICS), M.ledger(m.filter("turn >= 4"), TOPICS), 3)


@query("constraints_last_wins", "SELECT conv_id, arg_max(w, turn) FILTER (WHERE w IS NOT NULL) AS first_word, coalesce(arg_max(q, turn) FILTER (WHERE q IS NOT NULL), 0) AS has_comma FROM (SELECT *, nullif(regexp_extract(text, '^([A-Za-z]+)', 1), '') AS w, CASE WHEN contains(text, ',') THEN length(text) END AS q FROM conversations WHERE role = 'user') GROUP BY conv_id")
def constraints_last_wins(spark, d):
    word = F.nullif(F.regexp_extract("text", "^([A-Za-z]+)", 1), F.lit(""))
    return M.constraints(messages(spark, d), {"first_word": word, "has_comma": F.when(F.contains("text", F.lit(",")), F.length("text")).cast("long")}).na.fill(0, ["has_comma"])


@query("evidence_last8", "WITH r AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS ref, generate_subscripts(regexp_extract_all(text, '[A-Z][a-z]+'), 1) AS p FROM conversations), f AS (SELECT conv_id, ref, min((turn, p)) AS seen FROM r GROUP BY 1, 2), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seen DESC) AS n FROM f) WHERE n <= 8) SELECT conv_id, string_agg(ref, ',' ORDER BY seen) AS refs FROM l GROUP BY conv_id")
def evidence_last8(spark, d):
    refs = F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))
    return M.evidence(messages(spark, d), refs).select("conv_id", F.array_join("refs", ",").alias("refs"))


@query("session_compress", "SELECT conv_id, count(*) AS n_messages, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(*) > 6 OR sum(length(text)) > 1500 AS compress FROM conversations GROUP BY conv_id")
def session_compress(spark, d):
    return M.compression(messages(spark, d), most=6, chars=1500)


@query("session_recent", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def session_recent(spark, d):
    return M.recent(messages(spark, d), 2).select("conv_id", "turn", "role")


@query("session_summaries", f"WITH u AS (SELECT * FROM conversations WHERE role = 'user'), g AS (SELECT conv_id, arg_max(text, turn) AS l, arg_min(text, turn) AS f, string_agg(lower(text), ' ') AS everything FROM u GROUP BY conv_id), c AS (SELECT *, trim(regexp_replace(l, '\\s+', ' ', 'g')) AS flat FROM g) SELECT conv_id, CASE WHEN length(flat) > 160 THEN rtrim(substr(flat, 1, 160)) || '...' ELSE flat END AS goal, array_to_string(list_filter({TOPIC_LIST}, lambda x: contains(everything, x)), ',') AS topics, regexp_matches(l, '[?？]\\s*$') AS open_question, substr(f, 1, 30) AS title FROM c")
def session_summaries(spark, d):
    return M.summaries(messages(spark, d), TOPICS)


@query("session_memory", "WITH l AS (SELECT conv_id, turn, role || ': ' || CASE WHEN length(f) > 160 THEN rtrim(substr(f, 1, 160)) || '...' ELSE f END AS line FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM conversations)), s AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS c FROM l) SELECT conv_id, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY turn) AS memory FROM s WHERE c <= 1800 GROUP BY conv_id")
def session_memory(spark, d):
    return M.memory(messages(spark, d))


@query("followup_hints", f"""WITH u AS (SELECT conv_id, turn, text, list_filter({TOPIC_LIST}, lambda x: contains(lower(text), x)) AS t FROM conversations WHERE role = 'user'),
h AS (SELECT a.conv_id, a.turn, a.text, list_sort(list_distinct(flatten(list(b.t) FILTER (WHERE b.t IS NOT NULL)))) AS hints FROM u a LEFT JOIN u b ON b.conv_id = a.conv_id AND b.turn < a.turn GROUP BY 1, 2, 3),
q AS (SELECT *, regexp_replace(text, '(?i)\\b(it|this|that)\\b', ' ', 'g') AS bare FROM h WHERE contains(lower(text), 'it') OR contains(lower(text), 'this') OR contains(lower(text), 'that'))
SELECT conv_id, turn, concat_ws(' ', nullif(array_to_string(coalesce(hints, [])[1:6], ' '), ''), CASE WHEN length(regexp_replace(bare, '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g')) >= 6 THEN trim(regexp_replace(bare, '\\s+', ' ', 'g')) ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END) AS query FROM q""")
def followup_hints(spark, d):
    m = messages(spark, d)
    return M.follow_ups(m, ["it", "this", "that"], r"(?i)\b(it|this|that)\b", M.hints(m, TOPICS))


PICKS = "SELECT conv_id, turn, role, CASE role WHEN 'assistant' THEN '1. first of ' || conv_id || chr(10) || '2) second' || chr(10) || '3. third' WHEN 'user' THEN CASE WHEN turn % 4 <> 0 THEN 'number ' || (conv_id % 4 + 1) || ' please' ELSE 'none of them' END ELSE text END AS text FROM conversations"


@query("ordinal_selections", f"WITH m AS ({PICKS}), l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM m) SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'first of ' || conv_id WHEN 1 THEN 'second' WHEN 2 THEN 'third' END AS picked FROM l WHERE role = 'user' AND prior = 'assistant' AND turn % 4 <> 0")
def ordinal_selections(spark, d):
    """Choices from lists of three: the first, second or third, and a fourth that is not there."""
    return M.selections(over(spark, PICKS, conversations=messages(spark, d)))


@query("memory_recall", f"WITH {LEDGER} SELECT conv_id, arg_min(topic, (first_turn, topic)) AS first_topic FROM g GROUP BY conv_id")
def memory_recall(spark, d):
    return M.ledger(messages(spark, d), TOPICS).groupBy("conv_id").agg(F.min_by("topic", F.struct("first_turn", "topic")).alias("first_topic"))


@query("intent_labels", "SELECT conv_id, turn, CASE WHEN regexp_matches(text, 'https?://') THEN 'web' WHEN contains(lower(text), 'recommend') THEN 'recommendation' WHEN contains(lower(text), 'tion') THEN 'news' ELSE 'chat' END AS intent FROM conversations WHERE role = 'user'")
def intent_labels(spark, d):
    low = F.lower("text")
    intent = F.when(F.col("text").rlike("https?://"), "web").when(F.contains(low, F.lit("recommend")), "recommendation").when(F.contains(low, F.lit("tion")), "news").otherwise("chat")
    return messages(spark, d).filter("role = 'user'").select("conv_id", "turn", intent.alias("intent"))


@query("exchange_numbers", "SELECT conv_id, turn, CAST(turn // 2 + 1 AS BIGINT) AS exchange FROM conversations")
def exchange_numbers(spark, d):
    return M.turns(messages(spark, d)).select("conv_id", "turn", "exchange")


@query("scripted_turns", "WITH c AS (SELECT item_id AS case_id, 5 AS n FROM benchmark), t AS (SELECT case_id, unnest(range(1, 6)) AS turn FROM c) SELECT case_id, CAST(turn AS INT) AS turn, CASE WHEN turn = 3 THEN 'explicit' ELSE 'turn ' || turn || ' of the talk' END AS text FROM t")
def scripted_turns(spark, d):
    c = table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.lit("turn {n} of the talk").alias("template"), F.lit(5).alias("n"))
    o = c.select("case_id", F.lit(3).alias("turn"), F.lit("explicit").alias("text"))
    return M.scripted(c, o)


@query("tool_arguments", "SELECT conv_id, turn, length(text) BETWEEN 1 AND 500 AS valid FROM conversations WHERE role = 'user'")
def tool_arguments(spark, d):
    return messages(spark, d).filter("role = 'user'").select("conv_id", "turn", F.length("text").between(1, 500).alias("valid"))


@query("prompt_clip", "SELECT conv_id, turn, CASE WHEN length(f) > 180 THEN rtrim(substr(f, 1, 180)) || '...' ELSE f END AS brief FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM conversations)")
def prompt_clip(spark, d):
    return messages(spark, d).select("conv_id", "turn", X.clip(F.col("text"), 180).alias("brief"))


_KEPT = "list_filter(l, lambda x, i: list_position(l, x) = i)"
REPLAY = f"""WITH RECURSIVE {NEWS}, voc AS (SELECT unnest({TOPIC_LIST}) AS term, unnest(range(1, 6)) AS k),
top AS (SELECT term, k, doc_id, row_number() OVER (PARTITION BY term ORDER BY publish_ts DESC, doc_id) AS p FROM voc JOIN news ON contains(lower(content), term)),
lists AS (SELECT list(ids ORDER BY k) AS ls FROM (SELECT voc.k, coalesce(list(doc_id ORDER BY p) FILTER (WHERE p <= 11), []) AS ids FROM voc LEFT JOIN top USING (term) GROUP BY voc.k)),
turns AS (SELECT conv_id, turn, list_filter({TOPIC_LIST}, lambda x: contains(lower(text), x)) AS own, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS n FROM conversations WHERE role = 'user'),
r AS (SELECT DISTINCT conv_id, -1::BIGINT AS turn, 0 AS n, []::VARCHAR[] AS terms, []::BIGINT[] AS results, []::BIGINT[] AS evidence FROM turns
 UNION ALL SELECT conv_id, turn, n, terms, results, list_filter(list_concat(before, results), lambda x, i: list_position(list_concat(before, results), x) = i)[-8:] FROM (
  SELECT conv_id, turn, n, terms, before, list_filter({_KEPT}, lambda d: NOT list_contains(before, d))[1:3] AS results FROM (
   SELECT conv_id, turn, n, terms, before, flatten(list_transform(terms, lambda t: ls[list_position({TOPIC_LIST}, t)])) AS l FROM (
    SELECT t.conv_id, t.turn, t.n, CASE WHEN len(t.own) > 0 THEN t.own ELSE r.terms END AS terms, r.evidence AS before, ls FROM r JOIN turns t ON t.conv_id = r.conv_id AND t.n = r.n + 1, lists))))
SELECT conv_id, turn, n, array_to_string(terms, ',') AS terms, array_to_string(results, ',') AS results, array_to_string(evidence, ',') AS evidence FROM r WHERE n > 0"""


@query("replayed_turns", REPLAY)
def replayed_turns(spark, d):
    """Every user turn of all conversations, round by round: topics asked for (a turn without any stays on its conversation's), new documents, evidence carried on."""
    retrieve = Y.newest_unseen(news(spark, d), "content", TOPICS)
    done = Y.replayed(messages(spark, d), lambda c: X.vocabulary_hits(F.lower(X.text(c)), TOPICS), retrieve)
    line = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return done.select("conv_id", "turn", "n", line("terms"), line("results"), line("evidence"))
