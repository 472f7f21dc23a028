"""SQL of composed retrieval: common substrings, additive rules and source diversity as common table expressions."""

from __future__ import annotations

from ..sources.tables import NEWS

ENTITIES = "['the', 'tion', 'and', 'thing', 'ment', 'heit']"
QUALITY = """round(greatest(0.05, least(1.0, 1.0 - CASE WHEN trim(title) = '' THEN 0.55 ELSE 0 END - CASE WHEN length(trim(text)) < 12 THEN 0.20 ELSE 0 END
 - CASE WHEN contains(lower(title || ' ' || substr(text, 1, 160)), 'lorem') OR contains(lower(title || ' ' || substr(text, 1, 160)), '###') THEN 0.85 ELSE 0 END
 - least(0.75, 0.25 * (contains(title, '!!')::INT + contains(title, '***')::INT)))), 6)"""
AGE = "(1704067200 - publish_ts) / 86400.0"
RECENCY = f"CASE WHEN {AGE} <= 7 THEN 1.0 WHEN {AGE} <= 30 THEN 0.95 WHEN {AGE} <= 90 THEN 0.80 WHEN {AGE} <= 180 THEN 0.60 WHEN {AGE} <= 365 THEN 0.45 WHEN {AGE} <= 1095 THEN 0.20 WHEN {AGE} <= 3650 THEN 0.05 ELSE 0.0 END"


def compact(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '[\s\pP\pZ\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}]+', '', 'g')"


def common(a: str, b: str) -> str:
    """Length of the longest common substring of two compacted texts, by halving: where one of k characters exists, one of each smaller length does."""
    return f"""list_reduce(list_prepend(0, list_transform(range(16), lambda j: CAST(2 ** (15 - j) AS INTEGER))), lambda k, step:
 CASE WHEN k + step <= least(length({a}), length({b})) AND len(list_filter(range(length({a}) - k - step + 1), lambda i: contains({b}, {a}[i + 1:i + k + step]))) > 0 THEN k + step ELSE k END)"""


def lcs(source: str, name: str) -> str:
    """name: the rows of source with `common` of title and query; each pair of texts is compared once."""
    return f"""{name}_c AS (SELECT DISTINCT title, query, {compact("title")} AS ct, {compact("query")} AS cq FROM {source}),
{name}_l AS (SELECT title, query, CASE WHEN length(ct) <= length(cq) THEN {common("ct", "cq")} ELSE {common("cq", "ct")} END AS common FROM {name}_c),
{name} AS (SELECT s.*, l.common FROM {source} s JOIN {name}_l l ON s.title = l.title AND s.query = l.query)"""


def contained(x: str) -> str:
    return f"CASE WHEN len(entities) = 0 OR length({x}) = 0 THEN 0.0e0 ELSE len(list_filter(entities, lambda x: contains({x}, x))) / len(entities) END"


def rules(source: str, name: str) -> str:
    """name: the rows of source with final_score and rank by additive rules."""
    return f"""{name}_s AS (SELECT *, round(10 * score + 5 * (0.6e0 * {contained("title")} + 0.4e0 * {contained("text")})
 + (CASE WHEN title <> '' AND contains(query, title) THEN 10.0e0 WHEN common >= 8 THEN common * 0.8e0 WHEN common >= 5 THEN common * 0.4e0 ELSE 0.0e0 END
 + coalesce(list_sum(list_transform(list_filter(entities, lambda x: contains(title, x)), lambda x: CASE WHEN length(x) >= 4 THEN 3.0e0 ELSE 1.5e0 END)), 0)
 + CASE WHEN length(text) < 30 THEN -3.0e0 WHEN length(text) < 60 THEN -1.0e0 ELSE 0.0e0 END
 + CASE channel WHEN 'title_keyword' THEN 1.5e0 WHEN 'chunk_keyword' THEN 0.5e0 ELSE 0.0e0 END + CASE WHEN chunk_type = 'body' THEN 0.8e0 ELSE 0.0e0 END
 + 0.5e0 * len(list_filter(entities, lambda x: NOT contains(title, x) AND contains(title || ' ' || text, x)))) + date_score + source_score + analysis_score, 6) AS final_score FROM {source}),
{name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, pos) AS INTEGER) AS rank FROM {name}_s)"""


def diversified(source: str, name: str) -> str:
    """name: the rows of source with final_rank; the first ten places of a query are folded in order."""
    return f"""{name}_i AS (SELECT query_id, list({{'k': rank, 's': coalesce(nullif(source, ''), 'other'), 'f': final_score}} ORDER BY rank) AS its FROM {source} WHERE rank <= 10 GROUP BY query_id),
{name}_d AS (SELECT query_id, 0 AS r, []::INTEGER[] AS kept, []::INTEGER[] AS late, []::VARCHAR[] AS used, its FROM {name}_i
 UNION ALL SELECT query_id, r + 1, CASE WHEN stays THEN list_append(kept, r + 1) ELSE kept END, CASE WHEN stays THEN late ELSE list_append(late, r + 1) END, CASE WHEN stays THEN list_append(used, its[r + 1].s) ELSE used END, its
 FROM (SELECT *, len(list_filter(used, lambda u: u = its[r + 1].s)) < 2 OR len(list_filter(its, lambda y: y.k > r + 1 AND y.s <> its[r + 1].s AND len(list_filter(used, lambda u: u = y.s)) < 2 AND y.f >= its[r + 1].f - 2.0)) = 0 AS stays FROM {name}_d WHERE r < len(its))),
{name} AS (SELECT s.*, CAST(CASE WHEN rank <= 10 THEN list_position(list_concat(kept, late), rank) ELSE rank END AS INTEGER) AS final_rank FROM {source} s JOIN {name}_d d ON s.query_id = d.query_id AND d.r = len(d.its))"""


def month(x: str) -> str:
    return f"regexp_matches(hay, '(^|[^0-9])0?' || {x} || '月|[0-9]{{4}}[./-]0?' || {x} || '($|[^0-9])')"


def day(x: str) -> str:
    return f"regexp_matches(hay, '(^|[^0-9])0?' || {x} || '日|[0-9]{{4}}[./-][0-9]{{1,2}}[./-]0?' || {x} || '($|[^0-9])')"


def number(pattern: str) -> str:
    return f"CAST(nullif(regexp_extract(ask, '{pattern}', 1), '') AS INTEGER)"


def keyword(field: str) -> str:
    return f"""SELECT query_id, doc_id, 0.0 AS score, 'summary' AS chunk_type, row_number() OVER (PARTITION BY query_id ORDER BY publish_ts DESC, doc_id) AS pos FROM asked, news
 WHERE doc_id <> query_id AND (wanted IS NULL OR source = wanted) AND len(list_filter(terms, lambda t: contains({field}, t))) > 0 QUALIFY pos <= 20"""


ASKED = f"""asked0 AS (SELECT vec_id AS query_id, title AS query, title || CASE vec_id // 50 % 4 WHEN 0 THEN ' in 2020-07' WHEN 1 THEN ' from the first wire' WHEN 2 THEN ' the latest' ELSE ' and explain why' END AS ask FROM embeddings JOIN news ON doc_id = vec_id WHERE vec_id % 50 = 0),
asked1 AS (SELECT *, list_filter({ENTITIES}, lambda e: contains(lower(ask), e)) AS entities,
 list_filter(['src1', 'src2'], lambda s: contains(lower(ask), s) OR contains(lower(ask), CASE s WHEN 'src1' THEN 'first wire' ELSE 'second wire' END)) AS named,
 {number("([0-9]{4})")} AS y, {number("(?:年|[0-9]{4}[-/])[ \t\n\r\f\x0b]*([0-9]{1,2})")} AS m, {number("[0-9]{4}[-/年][0-9]{1,2}[-/月]([0-9]{1,2})")} AS dd, {number("(?i)since[ \t\n\r\f\x0b]+([0-9]{1,2})|([0-9]{1,2})月以来")} AS since FROM asked0),
asked AS (SELECT *, named[1] AS wanted, CASE WHEN len(named) = 1 THEN [named[1], CASE named[1] WHEN 'src1' THEN 'first wire' ELSE 'second wire' END] ELSE [] END AS aliases,
 CASE WHEN len(entities) > 0 THEN entities[1:3] ELSE named[1:2] END AS terms,
 dd IS NULL AND m IS NULL AND y IS NULL AND since IS NULL AND (contains(lower(ask), 'recent') OR contains(lower(ask), 'latest') OR contains(ask, '最近') OR contains(ask, '近期')) AS wants_new FROM asked1)"""

MULTI = """vecs AS (SELECT vec_id, vec_id - vec_id % 4 AS parent_id, CASE WHEN vec_id % 4 = 0 THEN 'summary' ELSE 'body' END AS chunk_type, embedding::DOUBLE[] AS v FROM embeddings),
qv AS (SELECT query_id, 0 AS number, v AS q FROM asked JOIN vecs ON vec_id = query_id UNION ALL SELECT query_id, 1, v FROM asked JOIN vecs ON vec_id = query_id + 1 WHERE len(entities) >= 2),
near AS (SELECT query_id, parent_id FROM (SELECT query_id, number, parent_id, row_number() OVER (PARTITION BY query_id, number ORDER BY round(list_cosine_similarity(q, v), 6) DESC, vec_id) AS k FROM qv, vecs) WHERE k <= 50 GROUP BY ALL),
each AS (SELECT query_id, parent_id, number, vec_id, chunk_type, list_cosine_similarity(q, v) AS s FROM near JOIN vecs USING (parent_id) JOIN qv USING (query_id)),
best AS (SELECT query_id, parent_id, number, max(s) AS m, first(chunk_type ORDER BY round(s, 6) DESC, vec_id) AS chunk_type FROM each GROUP BY ALL),
fused AS (SELECT query_id, parent_id AS doc_id, round(avg(m), 6) AS score, first(chunk_type ORDER BY number) AS chunk_type FROM best GROUP BY ALL),
recalled AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS pos FROM fused WHERE doc_id <> query_id - query_id % 4)"""

V2 = f"""WITH RECURSIVE {NEWS}, {ASKED}, {MULTI},
dense0 AS (SELECT r.*, coalesce(source = wanted, FALSE) AS hit FROM recalled r JOIN news USING (doc_id) JOIN asked USING (query_id)),
dense AS (SELECT query_id, doc_id, score, chunk_type, pos FROM dense0 QUALIFY hit OR NOT bool_or(hit) OVER (PARTITION BY query_id)),
titles AS ({keyword("title")}), texts AS ({keyword("content")}),
channels AS (SELECT *, 0 AS p, 'dense' AS channel FROM dense UNION ALL SELECT *, 1, 'title_keyword' FROM titles UNION ALL SELECT *, 2, 'chunk_keyword' FROM texts),
firsts AS (SELECT * FROM channels QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY p, pos) = 1),
merged AS (SELECT query_id, doc_id, score, chunk_type, channel, row_number() OVER (PARTITION BY query_id ORDER BY p, pos, doc_id) AS pos FROM firsts),
whole AS (SELECT m.*, title, content AS text, source, category, publish_ts, {QUALITY.replace("text", "content")} AS quality_score, {RECENCY} AS recency_score, a.* EXCLUDE (query_id), strftime(to_timestamp(publish_ts), '%Y-%m-%d') || ' ' || title AS hay
 FROM merged m JOIN news USING (doc_id) JOIN asked a USING (query_id)),
good AS (SELECT * FROM whole QUALIFY quality_score > 0.35 OR count(*) FILTER (WHERE quality_score > 0.35) OVER (PARTITION BY query_id) < 5),
{lcs("good", "shared")},
fresh AS (SELECT *, CASE WHEN y IS NOT NULL THEN contains(hay, CAST(y AS VARCHAR)) AND (m IS NULL OR {month("m")}) WHEN since IS NOT NULL THEN {month("since")} ELSE TRUE END AS meets FROM shared WHERE NOT wants_new OR recency_score >= 0.45 OR common >= 6),
dated AS (SELECT * FROM fresh QUALIFY meets OR count(*) FILTER (WHERE meets) OVER (PARTITION BY query_id) < 5),
ready AS (SELECT *, 2.0 * coalesce(contains(hay, CAST(y AS VARCHAR)), FALSE)::INT + 3.0 * coalesce({month("m")}, FALSE)::INT + 2.0 * coalesce({day("dd")}, FALSE)::INT + 2.0 * coalesce({month("since")}, FALSE)::INT AS date_score,
 CASE WHEN len(list_filter(aliases, lambda a: contains(lower(source || ' ' || title), a))) > 0 THEN 3.0 ELSE 0.0 END AS source_score,
 CASE WHEN (contains(lower(ask), 'why') OR contains(lower(ask), 'how') OR contains(lower(ask), 'explain')) AND (contains(category, 'fr') OR contains(title, 'thing')) THEN 1.2 ELSE 0.0 END AS analysis_score FROM dated),
{rules("ready", "ruled")}, {diversified("ruled", "spread")},
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(source = wanted, FALSE) DESC, final_rank) AS place FROM spread)
SELECT query_id, doc_id, channel, chunk_type, final_score, CAST(place AS INTEGER) AS final_rank FROM placed WHERE place <= 5"""
