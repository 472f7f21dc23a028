"""Queries of corpus engineering and of scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import runtime
from ..functions import dates as D
from ..functions import text as X
from ..operators import corpus as C
from ..operators import dictionary as K
from ..operators import graph as G
from ..operators import relational as R
from ..sources.tables import NEWS, NOW, news, table
from .registry import query

FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query("chunk_sliding", f"""WITH f AS (SELECT doc_id, {FLAT} AS t FROM documents), s AS (SELECT doc_id, t, unnest(range(0, greatest(CAST(ceil((length(t) - 600) / 480.0) AS INT), 0) + 1)) AS i FROM f WHERE t <> '')
SELECT doc_id, CAST(i AS INT) AS chunk_index, substr(t, i * 480 + 1, 600) AS chunk FROM s""")
def chunk_sliding(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.windows(X.collapse(F.col("text")), 600, 120)).alias("chunk_index", "chunk"))


@query("chunk_packed")
def chunk_packed(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.packed_chunks(F.col("text"))).alias("chunk_index", "chunk"))


@query("chunk_flatmap_ids", f"""WITH f AS (SELECT doc_id, {FLAT} AS t FROM documents), b AS (SELECT doc_id, t, unnest(range(0, least(8, greatest(CAST(ceil((length(t) - 600) / 480.0) AS INT), 0) + 1))) AS i FROM f WHERE t <> ''),
c AS (SELECT doc_id, 'summary' AS chunk_type, 0 AS chunk_index, length(substr(t, 1, 200)) AS n FROM f UNION ALL SELECT doc_id, 'body', CAST(i AS INT), length(substr(t, i * 480 + 1, 600)) FROM b)
SELECT doc_id, chunk_type, chunk_index, n AS chunk_chars, 'docs|news:' || doc_id || '|' || chunk_type || '|' || chunk_index AS chunk_key,
 CAST(('0x' || substr(sha256('docs|news:' || doc_id || '|' || chunk_type || '|' || chunk_index), 1, 16))::UBIGINT & 9223372036854775807 AS BIGINT) AS point_id FROM c""")
def chunk_flatmap_ids(spark, d):
    return C.document_chunks(news(spark, d)).select("doc_id", "chunk_type", "chunk_index", F.length("chunk_text").alias("chunk_chars"), "chunk_key", "point_id")


@query("index_build_estimate", f"WITH f AS (SELECT doc_id, source, {FLAT} AS t FROM documents) SELECT source, count(*) AS docs, CAST(sum(1 + CASE WHEN t = '' THEN 0 ELSE least(8, greatest(CAST(ceil((length(t) - 600) / 480.0) AS INT), 0) + 1) END) AS BIGINT) AS chunks FROM f GROUP BY source")
def index_build_estimate(spark, d):
    n = 1 + X.n_windows(F.length(X.collapse(F.col("text"))), 600, 120, 8)
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum(n.cast("long")).alias("chunks"))


ODD = "length({0}) - length(regexp_replace({0}, '[\\x00-\\x08\\x0e-\\x1f\\x7f-\\x9f\\x{{e000}}-\\x{{f8ff}}]', '', 'g'))"
IS_GARBLED = "(contains({0}, chr(65533)) OR ({1} >= 3 AND {1} > 0.02 * length({0})) OR (length({0}) >= 40 AND NOT regexp_matches({0}, '[\\x{{4e00}}-\\x{{9fff}}]') AND length(regexp_replace({0}, '[^A-Za-z]', '', 'g')) < 0.3 * length({0})))"
#: Dates as texts in all states, by id.
DATES = "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '2023-02-15' WHEN 2 THEN '2023-02-30' WHEN 3 THEN '2030/01/05' ELSE '1900-01-01' END"
_FLAGS = {
    "empty_title": "trim(title) = ''", "empty_content": "c = ''", **{f"under_{k}": f"length(c) BETWEEN 1 AND {k - 1}" for k in (80, 200, 500)}, "garbled_title": IS_GARBLED.format("a", "oa"), "garbled_content": IS_GARBLED.format("b", "ob"),
    "html_residue": "regexp_matches(c, '(?i)<(p|div|br|span|a|img|script)\\b')", "url_residue": "regexp_matches(c, 'https?://')", "tail_noise": "contains(right(content, 160), 'reserved')",
    **{f"date_{s}": f"doc_id % 5 = {i}" for s, i in (("missing", 0), ("unparseable", 2), ("future", 3), ("too_old", 4))},
}


@query("quality_flags", f"""WITH n AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS content FROM documents), s AS (SELECT *, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS c, substr(title, 1, 1000) AS a, substr(content, 1, 1000) AS b FROM n),
o AS (SELECT *, {ODD.format("a")} AS oa, {ODD.format("b")} AS ob FROM s) SELECT flag, n FROM (SELECT {", ".join(f"count(*) FILTER (WHERE {x}) AS {k}" for k, x in _FLAGS.items())} FROM o) UNPIVOT (n FOR flag IN ({", ".join(_FLAGS)}))""")
def quality_flags(spark, d):
    """All fourteen flags in one pass."""
    return C.flag_counts(news(spark, d), C.flags(["reserved"], F.expr(DATES)))


@query("flag_examples", "WITH n AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS c FROM documents), l AS (SELECT doc_id, 'under_80' AS flag FROM n WHERE length(c) BETWEEN 1 AND 79 UNION ALL SELECT doc_id, 'under_200' FROM n WHERE length(c) BETWEEN 1 AND 199) SELECT doc_id, flag, n FROM (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY doc_id) AS n FROM l) WHERE n <= 5")
def flag_examples(spark, d):
    marks = {k: v for k, v in C.flags().items() if k in ("under_80", "under_200")}
    return C.flag_examples(news(spark, d), marks, "doc_id")


BROKEN = "CASE doc_id % 10 WHEN 0 THEN chr(65533) || text WHEN 1 THEN repeat(chr(1), 40) || text WHEN 2 THEN repeat('12345 67890 ', 20) WHEN 3 THEN chr(1) || text ELSE text END"
_GARBLED = "CASE WHEN contains(h, chr(65533)) THEN 'replaced' WHEN odd >= 3 AND odd > 0.02 * length(h) THEN 'control' WHEN length(h) >= 40 AND length(regexp_replace(h, '[^A-Za-z]', '', 'g')) < 0.3 * length(h) THEN 'letterless' END"


@query("garbled_documents", f"WITH x AS (SELECT doc_id, {BROKEN} AS t FROM documents), s AS (SELECT doc_id, substr(split_part(t, chr(10), 1), 1, 1000) AS a, substr(t, 1, 1000) AS b FROM x), l AS (SELECT 'title' AS part, a AS h FROM s UNION ALL SELECT 'content', b FROM s), o AS (SELECT *, length(h) - length(regexp_replace(h, '[\\x00-\\x08\\x0e-\\x1f\\x7f-\\x9f\\x{{e000}}-\\x{{f8ff}}]', '', 'g')) AS odd FROM l) SELECT part, count({_GARBLED}) AS garbled, count(*) AS n FROM o GROUP BY part")
def garbled_documents(spark, d):
    """Documents, some of them broken in three ways, by their titles and contents."""
    i, t = F.col("doc_id") % 10, F.col("text")
    broken = F.when(i == 0, F.concat(F.lit("\ufffd"), t)).when(i == 1, F.concat(F.lit("\x01" * 40), t)).when(i == 2, F.lit("12345 67890 " * 20)).when(i == 3, F.concat(F.lit("\x01"), t)).otherwise(t)
    x = table(spark, d, "documents").select(broken.alias("content")).withColumn("title", F.substring_index("content", "\n", 1))
    parts = x.select(F.explode(F.array(F.struct(F.lit("title").alias("part"), X.garbled(F.col("title")).alias("g")), F.struct(F.lit("content").alias("part"), X.garbled(F.col("content")).alias("g")))).alias("_x"))
    return parts.groupBy("_x.part").agg(F.count_if(F.col("_x.g")).alias("garbled"), F.count("*").alias("n"))


@query("readability_markers", "SELECT doc_id, contains(text, '###')::INT + contains(text, ' | ')::INT + contains(text, 'token')::INT AS n_markers, regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') AS cjk FROM documents")
def readability_markers(spark, d):
    return table(spark, d, "documents").select("doc_id", X.marker_count(F.col("text"), ["###", " | ", "token"]).alias("n_markers"), X.has_cjk(F.col("text")).alias("cjk"))


@query("one_pass_histograms", f"WITH {NEWS}, b AS (SELECT category, source, CASE WHEN n_chars < 100 THEN 'short' WHEN n_chars <= 1000 THEN 'medium' WHEN n_chars <= 5000 THEN 'long' ELSE 'very_long' END AS bucket, year(to_timestamp(publish_ts)) AS year FROM news) SELECT 'category' AS dim, category AS value, count(*) AS n FROM b GROUP BY category UNION ALL SELECT 'source', source, count(*) FROM b GROUP BY source UNION ALL SELECT 'bucket', bucket, count(*) FROM b GROUP BY bucket UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM b GROUP BY year")
def one_pass_histograms(spark, d):
    return C.histograms(news(spark, d), {"category": F.col("category"), "source": F.col("source"), "bucket": X.length_bucket(F.col("n_chars")), "year": F.year(F.timestamp_seconds("publish_ts"))})


@query("field_presence", "SELECT count(doc_id) AS doc_id, count(text) AS text, count(lang) AS lang, count(source) AS source, count(*) AS n FROM documents")
def field_presence(spark, d):
    return table(spark, d, "documents").agg(*(F.count(c).alias(c) for c in ("doc_id", "text", "lang", "source")), F.count("*").alias("n"))


@query("length_percentiles", """WITH g AS (SELECT lang, list_sort(list(n_chars)) AS v, count(*) AS n FROM documents GROUP BY lang)
SELECT lang, v[CAST(ceil(n * 0.5) AS INT)] AS nearest_50, v[CAST(round_even((n - 1) * 0.5, 0) AS INT) + 1] AS rounded_50, v[CAST(ceil(n * 0.9) AS INT)] AS nearest_90, v[CAST(round_even((n - 1) * 0.9, 0) AS INT) + 1] AS rounded_90,
 q.l50 AS linear_50, q.l90 AS linear_90 FROM g JOIN (SELECT lang, quantile_cont(n_chars, 0.5) AS l50, quantile_cont(n_chars, 0.9) AS l90 FROM documents GROUP BY lang) q USING (lang)""")
def length_percentiles(spark, d):
    return C.percentiles(table(spark, d, "documents"), "n_chars", ["lang"])


@query("recent_windows", f"WITH {NEWS} SELECT " + ", ".join(f"count(*) FILTER (WHERE publish_ts >= 1704067200 - {n} * 86400) AS last_{n}" for n in (30, 90, 180, 365, 730)) + ", min(publish_ts) AS first, max(publish_ts) AS last FROM news")
def recent_windows(spark, d):
    return C.recent_windows(news(spark, d), "publish_ts", NOW, (30, 90, 180, 365, 730))


@query("topk_percent", "SELECT source, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 2) AS percent FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def topk_percent(spark, d):
    return C.top_share(table(spark, d, "documents"), "source", 10)


@query("source_label_matrix", "SELECT source, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'es') AS es, count(*) FILTER (WHERE lang = 'fr') AS fr FROM documents GROUP BY source")
def source_label_matrix(spark, d):
    return C.matrix(table(spark, d, "documents"), "source", "lang", ["de", "en", "es", "fr"])


@query("rollup_matched", f"WITH {NEWS} SELECT coalesce(source, 'all') AS source, count(*) AS n, count(*) FILTER (WHERE contains(content, 'tion')) AS matched, round(100.0 * count(*) FILTER (WHERE contains(content, 'tion')) / count(*), 2) AS rate FROM news GROUP BY ROLLUP (source)")
def rollup_matched(spark, d):
    hit = F.count_if(F.contains("content", F.lit("tion")))
    return news(spark, d).rollup("source").agg(F.count("*").alias("n"), hit.alias("matched"), X.percent(hit, F.count("*")).alias("rate")).withColumn("source", F.coalesce("source", F.lit("all")))


@query("tag_classify", f"""WITH {NEWS}, t AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(lower(content), '(^|[^a-z0-9])the($|[^a-z0-9])') THEN 'english' END, CASE WHEN regexp_matches(lower(content), '(^|[^a-z0-9])und($|[^a-z0-9])') THEN 'german' END, CASE WHEN regexp_matches(lower(content), '(^|[^a-z0-9])license($|[^a-z0-9])') OR regexp_matches(lower(content), '(^|[^a-z0-9])licensed($|[^a-z0-9])') THEN 'legal' END], lambda x: x IS NOT NULL) AS l FROM news)
SELECT doc_id, array_to_string(l, ',') AS labels, CASE WHEN list_contains(l, 'legal') THEN 'legal' WHEN list_contains(l, 'german') THEN 'german' WHEN list_contains(l, 'english') THEN 'english' ELSE 'other' END AS primary_label FROM t""")
def tag_classify(spark, d):
    labels, primary = C.tagged(F.col("content"), {"english": ["the"], "german": ["und"], "legal": ["license", "licensed"]}, ["legal", "german", "english"])
    return news(spark, d).select("doc_id", F.array_join(labels, ",").alias("labels"), primary.alias("primary_label"))


DICTIONARY = """bt AS (SELECT regexp_extract_all(lower(text), '[a-z0-9]+[^a-z0-9]*') AS t FROM benchmark), bi AS (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM bt),
bw AS (SELECT regexp_extract(t[i], '^[a-z0-9]+') AS a, t[i] AS ta, regexp_extract(t[i + 1], '^[a-z0-9]+') AS b FROM bi),
kw AS (SELECT DISTINCT k AS keyword, 'k' || (length(k) % 5) AS label FROM (SELECT a AS k FROM bw UNION ALL SELECT a || ' ' || b FROM bw WHERE ta = a || ' ' AND b <> '') WHERE length(k) >= 6)"""


@query("dictionary_tags", f"""WITH {DICTIONARY}, dt AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+[^a-z0-9]*') AS t FROM documents), di AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM dt),
dw AS (SELECT DISTINCT doc_id, unnest([regexp_extract(t[i], '^[a-z0-9]+'), t[i] || regexp_extract(t[i + 1], '^[a-z0-9]+')]) AS keyword FROM di),
h AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, count(DISTINCT keyword) AS n_keywords FROM dw JOIN kw USING (keyword) GROUP BY doc_id)
SELECT doc_id, coalesce(labels, '') AS labels, CASE WHEN contains(labels, 'k3') THEN 'k3' WHEN contains(labels, 'k1') THEN 'k1' ELSE coalesce(substr(labels, 1, 2), 'other') END AS primary_label, coalesce(n_keywords, 0) AS n_keywords FROM documents LEFT JOIN h USING (doc_id)""")
def dictionary_tags(spark, d):
    """Documents by a dictionary of all words and pairs of words (six characters or more) of the benchmark: labels by the keyword's length."""
    texts = table(spark, d, "benchmark").select(F.lower("text").alias("t"))
    word = F.explode(F.regexp_extract_all("t", F.lit("[a-z0-9]+"), F.lit(0)))
    pair = F.explode(F.regexp_extract_all("t", F.lit("(?=(?<![a-z0-9])([a-z0-9]+ [a-z0-9]+))"), F.lit(1)))
    words = texts.select(word.alias("keyword")).unionByName(texts.select(pair.alias("keyword"))).filter(F.length("keyword") >= 6).distinct()
    words = words.withColumn("label", F.concat(F.lit("k"), (F.length("keyword") % 5).cast("string")))
    found = K.tagged_by(table(spark, d, "documents"), "doc_id", "text", words, ["k3", "k1"])
    return found.select("doc_id", F.array_join("labels", ",").alias("labels"), F.col("primary").alias("primary_label"), "n_keywords")


@query("source_normalised", "SELECT grp, count(*) AS n FROM (SELECT CASE WHEN contains(source, 'src1') THEN 'teens' WHEN contains(source, 'src2') OR contains(source, 'src3') THEN 'few' ELSE 'rest' END AS grp FROM documents) GROUP BY grp")
def source_normalised(spark, d):
    return table(spark, d, "documents").groupBy(C.first_rule(F.col("source"), [("teens", ["src1"]), ("few", ["src2", "src3"])], "rest").alias("grp")).agg(F.count("*").alias("n"))


@query("exact_dup_groups", "SELECT sha1(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, d):
    return C.exact_duplicates(table(spark, d, "documents"), F.col("text"))


@query("dup_surplus", f"WITH {NEWS}, g AS (SELECT title, count(*) AS n FROM news GROUP BY title HAVING count(*) > 1) SELECT count(*) AS n_groups, CAST(sum(n - 1) AS BIGINT) AS surplus FROM g")
def dup_surplus(spark, d):
    return C.exact_duplicates(news(spark, d), F.col("title")).agg(F.count("*").alias("n_groups"), F.sum(F.col("n") - 1).alias("surplus"))



@query("neighbour_pairs", f"WITH {NEWS}, o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY publish_ts, doc_id) AS n FROM news) SELECT x.doc_id AS a, y.doc_id AS b FROM o x JOIN o y ON x.source = y.source AND y.n BETWEEN x.n + 1 AND x.n + 4")
def neighbour_pairs(spark, d):
    return C.neighbour_pairs(news(spark, d), ["source"], ["publish_ts"], "title").select("a", "b")


@query("near_dup_pairs")
def near_dup_pairs(spark, d):
    """Two passes over each source's quarters of 91 days: titles in their order at 0.90, and heads of 1,000 characters in the order of their first 200 at 0.95. A pair of both has the larger ratio; equal contents are exact duplicates and left out."""
    n = news(spark, d).withColumns({"quarter": F.floor(F.col("publish_ts") / (91 * 86400)), "flat": X.collapse(F.col("content"))})
    n = runtime.written(n.select("doc_id", "source", "quarter", "title", F.substring("flat", 1, 1000).alias("head"), F.sha1("flat").alias("hash")), "heads").withColumn("first", F.substring("head", 1, 200))
    titles = C.near_duplicates(n, ["source", "quarter"], ["title"], "title", 0.90, exact="hash")
    heads = C.near_duplicates(n, ["source", "quarter"], ["first"], "head", 0.95, exact="hash")
    return titles.unionByName(heads).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("ratio").alias("ratio"))


@query("near_dup_components")
def near_dup_components(spark, d):
    return G.components(near_dup_pairs(spark, d)).select("node", "component")


@query("edge_components", "WITH RECURSIVE e AS (SELECT DISTINCT min(doc_id) OVER (PARTITION BY text) AS a, doc_id AS b FROM documents) SELECT b AS node, a AS component FROM e WHERE a IN (SELECT a FROM e GROUP BY a HAVING count(*) > 1)")
def edge_components(spark, d):
    """Components over the edges from each text's first document to its copies."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("a"))
    return G.components(docs.join(first, "h").filter("doc_id <> a").select("a", F.col("doc_id").alias("b")))


@query("funnel_counts", f"WITH {NEWS} SELECT count(*) AS scanned, count(*) FILTER (WHERE publish_ts >= 1704067200 - 1825 * 86400) AS in_window, count(*) FILTER (WHERE publish_ts >= 1704067200 - 1825 * 86400 AND n_chars >= 80) AS long_enough, count(*) FILTER (WHERE publish_ts >= 1704067200 - 1825 * 86400 AND n_chars >= 80 AND contains(substr(content, 1, 1200), 'ing')) AS matched FROM news")
def funnel_counts(spark, d):
    return C.funnel(news(spark, d), [("in_window", F.col("publish_ts") >= NOW - 1825 * 86400), ("long_enough", F.col("n_chars") >= 80), ("matched", F.contains(F.substring("content", 1, 1200), F.lit("ing")))])


@query("corpus_verdict", f"WITH {NEWS}, r AS (SELECT round(1 - count(DISTINCT content) / count(*), 6) AS dup, round(count(*) FILTER (WHERE n_chars < 200) / count(*), 6) AS short FROM news) SELECT dup, short, concat_ws(',', CASE WHEN dup > 0.10 THEN 'duplicates' END, CASE WHEN short > 0.10 THEN 'short' END) AS problems, CASE WHEN dup > 0.10 OR short > 0.10 THEN 'repair' ELSE 'ready' END AS verdict FROM r")
def corpus_verdict(spark, d):
    r = news(spark, d).agg(F.round(1 - F.count_distinct("content") / F.count("*"), 6).alias("dup"), F.round(F.count_if(F.col("n_chars") < 200) / F.count("*"), 6).alias("short"))
    return C.verdicts(r, [("duplicates", F.col("dup") > 0.10), ("short", F.col("short") > 0.10)])


@query("html_visible_text")
def html_visible_text(spark, d):
    """Both variants: without hidden elements and joined by line breaks, and all text joined by spaces."""
    return table(spark, d, "pages").select("page_id", X.visible_text(F.col("html")).alias("text"), X.visible_text(F.col("html"), " ", hidden=()).alias("all_text"))


@query("url_source_policy", """WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages) SELECT page_id, host, CASE WHEN contains(host, '.org') THEN 'high' WHEN contains(host, 'blog.') THEN 'low' ELSE 'medium' END AS tier, NOT (host = 'example.net' OR ends_with(host, '.example.net')) AS allowed FROM h""")
def url_source_policy(spark, d):
    h = X.host(F.col("url"))
    return table(spark, d, "pages").select("page_id", h.alias("host"), X.credibility(h, [".org"], ["blog."]).alias("tier"), X.url_allowed(F.col("url"), denied=["example.net"]).alias("allowed"))


@query("line_denoise")
def line_denoise(spark, d):
    return table(spark, d, "documents").select("doc_id", X.denoised(F.col("text"), ["All rights reserved."]).alias("x")).select("doc_id", "x.n_lines", "x.n_repeated", "x.n_noise", F.length("x.text").alias("n_kept_chars"))


@query("search_terms")
def search_terms(spark, d):
    return news(spark, d).select("doc_id", F.array_join(X.keywords(F.col("title"), ["the", "and"]), " ").alias("terms"))


@query("rank_tokens", "SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n_tokens FROM documents")
def rank_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.rank_tokens(F.col("text"))).cast("long").alias("n_tokens"))


_TERMS = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{3,}'))"


@query("verification_join", f"""WITH b AS (SELECT item_id, {_TERMS} AS ts FROM benchmark), n AS (SELECT doc_id, {_TERMS} AS ts FROM documents), p AS (SELECT item_id, unnest(ts) AS t FROM b), q AS (SELECT doc_id, unnest(ts) AS t FROM n), s AS (SELECT item_id, doc_id, count(*) AS shared FROM p JOIN q USING (t) GROUP BY 1, 2),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS k FROM s) WHERE k = 1)
SELECT item_id AS left_id, doc_id AS right_id, coalesce(shared, 0) AS shared, CASE WHEN len(ts) < 2 THEN 'low_signal' WHEN shared IS NULL THEN 'unverified' WHEN shared >= 2 THEN 'station_matched' ELSE 'conflict' END AS status FROM b LEFT JOIN r USING (item_id)""")
def verification_join(spark, d):
    """Benchmark passages against documents, by all terms that they share."""
    terms = lambda c: X.verification_terms(F.col(c))
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("left_id"), terms("text").alias("terms"))
    n = table(spark, d, "documents").select(F.col("doc_id").alias("right_id"), terms("text").alias("terms"))
    return C.verified_against(b, n, "terms")


@query("date_statuses", """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN '2023-0' || (1 + doc_id % 9) || '-15' WHEN doc_id % 5 = 2 THEN '2023-02-30' WHEN doc_id % 5 = 3 THEN '2030/01/05' ELSE '1900-01-01' END AS s FROM documents)
SELECT CASE WHEN s = '' THEN 'missing' WHEN s = '2023-02-30' THEN 'unparseable' WHEN s LIKE '1900%' THEN 'too_old' WHEN s LIKE '2030%' THEN 'future' ELSE 'valid' END AS status, count(*) AS n FROM x GROUP BY 1""")
def date_statuses(spark, d):
    i = F.col("doc_id")
    s = F.when(i % 5 == 0, "").when(i % 5 == 1, F.concat(F.lit("2023-0"), (1 + i % 9).cast("string"), F.lit("-15"))).when(i % 5 == 2, "2023-02-30").when(i % 5 == 3, "2030/01/05").otherwise("1900-01-01")
    return table(spark, d, "documents").groupBy(D.parsed(s, "2024-01-31")["status"].alias("status")).agg(F.count("*").alias("n"))


@query("inferred_time", f"WITH {NEWS} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN publish_ts WHEN doc_id % 3 = 0 THEN 1686787200 ELSE 0 END AS ts FROM news")
def inferred_time(spark, d):
    n = news(spark, d)
    ts = F.when(F.col("doc_id") % 2 == 0, F.col("publish_ts").cast("string"))
    title = F.when(F.col("doc_id") % 3 == 0, F.lit("report of 2023-6-15")).otherwise(F.lit("no date, or 2023-13-45"))
    return n.select("doc_id", D.publish_ts(ts, title).alias("ts"))


@query("content_hashes", "SELECT doc_id, sha1(text) AS exact, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS normal FROM documents")
def content_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha1("text").alias("exact"), F.sha2(X.collapse(F.col("text")), 256).alias("normal"))


@query("index_coverage", "SELECT count(*) AS points, count(DISTINCT label) AS labels, count(*) FILTER (WHERE doc_id IS NOT NULL) AS with_parent FROM embeddings LEFT JOIN documents ON doc_id = vec_id")
def index_coverage(spark, d):
    e, n = table(spark, d, "embeddings"), table(spark, d, "documents").select("doc_id")
    return e.join(n, F.col("vec_id") == F.col("doc_id"), "left").agg(F.count("*").alias("points"), F.count_distinct("label").alias("labels"), F.count("doc_id").alias("with_parent"))


@query("dimension_check", "SELECT len(embedding) AS dims, count(*) AS n FROM embeddings GROUP BY 1")
def dimension_check(spark, d):
    return table(spark, d, "embeddings").groupBy(F.size("embedding").cast("long").alias("dims")).agg(F.count("*").alias("n"))


@query("catalogue_columns")
def catalogue_columns(spark, d):
    t = table(spark, d, "documents")
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in t.schema], "name string, type string, nullable boolean")


@query("jsonl_roundtrip", "SELECT doc_id, lang FROM documents")
def jsonl_roundtrip(spark, d):
    from ..sources import files as S

    good, _bad = S.parse_lines(table(spark, d, "documents").select(F.to_json(F.struct("doc_id", "lang")).alias("value")), "doc_id long, lang string")
    return good.select("doc_id", "lang")


@query("external_insert", f"WITH {NEWS}, old AS (SELECT title, min(doc_id) AS id FROM news GROUP BY title) SELECT page_id FROM pages WHERE url NOT IN (SELECT title FROM old)")
def external_insert(spark, d):
    p = table(spark, d, "pages").select("page_id", F.col("url").alias("title"))
    return R.without(p, news(spark, d), ["title"]).select("page_id")
