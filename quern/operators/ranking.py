"""Ranking of candidates: one row for each query and item; every order is total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as X

Q = "query_id"


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(Q).orderBy(*order)))


def lexical(df: DataFrame) -> DataFrame:
    """lexical_score of title, text and source against the query's text."""
    doc = F.concat_ws(" ", X.text(F.col("title")), X.text(F.col("text")), X.text(F.col("source")))
    return df.withColumn("lexical_score", X.lexical(X.rank_tokens(F.col("query")), X.rank_tokens(doc)))


def weighted(df: DataFrame, weights: dict[str, float], normal: Sequence[str], ties: Sequence[Column], digits: int = 6) -> DataFrame:
    """hybrid_score: a weighted sum of columns, of which `normal` are scaled by min-max over the query's candidates."""
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + w * (S.min_max(F.col(c), Q) if c in normal else F.col(c))
    return ranked(df.withColumn("hybrid_score", F.round(total, digits)), F.desc("hybrid_score"), *ties)


def hybrid(df: DataFrame, vector: float = 0.7, lex: float = 0.3) -> DataFrame:
    return weighted(df, {"score": vector, "lexical_score": lex}, ["score", "lexical_score"], [F.desc("score"), F.asc("doc_id")])


def quality_aware(df: DataFrame, vector: float = 0.62, lex: float = 0.28, quality: float = 0.10) -> DataFrame:
    return weighted(df, {"score": vector, "lexical_score": lex, "quality_score": quality}, ["score", "lexical_score"], [F.desc("score"), F.asc("doc_id")])


def time_aware(df: DataFrame, vector: float = 0.24, lex: float = 0.10, recency: float = 0.58, quality: float = 0.08) -> DataFrame:
    return weighted(df, {"score": vector, "lexical_score": lex, "recency_score": recency, "quality_score": quality}, ["score", "lexical_score"], [F.desc("recency_score"), F.desc("score"), F.asc("doc_id")])


def by_strategy(df: DataFrame, strategy: str) -> DataFrame:
    """Vector order, time-aware or quality-aware ranking."""
    return {"vector": lambda: ranked(df.withColumn("hybrid_score", F.col("score")), F.desc("score"), F.asc("doc_id")), "time": lambda: time_aware(df), "quality": lambda: quality_aware(df), "hybrid": lambda: hybrid(df)}[strategy]()


def fusion(df: DataFrame, cross: float = 0.4, vector: float = 0.4, rule: float = 0.2) -> DataFrame:
    """Cross-encoder score, vector score and rule bonus, each scaled; where a query has no cross-encoder scores, the order of vector score plus bonus."""
    have = F.max("cross_score").over(Window.partitionBy(Q)).isNotNull()
    mixed = cross * S.min_max(F.coalesce("cross_score", F.lit(0.0)), Q) + vector * S.min_max(F.col("score"), Q) + rule * S.min_max(F.col("rule_bonus"), Q)
    df = df.withColumn("hybrid_score", F.round(F.when(have, mixed).otherwise(F.col("score") + F.col("rule_bonus")), 6))
    return ranked(df, F.desc("hybrid_score"), F.desc("score"), F.asc("doc_id"))


def scored_first(df: DataFrame) -> DataFrame:
    """Rows that a remote ranker scored, by score; the others after them in their old order."""
    return ranked(df, F.desc_nulls_last("remote_score"), F.asc("pos"))


def preferred_first(df: DataFrame, is_preferred: Column) -> DataFrame:
    return ranked(df.withColumn("preferred", is_preferred), F.desc("preferred"), F.asc("pos"))


def boosted(df: DataFrame, carried: Column, boost: float = 0.08) -> DataFrame:
    """Carried items get a boost; the order before is kept as original_rank and settles ties."""
    df = ranked(df, F.asc("pos"), name="original_rank")
    return ranked(df.withColumn("boosted_score", F.round(F.col("score") + F.when(carried, boost).otherwise(0.0), 6)), F.desc("boosted_score"), F.asc("original_rank"))


def guarded(df: DataFrame, good: Column, least: int) -> DataFrame:
    """Only good rows, where a query has at least `least` of them; else all its rows, flagged."""
    n = F.count_if(good).over(Window.partitionBy(Q))
    return df.withColumn("fallback", n < least).filter(good | F.col("fallback"))


def stale(df: DataFrame, floor: float, shared: Column, exempt: int = 6) -> DataFrame:
    """Rows whose recency reaches the floor or whose title shares enough characters with the query."""
    return df.filter((F.col("recency_score") >= floor) | (shared >= exempt))


def must_should(df: DataFrame, must: dict[str, str], field: str, terms: Sequence[str], *, most: int = 4, limit: int = 20, order: Sequence[Column] | None = None) -> DataFrame:
    """Rows that equal all that must be, and whose field has any of the first `most` terms: the newest `limit`. Without terms there are none."""
    if not terms:
        return df.limit(0)
    kept = df
    for c, v in must.items():
        kept = kept.filter(F.col(c) == v)
    any_ = F.exists(X.words_of(list(terms)[:most]), lambda t: F.contains(X.text(F.col(field)), t))
    return kept.filter(any_).orderBy(*(order or [F.desc("publish_ts"), F.asc("doc_id")])).limit(limit)


def metadata_filter(df: DataFrame, *, chunk_type: str | None = None, sources: Sequence[str] = (), parent: int | None = None) -> DataFrame:
    """Rows of the chunk type, of the first of the sources' aliases and of the parent; what is not given does not filter. All three reach a Parquet scan."""
    for column, value in (("chunk_type", chunk_type), ("source", sources[0] if sources else None), ("doc_id", parent)):
        df = df if value is None else df.filter(F.col(column) == value)
    return df


def carried(asked: DataFrame, chunks: DataFrame, *, most: int = 8, per_id: int = 2, floor: float = 1.0) -> DataFrame:
    """Evidence of earlier turns as candidates: of the first `most` of each query's ids (each once, in their order) the first `per_id` chunks, scored `floor` at least. asked: query_id, ids; chunks: doc_id, chunk_type, chunk_index, score (null: the floor)."""
    ids = asked.select(Q, F.posexplode(F.array_distinct(F.slice("ids", 1, most))).alias("pos", "doc_id")).filter("doc_id IS NOT NULL")
    some = chunks.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    first = some.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", F.desc("chunk_type")))).filter(F.col("_n") <= per_id).drop("_n")
    return ids.join(first, "doc_id").withColumn("score", F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(floor)))


def keyword_channel(asked: DataFrame, docs: DataFrame, field: str, vocabulary: Sequence[str], *, limit: int = 20) -> DataFrame:
    """must_should() for many queries at once: query_id, doc_id, pos of the newest `limit` documents whose field has any of a query's terms and, if it names a source, that source. asked: query_id, terms (of the vocabulary), source (null: any). Of each term, and of each term and source, the newest `limit` documents and one more (a query's own is left out) are enough, so queries and documents meet over those alone."""
    hits = docs.select("doc_id", "source", "publish_ts", F.explode(X.vocabulary_hits(F.col(field), vocabulary)).alias("_t"))
    newest = lambda *keys: Window.partitionBy("_t", *keys).orderBy(F.desc("publish_ts"), "doc_id")
    top = lambda *keys: hits.withColumn("_n", F.row_number().over(newest(*keys))).filter(F.col("_n") <= limit + 1).drop("_n")
    wanted = asked.select("query_id", F.explode("terms").alias("_t"), F.col("source").alias("_s"))
    any_ = wanted.filter("_s IS NULL").join(top(), "_t").select(Q, "doc_id", "publish_ts")
    one = wanted.filter("_s IS NOT NULL").withColumnRenamed("_s", "source").join(top("source"), ["_t", "source"]).select(Q, "doc_id", "publish_ts")
    found = any_.unionByName(one).distinct().filter(F.col("doc_id") != F.col(Q))
    return ranked(found, F.desc("publish_ts"), F.asc("doc_id"), name="pos").filter(F.col("pos") <= limit).select(Q, "doc_id", "pos")


def merged(channels: Sequence[tuple[str, DataFrame]], key: str = "doc_id") -> DataFrame:
    """Channels in order, first wins by key for each query, with the channel that brought a row."""
    out = None
    for i, (name, df) in enumerate(channels):
        one = df.withColumns({"channel": F.lit(name), "_p": F.lit(i)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    w = Window.partitionBy(Q, key).orderBy("_p", "pos")
    kept = out.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return ranked(kept, F.asc("_p"), F.asc("pos"), F.asc(key), name="merged_pos").drop("_p")


def best_score(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The best score of each key (the first of equals), placed where the key was first seen."""
    w = Window.partitionBy(Q, key)
    df = df.withColumns({"_n": F.row_number().over(w.orderBy(F.desc("score"), "pos")), "first_pos": F.min("pos").over(w)})
    return df.filter("_n = 1").drop("_n")


def parents(chunks: DataFrame, now: int, top: int) -> DataFrame:
    """The best chunk of each parent by score and age, then one for each title prefix without digits (titles without one are all kept), then the top."""
    final = F.round(F.col("score") * S.parent_decay(F.col("publish_ts"), F.lit(now)), 6)
    df = chunks.withColumn("final_score", final)
    best = df.withColumn("_n", F.row_number().over(Window.partitionBy(Q, "parent_id").orderBy(F.desc("final_score"), "pos"))).filter("_n = 1")
    key = F.substring(F.regexp_replace(X.text(F.col("title")), r"[\d\s]+", ""), 1, 20)
    best = best.withColumn("_k", key).withColumn("_n", F.row_number().over(Window.partitionBy(Q, "_k").orderBy(F.desc("final_score"), "pos")))
    return ranked(best.filter((F.col("_n") == 1) | (F.col("_k") == "")).drop("_n", "_k"), F.desc("final_score"), F.asc("pos")).filter(F.col("rank") <= top)


def slots(summaries: DataFrame, bodies: DataFrame, limit: int, reserved: int) -> DataFrame:
    """limit - reserved summaries, then up to `reserved` bodies of parents not among them, then more summaries."""
    s = ranked(summaries, F.asc("pos"), name="_r").withColumns({"kind": F.lit("summary")})
    head = s.filter(F.col("_r") <= limit - reserved)
    b = bodies.join(head.select(Q, "parent_id").distinct(), [Q, "parent_id"], "left_anti")
    b = ranked(b, F.asc("pos"), name="_r").withColumn("kind", F.lit("body"))
    first = Window.partitionBy(Q, "parent_id").orderBy("pos")
    b = b.withColumn("_f", F.row_number().over(first)).filter("_f = 1").drop("_f")
    b = ranked(b.drop("_r"), F.asc("pos"), name="_r").filter(F.col("_r") <= reserved)
    rest = s.filter(F.col("_r") > limit - reserved).join(b.select(Q, "parent_id"), [Q, "parent_id"], "left_anti")
    both = head.withColumn("_s", F.lit(0)).unionByName(b.withColumn("_s", F.lit(1)), allowMissingColumns=True).unionByName(rest.withColumn("_s", F.lit(2)), allowMissingColumns=True)
    return ranked(both, F.asc("_s"), F.asc("_r"), name="slot").filter(F.col("slot") <= limit).drop("_r", "_s")


def diversified(df: DataFrame, most: int = 2, window: int = 10, tolerance: float = 2.0) -> DataFrame:
    """Source diversity in the first places: an item of a source that has its share waits after the window, if a later item of another source with a share left is nearly as good. The window's rows are folded in order, at most `window` of them for a query; the others keep their places."""
    df = df.withColumn("_source", F.coalesce(F.nullif("source", F.lit("")), F.lit("other")))
    size = max(window, most)
    head = F.when(F.col("rank") <= size, F.struct("rank", F.col("_source").alias("s"), F.col("final_score").alias("f")))
    df = df.withColumn("_i", F.array_sort(F.collect_list(head).over(Window.partitionBy(Q))))
    state = F.struct(F.array().cast("array<int>").alias("kept"), F.array().cast("array<int>").alias("late"), F.array().cast("array<string>").alias("used"))

    def step(all_items: Column):
        def one(s: Column, x: Column) -> Column:
            used = lambda name: F.size(F.filter(s["used"], lambda u: u == name))
            free = used(x["s"]) < most
            other = F.exists(all_items, lambda y: (y["rank"] > x["rank"]) & (y["s"] != x["s"]) & (used(y["s"]) < most) & (y["f"] >= x["f"] - tolerance))
            stays = free | ~other
            return F.struct(F.when(stays, F.concat(s["kept"], F.array(x["rank"]))).otherwise(s["kept"]).alias("kept"), F.when(stays, s["late"]).otherwise(F.concat(s["late"], F.array(x["rank"]))).alias("late"), F.when(stays, F.concat(s["used"], F.array(x["s"]))).otherwise(s["used"]).alias("used"))

        return one

    order = F.aggregate("_i", state, step(F.col("_i")), lambda s: F.concat(s["kept"], s["late"]))
    return df.withColumn("final_rank", F.when(F.col("rank") <= size, F.array_position(order, F.col("rank")).cast("int")).otherwise(F.col("rank"))).drop("_i", "_source")


def light_rules(df: DataFrame, *, body: float = 0.8, in_text: float = 0.5) -> DataFrame:
    """final_score by additive rules over columns query, entities, title, chunk, score, date_score, source_score, channel, chunk_type, analysis_score; the parts are kept."""
    title, chunk, entities = X.text(F.col("title")), X.text(F.col("chunk")), F.col("entities")
    long_hits = F.aggregate(F.filter(entities, lambda e: F.contains(title, e)), F.lit(0.0), lambda a, e: a + F.when(F.length(e) >= 4, 3.0).otherwise(1.5))
    both = F.concat_ws(" ", title, chunk)
    only_text = F.size(F.filter(entities, lambda e: (e != "") & ~F.contains(title, e) & F.contains(both, e))) * in_text
    channel = F.when(F.col("channel") == "title_keyword", 1.5).when(F.col("channel") == "chunk_keyword", 0.5).when(F.col("channel") == "carryover_evidence", 4.0).otherwise(0.0)
    parts = {
        "lexical": 0.6 * X.contained(entities, title) + 0.4 * X.contained(entities, chunk),
        "title_score": S.title_match(F.col("query"), title, F.col("common")),
        "entity_bonus": long_hits,
        "length_penalty": S.length_penalty(F.length(chunk)),
        "channel_bonus": channel,
        "body_bonus": F.when(F.col("chunk_type") == "body", body).otherwise(0.0),
        "text_overlap": only_text,
    }
    df = df.withColumns(parts)
    total = 10 * F.col("score") + 5 * F.col("lexical") + sum((F.col(c) for c in parts if c != "lexical"), F.lit(0.0)) + F.col("date_score") + F.col("source_score") + F.col("analysis_score")
    return ranked(df.withColumn("final_score", F.round(total, 6)), F.desc("final_score"), F.asc("pos"))


def rule_rerank(df: DataFrame) -> DataFrame:
    """Diagnostic rules: 3 or 1 for each entity in title or text, the common substring's length from 8 on, 8 for a title within the query, 2 for the source."""
    title, chunk = X.text(F.col("title")), X.text(F.col("chunk"))
    hits = lambda c: F.size(F.filter("entities", lambda e: F.contains(c, e)))
    total = 3 * hits(title) + hits(chunk) + F.when(F.col("common") >= 8, F.col("common")).otherwise(0) + F.when((title != "") & F.contains(F.col("query"), title), 8).otherwise(0) + F.when(F.col("source_score") > 0, 2).otherwise(0)
    return ranked(df.withColumn("rule_score", total), F.desc("rule_score"), F.asc("pos"))


def no_answer(df: DataFrame) -> DataFrame:
    """For each query: the share of four signs of no answer among the first five (first score below .55, lexical below .05, title score below 2, no date or source hit)."""
    top = df.filter(F.col("rank") <= 5)
    agg = top.groupBy(Q).agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1"), F.round(F.avg("score"), 4).alias("top5_avg"), F.max("lexical").alias("_l"), F.max("title_score").alias("_t"), F.bool_or((F.col("date_score") > 0) | (F.col("source_score") > 0)).alias("_h"))
    signs = sum((c.cast("int") for c in (F.col("top1") < 0.55, F.col("_l") < 0.05, F.col("_t") < 2.0, ~F.col("_h"))), F.lit(0))
    n = df.groupBy(Q).agg(F.count("*").alias("_n"))
    return agg.join(n, Q).withColumn("no_answer_score", F.round(signs / 4.0, 4)).withColumn("should_no_answer", (signs >= 4) & (F.col("_n") < 2)).select(Q, "top1", "top5_avg", "no_answer_score", "should_no_answer")


def anchors(df: DataFrame) -> DataFrame:
    """Confidence of anchor candidates from signals worth up to 11: high from 5, medium from 3; up to five candidates and eight leads for each query."""
    points = 3 * F.col("source_hit").cast("int") + 2 * F.col("topic_hit").cast("int") + 2 * F.col("date_hit").cast("int") + 2 * F.col("title_hit").cast("int") + F.col("ocr_hit").cast("int") + F.col("verified").cast("int")
    df = df.withColumn("points", points).withColumn("confidence", F.when(points >= 5, "high").when(points >= 3, "medium").otherwise("low"))
    df = df.withColumn("kind", F.when(F.col("confidence") == "low", "lead").otherwise("candidate"))
    w = Window.partitionBy(Q, "kind").orderBy(F.desc("points"), F.asc("doc_id"))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.when(F.col("kind") == "lead", 8).otherwise(5))
