"""Composed retrieval: recall, guarded filters, channels, ranking, diversity and parents, for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import runtime
from ..functions import dates as D
from ..functions import scores as S
from ..functions import text as X
from ..operators import multivector as M
from ..operators import ranking as K
from ..operators import routing as R
from ..operators import vector as V
from ..sources.tables import NOW, news, table

#: Vocabularies are parameters; these neutral ones fit the driver's texts.
ENTITIES = ("the", "tion", "and", "thing", "ment", "heit")
CLICKBAIT, ARTEFACTS = ("!!", "***"), ("lorem", "###")
RECALL, TOP = 50, 5


def recalled(spark: SparkSession, sf_dir: str, k: int = RECALL) -> DataFrame:
    """The k nearest of every query (vec_id divisible by 50), joined with both texts: candidates in vector order."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = V.exact_knn(asked, e, k).select("query_id", F.col("vec_id").alias("doc_id"), "score", F.col("rank").alias("pos"))
    n = news(spark, sf_dir)
    q = n.select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))
    return found.join(n, "doc_id").join(q, "query_id").withColumn("text", F.col("content"))


def scored(df: DataFrame, now: int = NOW) -> DataFrame:
    quality = S.quality(F.col("title"), F.col("text"), F.col("source"), artefacts=ARTEFACTS, clickbait=CLICKBAIT)
    return K.lexical(df).withColumns({"quality_score": F.round(quality, 6), "recency_score": D.recency(F.col("publish_ts"), F.lit(now))})


def v1(spark: SparkSession, sf_dir: str, *, strategy: str = "hybrid", limit: int = TOP) -> DataFrame:
    """Recall, ranking by strategy, severe low quality out where enough remains, stale items out for time-aware ranking, sources preferred, first by id, limit."""
    df = K.by_strategy(scored(recalled(spark, sf_dir)), strategy)
    df = K.guarded(df.withColumn("pos", F.col("rank")), F.col("quality_score") > 0.35, 5)
    if strategy == "time":
        df = K.stale(df, 0.45, X.longest_common(F.col("title"), F.col("query")))
    df = K.preferred_first(df.drop("rank"), F.col("source") == "src1")
    return df.filter(F.col("rank") <= limit)


#: What requests look for besides their titles.
VOCABULARY = R.Vocabulary(entities=ENTITIES, timeline=("latest",), sources={"src1": ("first wire",), "src2": ("second wire",)})


#: What requests of the second kind want besides; sections and title words of analyses.
WISHES = (" in 2020-07", " from the first wire", " the latest", " and explain why")
ANALYSES, ANALYSIS_WORDS = ("fr",), ("thing",)
#: Vectors of a document: its own number of this many, the first of its title and the others of its body.
VECTORS = 4


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query, ask and what it asks for: each title with a wish for a month, a source, the latest, or an explanation. terms: what keyword channels look for, where the plan has them."""
    asked = table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("doc_id")).join(news(spark, sf_dir), "doc_id").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))
    wish = F.array(*map(F.lit, WISHES))[(F.floor(F.col("query_id") / 50) % len(WISHES)).cast("int")]
    asked = asked.withColumn("ask", F.concat("query", wish)).withColumn("_i", R.structured(F.col("ask"), VOCABULARY))
    found = asked.select("query_id", "query", "ask", F.col("_i.entities").alias("entities"), F.get("_i.source.named", F.lit(0)).alias("wanted_source"), F.col("_i.source.aliases").alias("aliases"), F.col("_i.date").alias("date"), F.col("_i.query_type").alias("query_type"), F.col("_i.plan").alias("plan"), F.col("_i.source.named").alias("_named"))
    terms = F.when(F.size("entities") > 0, F.slice("entities", 1, 3)).otherwise(F.slice("_named", 1, 2))
    return found.withColumn("terms", F.when(F.array_contains("plan", "title_keyword"), terms).otherwise(F.array().cast("array<string>"))).drop("_named")


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, parent_id, chunk_type, embedding: VECTORS vectors for a document, whose id is that of the first."""
    number = F.col("vec_id") % VECTORS
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") - number).alias("parent_id"), F.when(number == 0, "summary").otherwise("body").alias("chunk_type"), "embedding")


def multi_recalled(spark: SparkSession, sf_dir: str, asked: DataFrame, k: int = RECALL) -> DataFrame:
    """query_id, doc_id, score, chunk_type, pos: late fusion over a query's own vector and, where it names two entities, that of its variant. The document that the query was taken from is left out."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), "embedding")
    own = asked.select("query_id", F.col("query_id").alias("vec_id"), F.lit(0).alias("number"))
    variant = asked.filter(F.size("entities") >= 2).select("query_id", (F.col("query_id") + 1).alias("vec_id"), F.lit(1).alias("number"))
    found = M.nearest_parents(own.unionByName(variant).join(e, "vec_id"), document_vectors(spark, sf_dir), k)
    found = found.filter(F.col("parent_id") != F.col("query_id") - F.col("query_id") % VECTORS)
    return K.ranked(found, F.desc("score"), F.asc("parent_id"), name="pos").select("query_id", F.col("parent_id").alias("doc_id"), "score", "chunk_type", "pos")


#: What requests of routed retrieval look for: the same sources, and a topic with a collection of its own.
ROUTED = R.Vocabulary(entities=ENTITIES, timeline=("latest",), sources=VOCABULARY.sources, topics=("tion",))


def v1_routed(spark: SparkSession, sf_dir: str, *, limit: int = TOP) -> DataFrame:
    """Route and collection of each request, recall within its collection (topical requests search documents of one category, others all), the source that is asked for where recall has any of it, hybrid ranking, severe low quality out where enough remains, stale items out for timelines, the source first, limit."""
    n, e = news(spark, sf_dir), table(spark, sf_dir, "embeddings")
    wish = F.array(F.lit(" in 2020-07"), F.lit(" from the first wire"), F.lit(" the latest"), F.lit(""))[(F.floor(F.col("query_id") / 50) % 4).cast("int")]
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding").join(n.select(F.col("doc_id").alias("query_id"), F.col("title").alias("query")), "query_id")
    ask = F.concat("query", wish)
    asked = runtime.written(asked.withColumns({"route": R.route(ask, ROUTED)["route"], "collection": R.collection(ask, ROUTED), "wanted": F.get(R.sources_in(ask, ROUTED)["aliases"], F.lit(0))}), "requests")
    topical = e.join(n.filter("category = 'en'").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    of = lambda name: asked.filter(F.col("collection") == name).select("query_id", "embedding")
    found = V.exact_knn(of("topic"), topical, RECALL).unionByName(V.exact_knn(of("default"), e, RECALL)).select("query_id", F.col("vec_id").alias("doc_id"), "score", F.col("rank").alias("pos"))
    df = found.join(n, "doc_id").join(asked.drop("embedding"), "query_id").withColumn("text", F.col("content"))
    hit = F.coalesce(F.col("source") == F.col("wanted"), F.lit(False))
    df = df.withColumn("_some", F.bool_or(hit).over(Window.partitionBy("query_id"))).filter(hit | ~F.col("_some")).drop("_some")
    df = K.by_strategy(scored(df), "hybrid")
    df = K.guarded(df.withColumn("pos", F.col("rank")), F.col("quality_score") > 0.35, 5)
    df = df.filter((F.col("route") != "timeline") | (F.col("recency_score") >= 0.45)).drop("rank")
    return K.preferred_first(df, F.coalesce(F.col("source") == F.col("wanted"), F.lit(False))).filter(F.col("rank") <= limit)


def v2(spark: SparkSession, sf_dir: str, *, limit: int = TOP) -> DataFrame:
    """Intent; then by its plan: dense recall with several vectors (of the source that is asked for, where it has any) and keywords in titles and texts as channels, merged first-wins; severe low quality and stale items out, the date asked for where enough remains, additive rules with date, source and analysis points, source diversity, the source first, limit."""
    asked, n = runtime.written(requests(spark, sf_dir), "requests"), news(spark, sf_dir)
    light = n.select("doc_id", "source")  # whole texts join once the candidates are known
    dense = runtime.written(multi_recalled(spark, sf_dir, asked).join(light, "doc_id").join(asked.select("query_id", "wanted_source"), "query_id"), "dense")
    hit = F.coalesce(F.col("source") == F.col("wanted_source"), F.lit(False))
    dense = dense.withColumn("_some", F.bool_or(hit).over(Window.partitionBy("query_id"))).filter(hit | ~F.col("_some")).select("query_id", "doc_id", "score", "chunk_type", "pos")
    terms, vocabulary = asked.select("query_id", "terms", F.col("wanted_source").alias("source")), (*ENTITIES, *VOCABULARY.sources)

    def keyword(field: str) -> DataFrame:
        return K.keyword_channel(terms, n, field, vocabulary).select("query_id", "doc_id", F.lit(0.0).alias("score"), F.lit("summary").alias("chunk_type"), "pos")

    df = K.merged([("dense", dense), ("title_keyword", keyword("title")), ("chunk_keyword", keyword("content"))]).withColumn("pos", F.col("merged_pos"))
    df = df.join(n, "doc_id").join(asked, "query_id").withColumn("text", F.col("content"))
    df = K.guarded(scored(df), F.col("quality_score") > 0.35, limit).drop("fallback")
    wants_new = F.array_contains("plan", "recent")
    close = F.when(wants_new & (F.col("recency_score") < 0.45), X.longest_common(F.col("title"), F.col("query")) >= 6).otherwise(True)  # compared where it decides
    df = df.filter(close).withColumn("_hay", F.concat_ws(" ", F.date_format(F.timestamp_seconds("publish_ts"), "yyyy-MM-dd"), "title"))
    df = K.guarded(df, D.meets(F.col("date"), F.col("_hay")), 5).drop("fallback")
    analysis = S.analysis_section(F.col("ask"), F.col("title"), F.col("category"), explain=VOCABULARY.explain, sections=ANALYSES, in_title=ANALYSIS_WORDS)
    return limited(df.withColumns({"date_score": D.match_score(F.col("date"), F.col("_hay")), "source_score": D.source_score(F.col("aliases"), F.col("source"), F.col("title")), "analysis_score": analysis}), limit)


def limited(df: DataFrame, limit: int) -> DataFrame:
    """Additive rules, diversity, and the source that is asked for first."""
    given = lambda name, value: F.col(name) if name in df.columns else value
    ready = df.withColumns({
        "entities": given("entities", X.vocabulary_hits(F.col("query"), ENTITIES)), "chunk": F.col("text"), "common": given("common", X.longest_common(F.col("title"), F.col("query"))), "date_score": given("date_score", F.lit(0.0)),
        "source_score": given("source_score", F.when(F.col("source") == "src1", 3.0).otherwise(0.0)), "analysis_score": given("analysis_score", F.lit(0.0)), "chunk_type": given("chunk_type", F.lit("summary")),
    })
    ranked = K.diversified(K.light_rules(ready))
    if "wanted_source" in df.columns:
        ranked = K.preferred_first(ranked.drop("rank").withColumn("pos", F.col("final_rank")), F.coalesce(F.col("source") == F.col("wanted_source"), F.lit(False))).withColumn("final_rank", F.col("rank"))
    return ranked.filter(F.col("final_rank") <= limit)
