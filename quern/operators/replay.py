"""Replay of conversations in which a turn's result feeds the next: all conversations' turn n at once, then turn n + 1.

A round joins every conversation's n-th question with its state, retrieves for all of them in one job,
and folds the results into the next state, which is a written table. There are as many rounds as the
longest conversation has questions, whatever the number of conversations.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import runtime
from ..functions import text as X

#: Evidence ids and terms that a conversation carries on; results of a turn.
CARRIED, TERMS, RESULTS = 8, 6, 3


def asked_turns(messages: DataFrame) -> DataFrame:
    """conv_id, turn, question, n: the user turns with text, numbered from 1 in each conversation."""
    users = messages.filter("role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL")
    one = users.groupBy("conv_id", "turn").agg(F.min(X.text(F.col("text"))).alias("question"))  # rows that repeat a turn are one
    return one.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))


def last_distinct(ids, keep: int):
    """The last `keep` of an array's distinct values, in the order in which they were first seen."""
    d = F.array_distinct(ids)
    return F.slice(d, F.greatest(F.size(d) - keep + 1, F.lit(1)), keep)


def replayed(messages: DataFrame, terms_of: Callable, retrieve: Callable[[DataFrame], DataFrame], *, carried: int = CARRIED, terms: int = TERMS) -> DataFrame:
    """conv_id, turn, n, terms, results, evidence: what each user turn asked for, what it got, and the evidence carried on after it.

    terms_of(question column) gives an array of terms. A turn without any asks for those that its conversation asked for last, so that a follow-up stays on its subject. retrieve(asked) takes conv_id, terms, evidence (what is carried so far) and gives conv_id, results (an array of ids, first first). evidence keeps the last `carried` distinct ids. Conversations without user turns have no rows; rows that repeat a turn are one turn, with the smallest text; an empty table gives none."""
    spark = runtime.prepare(messages.sparkSession)
    turns = runtime.written(asked_turns(messages).withColumn("_own", terms_of(F.col("question"))).drop("question"), "turns")
    longest = turns.agg(F.max("n")).first()[0] or 0
    kind = turns.schema["conv_id"].dataType.simpleString()
    state = spark.createDataFrame([], f"conv_id {kind}, _terms array<string>, _evidence array<long>")
    schema, path = f"conv_id {kind}, turn {turns.schema['turn'].dataType.simpleString()}, n int, terms array<string>, results array<long>, evidence array<long>", runtime.new_path(spark, "rounds")
    nothing = F.array().cast("array<string>")
    for n in range(1, longest + 1):
        now = turns.filter(F.col("n") == n).join(state, "conv_id", "left")
        own = F.coalesce("_own", nothing)
        now = now.select("conv_id", "turn", "n", F.slice(F.when(F.size(own) > 0, own).otherwise(F.coalesce("_terms", nothing)), 1, terms).alias("terms"), F.coalesce("_evidence", F.array().cast("array<long>")).alias("_before"))
        now = runtime.written(now, "asked")
        got = retrieve(now.select("conv_id", "terms", F.col("_before").alias("evidence")))
        none = F.array().cast("array<long>")
        done = now.join(got, "conv_id", "left").withColumn("results", F.coalesce("results", none))
        done.select("conv_id", "turn", "n", "terms", "results", last_distinct(F.concat("_before", "results"), carried).alias("evidence")).write.mode("overwrite").parquet(f"{path}/_round={n}")
        done = spark.read.schema(schema).parquet(f"{path}/_round={n}")
        state = done.select("conv_id", F.col("terms").alias("_terms"), F.col("evidence").alias("_evidence"))  # a conversation that is over is not asked again
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/_round=*").drop("_round") if longest else spark.createDataFrame([], schema)


def newest_unseen(docs: DataFrame, text: str, vocabulary: Sequence[str], *, results: int = RESULTS, carried: int = CARRIED) -> Callable[[DataFrame], DataFrame]:
    """A retrieve() for replayed(): the first `results` documents that hold a term and are not carried already, by the place of their first term and then the newest. docs: doc_id, publish_ts and a text.

    Of each term the newest results + carried documents are enough, as no more can be carried; they are found once for all rounds."""
    hits = docs.select("doc_id", "publish_ts", F.explode(X.vocabulary_hits(F.lower(F.col(text)), vocabulary)).alias("term"))
    newest = Window.partitionBy("term").orderBy(F.desc("publish_ts"), "doc_id")
    top = runtime.written(hits.withColumn("_p", F.row_number().over(newest)).filter(F.col("_p") <= results + carried).select("term", "doc_id", "_p"), "newest")

    def retrieve(asked: DataFrame) -> DataFrame:
        wanted = asked.select("conv_id", "evidence", F.posexplode("terms").alias("_t", "term"))
        found = wanted.join(top, "term").filter(~F.array_contains("evidence", F.col("doc_id")))
        one = found.groupBy("conv_id", "doc_id").agg(F.min(F.struct("_t", "_p")).alias("_at"))
        first = one.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy("_at", "doc_id"))).filter(F.col("_n") <= results)
        return first.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "doc_id"))), lambda x: x["doc_id"]).alias("results"))

    return retrieve
