"""Conversation state: ordered folds over the turns of a session, and merges of keyed state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def ordered(messages: DataFrame) -> DataFrame:
    """One row per session with its messages in order, as an array of turn, role, text."""
    return messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def recent(messages: DataFrame, turns: int = 6) -> DataFrame:
    """The last 2 * turns messages of each session, in order."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 2 * turns).drop("_n")


def compression(messages: DataFrame, *, most: int = 12, chars: int = 6000) -> DataFrame:
    """Per session: messages, characters, and whether it is to be compressed."""
    g = messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.sum(F.length("text").cast("long")).alias("n_chars"))
    return g.withColumn("compress", (F.col("n_messages") > most) | (F.col("n_chars") > chars))


def constraints(messages: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The last value that a user turn gives to each constraint."""
    users = messages.filter("role = 'user'")
    return users.groupBy("conv_id").agg(*(F.max_by(c, F.when(c.isNotNull(), F.col("turn"))).alias(k) for k, c in rules.items()))


def evidence(messages: DataFrame, refs: Column, keep: int = 8) -> DataFrame:
    """Distinct references in the order in which they are first seen, the last `keep` of them."""
    long = messages.select("conv_id", "turn", F.posexplode(refs).alias("_p", "ref"))
    first = long.groupBy("conv_id", "ref").agg(F.min(F.struct("turn", "_p")).alias("_at"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("_at"))
    last = first.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep)
    return last.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "ref"))), lambda x: x["ref"]).alias("refs"))


def ledger(messages: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Topics of user turns with first and last turn and a number by first appearance."""
    hits = messages.filter("role = 'user'").select("conv_id", "turn", F.explode(X.vocabulary_hits(F.lower("text"), topics)).alias("topic"))
    g = hits.groupBy("conv_id", "topic").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"))
    return g.withColumn("entry", F.concat(F.lit("topic:"), F.row_number().over(Window.partitionBy("conv_id").orderBy("first_turn", "topic")).cast("string")))


def merged_ledgers(old: DataFrame, new: DataFrame, keep: int = 80) -> DataFrame:
    """Two ledgers as one: smallest first turn, largest last turn, summed counts; the `keep` entries seen last."""
    cols = ["conv_id", "topic", "first_turn", "last_turn", "n"]
    g = old.select(*cols).unionByName(new.select(*cols)).groupBy("conv_id", "topic").agg(F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"), F.sum("n").alias("n"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("last_turn"), "topic")
    return g.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")


def summaries(messages: DataFrame, topics: Sequence[str], clip: int = 160) -> DataFrame:
    """Per session: last user text, topics in the vocabulary's order, an open question if the last user turn looks like one, the title from the first user turn."""
    u = messages.filter("role = 'user'")
    g = u.groupBy("conv_id").agg(F.max_by("text", "turn").alias("_last"), F.min_by("text", "turn").alias("_first"), *(F.max(F.contains(F.lower("text"), F.lit(t))).alias(f"_t{i}") for i, t in enumerate(topics)))
    found = F.array_compact(F.array(*(F.when(F.col(f"_t{i}"), F.lit(t)) for i, t in enumerate(topics))))
    return g.select("conv_id", X.clip(F.col("_last"), clip).alias("goal"), F.array_join(found, ",").alias("topics"), F.col("_last").rlike(r"[?？]\s*$").alias("open_question"), F.substring("_first", 1, 30).alias("title"))


def memory(messages: DataFrame, *, each: int = 160, total: int = 1800) -> DataFrame:
    """Bounded memory: clipped messages in order, as many of the last as fit."""
    flat = messages.withColumn("_line", F.concat(F.col("role"), F.lit(": "), X.clip(F.col("text"), each)))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    kept = flat.withColumn("_sum", F.sum(F.length("_line") + 1).over(w)).filter(F.col("_sum") <= total)
    return kept.groupBy("conv_id").agg(F.count("*").alias("n_kept"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "_line"))), lambda x: x["_line"]), "\n").alias("memory"))


def hints(messages: DataFrame, topics: Sequence[str]) -> DataFrame:
    """conv_id, turn, hints: for each user turn the topics of the user turns before it, in order of their names."""
    seen = F.filter(X.words_of(topics), lambda t: F.contains(F.lower("text"), t))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    told = messages.filter("role = 'user'").withColumn("_t", F.flatten(F.collect_list(seen).over(before)))
    return told.select("conv_id", "turn", F.array_sort(F.array_distinct("_t")).alias("hints"))


def follow_ups(messages: DataFrame, markers: Sequence[str], pronouns: str, hints: DataFrame, least: int = 6) -> DataFrame:
    """User turns that look like follow-ups, without pronouns where enough remains, with up to six hints of the turns before them. hints: conv_id, turn, hints (array)."""
    u = messages.filter("role = 'user'").filter(F.exists(X.words_of(markers), lambda m: F.contains(F.lower("text"), m)))
    bare = F.regexp_replace("text", pronouns, " ")
    query = F.when(X.signal_chars(bare) >= least, X.collapse(bare)).otherwise(X.collapse(F.col("text")))
    return u.join(hints, ["conv_id", "turn"], "left").select("conv_id", "turn", F.concat_ws(" ", F.slice(F.coalesce("hints", F.array().cast("array<string>")), 1, 6), query).alias("query"))


def selections(messages: DataFrame) -> DataFrame:
    """User turns that pick an ordinal from the numbered list in the turn before: the line picked."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    df = messages.withColumn("_before", F.lag("text").over(w)).withColumn("_by", F.lag("role").over(w))
    n = F.nullif(F.regexp_extract("text", r"(?i)(?:^|\b)(?:option|number|no\.?|#)?\s*(\d{1,2})\b", 1), F.lit("")).cast("int")
    items = F.regexp_extract_all("_before", F.lit(r"(?m)^\s*\d{1,2}[.)]\s*(.+)$"), F.lit(1))
    return df.filter("role = 'user' AND _by = 'assistant'").withColumns({"_n": n, "_items": items}).filter((F.size("_items") > 0) & (F.col("_n") >= 1)).select("conv_id", "turn", F.get("_items", F.col("_n") - 1).alias("picked"))


def turns(session: DataFrame) -> DataFrame:
    """turn numbers of questions and answers: message index over two, plus one."""
    return session.withColumn("exchange", F.floor(F.col("turn") / 2).cast("long") + 1)


def scripted(cases: DataFrame, overrides: DataFrame) -> DataFrame:
    """A case of n turns from a template, with explicit turns in place. cases: case_id, template, n; overrides: case_id, turn, text."""
    t = cases.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("n")))).join(overrides, ["case_id", "turn"], "left")
    return t.select("case_id", "turn", F.coalesce("text", F.replace("template", F.lit("{n}"), F.col("turn").cast("string"))).alias("text"))
