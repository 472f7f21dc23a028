"""Classifiers of queries and results: intents, routes, structured intents, next actions, tri-state checks. Vocabularies are parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X


@dataclass(frozen=True)
class Vocabulary:
    """What the classifiers look for; lower-case."""

    web: Sequence[str] = ("search the web", "look up online")
    news: Sequence[str] = ("news", "report", "happened")
    recommend: Sequence[str] = ("recommend", "suggest")
    boundary: Sequence[str] = ("guarantee", "will it rise")
    timeline: Sequence[str] = ("timeline", "latest", "recent")
    detail: Sequence[str] = ("detail", "full text", "what does it say")
    lists: Sequence[str] = ("list", "which ones")
    topics: Sequence[str] = ("economy", "market", "bank")
    explain: Sequence[str] = ("why", "how", "explain")
    entities: Sequence[str] = ()
    sources: Mapping[str, Sequence[str]] = field(default_factory=dict)


def has(c: Column, terms: Sequence[str]) -> Column:
    low = F.lower(X.text(c))
    return F.exists(X.words_of(list(terms)), lambda t: F.contains(low, t)) if terms else F.lit(False)


def intent(c: Column, v: Vocabulary = Vocabulary()) -> Column:
    """First that holds: a URL or a web word, a recommendation, a news or boundary word; else chat."""
    return F.when(X.text(c).rlike(r"https?://\S+") | has(c, v.web), "web_research").when(has(c, v.recommend), "recommendation").when(has(c, v.news) | has(c, v.boundary), "news_qa").otherwise("general_chat")


def fallback_plan(c: Column, v: Vocabulary = Vocabulary()) -> Column:
    """The tool that an intent falls back to, with its argument."""
    number = F.regexp_extract(X.text(c), r"(?i)(?:news|id|#)\s*(\d+)", 1)
    url = F.regexp_extract(X.text(c), r"(https?://[^\s]+)", 1)
    tool = F.when(number != "", "news_detail").when(url != "", "web_fetch").when(has(c, v.recommend), "recommend_news").otherwise("news_search")
    return F.struct(tool.alias("tool"), F.when(number != "", number).when(url != "", url).otherwise(X.collapse(c)).alias("argument"))


def sources_in(c: Column, v: Vocabulary) -> Column:
    """Named sources, and the aliases to filter by: none if more than one is named."""
    named = F.array_compact(F.array(*(F.when(has(c, [s.lower(), *(a.lower() for a in al)]), F.lit(s)) for s, al in v.sources.items()))) if v.sources else F.array().cast("array<string>")
    aliases = F.array().cast("array<string>")
    for s, al in v.sources.items():
        aliases = F.when((F.size(named) == 1) & F.array_contains(named, s), X.words_of([s, *al])).otherwise(aliases)
    return F.struct(named.alias("named"), aliases.alias("aliases"))


def route(c: Column, v: Vocabulary = Vocabulary(), slots: int = 0) -> Column:
    """source before timeline before detail before title, with the number of body slots (one at least for details)."""
    src = sources_in(c, v)["named"]
    kind = F.when(F.size(src) > 0, "source").when(has(c, v.timeline), "timeline").when(has(c, v.detail), "detail").otherwise("title")
    return F.struct(kind.alias("route"), F.when(kind == "detail", max(slots, 1)).otherwise(slots).alias("body_slots"), has(c, v.timeline).alias("recent"))


def structured(c: Column, v: Vocabulary = Vocabulary(), most: int = 15) -> Column:
    """Entities, sources, date, type and the channels to search."""
    entities = F.slice(F.filter(X.words_of(list(v.entities)), lambda e: F.contains(F.lower(X.text(c)), e)), 1, most)
    src, date = sources_in(c, v), D.constraint(c)
    kind = F.when(F.size(src["named"]) > 0, "source_constrained").when(date["kind"].isin("day", "month", "year"), "dated").when(has(c, v.lists), "list").when(has(c, v.explain), "explain").when(F.size(entities) > 0, "entity").otherwise("semantic")
    keyword = (F.size(entities) > 0) | (F.size(src["named"]) > 0)
    plan = F.array_compact(F.array(F.lit("dense"), F.when(keyword, F.lit("title_keyword")), F.when(keyword, F.lit("chunk_keyword")), F.when(date["kind"] == "recent", F.lit("recent"))))
    return F.struct(entities.alias("entities"), src.alias("source"), date.alias("date"), kind.alias("query_type"), plan.alias("plan"))


def collection(c: Column, v: Vocabulary = Vocabulary(), topical: str = "topic", default: str = "default") -> Column:
    """The corpus to search: that of the topic, unless a source is named."""
    return F.when((F.size(sources_in(c, v)["named"]) == 0) & has(c, v.topics), topical).otherwise(default)


def answer_constraints(c: Column) -> Column:
    """Limits that a request sets: characters, points, time scope, wants a list, wants sources."""
    number = lambda p: F.nullif(F.regexp_extract(F.lower(X.text(c)), p, 1), F.lit("")).cast("int")
    scope = F.when(has(c, ["today"]), "day").when(has(c, ["this week"]), "week").when(has(c, ["this month", "recent"]), "month").when(has(c, ["this year"]), "year")
    return F.struct(number(r"(\d+)\s*(?:characters|chars|words)").alias("max_chars"), number(r"(\d+)\s*(?:points|items|bullets)").alias("max_points"), scope.alias("time_scope"), has(c, ["list", "bullets"]).alias("as_list"), has(c, ["source", "cite"]).alias("wants_sources"))


def next_action(anchor: Column, n_results: Column, allowed: Column) -> Column:
    """confirm, ask or search an anchor before answering; answer only with results."""
    can = lambda t: F.array_contains(allowed, t)
    return F.when(anchor == "needs_confirmation", "ask_confirmation").when(anchor == "ambiguous", "ask_clarification").when((n_results == 0) & can("news_search"), "search").when((n_results == 0) & can("web_search"), "search_web").when(n_results == 0, "refuse").otherwise("answer")


def check(applies: Column, holds: Column) -> Column:
    """1, 0, or null where the check does not apply."""
    return F.when(applies, holds.cast("double"))


def policy_allows(policy: Column, tier: Column, verified: Column) -> Column:
    """strict: high credibility and verified; balanced: not low, or verified; else all."""
    return F.when(policy == "strict", (tier == "high") & verified).when(policy == "balanced", (tier != "low") | verified).otherwise(True)


def triage(known: DataFrame, candidates: DataFrame, key: str, refused: Sequence[str], kind: str) -> DataFrame:
    """merge_with_existing where the key is known, accept_as_gold where the class needs no evidence or some is given, else needs_evidence_lookup."""
    flagged = candidates.join(known.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    return flagged.withColumn("decision", F.when(F.col("_known"), "merge_with_existing").when(F.col(kind).isin(*refused) | (F.size("evidence") > 0), "accept_as_gold").otherwise("needs_evidence_lookup")).drop("_known")


def capture_status(confidence: Column, signal: Column, least_confidence: float = 0.35, least_signal: int = 8) -> Column:
    """staged, or why a capture is rejected."""
    return F.when(confidence < least_confidence, "rejected_low_confidence").when(signal < least_signal, "rejected_low_signal").otherwise("staged")
