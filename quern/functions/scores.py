"""Scores of candidates: expressions, and windows over the candidates of one query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from . import text as X


def min_max(value: Column, *keys: str) -> Column:
    """Scaled to 0..1 over the candidates of a query; where all are equal, 1 if they are positive and 0 if not."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(low == high, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((value - low) / (high - low))


#: What a flaw of a title or summary costs; click-bait costs as much for each word, up to three.
PENALTIES = {"no title": 0.55, "short summary": 0.20, "artefact": 0.85, "click-bait": 0.25, "generic title": 0.70, "legacy source off topic": 0.75, "undated bulletin": 0.20}


def quality(title: Column, summary: Column, source: Column | None = None, *, artefacts: Sequence[str] = (), clickbait: Sequence[str] = (), generic: Sequence[str] = (), legacy: str = "old", topics: Sequence[str] = (), bulletin: Sequence[str] = (), dated: Column | None = None) -> Column:
    """1 less PENALTIES, held to .05 .. 1."""
    t, s = X.text(title), X.text(summary)
    joined = F.lower(F.concat_ws(" ", t, F.substring(s, 1, 160)))
    has = lambda terms, c: F.exists(X.words_of([x.lower() for x in terms]), lambda x: F.contains(c, x))
    flaws = {
        "no title": X.strip(t) == "",
        "short summary": F.length(X.strip(s)) < 12,
        "artefact": has(artefacts, joined),
        "click-bait": F.least(F.lit(3), F.size(F.filter(X.words_of(clickbait), lambda x: F.contains(t, x)))),
        "generic title": F.array_contains(X.words_of(generic), X.strip(t)),
    }
    if source is not None:
        flaws["legacy source off topic"] = (F.lower(X.text(source)) == legacy) & ~has(topics, joined)
    if dated is not None:
        flaws["undated bulletin"] = has(bulletin, F.lower(t)) & ~dated
    cost = sum((PENALTIES[k] * F.coalesce(c.cast("int"), F.lit(0)) for k, c in flaws.items()), F.lit(0.0))
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), 1.0 - cost))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null if either vector is null or zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def parent_decay(ts: Column, now: Column) -> Column:
    """A chunk's weight by age: 1 - days / 3650, .85 at least; without a time as for 3650 days."""
    days = F.when(ts.isNull() | (ts <= 0), F.lit(3650.0)).otherwise(F.greatest(F.lit(0.0), (now - ts) / 86400.0))
    return F.greatest(F.lit(0.85), 1.0 - days / 3650.0)


def title_match(query: Column, title: Column, common: Column) -> Column:
    """10 for a title within the query, else .8 or .4 of the common substring's length from 8 or 5 characters on."""
    return F.when((X.text(title) != "") & F.contains(query, title), 10.0).when(common >= 8, common * 0.8).when(common >= 5, common * 0.4).otherwise(0.0)


def length_penalty(n: Column) -> Column:
    return F.when(n < 30, -3.0).when(n < 60, -1.0).otherwise(0.0)


#: Fixed value: what an analysis counts for, where a request wants an explanation.
ANALYSIS_POINTS = 1.2


def analysis_section(query: Column, title: Column, section: Column, *, explain: Sequence[str], sections: Sequence[str], in_title: Sequence[str] = ()) -> Column:
    """ANALYSIS_POINTS where the query asks for an explanation and the item stands in a section of analyses, or its title says so; else 0."""
    any_ = lambda terms, c: F.exists(X.words_of(list(terms)), lambda t: F.contains(c, t))
    asked = any_(explain, F.lower(X.text(query)))
    return F.when(asked & (any_(sections, X.text(section)) | any_(in_title, X.text(title))), ANALYSIS_POINTS).otherwise(0.0)
