"""Dates in texts, and what depends on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A year of four digits, a month and a day that a calendar has, with one sign between them or the signs for year and month; no digit stands right before or after.
YMD = r"(?<![0-9])([0-9]{4})(?:年| ?[./-] ?)(1[0-2]|0?[1-9])(?:月| ?[./-] ?)(3[01]|[12][0-9]|0?[1-9])(?![0-9])"
#: The steps of the recency score, oldest age in days and score.
RECENCY = ((7, 1.0), (30, 0.95), (90, 0.80), (180, 0.60), (365, 0.45), (365 * 3, 0.20), (365 * 10, 0.05))


def day_in(c: Column) -> Column:
    """The first year-month-day of a text as a date; null if there is none or it does not exist."""
    part = lambda i, n: F.lpad(F.regexp_extract(F.coalesce(c, F.lit("")), YMD, i), n, "0")
    return F.when(F.coalesce(c, F.lit("")).rlike(YMD), F.try_to_date(F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2)), "yyyy-MM-dd"))


def publish_ts(ts: Column, *texts: Column) -> Column:
    """An explicit time in seconds, else the first date found in the texts, else 0."""
    given = F.expr("1").cast("long") * 0 if ts is None else F.nullif(ts.try_cast("long"), F.lit(0).cast("long"))
    return F.coalesce(given, *(F.unix_timestamp(day_in(t)) for t in texts), F.lit(0).cast("long"))


def recency(ts: Column, now: Column) -> Column:
    """A step function of age; 0 without a time."""
    age = F.greatest(F.lit(0.0), (now - ts) / 86400.0)
    out = F.lit(0.0)
    for days, score in reversed(RECENCY):
        out = F.when(age <= days, F.lit(score)).otherwise(out)
    return F.when((ts == 0) | ts.isNull(), F.lit(0.0)).otherwise(out)


def parsed(c: Column, as_of: str, earliest: int = 1949) -> Column:
    """A struct of day and status (missing, unparseable, too_old, future, valid) from several layouts; a bare year counts as its first day."""
    flat = F.trim(F.coalesce(c, F.lit("")))
    day = F.coalesce(F.try_to_date(F.substring(flat, 1, 10), "yyyy-MM-dd"), F.try_to_date(F.substring(flat, 1, 10), "yyyy/MM/dd"), F.try_to_date(F.substring(flat, 1, 8), "yyyyMMdd"), day_in(flat), F.when(flat.rlike(r"^\d{4}$"), F.try_to_date(F.concat(flat, F.lit("-01-01")), "yyyy-MM-dd")))
    status = F.when(flat == "", "missing").when(day.isNull(), "unparseable").when(F.year(day) < earliest, "too_old").when(day > F.lit(as_of).cast("date"), "future").otherwise("valid")
    return F.struct(day.alias("day"), status.alias("status"))


def third_of_month(c: Column) -> Column:
    """The interval that a year, a month and early, middle or late (or none: all of it) name, as a struct of first and last day."""
    year, month = F.regexp_extract(c, r"(\d{4})\D", 1), F.regexp_extract(c, r"\d{4}\D(\d{1,2})", 1)
    first = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lit("01")), "yyyy-MM-dd")
    early, middle, late = (c.rlike(x) for x in ("(?i)early|上旬", "(?i)mid|中旬", "(?i)late|下旬"))
    return F.struct(F.when(middle, F.date_add(first, 10)).when(late, F.date_add(first, 20)).otherwise(first).alias("first"), F.when(early, F.date_add(first, 9)).when(middle, F.date_add(first, 19)).otherwise(F.last_day(first)).alias("last"))


def constraint(c: Column, recent=("recent", "latest", "最近", "近期")) -> Column:
    """The date that a query asks for: day before month before year before since a month before soft recency."""
    value = F.coalesce(c, F.lit(""))
    number = lambda p, i: F.nullif(F.regexp_extract(value, p, i), F.lit("")).cast("int")
    year, month, day, since = number(r"(\d{4})\s*(?:年|-|/)?", 1), number(r"(?:年|\d{4}[-/])\s*(\d{1,2})", 1), number(r"\d{4}[-/年]\d{1,2}[-/月](\d{1,2})", 1), number(r"(?i)since\s+(\d{1,2})|(\d{1,2})月以来", 1)
    soft = F.exists(F.array(*(F.lit(x) for x in recent)), lambda t: F.contains(F.lower(value), t))
    kind = F.when(day.isNotNull(), "day").when(month.isNotNull(), "month").when(year.isNotNull(), "year").when(since.isNotNull(), "since").when(soft, "recent").otherwise("none")
    return F.struct(kind.alias("kind"), year.alias("year"), month.alias("month"), day.alias("day"), since.alias("since"))


#: Points for a year, a month, a day and a month since which, and for a named source.
POINTS = {"year": 2.0, "month": 3.0, "day": 2.0, "since": 2.0}
SOURCE_POINTS = 3.0


def names_month(hay: Column, month: Column) -> Column:
    """Whether a text names a month, as a number before the sign for month or behind a year of four digits."""
    return F.regexp_like(hay, F.concat(F.lit("(?<![0-9])0?"), month.cast("string"), F.lit("月|[0-9]{4}[./-]0?"), month.cast("string"), F.lit("(?![0-9])")))


def names_day(hay: Column, day: Column) -> Column:
    return F.regexp_like(hay, F.concat(F.lit("(?<![0-9])0?"), day.cast("string"), F.lit("日|[0-9]{4}[./-][0-9]{1,2}[./-]0?"), day.cast("string"), F.lit("(?![0-9])")))


def match_score(date: Column, hay: Column) -> Column:
    """Points of a text (publication time and title) for each part of a constraint that it has; 0 without a constraint."""
    hit = lambda part, found: F.when(date[part].isNotNull() & found, POINTS[part]).otherwise(0.0)
    return hit("year", F.contains(hay, date["year"].cast("string"))) + hit("month", names_month(hay, date["month"])) + hit("day", names_day(hay, date["day"])) + hit("since", names_month(hay, date["since"]))


def meets(date: Column, hay: Column) -> Column:
    """Whether a text has a constraint's year and month, or the month since which; true without one."""
    year = F.contains(hay, date["year"].cast("string")) & (date["month"].isNull() | names_month(hay, date["month"]))
    return F.coalesce(F.when(date["year"].isNotNull(), year), F.when(date["since"].isNotNull(), names_month(hay, date["since"])), F.lit(True))


def source_score(aliases: Column, source: Column, title: Column) -> Column:
    """Points where the source or the title has one of a named source's aliases."""
    return F.when(F.exists(aliases, lambda a: F.contains(F.lower(F.concat_ws(" ", source, title)), a)), SOURCE_POINTS).otherwise(0.0)
