"""Text functions: columns in, a column out; no Python on the executors."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Signs after which a sentence ends. A full stop is none, as numbers and addresses hold it.
SENTENCE_ENDS = "。！？!?；;"
SENTENCE = "(?<=[" + SENTENCE_ENDS + "])"
CJK = r"[\x{4e00}-\x{9fff}]"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words_of(terms: Sequence[str]) -> Column:
    return F.array(*(F.lit(t) for t in terms)) if terms else F.array().cast("array<string>")


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Every run of white space as one space, none at the ends. Single spaces, which are most, are not replaced."""
    return F.trim(F.regexp_replace(text(c), r"(?U) \s+|[^\S ]\s*", " "))


def clip(c: Column, limit: int, tail: str = "...") -> Column:
    """White space made single, cut at limit characters with a tail in place of the rest."""
    flat = collapse(c)
    cut = F.regexp_replace(F.substring(flat, 1, limit), r"(?U)\s+$", "")
    return F.when(F.length(flat) > limit, F.concat(cut, F.lit(tail))).otherwise(flat)


def rank_tokens(c: Column) -> Column:
    """Distinct lower-case ASCII words and numbers, then distinct single CJK characters."""
    low = F.lower(text(c))
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), F.regexp_extract_all(low, F.lit(CJK), F.lit(0))))


def lexical(query: Column, doc: Column) -> Column:
    """Share of the query's tokens that the document has; 0 without tokens."""
    return F.when((F.size(query) == 0) | (F.size(doc) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(query, doc)) / F.size(query))


def contained(terms: Column, c: Column) -> Column:
    """Share of the terms that the text contains."""
    return F.when((F.size(terms) == 0) | (F.length(text(c)) == 0), F.lit(0.0)).otherwise(F.size(F.filter(terms, lambda t: F.contains(c, t))) / F.size(terms))


def grams(run: Column, n: int) -> Column:
    return F.when(F.length(run) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - n + 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(n))))


def keywords(c: Column, stop: Sequence[str] = (), most: int = 12) -> Column:
    """Search terms: ASCII words of two letters or more, lower-cased; runs of other scripts cut at stop words, whole up to three characters, else as pairs of characters. Distinct, in order, at most `most`."""
    tokens = F.filter(F.split(F.regexp_replace(text(c), r"(?U)[^\w]+", " "), " "), lambda t: (t != "") & ~F.array_contains(words_of(stop), t))

    def of(t: Column) -> Column:
        ascii_ = ~t.rlike(r"[^\x00-\x7f]")
        pieces = t
        for s in stop:
            pieces = F.replace(pieces, F.lit(s), F.lit(" "))
        runs = F.filter(F.split(pieces, " "), lambda p: F.length(p) >= 2)
        pairs = F.flatten(F.transform(runs, lambda p: F.when(F.length(p) <= 3, F.array(p)).otherwise(grams(p, 2))))
        return F.when(ascii_, F.when(F.length(t) >= 2, F.array(F.lower(t))).otherwise(F.array().cast("array<string>"))).otherwise(pairs)

    return F.slice(F.array_distinct(F.flatten(F.transform(tokens, of))), 1, most)


def verification_terms(c: Column, stop: Sequence[str] = (), chars: int = 200) -> Column:
    """Lower-case ASCII words of three letters or more but the stop words, and all runs of two to six of the first `chars` CJK characters."""
    ascii_ = F.filter(F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]{3,}"), F.lit(0)), lambda t: ~F.array_contains(words_of(stop), t))
    run = F.substring(F.regexp_replace(text(c), r"[^\x{4e00}-\x{9fff}]", ""), 1, chars)
    return F.array_distinct(F.concat(ascii_, *(grams(run, n) for n in range(2, 7))))


def vocabulary_hits(c: Column, vocabulary: Sequence[str]) -> Column:
    return F.filter(words_of(vocabulary), lambda t: F.contains(text(c), t))


def compact(c: Column) -> Column:
    """Without white space and punctuation."""
    return F.regexp_replace(text(c), r"(?U)[\s\p{P}]+", "")


@F.pandas_udf(T.IntegerType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y, autojunk=False).find_longest_match().size if x and y else 0 for x, y in zip(a, b, strict=True)], dtype="int32")


def longest_common(a: Column, b: Column) -> Column:
    """Length of the longest substring that two texts share after compact(). A fold over characters in column expressions was over a hundred times slower, so this one goes through Arrow."""
    return _common(compact(a), compact(b))


def n_windows(length: Column, size: int, overlap: int, most: int | None = None) -> Column:
    """How many windows a text of a length has."""
    n = F.when(length == 0, 0).otherwise(F.greatest(F.ceil((length - size) / (size - overlap)), F.lit(0)).cast("int") + 1)
    return F.least(n, F.lit(most)) if most else n


def windows(c: Column, size: int, overlap: int, most: int | None = None) -> Column:
    """Fixed windows of `size` characters that overlap; the last ends with the text."""
    step = size - overlap

    def cut(t: Column) -> Column:
        n = n_windows(F.length(t), size, overlap, most)
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(t, i * step + 1, F.lit(size))))

    return let(c, cut)


def paragraphs(c: Column, longest: int = 1000) -> Column:
    """Lines that are not blank, stripped, without carriage returns; longer ones cut after sentence ends."""
    lines = F.filter(F.transform(F.split(F.replace(text(c), F.lit("\r")), r"\n"), strip), lambda p: p != "")
    return F.flatten(F.transform(lines, lambda p: F.when(F.length(p) > longest, F.filter(F.transform(F.split(p, SENTENCE), strip), lambda x: x != "")).otherwise(F.array(p))))


def packed_chunks(c: Column, size: int = 600, overlap: int = 120, most: int = 8) -> Column:
    """Paragraphs packed greedily to about `size` characters; each chunk starts with the end of the one before it."""

    def step(s: Column, p: Column) -> Column:
        room = (s["buf"] == "") | (F.length(s["buf"]) + F.length(p) + 1 <= size)
        joined = F.when(s["buf"] == "", p).otherwise(F.concat(s["buf"], F.lit("\n"), p))
        tail = F.when(F.lit(overlap > 0), F.concat(F.substring(s["buf"], -overlap, overlap), F.lit("\n"), p)).otherwise(p)
        return F.struct(F.when(room, s["out"]).otherwise(F.concat(s["out"], F.array(s["buf"]))).alias("out"), F.when(room, joined).otherwise(tail).alias("buf"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))
    return F.aggregate(paragraphs(c), start, step, lambda s: F.slice(F.when(s["buf"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["buf"]))), 1, most))


def stable_id(key: Column) -> Column:
    """63 bits of a key's SHA-256, as a long."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit("9223372036854775808").cast("decimal(20,0)")).cast("long")


def garbled(c: Column, chars: int = 1000, *, least: int = 3, share: float = 0.02, judged: int = 40, letters: float = 0.3) -> Column:
    """By the first characters: a replacement character; `least` or more control or private-use characters that are more than a share of all; or, from `judged` characters on, no CJK and few Latin letters."""

    def told(head: Column) -> Column:
        n = F.length(head)
        count = lambda p: F.regexp_count(head, F.lit(p))
        odd = count(r"[\x00-\x08\x0e-\x1f\x7f-\x9f\x{e000}-\x{f8ff}]")
        return F.contains(head, F.lit("\ufffd")) | ((odd >= least) & (odd > share * n)) | ((n >= judged) & ~head.rlike(CJK) & (count("[A-Za-z]") < letters * n))

    return let(F.substring(text(c), 1, chars), told)


def marker_count(c: Column, markers: Sequence[str]) -> Column:
    """How many of the markers a text has."""
    return F.size(F.filter(words_of(markers), lambda m: F.contains(text(c), m)))


def has_cjk(c: Column) -> Column:
    return text(c).rlike(CJK)


def tail_noise(c: Column, terms: Sequence[str], window: int = 160) -> Column:
    tail = F.substring(text(c), -window, window)
    return F.exists(words_of(terms), lambda t: F.contains(tail, t))


def signal_chars(c: Column) -> Column:
    return F.length(F.regexp_replace(text(c), r"(?U)[^\w]|_", ""))


def denoised(c: Column, noise: Sequence[str] = (), least: int = 4, ratio: float = 0.35) -> Column:
    """Lines made single-spaced, without repeats (letter case aside) and without noise: listed lines, lines of few signal characters, or of a small share of them. A struct of text, n_lines, n_repeated, n_noise. Through Arrow: the set of lines seen has no cheap column expression."""
    listed_ = frozenset(n.lower() for n in noise)

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_repeated", T.LongType()), T.StructField("n_noise", T.LongType())]))
    def clean(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            lines = [x for x in (" ".join(line.split()) for line in (t or "").split("\n")) if x]
            seen: dict[str, str] = {}
            for x in lines:
                seen.setdefault(x.lower(), x)
            first = list(seen.items())
            good = [x for k, x in first if k not in listed_ and (n := sum(map(str.isalnum, x))) >= least and n / len(x) >= ratio]
            out.append(("\n".join(good), len(lines), len(lines) - len(first), len(first) - len(good)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_repeated", "n_noise"])

    return clean(c)


@F.pandas_udf(T.StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    import html
    import re

    zeros, beyond = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[1-9][0-9]{7,};?")
    return texts.map(lambda t: None if t is None else html.unescape(beyond.sub("\ufffd", zeros.sub("&#", t))))


def unescaped(c: Column) -> Column:
    """Character references decoded; there are over 2,000 names and no built-in for them, so texts with an ampersand go through Arrow, and only those."""
    return F.when(F.contains(c, F.lit("&")), _unescaped(F.when(F.contains(c, F.lit("&")), c))).otherwise(c)


def visible_text(html: Column, separator: str = "\n", *, hidden: Sequence[str] = ("script", "style", "noscript", "svg", "canvas")) -> Column:
    """Text outside hidden elements, pieces without white space at their ends joined by the separator, character references decoded. hidden=() with a space as separator keeps all text."""
    apart = "|<(" + "|".join(hidden) + r")\b[^>]*>.*?</\1\s*>" if hidden else ""
    bare = F.regexp_replace(text(html), rf"(?is)<!--.*?-->|<!doctype[^>]*>{apart}", " ")
    pieces = F.filter(F.transform(F.split(bare, r"<[^>]*>"), collapse), lambda x: x != "")
    return unescaped(F.array_join(pieces, separator))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), "^www\\.", "")


def credibility(source: Column, high: Sequence[str], low: Sequence[str]) -> Column:
    has = lambda terms: F.exists(words_of(terms), lambda t: F.contains(text(source), t))
    return F.when(has(high), "high").when(has(low), "low").otherwise("medium")


def url_allowed(url: Column, allowed: Sequence[str] = (), denied: Sequence[str] = ()) -> Column:
    """http or https, no credentials, host in an allowed domain (any, if none are named) and in no denied one, and no private or local address."""
    name = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    under = lambda terms: F.exists(words_of(terms), lambda d: (name == d) | name.endswith(F.concat(F.lit("."), d)))
    private = name.rlike(r"^(localhost|127\.|10\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|\[?::1|\[?f[cd])")
    ok = url.rlike("(?i)^https?://") & (name != "") & ~url.rlike(r"^[a-zA-Z]+://[^/]*@") & ~private
    return ok & (under(allowed) if allowed else F.lit(True)) & (~under(denied) if denied else F.lit(True))


def citations(c: Column) -> Column:
    return F.regexp_extract_all(text(c), F.lit(r"\[(news:[A-Za-z0-9_:.-]+)\]"), F.lit(1))


def core_id(ref: Column) -> Column:
    """A citation without brackets and prefix."""
    return F.regexp_replace(F.regexp_replace(strip(text(ref)), r"^\[|\]$", ""), "^news:", "")


def source_and_doc(core: Column) -> Column:
    many = F.contains(core, F.lit(":"))
    return F.struct(F.when(many, F.substring_index(core, ":", 1)).otherwise("").alias("source"), F.regexp_replace(core, "^[^:]*:", "").alias("doc"))


def numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text(c), F.lit(r"\d+(?:\.\d+)?%?"), F.lit(0)))


def quoted(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text(c), F.lit(r"[\"“《]([^\"”》]{2,40})[\"”》]"), F.lit(1)))


def unsupported_terms(query: Column, evidence: Column) -> Column:
    """Quoted terms of a query that its evidence does not have."""
    return F.filter(quoted(query), lambda t: ~F.contains(text(evidence), t))


def cleaned_query(c: Column, phrases: Sequence[str] = ()) -> Column:
    """Without instruction phrases, punctuation at the ends and double spaces."""
    out = text(c)
    for p in phrases:
        out = F.replace(out, F.lit(p), F.lit(" "))
    return F.regexp_replace(collapse(out), r"(?U)^[\s,;:.]+|[\s,;:]+$", "")


def listed(c: Column) -> Column:
    """An array from JSON text, or from text delimited by semicolons or commas; blank items dropped."""
    parsed = F.from_json(c, "array<string>")
    return F.filter(F.transform(F.coalesce(parsed, F.split(text(c), "[;,；，]")), strip), lambda x: x != "")


def length_bucket(n: Column) -> Column:
    return F.when(n < 100, "short").when(n <= 1000, "medium").when(n <= 5000, "long").otherwise("very_long")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(100.0 * part / whole, 2))


def last_n(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.lit(1), F.size(items) - n + 1), F.lit(n))


def ordered_merge(old: Column, new: Column, limit: int = 80) -> Column:
    """Distinct items of both in order, the last `limit`."""
    empty = F.array().cast("array<string>")
    return last_n(F.filter(F.array_distinct(F.concat(F.coalesce(old, empty), F.coalesce(new, empty))), lambda x: x != ""), limit)
