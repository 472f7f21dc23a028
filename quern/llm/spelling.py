"""Spelling variants: a symmetric-delete join, exact distance one, frequent forms, roots.

Every word emits itself and its distinct single deletions. Two words at distance one share such a key:
if one has a letter more, the shorter word itself, and if they differ in one letter, what is left of
both without it. A key has a bounded number of words, as all of them are the key with one letter more.
Pairs of a key are verified, each word's pairs are aggregated to its form, and roots are found by
joining forms with forms, which doubles the distance with every round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Odd multiplier of the keys' hashes, and what undoes it.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(FACTOR), -1, 2**64))
#: Runs of letters; one of so many loses a letter; least length and number of a word; how much more frequent a form is.
LETTERS = r"[A-Za-zÀ-ÿ]+"
SLIP, LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 31, 7, 2, 10


def without(word: Column, at: Column) -> Column:
    """The word without its code point at a place from 0 on."""
    at = at.cast("int")
    return F.concat(word.substr(F.lit(1), at), word.substr(at + 2, F.char_length(word)))


def occurrences(docs: DataFrame, slip: int = SLIP) -> DataFrame:
    """_word: every run of letters of the whole texts, A-Z in lower case, without the code point that its checksum takes; a null id counts as an empty one in the checksum."""
    run = F.translate(F.col("_run"), common.UPPER, common.LOWER)
    each = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("_run")).select("doc_id", run.alias("_run"))
    sums = each.withColumn("_h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "_run")))
    return sums.select(F.when(F.col("_h") % slip == 0, without(F.col("_run"), F.col("_h") % F.char_length("_run"))).otherwise(F.col("_run")).alias("_word"))


def words(docs: DataFrame, *, slip: int = SLIP, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the distinct results that are long and frequent enough. Counts are folded before the shuffle."""
    found = occurrences(docs, slip).filter(F.char_length("_word") >= least_length)
    return found.groupBy(F.col("_word").alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def deletion_keys(word: str) -> np.ndarray:
    """Hashes of a word and of its distinct single deletions, in time linear in its length: a sum of its code points times powers, of which a deletion's is the part before it and the part after it, moved by one."""
    c = common.mixed(np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64) + FACTOR)
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(c) - 1, FACTOR)]))
    until = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * powers)])
    gone = until[:-1] + (until[-1] - until[1:]) * INVERSE
    return np.unique(np.append(gone, until[-1]).view(np.int64))


def keys(counted: DataFrame) -> DataFrame:
    """_key, word, n: hashes of the word itself and of its distinct single deletions."""

    @F.pandas_udf("array<long>")
    def of(words: pd.Series) -> pd.Series:
        return words.map(deletion_keys)

    return counted.select(F.explode(of("word")).alias("_key"), "word", "n")


def apart_by_one(a: Column, b: Column) -> Column:
    """Whether two words differ by exactly one inserted, deleted or replaced code point: between their common prefix and their common suffix nothing else is left."""
    n, m = F.char_length(a), F.char_length(b)
    least = F.least(n, m)
    steps = F.sequence(F.floor(F.log2(least)).cast("int"), F.lit(0), F.lit(-1))
    longer = lambda k, j: k + F.pow(F.lit(2), j).cast("int")
    same = F.aggregate(steps, F.lit(0), lambda k, j: F.when((longer(k, j) <= least) & (F.left(a, longer(k, j)) == F.left(b, longer(k, j))), longer(k, j)).otherwise(k))  # the common prefix, by halving
    rest = lambda w, k, skip: w.substr(k + 1 + skip, F.char_length(w))
    return (
        F.when(n == m, (a != b) & (rest(a, same, 1) == rest(b, same, 1)))
        .when(n == m + 1, rest(a, same, 1) == rest(b, same, 0))
        .when(m == n + 1, rest(b, same, 1) == rest(a, same, 0))
        .otherwise(F.lit(False))
    )


def near(counted: DataFrame) -> DataFrame:
    """word, n, other, m: each pair of near words once in either direction. Words meet in their keys; pairs that share several keys are one."""
    told = keys(counted)
    left, right = told.alias("l"), told.select("_key", F.col("word").alias("other"), F.col("n").alias("m")).alias("r")
    pairs = left.join(right, "_key").filter(F.col("word") < F.col("other")).groupBy("word", "other").agg(F.first("n").alias("n"), F.first("m").alias("m"))
    pairs = common.materialize(pairs.filter(apart_by_one(F.col("word"), F.col("other"))), "pairs")  # read twice
    return pairs.select("word", "n", "other", "m").unionByName(pairs.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: from each word with a form (word, form) along the forms to the last. A form is more frequent than its word, so that there are no circles; each round doubles the distance and is a written table."""
    now = common.materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if now.join(further, "root", "left_semi").isEmpty():
            return now
        now = common.materialize(now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")


def group(docs: DataFrame, *, slip: int = SLIP, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, form_times: int = FORM_TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of docs (doc_id, text).

    A word's form is its most frequent near word (ties: the smallest in code-point order), if that is form_times as frequent at least, else null. root follows forms to the last; a word without one is its own. Null and empty texts have no word; rows that repeat count again; an empty table gives none; other columns don't matter."""
    counted = common.materialize(words(docs, slip=slip, least_length=least_length, least_count=least_count), "words")
    best = near(counted).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("_minus"), F.col("other").alias("_other"))).alias("_best"))
    rows = counted.join(best, "word", "left").withColumn("_frequent", -F.col("_best._minus") >= form_times * F.col("n"))
    rows = rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_frequent"), F.col("_best._other")).alias("form"), F.when(F.col("_frequent"), -F.col("_best._minus")).alias("form_n")
    )
    rows = common.materialize(rows, "forms")
    return rows.join(roots(rows.filter("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """group() of documents."""
    return group(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("word", "form", "root", "n", "n_near", "form_n")


#: CRC-32 by its bits in SQL: the table of 256 remainders comes from the polynomial.
OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT b, 0 AS k, CAST(b AS BIGINT) AS c FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
remainders AS (SELECT list(c ORDER BY b) AS r FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)),
folded AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hexed AS (SELECT *, hex(encode(doc_id || ':' || run)) AS x FROM folded),
summed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(CAST(length(x) // 2 AS BIGINT)), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
                lambda c, y: xor(c >> 8, r[xor(c & 255, y) + 1])), 4294967295) AS h FROM hexed, remainders),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM summed) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, n, i, word[:i] || word[i + 2:] AS k FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.i = b.i AND a.k = b.k WHERE a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.k = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.k = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chains AS (
  SELECT word, word AS root, form FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chains c JOIN forms f ON c.form = f.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chains c ON f.word = c.word AND c.form IS NULL
"""
