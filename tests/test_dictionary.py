"""Keyword dictionaries against a pattern a keyword."""

import random
import re
import time

from pyspark.sql import functions as F

from quern.operators import corpus as C
from quern.operators import dictionary as K

WORDS = ["tax", "taxes", "interest rate", "rate", "c++", ".net", "u.s. dollar", "at&t", "++", "-", "a", "über", "naïve rate", "利率", "中国经济", "国", "A股", "New  York", "new york", "x" * 300]
PIECES = [*WORDS, "Tax", "INTEREST RATE", "ratex", "c++x", "x.net", "u.s.", " ", "  ", "\n", ".", "+", "中", "利", "率", "経", "Über", "ÜBERx", "1", "york", "é"]


def has(text, word):
    text, word = text.lower(), word.lower()
    return bool(re.search(rf"(?<![a-z0-9]){re.escape(word)}(?![a-z0-9])", text)) if word.isascii() else word in text


def texts(n, seed):
    rnd = random.Random(seed)
    return [(i, "".join(rnd.choice(PIECES) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(0, 25)))) for i in range(n)]


def test_every_kind_of_keyword(spark):
    rows = texts(400, 1)
    found = K.hits(spark.createDataFrame(rows, "id long, t string"), "id", "t", spark.createDataFrame([(w, f"l{len(w)}") for w in WORDS], "keyword string, label string"))
    got = [(r["id"], r["keyword"]) for r in found.collect() if r["keyword"] is not None]
    want = {(i, w.lower()) for i, t in rows for w in WORDS if has(t, w)}
    assert len(got) == len(set(got)) and set(got) == want and len({w for _, w in want}) == len({w.lower() for w in WORDS})


def test_labels_as_the_rules_give_them(spark):
    """The same as one test a keyword, labels and first by priority."""
    rules = {"money": ["tax", "interest rate", "利率"], "place": ["new york", "国"], "code": ["c++", ".net", "tax"]}
    docs = spark.createDataFrame(texts(200, 2), "id long, t string")
    labels, primary = C.tagged(F.col("t"), rules, ["place", "code", "money"])
    want = {r["id"]: (sorted(r["l"]), r["p"]) for r in docs.select("id", labels.alias("l"), primary.alias("p")).collect()}
    words = spark.createDataFrame([(w, k) for k, ws in rules.items() for w in ws], "keyword string, label string")
    got = {r["id"]: (list(r["labels"]), r["primary"]) for r in K.tagged_by(docs, "id", "t", words, ["place", "code", "money"]).collect()}
    assert got == want


def test_odd_rows(spark):
    """Null and empty texts and keywords, repeats, null ids, no rows, a full filter's false hits, a name that clashes."""
    words = spark.createDataFrame([("a", "x"), ("A", "x"), ("a", "y"), ("", "z"), (None, "z")], "keyword string, label string")
    docs = spark.createDataFrame([(1, "a a A", 0), (2, None, 0), (3, "", 0), (None, "b a", 0), (4, "ab" * 200_000, 0)], "id long, t string, label int")
    got = {r["id"]: (r["labels"], r["primary"], r["n_keywords"]) for r in K.tagged_by(docs, "id", "t", words).collect()}
    none = ([], "other", 0)
    assert got == {1: (["x", "y"], "x", 1), 2: none, 3: none, None: (["x", "y"], "x", 1), 4: none}
    assert K.tagged_by(docs.limit(0), "id", "t", words).collect() == []
    assert K.tagged_by(docs, "id", "t", words.limit(0)).filter("n_keywords > 0").count() == 0


def test_ten_thousand_keywords(spark, sf):
    """Ten thousand keywords take less than four times as long as ten, and find the same for those ten."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few = spark.createDataFrame([(w, w) for w in "the und license licensed and of to in die der".split()], "keyword string, label string")
    many = few.unionByName(spark.range(10_000).select(F.concat(F.lit("w"), "id").alias("keyword"), F.lit("other").alias("label")))
    took, out = [], []
    for words in (few, few, many):
        start = time.time()
        out.append(sorted((r["doc_id"], r["keyword"]) for r in K.hits(docs, "doc_id", "text", words).filter("label <> 'other'").collect()))
        took.append(time.time() - start)
    assert out[1] == out[2] and out[1] and took[2] < 4 * took[1] + 1
