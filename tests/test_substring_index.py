"""Substring search by the index against a scan, and what it opens."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import substring_index as T


def scan(rows, terms):
    return sorted({(t.lower(), k) for t in terms if t for k, x in rows if k is not None and x and t.lower() in x.lower()})


def found(df, key="id"):
    return sorted({(r["term"], r[key]) for r in df.collect()})


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    words = ["alpha", "Beta", "gamma", "Größe", "naïve", "the", "tion", "中文字", "x", "aaaa", "a.b*c", "100%"]
    return [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for k in range(120)] + [(200, None), (201, ""), (202, "ab"), (203, "z" * 30_000), (None, "alpha"), (204, "q"), (5, "twice with another text")]


TERMS = ["alpha", "BETA", "größe", "ïve g", "文字", "文", "a", "ab", "q", "zzzz", "a.b*", "0%", "not there", "aaaa aaaa", "tion the", "another", "", None, " ", "z" * 500]


def test_search_is_a_scan(spark, texts):
    docs = spark.createDataFrame(texts, "id long, text string").withColumns({"gram": F.lit(1), "_folder": F.lit(2)})
    asked = spark.createDataFrame([(t,) for t in TERMS], "term string")
    index = T.build(docs, "id", "text", folders=16)
    assert found(T.search(index, docs, "text", asked)) == scan(texts, [t for t in TERMS if t])
    more = [(300, "alpha omega"), (301, "omega only")]
    added = spark.createDataFrame(more, "id long, text string")
    T.add(index, added, "text")
    asked = spark.createDataFrame([("omega",), ("alpha o",), ("pha om",)], "term string")
    assert found(T.search(index, docs.select("id", "text").unionByName(added), "text", asked)) == scan(texts + more, ["omega", "alpha o", "pha om"])
    empty = T.build(docs.limit(0), "id", "text", folders=4)
    assert found(T.search(empty, docs, "text", asked)) == []


def test_a_search_opens_few_folders(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    index = T.build(docs, "doc_id", "text", folders=64)
    asked = spark.createDataFrame([("ingth",)], "term string")
    want = found(docs.filter(F.contains(F.lower("text"), F.lit("ingth"))).withColumn("term", F.lit("ingth")), "doc_id")
    assert found(T.search(index, docs, "text", asked), "doc_id") == want
    opened = T.chosen(index, asked).select("_folder").distinct().count()
    assert 1 <= opened <= T.TAKEN  # of 64
    near = T.candidates(index, asked)
    assert near.count() < docs.count() and "PartitionFilters: [_folder" in near._jdf.queryExecution().toString()
