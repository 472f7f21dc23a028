"""The queries with SQL against DuckDB, and the pipeline against plain Python."""

import os
import struct
import zlib

import duckdb
import plain
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quern.llm import catalogue, common, packing, pii, rule_classifier, textstats


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    got = catalogue.queries()[name](spark, sf)
    want = c.execute(catalogue.oracle_sql()[name]).fetchall()
    order = [d[0] for d in c.description]
    assert sorted(map(tuple, got.select(*order).collect())) == sorted(want)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf), name)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS and docs.filter("n_chars <> char_length(text)").isEmpty()
        if name in ("line_dedup", "pii"):
            assert docs.count() == before
        assert 0 < docs.count() <= before
        before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.select("doc_id").distinct().count() == before and out.groupBy("sequence_id").sum("length").filter(f"`sum(length)` > {packing.CAPACITY}").isEmpty()


def test_stages_take_awkward_documents(spark, sf):
    rows = [(1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "no id", "en", "s", 5), (4, "w " * 20_000, "en", "s", 40_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf).collect()


def test_run_against_plain_python(spark, sf):
    """All stages: the classifier's rules by numpy, lines, near copies by all pairs, pseudonyms, and the library's tokens packed by best fit decreasing."""
    spark.conf.set(pii.KEY_CONF, "a key")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = rule_classifier.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    x = textstats.with_stats(docs.select("doc_id", "text"), keep=["doc_id"]).select("doc_id", *rule_classifier.features()).toPandas()
    good = set(x["doc_id"][rules.score(x[list(rule_classifier.FEATURES)].to_numpy()) >= rule_classifier.THRESHOLD])
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good)

    key = lambda line: line.strip(common.SPACES).translate(str.maketrans(common.UPPER, common.LOWER))
    holders: dict[str, set] = {}
    for i, t in rows:
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    gone = lambda i, line: len(holders.get(key(line), ())) >= 5 and max(holders[key(line)]) != i
    rows = [(i, "\n".join(line for line in t.split("\n") if not gone(i, line))) for i, t in rows]

    rows = [(i, plain.pseudonymized(t, "a key")[0]) for i, t in plain.near_duplicates(rows)]
    library, want = Tokenizer.from_file(common.tokenizer_path()), set()
    for i, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, packing.END_ID]
        for k, lo in enumerate(range(0, len(ids), 4096)):
            part = ids[lo : lo + 4096]
            want.add((i, k, lo, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert 50 < len(rows) < docs.count() and set(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want and len(got) == len(want)
    assert got["sequence_id"].nunique() == plain.best_fit_decreasing([w[3] for w in want], 4096)


def test_one_row_of_those_that_repeat_an_id(spark):
    rows = [(1, "b", "en", "s", 1), (1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (2, "c", "en", "s", 1), (None, "d", "en", "s", 1), (None, "d", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [sorted(map(str, map(tuple, corpus_pipeline.one_row_each(d).collect()))) for d in (docs, docs.repartition(3).sortWithinPartitions(F.desc("text")))]
    assert got[0] == got[1] and len(got[0]) == 4
