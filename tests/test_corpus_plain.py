"""Operators of the corpus that SQL cannot say, or whose plan prunes, against plain versions."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import corpus as C
from quern.plans import catalogue
from quern.sources.tables import NOW


def plain_chunks(text, size=600, overlap=120, most=8):
    parts = []
    for line in (text or "").replace("\r", "").split("\n"):
        line = line.strip()
        if len(line) <= 1000:
            parts += [line] if line else []
        else:
            parts += [s.strip() for s in re.split("(?<=[。！？!?；;])", line) if s.strip()]
    chunks, buf = [], ""
    for p in parts:
        if buf and len(buf) + len(p) + 1 > size:
            chunks.append(buf)
            buf = buf[-overlap:] + "\n" + p
        else:
            buf = buf + "\n" + p if buf else p
    return (chunks + [buf] if buf else chunks)[:most]


def test_packed_chunks_are_plain(spark, sf):
    long = "Pi is 3.14 and e is 2.718, see www.example.org/a.b?c=1 for v1.2.3; " * 40
    texts = [long, long + "\n\nshort\r\nline!", "a. b. c.\n" * 300, None, "", " \r\n ", "x" * 5000, "。".join(["文" * 90] * 40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["i"]: r["c"] for r in spark.createDataFrame(rows, "i long, t string").select("i", X.packed_chunks(F.col("t")).alias("c")).collect()}
    assert all(got[i] == plain_chunks(t) for i, t in rows)
    assert not any(re.search(r"\b3\.$", c) for c in got[0])


def test_near_duplicate_pairs_are_plain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = []
    for r in docs:
        flat = " ".join((r["text"] or "").split())
        rows.append((r["doc_id"], (r["text"] or "").split("\n")[0], flat, r["source"], (NOW - (r["doc_id"] * 7919 % 4000) * 86400) // (91 * 86400)))
    near = lambda a, b, least: 2 * min(len(a), len(b)) / max(len(a) + len(b), 1) >= least and SequenceMatcher(None, a, b, autojunk=False).ratio()
    want = {}
    for block in {r[3:] for r in rows}:
        own = [r for r in rows if r[3:] == block]
        for key, value, least in ((lambda r: (r[1], r[0]), lambda r: r[1], 0.9), (lambda r: (r[2][:200], r[0]), lambda r: r[2][:1000], 0.95)):
            own.sort(key=key)
            for i, a in enumerate(own):
                for b in own[i + 1 : i + 5]:
                    if a[2] != b[2] and (ratio := round(near(value(a), value(b), least), 6)) >= least:
                        k = (min(a[0], b[0]), max(a[0], b[0]))
                        want[k] = max(want.get(k, 0), ratio)
    got = {(r["a"], r["b"]): r["ratio"] for r in catalogue.queries()["near_dup_pairs"](spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_arg_max_join_prunes_and_is_plain(spark, seed):
    r = random.Random(seed)
    common, rare = [f"c{k}" for k in range(12)], [f"r{k}" for k in range(400)]
    right = [(k, [w for w in common if r.random() < 0.7] + r.sample(rare, r.randint(0, 6))) for k in range(300)]
    left = [(k, (r.choice(right)[1][: r.randint(0, 14)] if r.random() < 0.7 else r.sample(common, 3)) + r.sample(rare, r.randint(0, 2)) + ["nowhere"]) for k in range(60)] + [(60, []), (61, ["nowhere"]), (62, None)]
    a, b = spark.createDataFrame(left, "left_id long, terms array<string>"), spark.createDataFrame(right + [(None, common)], "right_id long, terms array<string>")
    got = {x["left_id"]: (x["right_id"], x["shared"], x["status"]) for x in C.verified_against(a, b, "terms").collect()}
    for k, terms in left:
        best = min(((-len(set(terms or []) & set(t)), j) for j, t in right), default=(0, None))
        shared, who = (-best[0], best[1]) if best[0] else (0, None)
        status = "low_signal" if terms is not None and len(terms) < 2 else "unverified" if who is None else "station_matched" if shared >= 2 else "conflict"
        assert got[k] == (who, shared, status)


def test_arg_max_join_meets_few_pairs(spark, sf):
    terms = lambda c: X.verification_terms(F.col(c))
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("left_id"), terms("text").alias("terms"))
    n = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("right_id"), terms("text").alias("terms"))
    flat = lambda df, k: df.select(k, F.explode(F.array_distinct("terms")).alias("t"))
    every = flat(b, "left_id").join(flat(n, "right_id"), "t").count()  # what a join on all terms makes
    met = C.shared_pairs(b, n, "terms").count()
    print("rows of the join on all terms:", every, "pairs met:", met)
    assert met < every / 10


def test_labels_of_odd_texts_without_lambdas(spark):
    rules = {"a": ["the", "c++"], "b": ["ab a"], "c": ["国", "é"], "none": []}
    r = random.Random(6)
    pieces = ["the", "The", "THE9", "lathe", " ", "_", "é", "c++", "C++x", "ab a", "ab ab a", "国", "K", "\n", "9"]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.randint(0, 9)))) for i in range(400)] + [(400, None), (401, "x" * 100_000 + " the")]
    labels, primary = C.tagged(F.col("t"), rules, ["c", "unknown", "a"])
    found = spark.createDataFrame(rows, "i long, t string").select("i", labels.alias("l"), primary.alias("p"))
    has = lambda t, w: w in t if not w.isascii() else re.search(rf"(?<![a-z0-9]){re.escape(w)}(?![a-z0-9])", t)
    for x in found.collect():
        want = [k for k, ws in rules.items() if any(has((rows[x["i"]][1] or "").lower(), w) for w in ws)]
        assert x["l"] == want and x["p"] == next((p for p in ("c", "a") if p in want), "other")
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
