"""Hard negatives, spelling variants and substring dedup against plain versions and SQL, and on awkward rows."""

import collections
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import catalogue, hard_negatives, simhash, spelling, substring_dedup

SPACES = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_spelling_variants", "op13_substring_dedup"])
def test_queries_are_their_sql(spark, sf, name):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    got = catalogue.queries()[name](spark, sf)
    want = c.execute(catalogue.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


# substring dedup


def plain_substring_dedup(rows, window):
    """rows of (doc_id, text): kept text, n_words, n_removed, by row."""
    first = {}
    words = [(t or "").encode().split() for _, t in rows]
    ids = [substring_dedup.NO_ID if i is None else i for i, _ in rows]
    for i, w in zip(ids, words, strict=True):
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, w in zip(ids, words, strict=True):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                gone.update(range(s, s + window))
        out.append((b" ".join(x for k, x in enumerate(w) if k not in gone).decode(), len(w), len(gone)))
    return out


def pieces(seed, n, window):
    """Texts made of shared passages, own words, single repeated words and copies with a word replaced."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    passages = [[r.choice(words) for _ in range(r.randint(window - 2, 4 * window))] for _ in range(6)]
    texts = []
    for _ in range(n):
        text = []
        for _ in range(r.randint(0, 5)):
            kind = r.random()
            if kind < 0.5:
                text += r.choice(passages)
            elif kind < 0.7:
                text += [r.choice(words)] * r.randint(1, 3 * window)
            else:
                text += [r.choice(words) for _ in range(r.randint(1, 2 * window))]
        if text and r.random() < 0.3:
            text[r.randrange(len(text))] = "other"
        texts.append("".join(w + r.choice([" ", "  ", "\n", "\t "]) for w in text))
    return texts


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"shard_words": 40}), (3, {"name_contents": 2, "shard_words": 200}), (4, {"gram": 3}), (5, {"gram": 8, "name_contents": 1})])
def test_substring_dedup_is_plain(spark, seed, options):
    window = 8
    texts = pieces(seed, 60, window)
    rows = list(enumerate(texts)) + [(7, texts[7]), (None, texts[3]), (None, texts[9]), (9, texts[3])]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, _row_no long").repartition(5)
    got = {r["_row_no"]: (r["_text"], r["_n_words"], r["_n_removed"]) for r in substring_dedup.dedup(docs, window=window, **{"gram": 4} | options).collect()}
    want = plain_substring_dedup(rows, window)
    assert [got[k] for k in range(len(rows))] == want and any(w[2] for w in want)


def test_substring_dedup_awkward(spark):
    long = "the same long text of few words " * 20_000
    rows = [(1, long), (2, None), (3, ""), (4, " \n\t "), (5, long), (5, long), (None, "no id"), (6, "a b 　 c"), (7, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_key": F.lit(1), "_text": F.lit("clash"), "_n_words": F.lit(0), "_doc": F.lit(3), "words": F.lit("w")})
    got = substring_dedup.dedup(docs).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["_n_words"], r["_n_removed"], r["_text"]))
    want = collections.defaultdict(list)
    for (i, _), (t, n, gone) in zip(rows, plain_substring_dedup(rows, 20), strict=True):
        want[i].append((n, gone, t))
    assert by == want and by[5] == [(140_000, 140_000, "")] * 2 and by[6][0][1] == 0
    assert substring_dedup.dedup(docs.limit(0)).count() == 0


def test_automaton_knows_every_place():
    r = random.Random(5)
    for _ in range(60):
        sequences = [[r.randrange(3) for _ in range(r.randint(1, 25))] for _ in range(r.randint(1, 6))]
        a, places = substring_dedup.Automaton(), [1000 * k for k in r.sample(range(50), len(sequences))]
        for s, p in zip(sequences, places, strict=True):
            a.add(s, p)
        a.settle()
        query, k = [r.randrange(3) for _ in range(40)], r.randint(1, 6)
        lengths, found = a.statistics(query, k)
        for e in range(len(query)):
            held = [n for n in range(0, min(k, e + 1) + 1) if n == 0 or any(query[e + 1 - n : e + 1] == s[i : i + n] for s in sequences for i in range(len(s) - n + 1))]
            assert lengths[e] == max(held)
            ends = [p + i + k - 1 for s, p in zip(sequences, places, strict=True) for i in range(len(s) - k + 1) if e + 1 >= k and s[i : i + k] == query[e + 1 - k : e + 1]]
            assert found[e] == min(ends, default=-1)


# spelling variants


def plain_group(rows, slip=31):
    import re

    n = collections.Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if len(a) < len(b):
            a, b = b, a
        return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))

    out = {}
    for w, k in n.items():
        near = [o for o in n if o != w and abs(len(o) - len(w)) < 2 and one(w, o)]
        best = min(near, key=lambda o: (-n[o], o), default=None)
        out[w] = [k, len(near), best if best and n[best] >= 10 * k else None]
    rows = {}
    for w, (k, near, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows[w] = (k, near, form, n[form] if form else None, root)
    return rows


@pytest.mark.parametrize("seed,slip", [(1, 31), (2, 3)])
def test_spelling_is_plain(spark, seed, slip):
    r = random.Random(seed)
    base = ["Strasse", "straßen", "caféteria", "aaaaaaaa", "aaaaaaab", "received", "abcdefgh", "bcdefghi", "ÀÁÂÃÄÅÆ", "õö÷øùúû"]

    def slipped(w):
        k = r.randrange(len(w))
        return r.choice([w, w, w, w[:k] + w[k + 1 :], w[:k] + r.choice("xé") + w[k + 1 :], w[:k] + r.choice("ab") + w[k:]])

    chain = "chained " * 2000 + "chaineda " * 180 + "chainedab " * 15 + "chainedabc " * 1 + "chainedab-"
    rows = [(k, " ".join(slipped(r.choice(base)) + r.choice(["", ",", "1", "-"]) for _ in range(200))) for k in range(40)] + [(50, chain), (51, None), (None, "received receivedx receivedx"), (52, ""), (50, chain), (53, "z" * 400 + " " + "z" * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit(2), "_key": F.lit("x"), "root": F.lit("y")})
    got = {x["word"]: (x["n"], x["n_near"], x["form"], x["form_n"], x["root"]) for x in spelling.group(docs, slip=slip).collect()}
    want = plain_group(rows, slip)
    assert got == want
    assert any(v[2] and v[4] != v[2] for v in want.values())  # a chain
    assert spelling.group(docs.limit(0)).count() == 0


# hard negatives


def plain_mine(rows, every=100):
    def score(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True))

    x = {i: (label, [int(np.floor(256 * float(v))) for v in vector]) for i, vector, label in rows}
    out = []
    for a in x:
        if a % every:
            continue
        near = sorted((-score(x[a][1], x[o][1]), o) for o in x if o != a and len(x[o][1]) == len(x[a][1]))
        own = [(-s, o) for s, o in near if x[o][0] == x[a][0]][:5]
        for s, p in own:
            inside = [(-t, o) for t, o in near if x[o][0] != x[a][0] and 30 * s <= -100 * t <= 90 * s][:10]
            out += [(a, p, k + 1, o, s, t) for k, (t, o) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clusters", "ties", "wide", "negative"])
def test_hard_negatives_are_plain(spark, kind):
    rng = np.random.default_rng(3)
    n, dims = 700, 9
    if kind == "ties":
        v = rng.integers(0, 2, (n, dims)).astype(float)
    elif kind == "wide":
        v = rng.standard_normal((n, dims)) * 1e6
    elif kind == "negative":
        v = -np.abs(rng.standard_normal((n, dims))) * np.where(np.arange(n) % 100 == 0, -1, 1)[:, None]
    else:
        v = rng.standard_normal((20, dims))[rng.integers(0, 20, n)] + 0.3 * rng.standard_normal((n, dims))
    rows = [(i, [float(np.float32(x)) for x in v[i]], int(rng.integers(0, 3) if rng.random() < 0.7 else 0)) for i in range(n)]
    rows += [(n + k, [0.5] * d, k % 2) for k, d in enumerate([3] * 4 + [0] * 4 + [9] * 2)] + [(800, [0.25, 0.5, 0.125], 1), (900, [], 0), (1000, [0.0] * 9, 1)]
    bad = [(1001, None, 1), (1002, [1.0] * 9, None), (1003, [float("nan")] * 9, 1), (1004, [float("inf")] * 9, 1), (1005, [1.0, None] + [1.0] * 7, 1), (None, [1.0] * 9, 1), (rows[5][0], rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, "clash") for r in rows + bad], "vec_id long, embedding array<float>, label int, _block string").withColumn("rank", F.lit(1)).repartition(4)
    got = sorted(tuple(r) for r in hard_negatives.mine(df, block_rows=150).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == plain_mine(rows) and (got or kind == "negative")
    assert hard_negatives.mine(df.limit(0)).count() == 0


def test_hard_negatives_gather_little_on_the_driver(spark):
    """The anchors' copies for all blocks are not broadcast, and the sample of the fit is chosen where the rows are."""
    base = spark.range(40_000).select(F.col("id").alias("vec_id"), F.array(F.col("id"), F.col("id") + 1).alias("_x"))
    some = hard_negatives.sampled(base, 40_000, 2)
    assert 0.9 * hard_negatives.FIT_ROWS < len(some) < 1.1 * hard_negatives.FIT_ROWS and (hard_negatives.sampled(base.repartition(9), 40_000, 2) == some).all()
    assert hard_negatives.sampled(base.limit(0), 0, 2).shape == (0, 2) and len(hard_negatives.sampled(base.limit(70), 70, 2)) == 70
    rows = spark.range(8).select(F.col("id").cast("int").alias("_block"))
    asked = spark.range(50).select(F.col("id").alias("vec_id"), F.lit(1).alias("_label"))
    met = hard_negatives.met(rows, asked, 8, 50, lambda row: [(row["_block"], a["vec_id"]) for a in row["_asked"]], "block long, vec_id long")
    assert met.count() == met.distinct().count() == 400
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.standard_normal((3000, 16)))
    q = hard_negatives.Quantiser(x[:1000])
    codes, norms = q.encode(x)
    low, high = q.bounds(x[:20], codes, norms)
    exact = x[:20] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    assert np.median(high - low) < 0.5 * exact.std()


def test_shingles_too_rare_for_the_sample_do_not_lead(spark, monkeypatch):
    """Passages that a few in a hundred texts share are not in a sample of bounded size; their texts still do not all meet under them, and near copies are found."""
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    texts = [f"{own(i, 90)} {own(f'p{i % 10}', 14)}" for i in range(400)]
    texts.append(texts[7] + " and one more")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = simhash.described(docs, 0.8, shingle=5).select(F.explode("_keys").alias("_k"))
    assert keys.groupBy("_k").count().agg(F.max("count")).first()[0] <= 3
    found = {r["doc_id"]: r["component_id"] for r in simhash.grouped_documents(docs, shingle=5, similarity=0.8).collect()}
    assert found[400] == 7 and sum(k != v for k, v in found.items()) == 1
