"""The maintained vector index against the exact search, and what upserts, predicates and awkward rows do to it."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.operators import vector as V
from quern.operators import vector_index as I

DIMS = 12


def frame(spark, v, first=0):
    return spark.createDataFrame([(first + i, [float(a) for a in x], i % 4) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((15, DIMS))[rng.integers(0, 15, 900)] + 0.25 * rng.standard_normal((900, DIMS))
    rows = frame(spark, v)
    bad = spark.createDataFrame([(9001, None, 1), (9002, [0.0] * DIMS, 1), (9003, [float("nan")] * DIMS, 1), (None, [1.0] * DIMS, 1), (3, [float(x) for x in v[3]], 3)], rows.schema)
    return rows, I.build(rows.unionByName(bad), meta=("label",), lists=12, k=5, rounds=3)


def asked(rows, n=30):
    return rows.filter(f"vec_id % {n} = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def pairs(df):
    return {(r["query_id"], r["vec_id"]): r["score"] for r in df.collect()}


def test_recall_work_and_scores(made):
    rows, index = made
    assert index.probes < 12 and index.rescored <= 90
    for where in (None, F.col("label") == 2):
        truth = pairs(V.exact_knn(asked(rows), rows if where is None else rows.filter(where), 5))
        found = pairs(I.search(index, asked(rows), 5, where=where))
        assert len(truth.keys() & found.keys()) >= 0.9 * len(truth)
        assert all(found[k] == pytest.approx(truth[k], abs=2e-6) for k in truth.keys() & found.keys())
    assert I.search(index, asked(rows), 5, where=F.col("label") == 99).count() == 0


def test_every_row_is_in_one_list(spark, made):
    rows, index = made
    held = I.stored(spark, index)
    assert held.count() == 900 and held.select("vec_id").distinct().count() == 900
    reopened = I.opened(spark, index.path)
    assert (reopened.cells == index.cells).all() and (reopened.probes, reopened.rescored, reopened.meta) == (index.probes, index.rescored, index.meta)


def test_upserts_are_found_and_replace(spark, made):
    rows, _ = made
    index = I.build(rows, meta=("label",), lists=6, k=3, rounds=2)
    taken = np.array(rows.filter("vec_id = 100").first()["embedding"])
    before = I.search(index, rows.filter("vec_id = 200").select(F.col("vec_id").alias("query_id"), "embedding"), 1).first()["vec_id"]
    for version, to in ((1, 7), (2, 8)):
        new = spark.createDataFrame([(before, [float(to * x) for x in taken], 3), (5000 + version, [float(x) for x in taken], 3), (6000, [1.0], 1), (6001, None, 1)], rows.schema)
        assert I.upsert(index, new) == version
    held = I.stored(spark, index)
    assert held.count() == 902 and held.filter(F.col("vec_id") == before).count() == 1
    near = pairs(I.search(index, rows.filter("vec_id = 100").select(F.col("vec_id").alias("query_id"), "embedding"), 3))
    assert set(near) == {(100, before), (100, 5001), (100, 5002)} and set(near.values()) == {1.0}
    assert I.search(index, rows.filter("vec_id = 200").select(F.col("vec_id").alias("query_id"), "embedding"), 1).first()["vec_id"] != before
    packed = I.compact(index)
    assert pairs(I.search(packed, asked(rows), 3)) == pairs(I.search(index, asked(rows), 3))
    assert I.stored(spark, packed).count() == 902 and spark.read.parquet(f"{packed.path}/replaced").count() == 0


def test_awkward_tables(spark, made):
    rows, index = made
    with pytest.raises(ValueError):
        I.build(rows.limit(0))
    with pytest.raises(ValueError):
        I.build(rows.unionByName(spark.createDataFrame([(77, [1.0], 1)], rows.schema)))
    odd = spark.createDataFrame([(1, [1.0]), (2, None), (None, [1.0] * DIMS), (3, [float("inf")] * DIMS)], "query_id long, embedding array<float>")
    assert I.search(index, odd, 5).count() == 0
    one = I.build(rows.limit(1), rounds=1)
    assert I.search(one, asked(rows), 5).count() <= 30 and one.probes == 1
    same = I.build(frame(spark, np.ones((40, 3))), lists=5, k=3, rounds=1)
    assert I.search(same, frame(spark, np.ones((1, 3)), 100).select(F.col("vec_id").alias("query_id"), "embedding"), 3).filter("score = 1").count() == 3


def test_exact_search_of_mixed_lengths(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [0.9, 0.1, 0.0]), (5, [float("nan"), 1.0]), (6, [0.0, 0.0]), (7, [1.0, None]), (8, None), (9, [])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in V.exact_knn(rows.select(F.col("vec_id").alias("query_id"), "embedding"), rows, 3).collect()}
    assert got == {(1, 2), (2, 1), (3, 4), (4, 3)}


def test_a_block_of_the_exact_search_is_bounded():
    """Many queries take no more memory at once than a few, and ties at a query's last place go to the smaller id."""
    rng = np.random.default_rng(8)
    v, q = rng.integers(-2, 3, (V.BLOCK_ROWS, 3)) + 0.5, rng.integers(-2, 3, (700, 3)) + 0.5
    left, right = pd.DataFrame({"vec_id": rng.permutation(len(v)), "embedding": list(v)}), pd.DataFrame({"query_id": np.arange(700), "embedding": list(q)})
    tracemalloc.start()
    got = V.nearest_in(left, right, 4, 6, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(v) * len(q)  # all scores of the block
    ids = left["vec_id"].to_numpy()
    for i in (0, 63, 64, 699):
        score = np.round((v @ q[i]) / np.sqrt((v * v).sum(axis=1)) / np.sqrt((q[i] * q[i]).sum()), 6)
        want = [(int(n), s) for s, n in sorted((-s, n) for s, n in zip(score, ids, strict=True) if n != i)[:4]]
        mine = got[got["query_id"] == i].sort_values(["score", "vec_id"], ascending=[False, True])
        assert mine["vec_id"].tolist() == [n for n, _ in want]


def test_copies_are_found_whatever_the_codes_tell(spark):
    """A query's copies come first even where the search scores one vector of a dense cluster exactly, and a common vector gives no more rows than are asked for."""
    rng = np.random.default_rng(6)
    v = rng.standard_normal(DIMS) + 1e-2 * rng.standard_normal((600, DIMS))
    v[1:600:20] = v[0:600:20]
    v[500:540] = v[500]
    rows = frame(spark, v)
    index = I.replace(I.build(rows, meta=("label",), lists=4, k=3, rounds=1), probes=1, rescored=1)
    got = {r["query_id"]: (r["vec_id"], r["score"]) for r in I.search(index, asked(rows, 20), 1).collect()}
    assert got == {i: (500 if 500 < i < 540 else 501 if i == 500 else i + 1, 1.0) for i in range(0, 600, 20)}
    assert I.search(index, asked(rows, 20), 1, where=F.col("label") == 0).filter("vec_id % 4 <> 0").count() == 0
    found = [(r["query_id"], r["vec_id"]) for r in I.search(index, asked(rows, 20).filter("query_id = 520"), 3).collect()]
    assert sorted(found) == [(520, 500), (520, 501), (520, 502)]
