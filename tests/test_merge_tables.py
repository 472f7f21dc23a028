"""Tables that take merges: results, files, plans, conflicts and breaks."""

import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern import runtime
from quern.sources import merge_tables as M


def local(path):
    return Path(path.removeprefix("file:").replace("//", "/"))


def files(path):
    return {str(p): hashlib.sha256(p.read_bytes()).hexdigest() for p in local(path).rglob("*.parquet")}


def now(spark, path, n=None):
    return {r["id"]: (r["a"], r["b"]) for r in M.read(spark, path, n).collect()}


SCHEMA = "id long, a string, b int"


@pytest.fixture
def place(spark):
    return runtime.new_path(spark, "merged")


def test_merges_against_a_dict(spark, place):
    rnd = random.Random(1)
    want = {i: (f"a{i}", i) for i in range(300)}
    M.create(spark.createDataFrame([(i, *v) for i, v in want.items()], SCHEMA), place, "id", slots=5, buckets=3)
    old = dict(want)
    for _ in range(3):
        ids = rnd.sample(range(400), rnd.choice([2, 60]))
        rows = [(i, rnd.choice([None, "x", "y"]), rnd.choice([None, -1, 7])) for i in ids]
        M.merge(place, spark.createDataFrame(rows, SCHEMA), ["a"])
        for i, a, b in rows:
            want[i] = (want[i][0] if a is None else a, want[i][1]) if i in want else (a, b)
        gone = rnd.sample(range(450), 20)
        M.delete(place, spark.createDataFrame([(i,) for i in gone] + [(None,)], "id long"))
        for i in gone:
            want.pop(i, None)
        assert now(spark, place) == want
    assert now(spark, place, 1) == old and M.versions(spark, place) == [1, 2, 3, 4, 5, 6, 7]
    assert M.forget(spark, place) == [1, 2, 3, 4, 5, 6] and now(spark, place) == want


def test_a_merge_of_one_key_writes_one_slot(spark, place):
    M.create(spark.range(500).select("id", F.lit("a").alias("a"), F.lit(1).alias("b")), place, "id", slots=8, buckets=2)
    before, old = files(place), M.version(spark, place)
    v = M.merge(place, spark.createDataFrame([(7, "new", 2)], SCHEMA), ["a"])
    changed = [s for s in v.places if v.places[s] != old.places[s]]
    assert len(changed) == 1 and files(place).items() >= before.items()
    assert M.read(spark, place).filter("id = 7").first()["a"] == "new" and now(spark, place, 1)[7] == ("a", 1)


def test_no_exchange_of_the_table(spark, place):
    """In the join of a merge and in others by the key only the new rows are exchanged."""
    M.create(spark.range(100).select("id", F.lit("a").alias("a"), F.lit(1).alias("b")), place, "id", slots=4, buckets=2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        other = spark.range(50).withColumn("c", F.lit(1)).repartition(2, "id")
        plan = M.read(spark, place).join(other, "id", "full")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        plan = M.read(spark, place).groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_breaks_and_conflicts(spark, place, monkeypatch):
    """A merge that breaks off before its version leaves the table as it was; of two on one version the second fails."""
    M.create(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], SCHEMA), place, "id", slots=2, buckets=2)
    want, commit = now(spark, place), M._commit
    new = spark.createDataFrame([(1, "z", 9)], SCHEMA)

    def broken(*_):
        raise OSError("lost")

    monkeypatch.setattr(M, "_commit", broken)
    with pytest.raises(OSError):
        M.merge(place, new, ["a"])
    monkeypatch.setattr(M, "_commit", commit)
    assert now(spark, place) == want and M.versions(spark, place) == [1]
    M.merge(place, new, ["a"], after=1)
    with pytest.raises(M.MergeConflict):
        M.merge(place, new, ["b"], after=1)
    assert now(spark, place) == {1: ("z", 1), 2: ("b", 2)}
    n = len(files(place))
    M.forget(spark, place)
    assert len(files(place)) < n and now(spark, place) == {1: ("z", 1), 2: ("b", 2)}


def test_odd_rows(spark, place):
    """Repeated and null keys, no rows, empty tables, missing and unknown columns."""
    empty = spark.createDataFrame([], SCHEMA)
    M.create(empty, place, "id", slots=2, buckets=2)
    assert now(spark, place) == {} and M.merge(place, empty, ["a"]).number == 1
    M.merge(place, spark.createDataFrame([(1, "a", 1), (1, "c", 0), (1, None, 5)], SCHEMA), ["a"], order=["b"])
    M.merge(place, spark.createDataFrame([(1, "q"), (3, "r")], "id int, a string"), ["a"])
    assert now(spark, place) == {1: ("q", 5), 3: ("r", None)}
    with pytest.raises(Exception, match="id is null"):
        M.merge(place, spark.createDataFrame([(None, "a", 1)], SCHEMA), ["a"])
    with pytest.raises(ValueError):
        M.merge(place, spark.createDataFrame([(1, 2)], "id long, other int"), ["a"])
    with pytest.raises(FileExistsError):
        M.create(empty, place, "id")
    with pytest.raises(FileNotFoundError):
        M.read(spark, place, 99)
    assert now(spark, place) == {1: ("q", 5), 3: ("r", None)}
