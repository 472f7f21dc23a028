"""The scorer's transport: calls by query and batch, failures, time-outs, missing scores."""

import time

from quern.operators import ranking as K
from quern.operators import scorers as Z

ROWS = [(q, p, f"q{q}" if q else None, t) for q in (1, 2, None) for p, t in enumerate(["a", "bb", None, "dddd", "eeeee", "ffffff", "bad"], 1)]


def frame(spark):
    return spark.createDataFrame(ROWS, "query_id long, pos int, query string, text string").repartition(3)


def maker():
    def make():  # not a name of this module, which workers do not have
        def score(query, texts):
            assert len(texts) <= 3
            if "bad" in texts:
                raise RuntimeError("no")
            return [None if t == "bb" else float("nan") if t == "" else len(t) for t in texts]

        return score

    return make


def test_failures_stay_with_their_calls(spark):
    got = {(r["query_id"], r["pos"]): (r["remote_score"], r["score_error"]) for r in Z.scored(frame(spark), maker(), batch=3).collect()}
    assert len(got) == len(ROWS)
    for q in (1, 2, None):
        assert [got[q, p] for p in range(1, 8)] == [(1.0, None), (None, None), (None, None), (4.0, None), (5.0, None), (6.0, None), (None, "RuntimeError: no")]
    order = [r["pos"] for r in K.scored_first(Z.scored(frame(spark), maker(), batch=3).filter("query_id = 1")).orderBy("rank").collect()]
    assert order == [6, 5, 4, 1, 2, 3, 7]
    assert Z.scored(frame(spark).limit(0), maker()).count() == 0


def test_late_and_wrong_answers(spark):
    def slow():
        return lambda query, texts: time.sleep(1.5) or [0.0] * len(texts)

    def short():
        return lambda query, texts: [1.0]

    one = frame(spark).filter("query_id = 1")
    assert {r["score_error"] for r in Z.scored(one, slow, seconds=0.2).collect()} == {"late"}
    assert {r["score_error"] for r in Z.scored(one, short).collect()} == {"ValueError: 1 scores for 7 texts"}


def test_attempts(spark):
    def flaky():
        calls = []

        def score(query, texts):
            calls.append(1)
            if len(calls) % 2:
                raise OSError("again")
            return [1.0] * len(texts)

        return score

    assert {r["remote_score"] for r in Z.scored(frame(spark), flaky, attempts=2).collect()} == {1.0}
