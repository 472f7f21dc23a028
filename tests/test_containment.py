"""Texts meet passages through runs of characters that pass a filter; no text is shuffled."""

import random
import re

from quern.operators import evaluation as E


def test_runs_are_those_of_the_passages(spark):
    r = random.Random(4)
    some = ["ab", "é", "文x", "\U0001f600\U0001f600", "a" * 16, "a" * 17, "ba" * 40, "b" * 300]
    text = lambda: "".join(r.choice([*some, "a", "b", "文", " "]) for _ in range(r.randint(0, 12)))
    texts = [text() for _ in range(200)] + ["", None, "a" * 70_000, "xb" * 50_000 + "b" * 300]
    passages = [*some, "", None, "never seen", "ab" * 500, "\0", "a\0"]
    want = {(t, p) for t in texts for p in passages if t is not None and p is not None and p in t}
    a, b = spark.createDataFrame([(t,) for t in texts * 2], "t string").repartition(3), spark.createDataFrame([(p,) for p in passages * 2], "p string")
    got = [tuple(x) for x in E.containing(a, "t", b, "p").collect()]
    assert len(got) == len(want) and set(got) == want
    rows = E.held(a.filter("t IS NOT NULL").distinct(), ["t"], "t", b, "p").collect()
    assert len(rows) < 1.01 * len({(t, p) for t, p in want if p}) + 5  # the filter lets hardly any other run pass


def test_keyword_gold_shuffles_no_title(spark):
    cases = spark.sql("SELECT * FROM VALUES (1L, array('Rate', 'x')), (2L, array('rate')), (3L, array('bank of the river and')) AS t(id, words)")
    docs = spark.sql("SELECT * FROM VALUES (7L, 'the RATE rose'), (8L, 'rate x'), (8L, 'Rate'), (9L, 'a bank of the river and more'), (null, 'x') AS t(doc, title)")
    found = E.keyword_gold(cases, docs, "id", "words", "title", "doc")
    assert sorted(map(tuple, found.filter("doc IS NOT NULL").collect())) == [(1, 7), (1, 8), (2, 7), (2, 8), (3, 9)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"(hash|range)partitioning\([^)]*(text|_id)#", plan)
