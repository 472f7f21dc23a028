"""Nested JSON against a plain walk: shapes, depths, and what is no JSON."""

import json

from pyspark.sql import functions as F

from quern.operators import nested as J

SHAPES = [
    [{"text": "a", "confidence": 0.5}, {"text": "b", "confidence": 1}],
    {"rec_texts": ["a", "b"], "rec_scores": [0.25, None]},
    {"res": {"pages": [{"lines": [{"text": "deep {not} [json]", "box": [[0, 1], [2, 3]]}]}, {"lines": []}]}},
    {"results": [{"data": {"items": [{"title": "t\"1\"", "ok": True, "more": {"text": "x"}}]}}, "plain", 7]},
]


def walk(x, path="$", name=None):
    if isinstance(x, dict):
        return [r for k, v in x.items() for r in walk(v, f"{path}.{k}", k)]
    if isinstance(x, list):
        return [r for i, v in enumerate(x) for r in walk(v, f"{path}[{i}]", name)]
    return [(path, name, None if x is None else str(x).lower() if isinstance(x, bool) else str(x))]


def test_leaves_are_a_walk(spark):
    deep = current = {}
    for k in range(30):
        current["n"] = {} if k % 3 else [{}]
        current = current["n"] if k % 3 else current["n"][0]
    current["text"] = "bottom"
    rows = [(i, json.dumps(x)) for i, x in enumerate([*SHAPES, deep, {}, [], "text", 5])] + [(90, None), (91, ""), (92, "{no json"), (0, json.dumps(SHAPES[0]))]
    df = spark.createDataFrame(rows, "id long, j string").withColumns({"path": F.lit(1), "key": F.lit(2), "value": F.lit(3)})
    got = sorted((r["id"], r["path"], str(r["name"]), str(r["value"])) for r in J.leaves(df, "id", "j").collect())
    want = sorted((i, p, str(n), str(v)) for i, t in rows if t and i < 91 for p, n, v in walk(json.loads(t)))
    assert got == want
    assert J.leaves(df.limit(0), "id", "j").count() == 0
    texts = [r["value"] for r in J.found(df, "id", "j", ["text", "rec_texts"]).orderBy("id", "path").collect()]
    assert texts == ["a", "a", "b", "b", "a", "b", "deep {not} [json]", "x", "bottom"]
