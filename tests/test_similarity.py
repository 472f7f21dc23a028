"""The ratio of near duplicates against difflib, and their neighbours across partitions against a plain version."""

import random
from difflib import SequenceMatcher

import pytest

from quern.functions import similarity as S
from quern.operators import corpus as C


def edited(r, text, times, letters):
    out = list(text)
    for _ in range(times):
        i = r.randrange(len(out) + 1)
        j = i + r.randint(0, 30)
        out[i:j] = r.choice((out[j : j + 30] + out[i:j], out[:20], [r.choice(letters)], [], out[i : i + 3]))
    return "".join(out)


@pytest.mark.parametrize("letters", ["ab", "a", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz é文"])
def test_ratio_is_difflibs(letters):
    r = random.Random(len(letters))
    for _ in range(300):
        a = "".join(r.choice(letters) for _ in range(r.randint(1, 150))) * r.randint(1, 3)
        b = edited(r, a, r.randint(0, 6), letters) or "a"
        plain = SequenceMatcher(None, a, b, autojunk=False)
        m = sum(x.size for x in plain.get_matching_blocks())
        assert S.matched(a, b, 0) == m <= S.subsequence(a, b)
        assert S.bound(S.counts(a), S.counts(b), len(a) + len(b)) >= plain.ratio() - 1e-9
        assert all(S.ratio(a, b, least) == (plain.ratio() if plain.ratio() >= least else 0) for least in (0.9, 0.95))


def test_long_texts_leave_little_to_difflib(monkeypatch):
    """difflib itself takes a step for each place of each character: the square of the length."""
    r = random.Random(2)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(500)]
    text = lambda: " ".join(r.choice(words) for _ in range(8000))
    steps = []
    monkeypatch.setattr(S, "SequenceMatcher", lambda junk, a, b, autojunk: steps.append(len(a) * len(b)) or SequenceMatcher(junk, a, b, autojunk))
    a, other = text(), text()[:45000]
    assert S.ratio(a, edited(r, a, 40, "abc"), 0.95) > 0.95
    assert S.ratio(a[:45000], other, 0.9) == 0
    assert sum(steps) < len(a)


def test_neighbours_across_partitions(spark):
    r = random.Random(8)
    base = ["the council met in the old hall and spoke of roads %d " % k * 3 for k in range(9)]
    rows = [(i, r.choice(("x", "x", "x", "y", "z", None)), edited(r, r.choice(base), r.randint(0, 2), "abc") if r.random() < 0.9 else None, r.choice((None, None, "p", "q"))) for i in range(300)]
    want = {}
    for block in ("x", "y", "z"):
        own = sorted((t[2] is not None, t[2] or "", t[0], t[3]) for t in rows if t[1] == block)
        for k, (_, t, i, same) in enumerate(own):
            for _, u, j, other in own[k + 1 : k + 5]:
                if t and u and (same is None or same != other) and (n := round(SequenceMatcher(None, t, u, autojunk=False).ratio(), 6)) >= 0.9:
                    want[i, j] = n
    docs = spark.createDataFrame(rows, "doc_id long, source string, title string, hash string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "5", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found = C.near_duplicates(docs, ["source"], ["title"], "title", 0.9, exact="hash")
            assert "Join" not in found._jdf.queryExecution().toString()  # no copies of values for each neighbour
            got = [tuple(x) for x in found.select("a", "b", "ratio").collect()]
            assert len(got) == len(want) > 100 and {(a, b): n for a, b, n in got} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_components_over_equal_titles(spark):
    """Pairs of equal titles with different contents: each has the ratio 1, and their components are plain ones."""
    from quern.operators import graph as G

    r = random.Random(9)
    rows = [(i, "s", "one title" if i % 3 else "".join(r.choice("abcdefgh ") for _ in range(60)), f"h{i % 50}") for i in range(120)]
    found = C.near_duplicates(spark.createDataFrame(rows, "doc_id long, source string, title string, hash string"), ["source"], ["title"], "title", 0.9, exact="hash")
    assert {x["ratio"] for x in found.collect()} == {1.0}
    own = [i for i in range(120) if i % 3]
    links = {(a, b) for k, a in enumerate(own) for b in own[k + 1 : k + 5] if a % 50 != b % 50}
    root = {i: i for i in own}
    for _ in own:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {x["node"]: x["component"] for x in G.components(found).collect()} == root
