"""Splits of whole groups against a version that takes one group at a time."""

import hashlib
import json
import math
import random
from collections import Counter, defaultdict

import pytest

from quern.operators import splits as S


def sha(*parts):
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()


def plain(rows, share, seed, least):
    """One group a step, every group scored anew."""
    groups = defaultdict(Counter)
    for g, c, n in rows:
        groups[g][c or "UNKNOWN"] += max(n or 0, 0)
    groups = {g: {c: n for c, n in sorted(v.items()) if n} for g, v in groups.items()}
    sides = dict.fromkeys(groups, "train")
    classes = Counter()
    for v in groups.values():
        classes.update(v)
    total = sum(classes.values())
    goal = math.ceil(total * share)
    if total >= least:
        goal = max(goal, least)
    goal = max(0, min(goal, total - 1))
    quota = {c: min(n * goal // max(total, 1), n - 1) for c, n in classes.items()}
    order = sorted(classes, key=lambda c: (-(classes[c] * goal % total), -classes[c], c))
    lack = goal - sum(quota.values())
    while lack and any(quota[c] < classes[c] - 1 for c in order):
        for c in order:
            if lack and quota[c] < classes[c] - 1:
                quota[c] += 1
                lack -= 1
    rest = {g: v for g, v in groups.items() if v}
    kind = {g: json.dumps([{"class": c, "n": n} for c, n in v.items()], separators=(",", ":")) for g, v in rest.items()}
    tie = {g: (sum(v.values()), sha(seed, kind[g]), sha(seed, g), g) for g, v in rest.items()}
    held, done = Counter(), 0

    def add(g):
        nonlocal done
        sides[g] = "heldout"
        held.update(rest[g])
        done += tie[g][0]
        del rest[g]

    while done < goal:
        fit = [g for g in rest if done + tie[g][0] <= goal]
        if not fit:
            break
        gain = lambda g: sum(min(n, max(0, quota[c] - held[c])) for c, n in rest[g].items()) or 0.01
        add(min(fit, key=lambda g: (-gain(g), *tie[g])))
    if rest and done < goal:
        g = min(rest, key=lambda g: (abs(goal - done - tie[g][0]), *tie[g]))
        if abs(goal - done - tie[g][0]) < goal - done:
            add(g)
    return sides


def split(spark, rows, **how):
    df = spark.createDataFrame(rows, "group_key string, class string, n int")
    found = S.split_groups(df, **how).collect()
    assert len(found) == len({r["group_key"] for r in found})
    return {r["group_key"]: r["side"] for r in found}


@pytest.mark.parametrize("number", range(6))
def test_equals_one_group_at_a_time(spark, number):
    rnd = random.Random(number)
    rows = []
    for g in range([3, 40, 150, 150, 300, 12][number]):
        for c in rnd.sample("abcde", rnd.choice([1, 1, 1, 2, 3])):
            rows.append((f"g{g}", c, rnd.choice([1, 1, 2, 5, 40 if number == 3 else 3])))
    how = {"share": rnd.choice([0.1, 0.3, 0.5]), "seed": number, "least": [0, 0, 30, 0, 500, 10_000][number]}
    assert split(spark, rows, **how) == split(spark, rows[::-1], **how) == plain(rows, **how)


def test_many_kinds_in_plain_python():
    """The counts alone, on more groups, with a class that has one row."""
    rnd = random.Random(9)
    groups = {f"g{i}": {c: rnd.randint(1, 9) for c in rnd.sample("abcdefgh", rnd.randint(1, 4))} for i in range(1500)} | {"only": {"z": 1}}
    rows = [(g, c, n) for g, v in groups.items() for c, n in v.items()]
    kinds = Counter(json.dumps([{"class": c, "n": n} for c, n in sorted(v.items())], separators=(",", ":")) for v in groups.values())
    got = S.taken(((k, sha(3, k), {x["class"]: x["n"] for x in json.loads(k)}, m) for k, m in kinds.items()), 0.3)
    want = plain(rows, 0.3, 3, 0)
    held = Counter(json.dumps([{"class": c, "n": n} for c, n in sorted(groups[g].items())], separators=(",", ":")) for g, s in want.items() if s == "heldout")
    assert {k: n for k, n in got.items() if n} == dict(held)


def test_shares_by_class(spark):
    rows = [(f"{c}{i}", c, 1) for c in "AB" for i in range(10)]
    held = Counter(g[0] for g, s in split(spark, rows).items() if s == "heldout")
    assert held == {"A": 3, "B": 3}
    sizes = dict(zip("ABCDEFGH", [20, 20, 15, 15, 15, 10, 10, 10], strict=True))
    held = Counter(g[0] for g, s in split(spark, [(f"{c}{i}", c, 1) for c, n in sizes.items() for i in range(n)], least=30).items() if s == "heldout")
    assert sum(held.values()) == 35 and held["A"] >= 5 and held["H"] >= 3


def test_odd_rows(spark):
    """Null classes, rows without a count, repeats, one group, none."""
    rows = [("a", None, 1), ("a", None, 1), ("b", "UNKNOWN", 2), ("c", "x", None), ("d", "x", 0), ("e", "x", -3), ("f", "x", 1)]
    assert split(spark, rows, share=0.5) == plain(rows, 0.5, 0, 0)
    assert split(spark, [("a", "x", 1)]) == {"a": "train"}
    assert split(spark, []) == {}
