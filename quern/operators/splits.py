"""Stratified splits of whole groups: greedy by what a group fills of the classes' deficits."""

from __future__ import annotations

import heapq
import json
import math
from collections import Counter
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from . import relational

#: What a group is worth that fills no deficit.
NO_GAIN = 0.01


def target(total: int, share: float, least: int = 0) -> int:
    """Rows to hold out: the share, rounded up, or `least` if that is more and there are as many rows; at most all but one."""
    wanted = math.ceil(total * share)
    return max(0, min(max(wanted, least) if total >= least else wanted, total - 1))


def quotas(counts: Mapping[str, int], held: int) -> dict[str, int]:
    """Held-out rows of each class by largest remainders (then larger classes, then names), as often around as it takes; at most all but one of a class."""
    total = sum(counts.values())
    if held <= 0 or not total:
        return dict.fromkeys(counts, 0)
    room = {c: max(0, n - 1) for c, n in counts.items()}
    out = {c: min(n * held // total, room[c]) for c, n in counts.items()}
    turn = sorted(counts, key=lambda c: (-(counts[c] * held % total), -counts[c], c))
    lack = held - sum(out.values())
    while lack > 0 and (open_ := [c for c in turn if out[c] < room[c]]):
        for c in open_[:lack]:
            out[c] += 1
        lack -= len(open_[:lack])
    return out


def taken(kinds: Iterable[tuple[str, str, Mapping[str, int], int]], share: float, least: int = 0) -> dict[str, int]:
    """How many groups of each kind are held out. kinds: name, tie, rows by class, number of groups.

    Of the groups that still fit, the one that fills most of the classes' deficits goes next, then the smaller, then the smaller tie. Deficits only fall, so a gain in the queue is never too low, and as many groups of a kind go at once as keep its gain: the work grows with the kinds, not with the groups. At last one group may go over the target if that ends nearer to it."""
    kinds = {name: (tie, dict(rows), copies) for name, tie, rows, copies in kinds}
    counts = Counter()
    for _, rows, copies in kinds.values():
        counts.update({c: n * copies for c, n in rows.items()})
    goal = target(sum(counts.values()), share, least)
    lack, total, out = quotas(counts, goal), 0, Counter()
    worth = lambda rows: sum(min(n, lack[c]) for c, n in rows.items()) or NO_GAIN
    queue = [(-worth(rows), sum(rows.values()), tie, name) for name, (tie, rows, _) in kinds.items()]
    heapq.heapify(queue)
    while queue and total < goal:
        gain, size, tie, name = heapq.heappop(queue)
        _, rows, copies = kinds[name]
        if total + size > goal:
            continue
        if worth(rows) == -gain:
            many = min([copies - out[name], (goal - total) // size, *(max(1, lack[c] // n) for c, n in rows.items() if lack[c])])
            out[name] += many
            total += many * size
            for c, n in rows.items():
                lack[c] = max(0, lack[c] - many * n)
        if out[name] < copies:
            heapq.heappush(queue, (-worth(rows), size, tie, name))
    over = min(((abs(goal - total - sum(rows.values())), sum(rows.values()), tie, name) for name, (tie, rows, copies) in kinds.items() if out[name] < copies), default=None)
    if over and total < goal and over[0] < goal - total:
        out[over[-1]] += 1
    return {name: out[name] for name in kinds}


def split_groups(groups: DataFrame, share: float = 0.3, seed: int = 0, least: int = 0) -> DataFrame:
    """group_key and side, train or heldout: whole groups, chosen by the deficits of their classes. groups: group_key, class, n (rows of one class come summed or not).

    Groups with the same rows by class are one kind. The driver gets a row for each kind, with its number of groups (kinds are few beside groups: a kind for each different vector of counts), and says how many of each go; which ones is by a seeded hash, in numbers that spread a kind of any size over many tasks. A null class counts as UNKNOWN, rows with n null or below 1 count for nothing, a group without others is train; no groups give no rows."""
    counted = groups.groupBy("group_key", F.coalesce("class", F.lit("UNKNOWN")).alias("class")).agg(F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).cast("long").alias("n"))
    rows = F.filter(F.sort_array(F.collect_list(F.struct("class", "n"))), lambda x: x["n"] > 0)  # as many as classes
    named = runtime.written(counted.groupBy("group_key").agg(F.to_json(rows).alias("kind")), "kinds")
    found = named.groupBy("kind").agg(F.count("*").alias("copies")).select("kind", F.sha2(F.concat_ws(":", F.lit(seed), "kind"), 256).alias("tie"), "copies")
    vectors = ((r["kind"], r["tie"], {x["class"]: x["n"] for x in json.loads(r["kind"])}, r["copies"]) for r in found.collect())
    kinds = [v for v in vectors if v[2]]
    some = taken(kinds, share, least)
    whole = {k: copies for k, _, _, copies in kinds if some[k] == copies}
    part = {k: n for k, n in some.items() if n and k not in whole}
    chosen = groups.sparkSession.createDataFrame([*whole.items(), *part.items()], "kind string, _held long")
    partly = groups.sparkSession.createDataFrame([(k,) for k in part], "kind string")
    hashed = named.join(partly, "kind", "left_semi").withColumn("_hash", F.sha2(F.concat_ws(":", F.lit(seed), "group_key"), 256))
    ranked = relational.numbered(hashed, ["kind"], ["_hash", "group_key"], "_rank").select("group_key", "kind", "_rank")
    others = named.join(partly, "kind", "left_anti").withColumn("_rank", F.lit(0).cast("long"))
    held = F.coalesce(F.col("_rank") <= F.col("_held"), F.lit(False))
    return ranked.unionByName(others).join(chosen, "kind", "left").select("group_key", F.when(held, "heldout").otherwise("train").alias("side"))
