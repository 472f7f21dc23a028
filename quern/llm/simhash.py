"""SimHash near duplicates by the generalised pigeonhole principle.

The 64 bits are grouped into partitions, correlated bits together. Two fingerprints that differ in at
most r bits differ in at most t_i bits of some partition i, as long as the sum of (t_i + 1) exceeds r
(t_i = -1: the partition is not probed). The thresholds, which need not be equal, are chosen by dynamic
programming on estimated costs: probes plus candidates to verify, from counts of bits over all
fingerprints. Fingerprints that share a probed value meet in a bucket, where every pair is verified
by its exact distance; of the links found, a spanning forest is given, so that a bucket of n gives
fewer than n rows and loses no connection. Large buckets are cut into blocks that meet in pairs.

Documents of a given similarity can lie further apart than r bits. For them (near_links) every text is
listed under the first of its shingles in one order of all shingles, rare ones first: so many that two
texts of that similarity share one of them (a prefix filter, exact). Texts under one shingle are compared
with two of them first; those not connected by then meet in blocks, pair by pair. A pair is dropped
only where its sizes or the parities of its shingles rule the similarity out; the rest are verified by
their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from . import common

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Least bits of a set's parities, the number of texts from which frequent shingles are estimated (they order the shingles, nothing more), and how many of these there are at most.
PARITIES, SAMPLE, FREQUENT = 1024, 16_000, 100_000
#: Of one in so many texts the leading part of the shingles, in this proportion to what a similar set can lack, is counted; those of this many texts go behind the rare ones. The share is fixed, so that groups under a shingle do not grow with the number of texts.
SHARE, PART, SHARED = 4, 2.5, 2
#: A table of up to so many texts' hashes (8 MB) is broadcast to find the texts; a larger one is joined with a shuffle. Texts whose shingles a task remembers.
BROADCAST_ROWS, REMEMBERED = 1 << 20, 64
#: Texts under one shingle meet in pairs of blocks of about so many.
MEETING = 512
#: Buckets of more fingerprints are cut into blocks of about so many.
BLOCK = 2048
#: Cost of a probe (a shuffled row) in verified candidates; fingerprints of the sample whose pairs tell how many candidates there will be.
PROBE_COST, PAIRED = 100.0, 2000
_ASCII_LOWER = bytes.maketrans(common.UPPER.encode(), common.LOWER.encode())


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).split()


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of every k-word shingle, repeats included; of the whole sequence, if it is shorter."""
    w = words(text)
    if len(w) > k:
        grams = map(b" ".join, zip(*(w[i : len(w) - k + 1 + i] for i in range(k)), strict=True))
    else:
        grams = [b" ".join(w)] if w else []
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(g, SEED) for g in grams]), dtype=">u8")


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """Bit by bit, 1 if set in over half of the hashes; 0 for a text without words."""
    return majority(shingle_hashes(text, k))


def majority(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """The kept columns and _fp, the fingerprint as a signed long. Null texts have no words."""
    keep = ["doc_id"] if keep is None else keep
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", _fp long"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, shingle) for t in b.column(b.num_columns - 1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found)], names=[*keep, "_fp"])

    return common.giving_way(docs, "_fp", "_text_").select(*keep, F.col("text").alias("_text_")).mapInArrow(each, schema)


def frequent(docs: DataFrame, *, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles' hashes that come up in four or more of a sample of texts, in order, and how often. What is not among them counts as rare: this moves a shingle within the order and drops nothing."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.unique(shingle_hashes(t, shingle)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).astype(np.uint64).view(np.int64) if own else np.zeros(0, dtype=np.int64))], names=["_k"])

    every = max(1, docs.count() // SAMPLE)
    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").mapInArrow(each, "_k long")
    top = some.groupBy("_k").agg(F.count("*").alias("_n")).filter("_n >= 4").orderBy(F.desc("_n"), "_k").limit(FREQUENT).collect()
    keys, n = np.array([r["_k"] for r in top], dtype=np.int64).view(np.uint64), np.array([r["_n"] for r in top], dtype=np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def ordered_last(docs: DataFrame, similarity: float, *, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """frequent(), and those of the shingles that then come first which SHARED or more different texts of a fixed share have: shingles too rare for a sample of bounded size, under which many texts of a large table meet. Like it, this orders shingles and drops nothing."""
    keys, counts = frequent(docs, shingle=shingle)

    least = max(0.0, 1 - PART * (1 - similarity))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [leading(np.unique(shingle_hashes(t, shingle).astype(np.uint64)), least, keys, counts) for t in b.column(1).to_pylist()]
            bits = np.repeat(b.column(0).to_numpy(), [len(h) for h in own])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64) if own else np.zeros(0, dtype=np.int64)), pa.array(bits)], names=["_k", "_bit"])

    row = F.xxhash64(F.coalesce("text", F.lit("")))
    some = docs.filter(F.pmod(row, F.lit(SHARE)) == 0).select(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(row, 8), F.lit(64)).cast("int")).alias("_bit"), "text")
    led = some.mapInArrow(each, "_k long, _bit long").groupBy("_k").agg(F.count("*").alias("_n"), F.bit_count(F.bit_or("_bit")).alias("_texts"))
    top = led.filter(F.col("_texts") >= SHARED).orderBy(F.desc("_texts"), F.desc("_n"), "_k").limit(FREQUENT).collect()  # copies of a text count once
    also, n = np.array([r["_k"] for r in top], dtype=np.int64).view(np.uint64), np.array([r["_n"] for r in top], dtype=np.int64)
    new = ~np.isin(also, keys)  # of a frequent one the sample's count stands
    keys, counts = np.concatenate([keys, also[new]]), np.concatenate([counts, n[new]])
    order = np.argsort(keys)
    return keys[order], counts[order]


def leading(h: np.ndarray, similarity: float, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of a set of shingles (distinct, in order) the first ones, rare before frequent and then by hash: as many as a similar set cannot do without all of."""
    n = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1 if len(h) else 0
    if len(keys) and len(h):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        seen = np.where(keys[at] == h, counts[at], 0)
        if seen.any():
            return h[np.argsort(seen, kind="stable")[:n]]
    return h[:n]


def parities(h: np.ndarray) -> np.ndarray:
    """For each of two buckets a shingle, or a few more (a power of two, PARITIES at least), whether a set has an odd number of shingles in it, as longs. Two sets differ in at least as many shingles as they do in these bits."""
    buckets = max(PARITIES, 1 << (2 * len(h) - 1).bit_length()) if len(h) else PARITIES
    odd = np.bincount((h & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def halved(odd: Column) -> Column:
    """The parities in half as many buckets."""
    half = (F.size(odd) / 2).cast("int")
    return F.zip_with(F.slice(odd, F.lit(1), half), F.slice(odd, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def bits_apart(a: Column, b: Column) -> Column:
    """In how many bits the parities of two sets differ, whose sizes are less than a factor of two apart (null beyond)."""
    one, two = F.when(F.size(a) > F.size(b), halved(a)).otherwise(a), F.when(F.size(b) > F.size(a), halved(b)).otherwise(b)
    return F.aggregate(F.zip_with(one, two, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)


def described(docs: DataFrame, similarity: float, *, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, _fp, _row (the text's hash), _size (distinct shingles), _keys (the leading ones), _odd (parities). Null texts have no words."""
    keys, counts = ordered_last(docs, similarity, shingle=shingle)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sizes, lead, odd = [], [], [], []
            for t in b.column(2).to_pylist():
                h = shingle_hashes(t, shingle)
                fps.append(majority(h))
                h = np.unique(h.astype(np.uint64))
                sizes.append(len(h))
                lead.append(leading(h, similarity, keys, counts).view(np.int64))
                odd.append(parities(h))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), b.column(1), pa.array(sizes, pa.int64()), pa.array(lead, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))], names=["doc_id", "_fp", "_row", "_size", "_keys", "_odd"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row"), "text").mapInArrow(each, "doc_id long, _fp long, _row long, _size long, _keys array<long>, _odd array<long>")


def alike(pairs: DataFrame, docs: DataFrame, similarity: float, *, shingle: int = SHINGLE) -> DataFrame:
    """_a, _b: fingerprints of those pairs of texts (_x, _y, with _a, _b) whose shingles, as sets, reach the similarity. Only the texts of pairs are shuffled."""
    pairs = common.materialize(pairs, "pairs")
    wanted = common.materialize(pairs.select(F.explode(F.array("_x", "_y")).alias("_row")).distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row"), "text").join(wanted, "_row", "left_semi").dropDuplicates(["_row"])
    texts = common.materialize(texts, "pair-texts")
    both = pairs.join(texts.select(F.col("_row").alias("_x"), F.col("text").alias("_t1")), "_x").join(texts.select(F.col("_row").alias("_y"), F.col("text").alias("_t2")), "_y")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct = lru_cache(maxsize=REMEMBERED)(lambda t: np.unique(shingle_hashes(t, shingle)))
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = distinct(x), distinct(y)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["_a", "_b"])

    return both.select("_a", "_b", "_t1", "_t2").mapInArrow(each, "_a long, _b long")


def most_apart(similarity: float, sizes):
    """In how many elements two sets that are similar can differ, by the sum of their sizes."""
    return sizes * ((1 - similarity) / (1 + similarity)) + 1e-6


def meeting(blocks: DataFrame, similarity: float) -> DataFrame:
    """_x, _y: pairs of texts of a block with different _root that sizes and parities do not tell apart. blocks: _k, _i, _j, _row, _root, _size, _odd, all rows of a block together and in order."""

    def found(cols: list[np.ndarray], lo: int, hi: int) -> Iterator[np.ndarray]:
        row, root, size, odd = (c[lo:hi] for c in cols[3:])
        width = np.fromiter(map(len, odd), dtype=np.int64, count=hi - lo)
        at = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
        bits = {w: np.stack(odd[i]).view(np.uint64) for w, i in at.items()}
        for w, own in at.items():
            half = bits[w][:, : w // 2] ^ bits[w][:, w // 2 :] if w // 2 in at else None
            for n, i in enumerate(own):
                sides = [(own[n + 1 :], bits[w][n + 1 :], bits[w][n])]
                if half is not None:
                    sides.append((at[w // 2], bits[w // 2], half[n]))
                for others, theirs, mine in sides:
                    ok = np.flatnonzero((root[others] != root[i]) & (np.minimum(size[others], size[i]) >= similarity * np.maximum(size[others], size[i]) - 1e-9))
                    if len(ok):
                        ok = ok[np.bitwise_count(theirs[ok] ^ mine).sum(axis=1, dtype=np.int64) <= most_apart(similarity, size[others[ok]] + size[i])]
                        if len(ok):
                            yield np.stack([np.full(len(ok), row[i]), row[others[ok]]], axis=1)

    def told(pairs: list[np.ndarray]) -> pa.RecordBatch:
        xy = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["_x", "_y"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, out, n = None, [], 0
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]  # of the last, an array for each row
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            if not len(cols[0]):
                continue
            change = np.zeros(len(cols[0]) - 1, dtype=bool)
            for c in cols[:3]:
                change |= np.diff(c) != 0
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])
            for lo, hi in zip(starts[:-1], starts[1:]):
                for xy in found(cols, lo, hi):
                    out.append(xy)
                    n += len(xy)
                    if n > 1 << 16:
                        yield told(out)
                        out, n = [], 0
            rest = [c[starts[-1] :] for c in cols]
        if rest is not None:
            for xy in found(rest, 0, len(rest[0])):
                out.append(xy)
                n += len(xy)
                if n > 1 << 16:
                    yield told(out)
                    out, n = [], 0
        if out:
            yield told(out)

    return blocks.mapInArrow(each, "_x long, _y long")


def near_links(docs: DataFrame, told: DataFrame, known: DataFrame, similarity: float, *, shingle: int = SHINGLE, block: int = MEETING) -> DataFrame:
    """_a, _b: links between fingerprints that, with the known ones, connect all documents whose shingles (as sets) have a Jaccard similarity of at least `similarity`, directly or by others, and no link below it. told: described(docs).

    Each different text takes part. Under a shingle, all texts are compared with two of them, the smallest and the largest; that is all pairs of up to three. Where more are listed and these links and the known ones leave them in several components, all pairs across components are compared in blocks."""
    one = common.materialize(told.filter("_size > 0").select("_row", "_fp", "_size", "_keys", "_odd").dropDuplicates(["_row"]), "texts")
    posts = one.select(F.explode("_keys").alias("_k"), "_row")
    shared = posts.groupBy("_k").agg(F.count("*").alias("_n"), F.min("_row").alias("_min"), F.max("_row").alias("_max")).filter("_n > 1")
    met = common.materialize(posts.join(shared, "_k"), "met")
    side = lambda a, b, n: one.select(F.col("_row").alias(a), F.col("_fp").alias(b), F.col("_size").alias(f"_s{n}"), F.col("_odd").alias(f"_o{n}"))
    sided = lambda pairs: pairs.join(side("_x", "_a", 1), "_x").join(side("_y", "_b", 2), "_y")
    near = (F.least("_s1", "_s2") >= similarity * F.greatest("_s1", "_s2") - 1e-9) & (bits_apart(F.col("_o1"), F.col("_o2")) <= most_apart(similarity, F.col("_s1") + F.col("_s2")))
    pairs = met.select("_row", F.explode(F.array("_min", "_max")).alias("_c")).filter("_row <> _c").select(F.least("_row", "_c").alias("_x"), F.greatest("_row", "_c").alias("_y")).distinct()
    first = common.materialize(alike(sided(pairs).filter((F.col("_a") != F.col("_b")) & near).select("_x", "_y", "_a", "_b"), docs, similarity, shingle=shingle), "links")
    roots = components(known.unionByName(first))
    of = one.join(roots, one["_fp"] == roots["_node"], "left").select("_row", F.coalesce("_root", "_fp").alias("_root"), "_size", "_odd")
    of = common.materialize(of, "rooted")
    many = met.filter("_n > 3").select("_k", "_n", "_row").join(of.select("_row", "_root"), "_row")
    mixed = many.groupBy("_k").agg(F.min("_root").alias("_l"), F.max("_root").alias("_g")).filter("_l <> _g").select("_k")
    rest = many.join(mixed, "_k", "left_semi").select("_k", "_n", "_row").join(of, "_row")
    blocks = F.ceil(F.col("_n") / block).cast("int")
    mine = F.pmod(F.xxhash64("_row"), F.col("_blocks").cast("long")).cast("int")
    paired = rest.withColumn("_blocks", blocks).withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cut = paired.select("_k", F.least("_mine", "_other").alias("_i"), F.greatest("_mine", "_other").alias("_j"), "_row", "_root", "_size", "_odd")
    second = meeting(cut.repartition("_k", "_i", "_j").sortWithinPartitions("_k", "_i", "_j"), similarity).distinct()
    return first.unionByName(alike(sided(second).select("_x", "_y", "_a", "_b"), docs, similarity, shingle=shingle))


@dataclass(frozen=True)
class Plan:
    """Bits of each partition (0: the lowest) and its threshold."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, how many have both; 2,080 rows come to the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), dtype=np.int64), 0
        for b in batches:
            v = b.column(0).to_numpy().view(np.uint64)
            n += len(v)
            ones = ((v[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
            total += (ones.T @ ones).astype(np.int64)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()), pa.array(np.append(total[i, j], n))], names=["i", "j", "n"])

    rows = fps.select("_fp").mapInArrow(each, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((BITS, BITS), dtype=np.int64), 0
    for r in rows:
        if r["i"] < 0:
            n = r["n"]
        else:
            both[r["i"], r["j"]] = both[r["j"], r["i"]] = r["n"]
    return n, both


def grouped(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of about equal size: each starts with the bit least like those placed, and takes the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    like = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, parts = set(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        placed = [b for part in parts for b in part]
        part = [min(left, key=lambda b: (like[b, placed].sum() if placed else -like[b].sum(), b))]
        left.remove(part[0])
        while len(part) < size:
            b = max(left, key=lambda b: (like[b, part].sum(), -b))
            part.append(b)
            left.remove(b)
        parts.append(sorted(part))
    return parts


def within(p: np.ndarray, t: int) -> np.ndarray:
    """Chance that two fingerprints differ in at most 0, 1 .. t of some bits, from the chance of each bit to be set, as if bits were independent."""
    chance = np.zeros(t + 2)
    chance[0] = 1
    for q in 2 * p * (1 - p):
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    return np.cumsum(chance)[: t + 1]


def apart(sample: np.ndarray, p: np.ndarray, part: list[int], t: int) -> np.ndarray:
    """The same chance for a partition's bits, counted over all pairs of a sample, as the bits that share a partition are correlated; where fewer than five pairs are that near, the chance of independent bits."""
    v = sample & np.uint64(sum(1 << b for b in part))
    counts = np.zeros(t + 1)
    for i in range(len(v) - 1):
        counts += np.bincount(np.minimum(np.bitwise_count(v[i + 1 :] ^ v[i]), t + 1), minlength=t + 2)[: t + 1]
    seen = np.cumsum(counts)
    return np.where(seen >= 5, seen / max(len(v) * (len(v) - 1) / 2, 1), within(p[part], t))


def allocate(costs: list[list[float]], need: int) -> tuple[float, tuple[int, ...]]:
    """Least total cost, and thresholds t_i, with a sum of (t_i + 1) of need at least; costs[i][t + 1] is that of threshold t in partition i."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in costs:
        now: dict[int, tuple[float, tuple[int, ...]]] = {}
        for got, (cost, chosen) in best.items():
            for t, c in enumerate(row):
                to, new = min(need, got + t), (cost + c, (*chosen, t - 1))
                if to not in now or new < now[to]:
                    now[to] = new
        best = now
    return best[need]


def planned(fps: DataFrame, *, radius: int = RADIUS) -> Plan:
    """The cheapest of plans with up to radius + 2 partitions. Counts of bits and pairs of bits are over all fingerprints; candidates are estimated from PAIRED of them, which decides costs and no result."""
    n, both = bit_counts(fps)
    p = np.diag(both) / max(n, 1)
    some = fps.orderBy(F.xxhash64("_fp"), "_fp").limit(PAIRED).collect()
    sample = np.array([r["_fp"] for r in some], dtype=np.int64).view(np.uint64)
    ball = lambda w, t: sum(float(np.prod([(w - i) / (i + 1) for i in range(k)])) for k in range(t + 1))
    plans = []
    for m in range(1, radius + 3):
        parts = grouped(n, both, m)
        costs = []
        for part in parts:
            top = min(radius, 2)
            chance = apart(sample, p, part, top)
            costs.append([0.0] + [n * ball(len(part), t) * PROBE_COST + n * n / 2 * float(chance[t]) for t in range(top + 1)])
        if sum(len(c) - 1 for c in costs) > radius:
            plans.append((*allocate(costs, radius + 1), parts))
    cost, thresholds, parts = min(plans, key=lambda x: x[0])
    return Plan(tuple(map(tuple, parts)), thresholds)


def mask(bits) -> int:
    """A signed long with these bits set."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def flips(bits: tuple[int, ...], t: int) -> list[int]:
    """What to XOR a value with to reach all values that differ in at most t of the bits."""
    out = [()]
    for _ in range(t):
        out = list(dict.fromkeys([*out, *(tuple(sorted({*x, b})) for x in out for b in bits if b not in x)]))
    return [mask(x) for x in out]


def probes(fps: DataFrame, plan: Plan) -> DataFrame:
    """_part, _key, _fp for each value that a fingerprint has or probes."""
    keys = [
        F.struct(F.lit(i).alias("_part"), F.col("_fp").bitwiseAND(F.lit(mask(part))).bitwiseXOR(F.lit(x)).alias("_key"))
        for i, (part, t) in enumerate(zip(plan.parts, plan.thresholds, strict=True))
        if t >= 0
        for x in flips(part, t)
    ]
    return fps.select("_fp", F.explode(F.array(*keys)).alias("_k")).select("_k._part", "_k._key", "_fp")


def forest(v: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected among fingerprints v: rows reached from each one not reached before, by exact distances."""
    left, a, b = v, [], []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                a.append(np.full(len(found), at))
                b.append(found)
                todo += list(found)
    empty = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def verified(buckets: DataFrame, radius: int) -> DataFrame:
    """_a, _b of a spanning forest of each bucket. buckets: _bucket columns and _fp, all rows of a bucket together and in order."""

    def told(a: list, b: list) -> pa.RecordBatch:
        cat = lambda x: pa.array(np.concatenate(x).astype(np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([cat(a), cat(b)], names=["_a", "_b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            n = len(cols[0])
            if not n:
                continue
            change = np.zeros(n - 1, dtype=bool)
            for c in cols[:-1]:
                change |= np.diff(c) != 0
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])
            yield from done(cols, starts[:-1], starts[1:])
            rest = [c[starts[-1] :] for c in cols]
        if rest is not None:
            yield from done(rest, np.array([0]), np.array([len(rest[0])]))

    def done(cols: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
        v = cols[-1].view(np.uint64)
        size = hi - lo
        two = lo[size == 2]
        near = np.bitwise_count(v[two] ^ v[two + 1]) <= radius
        a, b = [v[two][near]], [v[two + 1][near]]
        for i in np.flatnonzero(size > 2):
            x = v[lo[i] : hi[i]]
            if size[i] <= 24:  # whether any pair is near is soon known
                if not (np.bitwise_count(x[:, None] ^ x[None, :]) <= radius).sum() > len(x):
                    continue
            fa, fb = forest(np.unique(x), radius)
            a.append(fa)
            b.append(fb)
        if sum(map(len, a)):
            yield told(a, b)

    return buckets.mapInArrow(each, "_a long, _b long")


def links(fps: DataFrame, *, radius: int = RADIUS, plan: Plan | None = None, block: int = BLOCK) -> DataFrame:
    """_a, _b: links between fingerprints (distinct, in _fp) that connect exactly those within radius bits, directly or by others."""
    plan = plan or planned(fps, radius=radius)
    rows = probes(fps, plan)
    large = common.materialize(rows.groupBy("_part", "_key").agg(F.count("*").alias("_n")).filter(F.col("_n") > block), "large")
    if large.isEmpty():
        return verified(rows.repartition("_part", "_key").sortWithinPartitions("_part", "_key", "_fp"), radius)
    sized = rows.join(large, ["_part", "_key"], "left")
    blocks = F.ceil(F.coalesce("_n", F.lit(1)) / block).cast("int")
    mine = F.pmod(F.xxhash64("_fp"), blocks.cast("long")).cast("int")
    paired = sized.withColumns({"_blocks": blocks, "_mine": mine}).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cut = paired.select("_part", "_key", F.least("_mine", "_other").alias("_i"), F.greatest("_mine", "_other").alias("_j"), "_fp")
    return verified(cut.repartition("_part", "_key", "_i", "_j").sortWithinPartitions("_part", "_key", "_i", "_j", "_fp"), radius)


def components(edges: DataFrame) -> DataFrame:
    """_node, _root: the smallest node of each node's component, for nodes with an edge (_a, _b)."""
    return graph.components(edges, "_a", "_b").select(F.col("node").alias("_node"), F.col("component").alias("_root"))


def grouped_documents(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """doc_id, _fp, component_id: the smallest doc_id that links of at most radius bits (and, if a similarity is given, near_links) reach, its own included. One row per row of docs; texts without words have fingerprint 0 and link like any other; null ids take part, but name no component unless all are null."""
    told = common.materialize(fingerprints(docs, shingle=shingle) if similarity is None else described(docs, similarity, shingle=shingle), "fingerprints")
    nodes = common.materialize(told.groupBy("_fp").agg(F.min("doc_id").alias("_least")), "nodes")
    edges = links(nodes.select("_fp"), radius=radius)
    if similarity is not None:
        edges = common.materialize(edges, "close")
        edges = edges.unionByName(near_links(docs, told, edges, similarity, shingle=shingle))
    roots = components(edges)
    of = nodes.join(roots, nodes["_fp"] == roots["_node"], "left").select("_fp", "_least", F.coalesce("_root", "_fp").alias("_root"))
    least = of.groupBy("_root").agg(F.min("_least").alias("component_id"))
    return told.join(of.join(least, "_root").select("_fp", "component_id"), "_fp").select("doc_id", "_fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = grouped_documents(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
