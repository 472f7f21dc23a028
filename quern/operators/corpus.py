"""Corpus engineering: chunks, profiles, quality flags, duplicates, tags."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import runtime
from ..functions import dates as D
from ..functions import similarity as S
from ..functions import text as X
from . import relational


def document_chunks(docs: DataFrame, *, size: int = 600, overlap: int = 120, most: int = 8, collection: str = "docs") -> DataFrame:
    """One summary chunk and up to `most` body chunks of each document, with a key, a stable 63-bit id and the text to embed."""

    def chunks(flat: Column) -> Column:
        summary = F.array(F.struct(F.lit("summary").alias("chunk_type"), F.lit(0).alias("chunk_index"), F.substring(flat, 1, 200).alias("chunk_text")))
        bodies = F.transform(X.windows(flat, size, overlap, most), lambda t, i: F.struct(F.lit("body").alias("chunk_type"), i.alias("chunk_index"), t.alias("chunk_text")))
        return F.concat(summary, bodies)

    out = docs.withColumn("_c", F.explode(X.let(X.collapse(F.col("content")), chunks))).select(*docs.columns, "_c.*")
    key = F.concat_ws("|", F.lit(collection), F.concat(F.lit("news:"), F.col("doc_id").cast("string")), "chunk_type", F.col("chunk_index").cast("string"))
    return out.withColumns({"chunk_key": key, "point_id": X.stable_id(key), "embed_text": F.concat_ws("\n", "title", "chunk_text")})


def flags(noise: Sequence[str] = (), date: Column | None = None, as_of: str = "2024-01-31") -> dict[str, Column]:
    """Quality flags of a document with title and content, and the bad states of its date as text if one is given. An empty content is not a short one."""
    t, c = X.strip(X.text(F.col("title"))), X.strip(X.text(F.col("content")))
    n = F.length(c)
    return {
        "empty_title": t == "", "empty_content": c == "", **{f"under_{k}": (n > 0) & (n < k) for k in (80, 200, 500)},
        "garbled_title": X.garbled(F.col("title")), "garbled_content": X.garbled(F.col("content")),
        "html_residue": c.rlike(r"(?i)<(p|div|br|span|a|img|script)\b"), "url_residue": c.rlike(r"https?://"), "tail_noise": X.tail_noise(F.col("content"), noise),
        **({} if date is None else {f"date_{s}": D.parsed(date, as_of)["status"] == s for s in ("missing", "unparseable", "too_old", "future")}),
    }


def flag_counts(docs: DataFrame, marks: Mapping[str, Column]) -> DataFrame:
    """Long form: flag and number of documents, all flags in one pass."""
    one = docs.agg(*(F.count_if(c).alias(k) for k, c in marks.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("flag"), F.col(k).alias("n")) for k in marks))).alias("_x")).select("_x.*")


def flag_examples(docs: DataFrame, marks: Mapping[str, Column], key: str, most: int = 5) -> DataFrame:
    """The first examples of each flag, by key."""
    hit = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in marks.items())))
    long = docs.select(key, F.explode(hit).alias("flag"))
    return long.withColumn("n", F.row_number().over(Window.partitionBy("flag").orderBy(key))).filter(F.col("n") <= most)


def histograms(docs: DataFrame, dims: Mapping[str, Column]) -> DataFrame:
    """Counts along several dimensions in one pass, as rows of dimension, value, n."""
    cols = docs.select(*(c.cast("string").alias(k) for k, c in dims.items()))
    pairs = cols.select(F.explode(F.array(*(F.struct(F.lit(k).alias("dim"), F.coalesce(k, F.lit("")).alias("value")) for k in dims))).alias("_x")).select("_x.*")
    return pairs.groupBy("dim", "value").agg(F.count("*").alias("n"))


def top_share(docs: DataFrame, column: str, k: int) -> DataFrame:
    """The k commonest values with their share of all rows in percent; ties by value."""
    n = docs.groupBy(column).agg(F.count("*").alias("n"))
    total = docs.agg(F.count("*").alias("_t"))
    return n.crossJoin(F.broadcast(total)).select(column, "n", X.percent(F.col("n"), F.col("_t")).alias("percent")).orderBy(F.desc("n"), F.asc(column)).limit(k)  # one row


def percentiles(docs: DataFrame, value: str, keys: Sequence[str], points: Sequence[int] = (50, 90)) -> DataFrame:
    """Percentiles by three rules: nearest rank, rounded index (half to even), linear interpolation. A value's counts stand for its rows, and their running sums spread over many tasks, so that a group's rows need not meet."""
    n = docs.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    total = docs.groupBy(*(F.col(k).alias(f"_g{i}") for i, k in enumerate(keys))).agg(F.count("*").alias("_all"))
    same = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
    run = relational.running_sum(n, keys, [value], "_c", "_to").join(F.broadcast(total) if not keys else total, same)
    at = lambda rank: F.min(F.when(F.col("_to") >= rank, F.col(value)))
    near = lambda p: F.ceil(F.col("_all") * p / 100)
    index = lambda p: F.bround((F.col("_all") - 1) * p / 100.0) + 1
    exact = lambda p: (F.col("_all") - 1) * p / 100.0
    out = run.groupBy(*keys).agg(*(f(p).alias(f"{name}_{p}") for p in points for name, f in (("nearest", lambda p: at(near(p))), ("rounded", lambda p: at(index(p))), ("_lo", lambda p: at(F.floor(exact(p)) + 1)), ("_hi", lambda p: at(F.ceil(exact(p)) + 1)), ("_f", lambda p: F.max(exact(p) - F.floor(exact(p)))))))
    linear = [(F.col(f"_lo_{p}") + (F.col(f"_hi_{p}") - F.col(f"_lo_{p}")) * F.col(f"_f_{p}")).alias(f"linear_{p}") for p in points]
    return out.select(*keys, *(f"{name}_{p}" for p in points for name in ("nearest", "rounded")), *linear)


def recent_windows(docs: DataFrame, ts: str, now: int, days: Sequence[int]) -> DataFrame:
    return docs.agg(*(F.count_if(F.col(ts) >= now - d * 86400).alias(f"last_{d}") for d in days), F.min(ts).alias("first"), F.max(ts).alias("last"))


def exact_duplicates(docs: DataFrame, value: Column) -> DataFrame:
    """Groups of equal values: hash, number of documents, smallest id."""
    return docs.groupBy(F.sha1(X.text(value)).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


def neighbour_pairs(docs: DataFrame, block: Sequence[str], order: Sequence[str], value: str, key: str = "doc_id", window: int = 4) -> DataFrame:
    """Each row with the next `window` rows of its block, by an equi-join on the position: rows that repeat a value stand next to each other. Positions come from a range partitioning, so a block of any size spreads over many tasks."""
    light = relational.numbered(docs.select(*dict.fromkeys([*block, *order, key])), block, [*order, key], "_n").select(*block, "_n", key)
    placed = light.join(docs.select(F.col(key), F.col(value)), key)
    left = placed.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(window)))).withColumn("_to", F.col("_n") + F.col("_k")).select(*block, F.col("_to").alias("_n"), F.col(key).alias("a"), F.col(value).alias("a_value"))
    return left.join(placed.select(*block, "_n", F.col(key).alias("b"), F.col(value).alias("b_value")), [*block, "_n"]).select("a", "b", "a_value", "b_value")


def near_duplicates(docs: DataFrame, block: Sequence[str], order: Sequence[str], value: str, threshold: float, window: int = 4, exact: str | None = None) -> DataFrame:
    """a, b, ratio: each row and those of the next `window` of its block (by order and doc_id) whose ratio reaches the threshold; lengths are compared first. Those with the same value of `exact` are left out.

    Rows are range-partitioned by block and order and compared as they stream by, so a value is shuffled once and a block of any size spreads over many tasks. What meets across partitions are the first rows of a partition's first block and the last of its last."""
    key, place = "doc_id", [*block, *order, "doc_id"]
    same = F.col(exact).cast("string") if exact else F.lit(None).cast("string")
    rows = docs.dropna(subset=list(block)).select(*dict.fromkeys(place), F.col(value).alias("_value"), same.alias("_same"), F.to_json(F.struct(*block)).alias("_block"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *place).sortWithinPartitions(*place).select(key, "_block", "_same", "_value")
    kind = docs.schema[key].dataType
    of = lambda *names: T.StructType([T.StructField(n, kind if n in ("a", "b") else T.DoubleType() if n == "ratio" else T.LongType() if n in ("_part", "_at") else T.StringType()) for n in names])

    def near(x: tuple, y: tuple, sums: dict) -> float:
        """The ratio of two rows of id, block, exact value, value, place; 0 where it is below the threshold."""
        if x[1] != y[1] or (x[2] is not None and x[2] == y[2]) or not S.gate(x[3], y[3], threshold):
            return 0.0
        if x[3] == y[3]:
            return 1.0
        for r in (x, y):
            if r[4] not in sums:
                sums[r[4]] = S.counts(r[3])
        return S.ratio(x[3], y[3], threshold) if S.bound(sums[x[4]], sums[y[4]], len(x[3]) + len(y[3])) >= threshold - S.SLACK else 0.0

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, sums, at = TaskContext.get().partitionId(), [], deque(maxlen=window), {}, 0
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), to_arrow_schema(out).types, strict=True)], names=out.names)
        edge = lambda r: (r[0], None, None, part, r[4], *r[1:4])
        for b in batches:
            found = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                r = (*r, at)
                found += [(x[0], r[0], n, *[None] * 5) for x in last if (n := near(x, r, sums))]
                if len(first) < window and (not first or first[0][1] == r[1]):
                    first.append(r)
                if last and last[-1][1] != r[1]:
                    last.clear()
                    sums.clear()
                last.append(r)
                at += 1
                sums.pop(at - window - 1, None)
            if found:
                yield made(found)
        if rows := list({r[4]: edge(r) for r in (*first, *last)}.values()):
            yield made(rows)

    out = of("a", "b", "ratio", "_part", "_at", "_block", "_same", "_value")
    found = runtime.written(placed.mapInArrow(streamed, out), "near")
    w = Window.partitionBy("_block").orderBy("_part", "_at")
    both = F.array(*(F.lead(F.struct("_part", F.col("a").alias("b"), "_same", "_value"), k).over(w) for k in range(1, window + 1)))
    edges = found.filter("_part IS NOT NULL").withColumn("_next", both)
    across = edges.select("a", "_part", "_block", "_same", "_value", F.explode("_next").alias("_y")).filter("_y._part > _part")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, _, block_, same_, value_, y = (c.to_pylist() for c in b.columns)
            ratios = [near((i, g, s, v, 0), (o["b"], g, o["_same"], o["_value"], 1), {}) for i, g, s, v, o in zip(a, block_, same_, value_, y, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(5).field("b"), pa.array(ratios, pa.float64())], names=["a", "b", "ratio"])

    pairs = found.filter("_part IS NULL").select("a", "b", "ratio").unionByName(across.mapInArrow(met, of("a", "b", "ratio")))
    return pairs.withColumn("ratio", F.round("ratio", 6)).filter((F.col("ratio") >= threshold) & F.col("a").isNotNull() & F.col("b").isNotNull())


def tagged(value: Column, rules: Mapping[str, Sequence[str]], priority: Sequence[str]) -> tuple[Column, Column]:
    """All labels whose keywords a text has (ASCII keywords as whole words in any case, others as substrings), and the first by priority, else other.

    No lambda stands around a text: Spark interprets those, once for each place that names them, where it computes equal parts of generated code once."""
    low = F.lower(X.text(value))

    def has(word: str) -> Column:
        """Whether letters or digits stand beside it is asked only of texts that have it, and only where it stands."""
        word = word.lower()
        found = F.contains(low, F.lit(word))
        return found & low.rlike(rf"{re.escape(word)}(?<![a-z0-9]{re.escape(word)})(?![a-z0-9])") if word.isascii() else found

    marks = {k: F.when(reduce(lambda a, b: a | b, map(has, ws), F.lit(False)), F.lit(k)) for k, ws in rules.items()}
    none = F.lit(None).cast("string")
    return F.array_except(F.array(*marks.values(), none), F.array(none)), F.coalesce(*(marks[p] for p in priority if p in marks), F.lit("other"))


def first_rule(value: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first rule one of whose needles the text has."""
    out = F.lit(default)
    for name, needles in reversed(rules):
        out = F.when(F.exists(X.words_of(needles), lambda n: F.contains(X.text(value), n)), F.lit(name)).otherwise(out)
    return out


def funnel(docs: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """How many rows pass the first stages, in one pass."""
    passed, out = F.lit(True), [F.count("*").alias("scanned")]
    for name, c in stages:
        passed = passed & F.coalesce(c, F.lit(False))
        out.append(F.count_if(passed).alias(name))
    return docs.agg(*out)


def verdicts(ratios: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Ratios in one row with the names of the rules they break and a verdict."""
    broken = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules)))
    return ratios.withColumn("problems", F.array_join(broken, ",")).withColumn("verdict", F.when(F.size(broken) == 0, "ready").when(F.size(broken) <= 2, "repair").otherwise("rebuild"))


def matrix(docs: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    return docs.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def shared_pairs(left: DataFrame, right: DataFrame, terms: str, first: int = 2) -> DataFrame:
    """left_id, right_id, shared: pairs among which each left row's best partner is, with the number of terms that they share.

    A left row meets right rows through its `first` rarest terms; the best of those shares some number of terms. To share as many, a row must have one of the rarest terms up to all but that number less one, so the left row meets others through these alone. Frequent terms, which most pairs have in common, are compared but never joined on."""
    a = runtime.written(left.select("left_id", F.array_distinct(terms).alias("_lt")).filter("left_id IS NOT NULL"), "left")
    b = runtime.written(right.select("right_id", F.array_distinct(terms).alias("_rt")).filter("right_id IS NOT NULL"), "right")
    asked, flat = a.select("left_id", F.explode("_lt").alias("_t")), b.select("right_id", F.explode("_rt").alias("_t"))
    found = flat.join(asked.select("_t").distinct(), "_t", "left_semi").groupBy("_t").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("left_id")
    rare = asked.join(found, "_t").withColumns({"_k": F.row_number().over(w.orderBy("_n", "_t")), "_size": F.count("*").over(w)})
    rare = runtime.written(rare, "terms")

    def met(some: DataFrame) -> DataFrame:
        return some.join(flat, "_t").select("left_id", "right_id").distinct()

    def counted(pairs: DataFrame) -> DataFrame:
        return pairs.join(b, "right_id").join(a, "left_id").select("left_id", "right_id", F.size(F.array_intersect("_lt", "_rt")).alias("shared"))

    near = runtime.written(counted(met(rare.filter(F.col("_k") <= first))), "pairs")
    least = near.groupBy("left_id").agg(F.max("shared").alias("_least"))
    more = rare.join(least, "left_id").filter((F.col("_k") > first) & (F.col("_k") <= F.col("_size") - F.col("_least") + 1))
    return near.unionByName(counted(met(more).join(near.select("left_id", "right_id"), ["left_id", "right_id"], "left_anti")))


def verified_against(left: DataFrame, right: DataFrame, terms: str, least: int = 2) -> DataFrame:
    """Arg-max join: each left row (left_id, terms) with the right row (right_id, terms) that shares most terms, smallest id on ties, and a status. Rows meet through rare terms, as far as a better partner is possible (shared_pairs())."""
    n = shared_pairs(left, right, terms)
    best = n.groupBy("left_id").agg(F.min(F.struct((-F.col("shared")).alias("_s"), "right_id")).alias("_b")).select("left_id", "_b.right_id", (-F.col("_b._s")).alias("shared"))
    status = F.when(F.size(terms) < least, "low_signal").when(F.col("shared").isNull(), "unverified").when(F.col("shared") >= least, "station_matched").otherwise("conflict")
    return left.join(best, "left_id", "left").select("left_id", "right_id", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"), status.alias("status"))
