"""Evaluation: retrieval metrics, ranks, failure attribution, gates, validation, splits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import runtime
from ..functions import text as X

#: Of passages longer than HEAD characters the first ones are looked up before the whole.
HEAD = 16
#: The base of hashes, odd; bits of a filter at least and at most; characters that are hashed at once.
BASE, FILTER, TOGETHER = 0x9E3779B97F4A7C15, (1 << 20, 1 << 26), 1 << 16


def flagged(df: DataFrame) -> DataFrame:
    """Adds flags (for each retrieved item whether it is gold; of an item that repeats only the first) and n_gold, from arrays retrieved and gold: for gold lists as short as those of labelled cases."""
    first = F.transform("retrieved", lambda x, i: F.array_position(F.col("retrieved"), x) == i + 1)
    return df.withColumns({"flags": F.zip_with(F.transform("retrieved", lambda x: F.array_contains("gold", x)), first, lambda g, f: g & f), "n_gold": F.size(F.array_distinct("gold"))})


def case_metrics(df: DataFrame, k: int = 5) -> DataFrame:
    """Per case, from flags (in rank order) and n_gold: any hit in the first k, reciprocal rank within them, hits and gold counted, recall against min(gold, k), reciprocal rank over the full list. Null without gold."""
    place = lambda flags: F.nullif(F.array_position(flags, True), F.lit(0))
    head = F.slice("flags", 1, k)
    hits = F.size(F.filter(head, lambda x: x))
    has = F.col("n_gold") > 0
    r_k, r_all = place(head), place(F.col("flags"))
    return df.withColumns({
        "hit": F.when(has, (hits > 0).cast("double")), "rr_k": F.when(has, F.coalesce(1.0 / r_k, F.lit(0.0))), "rr_full": F.when(has, F.coalesce(1.0 / r_all, F.lit(0.0))),
        "n_hits": F.when(has, hits), "recall_k": F.when(has, hits / F.least(F.col("n_gold"), F.lit(k))), "first_rank": r_all.cast("int"),
    })


def metrics_a(cases: DataFrame) -> DataFrame:
    """Any-hit recall, reciprocal rank within k, hits over gold."""
    return cases.agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("recall_at_k"), F.round(F.avg("rr_k"), 6).alias("mrr"), F.round(F.sum("n_hits") / F.sum(F.when(F.col("n_gold") > 0, F.col("n_gold"))), 6).alias("evidence_recall"))


#: Checks of a case that hold, fail or do not apply (true, false, null), and the rates that report them.
CHECKS = {
    "confirmed_when_asked": "confirmation_required_accuracy", "overconfident": "overconfident_answer_rate", "topic_recalled": "long_context_topic_recall", "anchor_recalled": "long_context_anchor_recall", "memory_apart": "memory_source_separation_rate", "source_labelled": "source_label_accuracy",
    "low_tier_warned": "low_credibility_warning_rate", "fell_back": "external_fallback_trigger_accuracy", "ocr_traced": "ocr_trace_completeness", "carried_over": "confirmed_carryover_accuracy", "said_insufficient": "insufficient_evidence_correctness",
}


def report(cases: DataFrame, keys: Sequence[str] = (), *, refusal: Column | None = None) -> DataFrame:
    """Every rate of an evaluation run, one row for each of the keys: counts, retrieval metrics of the answerable cases, citations, refusals, routes, validation, CHECKS, timeouts, ends of streams, and latencies (mean, P50 and P95 by linear interpolation). A rate whose cases are none is null.

    cases: what case_metrics gives, should_answer, should_refuse, answer, citations, evidence, must_cite, validated, risk, route, expected_route, latency_ms, error, done, CHECKS."""
    from . import corpus

    flag = lambda c: c.cast("double")
    answered, refuses = F.col("answer").isNotNull(), F.col("refused") if refusal is None else refusal
    no_answer = ~F.col("should_answer") | F.col("should_refuse")
    answerable = ~no_answer & (F.col("n_gold") > 0)
    cited = F.when(F.size("citations") > 0, F.size(F.array_except("citations", "evidence")) == 0).otherwise(F.lit(False))
    rates = {
        "recall_at_k": F.when(answerable, F.col("hit")), "mrr": F.when(answerable, F.col("rr_k")), "evidence_recall": F.when(answerable, F.col("n_hits") / F.col("n_gold")),
        "citation_valid_rate": F.when(answered & F.col("must_cite") & (F.col("answer") != ""), flag(cited)), "no_answer_accuracy": F.when(no_answer & answered, flag(refuses)), "refusal_correctness": F.when(F.col("should_refuse") & answered, flag(refuses)),
        "route_accuracy": F.when(F.col("expected_route") != "", flag(F.coalesce(F.col("route") == F.col("expected_route"), F.lit(False)))), "validation_pass_rate": F.when(answered, flag(F.col("validated"))), "hallucination_risk_rate": F.when(answered & F.col("validated").isNotNull(), flag(F.coalesce(F.col("risk").isin("medium", "high"), F.lit(False)))),
        **{name: flag(F.col(c)) for c, name in CHECKS.items()}, "timeout_rate": flag(F.coalesce(F.col("error"), F.lit(False))), "done_rate": flag(F.coalesce(F.col("done"), F.lit(False))), "latency_mean": F.col("latency_ms"),
    }
    cases = cases.withColumn("_every", F.lit(0))
    by = ["_every", *keys]
    out = cases.groupBy(*by).agg(F.count("*").alias("cases"), F.count_if(answerable).alias("answerable"), *(F.round(F.avg(c), 6).alias(n) for n, c in rates.items()))
    timed = corpus.percentiles(cases.filter("latency_ms IS NOT NULL"), "latency_ms", by, points=(50, 95)).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), F.round("linear_50", 6).alias("latency_p50"), F.round("linear_95", 6).alias("latency_p95"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return out.join(timed, on, "left").select(*keys, "cases", "answerable", *rates, "latency_p50", "latency_p95")


def metrics_b(cases: DataFrame) -> DataFrame:
    """Hit rate, reciprocal rank over the full list, macro recall; cases without gold are counted as skipped."""
    return cases.agg(F.count("hit").alias("evaluated"), F.count_if(F.col("hit").isNull()).alias("skipped"), F.round(F.avg("hit"), 6).alias("hit_at_k"), F.round(F.avg("rr_full"), 6).alias("mrr_full"), F.round(F.avg("recall_k"), 6).alias("recall_min_k"))


def failures(cases: DataFrame, k: int = 5) -> DataFrame:
    """Failing cases with their buckets: missing gold, gold not retrieved, gold ranked below k, route mismatch."""
    none = F.col("n_gold") == 0
    b = F.array_compact(F.array(F.when(none, F.lit("no_gold")), F.when(~none & F.col("first_rank").isNull(), F.lit("gold_not_retrieved")), F.when(F.col("first_rank") > k, F.lit("gold_ranked_low")), F.when(F.col("route") != F.col("expected_route"), F.lit("route_mismatch"))))
    return cases.withColumn("buckets", b).filter(F.size("buckets") > 0)


def attributed(failed: DataFrame, priority: Sequence[tuple[str, str]]) -> DataFrame:
    """One class for each failing case: that of its first bucket by priority; counts by class."""
    out = F.lit("U")
    for bucket, label in reversed(priority):
        out = F.when(F.array_contains("buckets", bucket), F.lit(label)).otherwise(out)
    return failed.groupBy(out.alias("failure_class")).agg(F.count("*").alias("n"))


def gate(old: DataFrame, new: DataFrame, thresholds: Mapping[str, float], lower_is_better: Sequence[str] = ("latency_p95",)) -> DataFrame:
    """metric, old_value, new_value, delta, passed. old and new: metric, value."""
    t = None
    for name, value in thresholds.items():
        one = F.struct(F.lit(name).alias("metric"), F.lit(float(value)).alias("threshold"))
        t = [one] if t is None else [*t, one]
    spark = old.sparkSession
    limits = spark.range(1).select(F.explode(F.array(*t)).alias("_x")).select("_x.*")
    j = old.withColumnRenamed("value", "old_value").join(new.withColumnRenamed("value", "new_value"), "metric", "full").join(limits, "metric", "left")
    ok = F.when(F.col("threshold").isNull(), F.lit(None).cast("boolean")).when(F.col("metric").isin(*lower_is_better), F.col("new_value") <= F.col("threshold")).otherwise(F.col("new_value") >= F.col("threshold"))
    return j.select("metric", "old_value", "new_value", F.round(F.col("new_value") - F.col("old_value"), 6).alias("delta"), ok.alias("passed"))


def deficits(have: DataFrame, coming: DataFrame, key: str, target: int) -> DataFrame:
    """Per class: counts of both sides, their sum, and what is missing to the target."""
    a, b = have.groupBy(key).agg(F.count("*").alias("have")), coming.groupBy(key).agg(F.count("*").alias("coming"))
    j = a.join(b, key, "full").na.fill(0, ["have", "coming"])
    return j.withColumn("projected", F.col("have") + F.col("coming")).withColumn("deficit", F.greatest(F.lit(0), F.lit(target) - F.col("projected")))


def validated(rows: DataFrame, key: str, rules: Sequence[tuple[str, Column]], unique: bool = True) -> DataFrame:
    """One row per broken rule: key, error. A rule is a condition that must hold (null: broken)."""
    errors = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules)))
    out = rows.select(F.col(key), F.explode(errors).alias("error"))
    if unique:
        twice = rows.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key, F.lit("duplicate_key").alias("error"))
        out = out.unionByName(twice)
    return out


def orphans(rows: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return rows.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti").select(key, F.lit("missing_parent").alias("error"))


def presence(ids: DataFrame, key: str, stores: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """For each id the stores that have it, in order, and a status."""
    out = ids.select(key).distinct()
    for name, (df, column) in stores.items():
        one = df.select(F.col(column).alias(key)).distinct().withColumn(f"_in_{name}", F.lit(True))
        out = out.join(one, key, "left")
    found = F.array_compact(F.array(*(F.when(F.col(f"_in_{n}"), F.lit(n)) for n in stores)))
    return out.select(key, F.array_join(found, ",").alias("present_in"), F.when(F.size(found) == len(stores), "everywhere").when(F.size(found) == 0, "missing").otherwise("partly").alias("status"))


def answer_checks(answers: DataFrame, *, longest: int, refusals: Sequence[str], unsafe: Sequence[str], guards: Sequence[str] = (), asks: Sequence[str] = (), phrases: Sequence[str] = (), slack: float = 1.05) -> DataFrame:
    """Violations and warnings of an answer's contract, whether it passed, and the risk: high with a violation, medium with a warning, else low. answers: query, answer, citations, evidence (ids), evidence_text, needs_evidence, must_cite.

    Violations: a fact without evidence, a citation that is no evidence, no citation, too long (by more than the slack), a phrase of no evidence, quoted terms of the query that the evidence lacks, unsafe wording or no guard where certainty is asked for. Warning: numbers that the evidence lacks. A refusal without evidence passes."""
    has = lambda column, terms: F.exists(X.words_of(list(terms)), lambda t: F.contains(F.lower(X.text(F.col(column))), t)) if terms else F.lit(False)
    refused, some = has("answer", refusals), (F.size("evidence") > 0) | (X.text(F.col("evidence_text")) != "")
    free = F.col("needs_evidence") & ~some & refused
    numbers = F.array_except(X.numbers(F.regexp_replace("answer", r"\[[^\]]*\]", "")), X.numbers(F.col("evidence_text")))
    asked = has("query", asks) & ~refused
    rules = {
        "no_evidence_fact_answer": F.col("needs_evidence") & ~some, "invalid_citation": F.size(F.array_except("citations", "evidence")) > 0, "missing_citation": F.col("must_cite") & some & (F.size("citations") == 0) & ~refused,
        "max_chars_exceeded": F.length("answer") > int(longest * slack), "non_evidence_expression": has("answer", phrases), "evidence_not_support_query": ~refused & (F.size(X.unsupported_terms(F.col("query"), F.col("evidence_text"))) > 0),
        "certainty": asked & has("answer", unsafe) & ~has("answer", guards), "missing_guard": asked & ~has("answer", unsafe) & ~has("answer", guards),
    }
    violations = F.array_compact(F.array(*(F.when(~free & F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))
    warnings = F.array_compact(F.array(F.when(~free & (F.size(numbers) > 0), F.lit("unsupported_number"))))
    out = answers.withColumns({"violations": violations, "warnings": warnings})
    return out.withColumns({"passed": F.size("violations") == 0, "risk": F.when(F.size("violations") > 0, "high").when(F.size("warnings") > 0, "medium").otherwise("low")})


def keyword_gold(cases: DataFrame, docs: DataFrame, key: str, keywords: str, title: str, doc: str) -> DataFrame:
    """key, doc: the documents whose title has any of a case's keywords, letter case aside, as rows (a set has no bound). A title's runs of characters meet the keywords in an equi-join as in containing(), and only their documents' ids go on."""
    wanted = runtime.written(cases.select(key, F.explode(F.transform(keywords, F.lower)).alias("passage")).filter("passage <> ''").distinct(), "wanted")
    found = held(docs.select(doc, F.lower(F.col(title)).alias("text")), [doc], "text", wanted.select("passage").distinct(), "passage")
    return wanted.join(found, "passage").select(key, doc).distinct()


def diagnosed(rows: DataFrame, diagnostics: DataFrame, key: str) -> DataFrame:
    """rows with the columns of their diagnostics (prefixed diag_; of several for a key the first by all columns) and has_diagnosis; rows without any stay."""
    from . import relational

    fields = [c for c in diagnostics.columns if c != key]
    one = relational.latest(diagnostics, [key], [F.col(c).asc_nulls_last() for c in fields])
    one = one.select(key, *(F.col(c).alias(f"diag_{c}") for c in fields), F.lit(True).alias("_has"))
    return rows.join(one, key, "left").withColumn("has_diagnosis", F.coalesce("_has", F.lit(False))).drop("_has")


def existence_summary(found: DataFrame) -> DataFrame:
    """section, name, n: distinct references by status, and by store that has them. found: what presence() gives."""
    status = found.groupBy(F.col("status").alias("name")).agg(F.count("*").alias("n")).withColumn("section", F.lit("status"))
    stores = found.select(F.explode(F.split("present_in", ",")).alias("name")).filter("name <> ''").groupBy("name").agg(F.count("*").alias("n")).withColumn("section", F.lit("store"))
    return status.unionByName(stores).select("section", "name", "n")


def scenario_coverage(cases: DataFrame, scenario: str, required: Sequence[str]) -> DataFrame:
    """scenario, n, required, missing: cases of each scenario (null counts as ''), and the required ones of which there is none."""
    have = cases.groupBy(F.coalesce(scenario, F.lit("")).alias("scenario")).agg(F.count("*").alias("n"))
    must = cases.sparkSession.range(1).select(F.explode(X.words_of(list(required))).alias("scenario")).withColumn("required", F.lit(True))
    both = have.join(must, "scenario", "full").select("scenario", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("required", F.lit(False)).alias("required"))
    return both.withColumn("missing", F.col("required") & (F.col("n") == 0))


def readability(rows: DataFrame, fallback: DataFrame, key: str, text: str, *, marks: int = 4) -> DataFrame:
    """One row of counters: rows with and without a text (a blank one is replaced by that of the fallback's row), with CJK, with replacement characters, with `marks` or more question marks in a row, garbled; blocking rows have no text, a replacement character or such marks, noted ones are garbled alone."""
    spare = fallback.groupBy(key).agg(F.max(text).alias("_spare"))
    t = F.coalesce(F.nullif(X.strip(X.text(F.col(text))), F.lit("")), X.strip(X.text(F.col("_spare"))))
    df = rows.join(spare, key, "left").withColumn("_t", t).withColumns({"_none": F.col("_t") == "", "_lost": F.contains("_t", F.lit("\ufffd")), "_marks": F.contains("_t", F.lit("?" * marks)), "_cjk": X.has_cjk(F.col("_t"))})
    df = df.withColumns({"_block": F.col("_none") | F.col("_lost") | F.col("_marks"), "_bad": ~F.col("_none") & X.garbled(F.col("_t"))})
    counts = {"with_text": ~F.col("_none"), "without_text": F.col("_none"), "with_cjk": F.col("_cjk"), "replacement_char": F.col("_lost"), "question_marks": F.col("_marks"), "garbled": F.col("_bad"), "blocking": F.col("_block"), "noted": F.col("_bad") & ~F.col("_block")}
    return df.agg(F.count("*").alias("rows"), *(F.count_if(c).alias(n) for n, c in counts.items()))


def completeness(samples: DataFrame, required: Sequence[str], rates: Mapping[str, Column], errors: Column, *, source: str) -> DataFrame:
    """One row: samples, sources, the share of required fields that are filled, the share of samples for which each of the rates holds, and errors."""
    filled = sum((F.count_if(X.strip(X.text(F.col(c).cast("string"))) != "") for c in required), F.lit(0))
    share = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    whole = share(F.try_divide(filled, F.count("*") * len(required)))
    return samples.agg(F.count("*").alias("samples"), F.count_distinct(F.nullif(X.text(F.col(source)), F.lit(""))).alias("sources"), whole.alias("required_rate"), *(share(F.avg(c.cast("double"))).alias(n) for n, c in rates.items()), F.count_if(errors).alias("errors"))


def gated(summary: DataFrame, least: Mapping[str, float], most: Mapping[str, float]) -> DataFrame:
    """condition, passed: a summary's figures against least and greatest values, and ready: whether all hold."""
    held = {**{f"{n}_at_least": F.col(n) >= v for n, v in least.items()}, **{f"{n}_at_most": F.col(n) <= v for n, v in most.items()}}
    ready = F.lit(True)
    for c in held.values():
        ready = ready & c
    rows = F.array(*(F.struct(F.lit(n).alias("condition"), c.alias("passed")) for n, c in [*held.items(), ("ready", ready)]))
    return summary.select(F.explode(rows).alias("_x")).select("_x.*")


def winnowed(df: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """key and hashes of a text's runs of length // 2 characters, thinned: of any `length` characters that two texts share, at least one hash is kept in both."""
    k = max(length // 2, 1)
    width = length - k + 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.power(np.uint64(1_000_003), np.arange(k, dtype=np.uint64))
        for b in batches:
            ids, out = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t is None or len(t) < length:
                    continue
                codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
                h = np.zeros(len(codes) - k + 1, dtype=np.uint64)
                for j in range(k):
                    h += codes[j : j + len(h)] * weights[k - 1 - j]
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                low = np.unique(np.lib.stride_tricks.sliding_window_view(h, width).min(axis=1))
                ids += [i] * len(low)
                out.append(low.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))], names=[key, "_h"])

    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(each, f"{key} long, _h long")


def sums(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a text's codes times powers of a base up to each place, and the inverse powers: of any run of characters the two tell a hash."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    power = lambda base: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(len(codes) - 1, 0), base, np.uint64)]))[: len(codes)]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power(BASE))]), power(pow(BASE, -1, 1 << 64))


def places(total: np.ndarray, down: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, salt: int, size: int) -> np.ndarray:
    """Where in a filter of `size` bits, a power of two, the runs from start to end are."""
    h = (total[end] - total[start]) * down[start] ^ np.uint64(salt * 0xD6E8FEB86659FD93 % (1 << 64))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) & np.uint64(size - 1)).astype(np.int64)


def filtered(passages: DataFrame, passage: str) -> tuple[list[int], np.ndarray]:
    """The lengths of passages, and a filter with a bit for each and, of those longer than HEAD, for their first HEAD characters: 64 bits a passage, within FILTER. The driver gets the lengths and the set bits."""
    lengths = sorted(r[0] for r in passages.select(F.length(passage)).distinct().collect() if r[0])
    size = min(max(1 << (64 * passages.count()).bit_length(), FILTER[0]), FILTER[1])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.zeros(0, np.int64)]
            for t in filter(None, b.column(0).to_pylist()):
                total, down = sums(t)
                out += [places(total, down, slice(0, 1), slice(n, n + 1), salt, size) for n, salt in ((len(t), len(t)), (HEAD, 0)) if n <= len(t) and (salt or len(t) > HEAD)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)))], names=["_bit"])

    bits = np.zeros(size, dtype=bool)
    bits[np.array([r[0] for r in passages.select(passage).mapInArrow(each, "_bit long").distinct().collect()], dtype=np.int64)] = True
    return lengths, np.packbits(bits)


def held(rows: DataFrame, keys: Sequence[str], text: str, passages: DataFrame, passage: str) -> DataFrame:
    """keys, passage: for each row the runs of its text that have the length of a passage and pass a filter of bounded size, each once. To be joined with the passages on equality; all that a text holds are among them, but the empty one. No text leaves its task."""
    lengths, packed = filtered(passages, passage)
    short, long = [n for n in lengths if n <= HEAD], [n for n in lengths if n > HEAD]
    schema = T.StructType([*(T.StructField(k, rows.schema[k].dataType) for k in keys), T.StructField(passage, T.StringType())])

    def found(group: list[tuple[int, str]], bits: np.ndarray) -> Iterator[tuple[int, str]]:
        """Rows' numbers and runs, of several texts at once."""
        every = "".join(t for _, t in group)
        ends = np.cumsum([len(t) for _, t in group])
        last = np.repeat(ends, [len(t) for _, t in group])
        total, down = sums(every)
        at, seen = np.arange(len(every)), set()

        def runs(start: np.ndarray, n: int) -> None:
            for row, i in zip(np.searchsorted(ends, start, "right").tolist(), start.tolist(), strict=True):
                seen.add((group[row][0], every[i : i + n]))

        whole = lambda n, salt: np.flatnonzero(bits[places(total, down, slice(0, len(every) - n + 1), slice(n, None), salt, len(bits))] & (at[: len(every) - n + 1] + n <= last[: len(every) - n + 1]))
        for n in short:
            if n <= len(every):
                runs(whole(n, n), n)
        heads = whole(HEAD, 0) if long and HEAD <= len(every) else at[:0]
        for n in long:
            some = heads[heads + n <= last[heads]]
            runs(some[bits[places(total, down, some, some + n, n, len(bits))]], n)
        yield from seen

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(packed).astype(bool)
        for b in batches:
            out, texts, group, size = ([], []), b.column(len(keys)).to_pylist(), [], 0
            made = lambda out, b=b: pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(out[0], pa.int64())) for i in range(len(keys))), pa.array(out[1], pa.string())], names=schema.names)
            for i, t in enumerate(texts):
                if t:
                    group.append((i, t))
                    size += len(t)
                if group and (size >= TOGETHER or i == len(texts) - 1):
                    weight = 0
                    for row, run in found(group, bits):
                        out[0].append(row)
                        out[1].append(run)
                        weight += len(texts[row]) + len(run)
                        if weight >= 8 * TOGETHER:
                            yield made(out)
                            out, weight = ([], []), 0
                    group, size = [], 0
            yield made(out)

    return rows.select(*keys, F.col(text).alias("_text")).mapInArrow(cut, schema)


def containing(texts: DataFrame, text: str, passages: DataFrame, passage: str) -> DataFrame:
    """text, passage: pairs of a text and a passage that it holds as a whole, both given once each. An empty passage is in every text; nulls are in none.

    A text's runs of characters meet the passages in an equi-join, after a filter in the task that cuts them (held())."""
    texts = texts.select(F.col(text).alias("text")).filter("text IS NOT NULL")
    passages = runtime.written(passages.select(F.col(passage).alias("passage")).filter("passage IS NOT NULL").distinct(), "passages")
    pairs = held(texts, ["text"], "text", passages, "passage").join(passages, "passage").select("text", "passage")
    return pairs.unionByName(texts.join(passages.filter("passage = ''"), F.lit(True))).distinct()  # one row


def large_copies(answers: DataFrame, evidence: DataFrame, length: int = 50) -> DataFrame:
    """Pairs of answer and evidence that share a run of `length` characters. Pairs come from thinned hashes (a join, with repeats taken out on both sides first) and are verified on the texts."""
    a, e = winnowed(answers, "answer_id", "answer", length), winnowed(evidence, "evidence_id", "evidence", length)
    pairs = a.join(e, "_h").select("answer_id", "evidence_id").distinct()

    @F.pandas_udf(T.BooleanType())
    def shared(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(t: str, u: str) -> bool:
            runs = {u[i : i + length] for i in range(len(u) - length + 1)}
            return any(t[i : i + length] in runs for i in range(len(t) - length + 1))

        return pd.Series([one(t, u) for t, u in zip(x, y, strict=True)], dtype=bool)

    both = pairs.join(answers, "answer_id").join(evidence, "evidence_id")
    return both.filter(shared("answer", "evidence")).select("answer_id", "evidence_id").distinct()
