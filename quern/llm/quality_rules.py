"""Quality rules: fixed rules on counts, then robust multivariate outliers per language and source.

The minimum covariance determinant is found by concentration steps over all documents. A step needs,
for each group, the mean and covariance of the share of rows nearest to the last estimate. Rows are
binned by their distance; a bin keeps a count and sums, so a group comes down to a fixed number of
rows by partial aggregation, whatever its size, and the bins up to the share give the next estimate.
Two steps are made from two starts; the start with the smaller determinant then goes on until it falls
no more. Groups that have settled take no part in the steps of the others.

Every group has an estimate of its own, whatever its size: that of a language and source is drawn
towards the language's, and that towards the one of all rows, as if PRIOR rows like those had been
seen besides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chi2, common, textstats

LEAST_WORDS, REPEAT_PERCENT = 10, 20
#: Share of a group that the estimate rests on; tail of the chi-square beyond which a row is rejected.
SHARE, TAIL = 0.75, 1e-7
#: Rows of the wider group that a group's own are joined by.
PRIOR = 50
#: A group's steps end when its log determinant falls by no more than FALL, or after so many; of two starts the better goes on after TRIED steps.
STEPS, FALL, TRIED = 12, 0.01, 2
#: Distances are binned by so many bins for each doubling; rows of a group meet its estimate in so many parts.
BINS, SALTS = 8, 16
DIMS = ("_x0", "_x1", "_x2", "_x3", "_x4")
P = len(DIMS)
#: Standard deviations that are tolerated in each dimension besides the estimated ones, as most rows have no symbol, repeated line or repeated word at all and the estimate of such a share's spread is 0.
TOLERANCE = (0.5, 0.08, 0.04, 0.12, 0.12)
ESTIMATE = "_mean array<double>, _cov array<double>"


def transformed() -> list[Column]:
    """The statistic vector: log words, log mean word length, and square roots of the shares of symbols, repeated lines and repeated words."""
    c = lambda n: F.col(textstats.PREFIX + n).cast("double")
    part = lambda a, b: c(a) / F.greatest(c(b), F.lit(1.0))
    vector = (F.log1p(c("n_words")), F.log1p(part("word_chars", "n_words")), F.sqrt(part("n_symbols", "n_chars")), F.sqrt(part("n_dup_lines", "n_lines")), F.sqrt(part("n_repeat_words", "n_words")))
    return [x.alias(n) for n, x in zip(DIMS, vector, strict=True)]


def tolerant(cov: np.ndarray) -> np.ndarray:
    return cov + np.diag(np.square(TOLERANCE))


def distance() -> Column:
    """Squared Mahalanobis distance to the estimate in _mean and _inverse."""
    dev = [F.col(x) - F.col("_mean")[i] for i, x in enumerate(DIMS)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            total = total + dev[i] * dev[j] * F.col("_inverse")[i * P + j] * (1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


def inverted(estimates: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, _mean, _cov, the tolerant covariance's _inverse and its log determinant _det. A row for each group."""
    schema = ", ".join(f"{k} {estimates.schema[k].dataType.simpleString()}" for k in keys) + f", {ESTIMATE}, _inverse array<double>, _det double"

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            covs = [tolerant(np.array(c, dtype=float).reshape(P, P)) for c in f["_cov"]]
            f["_inverse"] = [np.linalg.inv(c).reshape(-1) for c in covs]
            f["_det"] = [float(np.linalg.slogdet(c)[1]) for c in covs]
            yield f

    return estimates.select(*keys, "_mean", "_cov").mapInPandas(each, schema)


def started(vectors: DataFrame) -> DataFrame:
    """_group, _start, _n and two first estimates of each group: medians and interquartile ranges (0), means and covariances (1). Values are rounded to 0.01 for the quartiles, so a group's distinct values stay few."""
    quarters = [F.expr(f"percentile(round({x}, 2), array(0.25D, 0.5D, 0.75D))").alias(f"_p{i}") for i, x in enumerate(DIMS)]
    moments = [F.covar_pop(DIMS[min(i, j)], DIMS[max(i, j)]).alias(f"_c{i}{j}") for i in range(P) for j in range(i, P)]
    found = vectors.groupBy("_group").agg(F.count("*").alias("_n"), *quarters, *(F.avg(x).alias(f"_m{i}") for i, x in enumerate(DIMS)), *moments)
    spread = [F.pow((F.col(f"_p{i}")[2] - F.col(f"_p{i}")[0]) / 1.349, 2) for i in range(P)]
    robust = F.struct(F.lit(0).alias("_start"), F.array(*(F.col(f"_p{i}")[1] for i in range(P))).alias("_mean"), F.array(*(spread[i] if i == j else F.lit(0.0) for i in range(P) for j in range(P))).alias("_cov"))
    plain = F.struct(F.lit(1).alias("_start"), F.array(*(F.col(f"_m{i}") for i in range(P))).alias("_mean"), F.array(*(F.col(f"_c{min(i, j)}{max(i, j)}") for i in range(P) for j in range(P))).alias("_cov"))
    return found.select("_group", "_n", F.explode(F.array(robust, plain)).alias("_s")).select("_group", "_n", "_s.*")


def concentrated(vectors: DataFrame, last: DataFrame) -> DataFrame:
    """One concentration step for every group and start of last at once: _group, _start, _n, _mean, _cov, _inverse, _det, and the determinant before, _old."""
    bins = F.floor(F.log2(distance() + 1e-6) * BINS).cast("int").alias("_bin")
    sums = [F.sum(x).alias(f"_s{i}") for i, x in enumerate(DIMS)] + [F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"_q{i}{j}") for i in range(P) for j in range(i, P)]
    keys = ["_group", "_start", "_n", "_old"]
    last = last.drop("_old").withColumnRenamed("_det", "_old")
    salted = vectors.withColumn("_salt", F.pmod(F.xxhash64(*DIMS), F.lit(SALTS)).cast("int"))
    copies = last.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    binned = salted.join(copies, ["_group", "_salt"]).select(*keys, bins, *DIMS).groupBy(*keys, "_bin").agg(F.count("*").alias("_c"), *sums)
    correction = SHARE / chi2.cdf(chi2.quantile(SHARE, P), P + 2)

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_bin", kind="stable")
        upto = int(np.searchsorted(rows["_c"].cumsum().to_numpy(), SHARE * rows["_n"].iloc[0])) + 1
        near = rows.iloc[:upto].sum(numeric_only=True)
        n = near["_c"]
        mean = np.array([near[f"_s{i}"] / n for i in range(P)])
        cov = np.array([[near[f"_q{min(i, j)}{max(i, j)}"] / n for j in range(P)] for i in range(P)]) - np.outer(mean, mean)
        cov = (cov - np.diag(np.minimum(np.diag(cov), 0))) * correction  # rounding alone makes a variance negative
        whole = tolerant(cov)
        more = {"_mean": [mean.tolist()], "_cov": [cov.reshape(-1).tolist()], "_inverse": [np.linalg.inv(whole).reshape(-1).tolist()], "_det": [float(np.linalg.slogdet(whole)[1])]}
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in keys}, **more})

    return binned.groupBy(*keys).applyInPandas(step, f"_group string, _start int, _n long, _old double, {ESTIMATE}, _inverse array<double>, _det double")


def fitted(vectors: DataFrame) -> DataFrame:
    """_group, _n, _mean, _cov of every group. Each step's estimates, a row or two for each group that goes on, are written, so that no step is computed twice."""
    now = common.materialize(inverted(started(vectors), ["_group", "_start", "_n"]), "mcd")
    settled = None
    for step in range(1, STEPS + 1):
        now = common.materialize(concentrated(vectors, now), "mcd")
        if step < TRIED:
            continue
        if step == TRIED:
            better = Window.partitionBy("_group").orderBy("_det", "_start")
            now = now.withColumn("_k", F.row_number().over(better)).filter("_k = 1").drop("_k")
        goes_on = (F.col("_old") - F.col("_det") > FALL) if step < STEPS else F.lit(False)
        done = now.filter(~goes_on).select("_group", "_n", "_mean", "_cov")
        settled, now = done if settled is None else settled.unionByName(done), now.filter(goes_on).drop("_old")
        if now.isEmpty():
            break
    return settled


def drawn(own: DataFrame, wider: DataFrame, keys: list[str]) -> DataFrame:
    """Estimates of groups (keys, _up, _n, _mean, _cov) drawn towards the wider group's (_up, _mean, _cov): means and covariances are weighed by their rows, PRIOR of the wider one. That the means differ adds no spread: a group that is one outlier would hide itself."""
    schema = ", ".join(f"{k} {own.schema[k].dataType.simpleString()}" for k in keys) + f", {ESTIMATE}"
    both = own.join(wider.select("_up", F.col("_mean").alias("_wm"), F.col("_cov").alias("_wc")), "_up")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            means, covs = [], []
            for n, m, c, wm, wc in zip(f["_n"], f["_mean"], f["_cov"], f["_wm"], f["_wc"], strict=True):
                m, c, wm, wc = (np.array(v, dtype=float) for v in (m, c, wm, wc))
                w = n * SHARE / (n * SHARE + PRIOR)
                means.append(w * m + (1 - w) * wm)
                covs.append(w * c + (1 - w) * wc)
            yield pd.DataFrame({**{k: f[k] for k in keys}, "_mean": means, "_cov": covs})

    return both.select(*keys, "_n", "_mean", "_cov", "_wm", "_wc").mapInPandas(each, schema)


def estimates(told: DataFrame) -> DataFrame:
    """_pair, _mean, _inverse for every language and source of told (_all, _lang, _pair, DIMS)."""
    vectors = told.select(F.explode(F.array("_all", "_lang", "_pair")).alias("_group"), *DIMS)
    found = fitted(vectors)
    names = told.select("_all", "_lang", "_pair").distinct()
    everything = found.join(names.select(F.col("_all").alias("_group")).distinct(), "_group").select(F.col("_group").alias("_up"), "_mean", "_cov")
    langs = found.join(names.select(F.col("_lang").alias("_group"), F.col("_all").alias("_up")).distinct(), "_group")
    langs = drawn(langs, everything, ["_group"]).withColumnRenamed("_group", "_up")
    pairs = found.join(names.select(F.col("_pair").alias("_group"), F.col("_lang").alias("_up")).distinct(), "_group")
    return inverted(drawn(pairs, langs, ["_group"]), ["_group"]).select(F.col("_group").alias("_pair"), "_mean", "_inverse")


def judge(docs: DataFrame, *, tail: float = TAIL) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept: one row per row of docs (rows that repeat stay, and an empty table gives none). Null texts count as empty (and fail the base rules); null languages and sources are groups of their own, apart from empty ones."""
    common.prepare(docs.sparkSession)
    group = lambda *names: F.to_json(F.array(*(F.struct(F.col(n).cast("string").alias("v")) for n in names)))
    keyed = textstats.with_stats(docs.select("doc_id", "text", F.lit("[]").alias("_all"), group("lang").alias("_lang"), group("lang", "source").alias("_pair")), keep=["doc_id", "_all", "_lang", "_pair"])
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    told = common.materialize(keyed.select("doc_id", "_all", "_lang", "_pair", *(F.col(textstats.PREFIX + c).alias(c) for c in counts), *transformed()), "stats")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    near = distance() <= chi2.quantile(1 - tail, P)
    return told.join(common.materialize(estimates(told), "mcd"), "_pair").select("doc_id", *counts, failed.alias("base_failed"), (~failed & near).alias("kept"))


def op4_robust_outliers(spark, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"))
