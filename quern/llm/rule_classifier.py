"""Quality classifier: a sparse ensemble of rules, compiled into Spark column expressions.

Boosted trees over text statistics are fitted to labelled rows; every path of a tree is a conjunctive
rule; a lasso-penalised logistic regression weighs the rules and drops most. The score is one
column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, textstats, trees

#: The model is fitted on so many labelled rows at most, those of the smallest hashed ids.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
FEATURES = ("log_words", "mean_word", "symbols", "bangs", "pipes", "upper", "digits", "distinct", "adjacent", "dup_lines", "repeats", "line_chars", "stops")


def features() -> list[Column]:
    """FEATURES as expressions over the statistics; each is defined for an empty text."""
    c = lambda name: F.col(textstats.PREFIX + name).cast("double")
    part = lambda a, b: c(a) / F.greatest(c(b), F.lit(1.0))
    return [x.alias(n) for n, x in zip(FEATURES, (
        F.log1p(c("n_words")), part("word_chars", "n_words"), part("n_symbols", "n_chars"), part("n_bangs", "n_words"), part("n_pipes", "n_words"), part("n_upper", "n_chars"), part("n_digits", "n_chars"),
        part("n_distinct", "n_words"), part("n_adjacent", "n_words"), part("n_dup_lines", "n_lines"), part("n_repeat_words", "n_words"), part("n_chars", "n_lines"), part("n_stops", "n_words"),
    ), strict=True)]


@dataclass
class Rules:
    """Conjunctions of (feature, at most, threshold), their weights and the intercept."""

    rules: list[tuple[tuple[int, bool, float], ...]]
    weights: list[float]
    intercept: float

    def matrix(self, x: np.ndarray) -> np.ndarray:
        out = np.ones((len(x), len(self.rules)))
        for k, rule in enumerate(self.rules):
            for f, most, t in rule:
                out[:, k] *= (x[:, f] <= t) == most
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + self.matrix(x) @ np.array(self.weights))))

    def column(self) -> Column:
        """The score as an expression over columns named FEATURES."""
        total = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for f, most, t in rule:
                holds = holds & ((F.col(FEATURES[f]) <= t) if most else (F.col(FEATURES[f]) > t))
            total = total + F.when(holds, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def conjunctions(forest: trees.Forest) -> list[tuple[tuple[int, bool, float], ...]]:
    """Every path once, with the tightest bound for each feature and side."""
    found: dict[tuple, None] = {}
    for tree in forest.trees:
        for path in tree.paths():
            tight: dict[tuple[int, bool], float] = {}
            for f, most, t in path:
                tight[f, most] = min(t, tight.get((f, most), t)) if most else max(t, tight.get((f, most), t))
            found[tuple(sorted((f, most, t) for (f, most), t in tight.items()))] = None
    return list(found)


def lasso(m: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept (not penalised) of the logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    n = len(y)
    mean = m.mean(axis=0)
    centred = m - mean
    size = 0.25 * np.linalg.norm(centred, 2) ** 2 / n + 0.25
    w = v = np.zeros(m.shape[1])
    b = c = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    t = 1.0
    for _ in range(steps):
        err = 1 / (1 + np.exp(-(centred @ v + c))) - y
        step = v - centred.T @ err / n / size
        nw, nb = np.sign(step) * np.maximum(np.abs(step) - penalty / size, 0), c - err.mean() / size
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b - mean @ w)


def fit(x: np.ndarray, y: np.ndarray, *, n_trees: int = 30, depth: int = 3, penalty: float = 5e-4) -> Rules:
    """Without rows, or with one label alone, the score is constant."""
    x, y = np.asarray(x, dtype=float).reshape(-1, len(FEATURES)), np.asarray(y, dtype=float)
    if not len(y) or y.min() == y.max():
        return Rules([], [], 4.0 if not len(y) or y[0] else -4.0)
    out = Rules(conjunctions(trees.fit(x, y, trees=n_trees, depth=depth)), [], 0.0)
    if not out.rules:
        return Rules([], [], float(np.log(y.mean() / (1 - y.mean()))))
    w, b = lasso(out.matrix(x), y, penalty)
    kept = [k for k in np.argsort(-np.abs(w), kind="stable") if abs(w[k]) > 1e-6]
    return Rules([out.rules[k] for k in kept], [float(w[k]) for k in kept], b)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> Rules:
    """Fit on the labelled rows that are not held out, at most sample_rows of them. Only their ids (a bounded table, so broadcast) and their statistics leave the executors' tables. Labels of an id that differ count as their smallest, and of rows that repeat an id the one with the smallest statistics is taken; without a labelled row the score is constant."""
    common.prepare(docs.sparkSession)
    usable = labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    told = textstats.with_stats(found, keep=["doc_id", "_label"]).select("doc_id", "_label", F.struct(*features()).alias("_x"))
    rows = told.groupBy("doc_id", "_label").agg(F.min("_x").alias("_x")).select("doc_id", "_label", "_x.*").toPandas().sort_values("doc_id")
    return fit(rows[list(FEATURES)].to_numpy(), rows["_label"].to_numpy())


def score(docs: DataFrame, rules: Rules, *, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all, if none are named), _score and _predicted: one row per row of docs. Null and empty texts are scored by their statistics, as any; rows that repeat stay and get the same score; an empty table gives none; columns of docs with a result's name give way."""
    docs = common.giving_way(docs, "_score", "_predicted")
    keep = docs.columns if keep is None else keep
    told = textstats.with_stats(docs, keep=keep)
    named = told.select(*(F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep)), *features())
    return named.select(*(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)), rules.column().alias("_score")).withColumn("_predicted", (F.col("_score") >= THRESHOLD).cast("int"))


def op9_rule_ensemble(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rules = train(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, rules, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))
