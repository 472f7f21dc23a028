"""Scores from an injected scorer: a query with a batch of texts at a time, with attempts, a time-out and rows that say what failed."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .. import runtime

#: Texts of a call, calls of a batch before it counts as failed, seconds that a call may take.
BATCH, ATTEMPTS, SECONDS = 64, 2, 30.0

Scorer = Callable[[str, Sequence[str]], Sequence[float | None]]


def called(scorer: Scorer, pool: ThreadPoolExecutor, query: str, texts: list[str], attempts: int, seconds: float) -> tuple[list[float | None], str | None]:
    """Scores and no error, or no scores and the last attempt's error. A score that is missing or no number is none; as many answers as texts are wanted."""
    error = None
    for _ in range(max(1, attempts)):
        try:
            got = list(pool.submit(scorer, query, texts).result(timeout=seconds))
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} scores for {len(texts)} texts")
            return [None if x is None or x != x else float(x) for x in got], None
        except Late:
            return [None] * len(texts), "late"  # what goes on in the call cannot be stopped, so it is not repeated
        except Exception as e:  # whatever the scorer raises is the batch's result
            error = f"{type(e).__name__}: {e}"
    return [None] * len(texts), error


def scored(candidates: DataFrame, make: Callable[[], Scorer], *, name: str = "remote_score", batch: int = BATCH, attempts: int = ATTEMPTS, seconds: float = SECONDS) -> DataFrame:
    """candidates (query_id, pos, query, text and others) with `name` (null: not scored) and score_error.

    make() is called once in a task, where a model or a connection can be opened, and gives the scorer: (query, texts) to scores. Texts go in calls of `batch` at most, of one query, in the order of pos; a call that fails or is late leaves its rows without a score, and the others as they are. Null queries and texts are empty ones. Rows with a null query_id are one query. ranking.scored_first() and ranking.fusion() take it from there, with the rows that have no score in recall order behind the others."""
    runtime.prepare(candidates.sparkSession)
    rows = candidates.drop(*(c for c in (name, "score_error") if c in candidates.columns))
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType()), T.StructField("score_error", T.StringType())])

    def done(scorer: Scorer, pool: ThreadPoolExecutor, part: pd.DataFrame) -> pd.DataFrame:
        texts = [t or "" for t in part["text"]]
        scores, error = called(scorer, pool, part["query"].iloc[0] or "", texts, attempts, seconds)
        return part.assign(**{name: pd.array(scores, dtype="Float64"), "score_error": error})

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, held = make(), None
        with ThreadPoolExecutor(4) as pool:
            for f in frames:
                f = f if held is None else pd.concat([held, f], ignore_index=True)
                key = f["query_id"].astype("object").where(f["query_id"].notna(), "no id")
                block = (key != key.shift()).cumsum()
                parts = [g.iloc[lo : lo + batch] for _, g in f.groupby(block, sort=False) for lo in range(0, len(g), batch)]
                held = parts.pop() if parts else None  # the last may go on in the next frame
                for p in parts:
                    yield done(scorer, pool, p)
            if held is not None and len(held):
                yield done(scorer, pool, held)

    return rows.repartition("query_id").sortWithinPartitions("query_id", "pos").mapInPandas(each, schema)
