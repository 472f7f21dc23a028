"""Structured Streaming over events: tumbling counts, sessions, duplicates, keyed state. Batch frames take the same functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime


def stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A folder of parquet files as a stream; times without a zone are read as UTC."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return timed(df)


def timed(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(df: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of each event type in windows of fixed width."""
    g = df.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(df: DataFrame, width: str = "1 day", slide: str = "12 hours", late: str = "1 hour") -> DataFrame:
    g = df.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(df: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    g = df.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(df: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def merge_counts(old: dict[str, int], rows: pd.DataFrame) -> dict[str, int]:
    """The state's merge, shared by batch and stream."""
    out = dict(old)
    for kind, n in rows.groupby("event_type").size().items():
        out[kind] = out.get(kind, 0) + int(n)
    return out


def running_totals(df: DataFrame) -> DataFrame:
    """Counts of each user's event types so far, kept as state by user; every batch gives the users it changed."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kinds, counts = state.get if state.exists else ([], [])
        now = dict(zip(kinds, counts, strict=True))
        for b in batches:
            now = merge_counts(now, b)
        state.update((list(now), list(now.values())))
        yield pd.DataFrame({"user_id": [key[0]] * len(now), "event_type": list(now), "n": list(now.values())})

    return df.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_type string, n long", "kinds array<string>, counts array<long>", "update", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there and return its in-memory table."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    w.start().awaitTermination()
    return df.sparkSession.table(name)


def last_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """Run a stream of updates over what is there, and give the rows of the last batch that changed each key. A batch is written to a folder of its own in the shared folder, so one that runs twice leaves its rows once."""
    path = runtime.new_path(df.sparkSession, "updates")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={number}")

    w = df.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", runtime.new_path(df.sparkSession, "stream")).trigger(availableNow=True)
    w.start().awaitTermination()
    rows = df.sparkSession.read.schema(df.schema.add("_batch", "long")).option("basePath", path).parquet(path)
    last = rows.groupBy(*keys).agg(F.max("_batch").alias("_batch"))
    return rows.join(last, [*keys, "_batch"]).drop("_batch")
