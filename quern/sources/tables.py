"""The driver's tables, and views of them in the shape of a news corpus."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import prepare

#: The engine takes times as parameters; the catalogue's queries use these.
NOW, AS_OF = 1704067200, "2024-01-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def over(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """A SQL text over frames in place of the tables that it names; the session's own views stay as they are."""
    views = {name: f"quern_{name}_{uuid.uuid4().hex}" for name in frames}
    for name, view in views.items():
        frames[name].createOrReplaceTempView(view)
        sql = re.sub(rf"\b(FROM|JOIN|,) {name}\b", rf"\1 {view}", sql)
    try:
        return spark.sql(sql)  # analysed here and now
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as news: title (first line), content, category (language), source, and a publication time and number of views that follow from the id."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), F.col("lang").alias("category"), "source",
        (F.lit(NOW) - (F.col("doc_id") * 7919 % 4000) * 86400).alias("publish_ts"), (F.col("doc_id") * 37 % 1000).alias("views"), "n_chars",
    )


#: The same view as a common table expression.
NEWS = "news AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS content, lang AS category, source, 1704067200 - (doc_id * 7919 % 4000) * 86400 AS publish_ts, doc_id * 37 % 1000 AS views, n_chars FROM documents)"


def item_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with the item that their properties name."""
    return table(spark, sf_dir, "events").withColumn("item", F.get_json_object("props", "$.k").cast("long"))


EVENTS = "ev AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS item FROM events)"
