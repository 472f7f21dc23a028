"""Nested JSON of any depth and shape as rows: a VARIANT walked level by level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime


def leaves(df: DataFrame, key: str, json: str) -> DataFrame:
    """key, path, name, value of every leaf of the JSON in a column: path as $.a[0].b, name the last key on the way to it, value as text (null for a JSON null). Empty objects and arrays have no leaf.

    A round opens one level of all documents at once, by a lateral explode, and goes on with what is nested deeper; there are as many rounds as the deepest document has levels, and each is a written table. Texts that are null or no JSON have no rows; rows that repeat a key are walked each."""
    spark = runtime.prepare(df.sparkSession)
    start = df.select(F.col(key).alias("_key"), F.try_parse_json(F.col(json).cast("string")).alias("_v")).filter("_v IS NOT NULL")
    now = start.select("_key", F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), F.to_json("_v").alias("_json"))
    out = None
    while True:
        now = runtime.written(now, "level")  # VARIANT itself is written as its text
        nested = F.col("_json").startswith("{") | F.col("_json").startswith("[")
        done = now.filter(~nested).select("_key", "path", "name", F.try_variant_get(F.parse_json("_json"), "$", "string").alias("value"))
        out = done if out is None else out.unionByName(done)
        deeper = now.filter(nested)
        if deeper.isEmpty():
            break
        inside = deeper.withColumn("_v", F.parse_json("_json")).lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos"), F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
        now = inside.select("_key", F.concat("path", step).alias("path"), F.coalesce("key", "name").alias("name"), F.to_json("value").alias("_json"))
    return out.withColumnRenamed("_key", key)


def found(df: DataFrame, key: str, json: str, names: Sequence[str]) -> DataFrame:
    """key, path, name, value of the leaves that any of the names leads to, wherever they lie: heterogeneous results as one list of lines."""
    return leaves(df, key, json).filter(F.col("name").isin(*names))
