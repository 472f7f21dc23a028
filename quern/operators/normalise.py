"""Rows of many shapes to one: alias columns, payloads, nested lines, evidence packs, field-wise merges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Candidate fields and the names they go by in payloads, first that is not blank wins.
CANDIDATE = {
    "id": ("id", "news_id", "doc_id"), "parent_id": ("parent_news_id", "news_id", "doc_id"), "evidence_id": ("evidence_id",), "title": ("title", "headline"),
    "summary": ("summary", "abstract", "description"), "text": ("text", "chunk_text", "content"), "source": ("source", "source_code"), "section": ("section",), "category": ("category",),
    "publish_time": ("publish_time", "created_at", "date"), "chunk_type": ("chunk_type",),
}


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*(F.when(X.strip(c.cast("string")) != "", c.cast("string")) for c in columns))


def aliased(df: DataFrame, fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """One column for each field, from whichever of its names df has."""
    pick = lambda names: [F.col(n) for n in names if n in df.columns]
    return df.select(*((first_filled(*found) if (found := pick(names)) else F.lit(None).cast("string")).alias(f) for f, names in fields.items()))


def payload_fields(payload: Column, fields: Mapping[str, Sequence[str]] = CANDIDATE) -> list[Column]:
    """The same from JSON text."""
    return [first_filled(*(F.get_json_object(payload, f"$.{n}") for n in names)).alias(f) for f, names in fields.items()]


def candidates(points: DataFrame, payload: str, score: str) -> DataFrame:
    """Points of a vector store (JSON payload, score) as candidate rows; the evidence id follows from the id where it is missing; scores have four places."""
    df = points.select(*payload_fields(F.col(payload)), F.round(score, 4).alias("score"))
    return df.withColumn("evidence_id", F.coalesce("evidence_id", F.concat(F.lit("news:"), "id")))


def corpus_keys(source: Column, source_doc: Column) -> tuple[Column, Column]:
    """doc_id source:doc and evidence id news:source:doc."""
    doc = F.concat_ws(":", source, source_doc)
    return doc.alias("doc_id"), F.concat(F.lit("news:"), doc).alias("evidence_id")


def detail(df: DataFrame, labels: Mapping[str, str], prefer_parent: bool = False) -> DataFrame:
    """A detail row: parent or chunk text first, clipped to 260 and 1200 characters, the source's display name."""
    text = first_filled(*([F.col("content"), F.col("text")] if prefer_parent else [F.col("text"), F.col("content")]))
    name = F.coalesce(F.element_at(F.create_map(*(x for k, v in labels.items() for x in (F.lit(k), F.lit(v)))), F.col("source")), F.col("source")) if labels else F.col("source")
    return df.select("doc_id", "title", X.clip(text, 260, "…").alias("brief"), X.clip(text, 1200, "…").alias("body"), name.alias("source_label"))


def nested_lines(raw: Column) -> Column:
    """(text, confidence) of all objects with a text in JSON, in the two usual shapes: a list of objects, or an object with lists of texts and scores side by side."""
    listed = F.from_json(raw, "array<struct<text: string, confidence: double>>")
    sides = F.from_json(raw, "struct<rec_texts: array<string>, rec_scores: array<double>>")
    zipped = F.zip_with(sides["rec_texts"], sides["rec_scores"], lambda t, c: F.struct(t.alias("text"), c.alias("confidence")))
    return F.filter(F.coalesce(F.when(X.text(raw).rlike(r"^\s*\["), listed), zipped, F.array().cast("array<struct<text: string, confidence: double>>")), lambda x: X.strip(X.text(x["text"])) != "")


def merged_maps(old: Column, new: Column) -> Column:
    """Keys of both; a value of the old map that is not blank stays."""
    return F.map_zip_with(old, new, lambda _, a, b: F.when(X.strip(X.text(a)) != "", a).otherwise(b))


def merged_rows(df: DataFrame, keys: Sequence[str], longest: str) -> DataFrame:
    """One row per key: the longest text, first of equals; other columns their smallest value that is not null."""
    others = [c for c in df.columns if c not in (*keys, longest)]
    return df.groupBy(*keys).agg(F.max_by(longest, F.struct(F.length(longest), longest)).alias(longest), *(F.min(c).alias(c) for c in others))


def evidence_pack(df: DataFrame, key: str, most: int = 8) -> DataFrame:
    """JSON of a key's evidence in order of rank; a score of 0 counts as missing."""
    item = F.struct("rank", F.col("evidence_id"), F.nullif("score", F.lit(0.0)).alias("score"))
    rows = df.filter(F.col("rank") <= most).groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_i"))
    return rows.select(key, F.to_json("_i").alias("evidence"))


def traces(df: DataFrame, run: str, json_columns: Sequence[str]) -> DataFrame:
    """Rows for an append-only trace table: arrays and maps as JSON."""
    return df.select(F.lit(run).alias("run_id"), *(F.to_json(c).alias(c) if c in json_columns else F.col(c) for c in df.columns))


def rendered(df: DataFrame, key: str, order: str, title: str) -> DataFrame:
    """A numbered list of a key's titles."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(title).alias("t")))).alias("_i"))
    lines = F.transform("_i", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), X.text(x["t"])))
    return rows.select(key, F.array_join(lines, "\n").alias("text"))
