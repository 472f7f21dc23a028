"""File sources and sinks: JSON lines with errors apart, CSV, workbooks, dated texts; guarded promotion of files."""

from __future__ import annotations

import fnmatch
import hashlib
import io
import re
import time
import zipfile
from collections.abc import Callable, Iterator, Sequence
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import runtime
from ..operators.relational import numbered

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def parse_lines(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parsed rows, and the lines (value) that are no objects; blank lines are in neither."""
    parsed = lines.filter(F.trim("value") != "").withColumn("_r", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull() | ~F.col("value").rlike(r"^\s*\{")
    return parsed.filter(~bad).select("_r.*").drop("_corrupt"), parsed.filter(bad).select("value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and value of text files. Splits are counted where they lie, so a file of any size is read by many tasks."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    return numbered(runtime.written(lines, "lines"), ["_path"], ["_block", "_id"], "line").select("file", "line", "value")


def read_jsonl_errors(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their file and line, and an error for each line that is no object: file, line, error. Blank lines are in neither."""
    parsed = numbered_lines(spark, path).filter(F.trim("value") != "").withColumn("_r", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull() | ~F.col("value").rlike(r"^\s*\{")
    rows = parsed.filter(~bad).select("_r.*", F.col("file").alias("_file"), F.col("line").alias("_line")).drop("_corrupt")
    return rows, parsed.filter(bad).select("file", "line", F.format_string("line %d: not an object", "line").alias("error"))


def read_jsonl(spark: SparkSession, path: str, schema: str, *, strict: bool = False, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows and bad lines; strict: a bad line fails the job."""
    if strict:
        good = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        return (good.limit(most) if most else good), spark.createDataFrame([], "value string")
    good, bad = parse_lines(spark.read.text(path), schema)
    return (good.limit(most) if most else good), bad


def read_gold(spark: SparkSession, path: str, keys: tuple[str, ...] = ("cases", "items", "data", "rows")) -> DataFrame:
    """JSON lines, an array, or an object that wraps an array under one of the keys."""
    df = spark.read.option("multiLine", True).json(path) if not path.endswith(".jsonl") else spark.read.json(path)
    for k in keys:
        if k in df.columns:
            return df.select(F.explode(k).alias("_x")).select("_x.*")
    return df


def required(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """df, or an error that names the first missing or null required field."""
    for f in fields:
        if f not in df.columns:
            raise ValueError(f"missing field {f}")
    bad = df.filter(" OR ".join(f"`{f}` IS NULL" for f in fields)).limit(1).count()
    if bad:
        raise ValueError("a required field is null")
    return df


def read_mixed(spark: SparkSession, folder: str, template: str = "_template") -> DataFrame:
    """All JSON-lines and CSV files of a folder with their file name; rows marked as templates are left out."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().toString() for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    out = None
    for kind, found in (("json", [n for n in names if n.endswith(".jsonl")]), ("csv", [n for n in names if n.endswith(".csv")])):
        if found:
            one = spark.read.json(found) if kind == "json" else spark.read.option("header", True).option("multiLine", True).csv(found)
            one = one.select(*(F.col(c).cast("string").alias(c) for c in one.columns), F.col("_metadata.file_name").alias("_file"))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(folder)
    return out.filter(~F.coalesce(F.lower(template) == "true", F.lit(False))) if template in out.columns else out


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """With a header; a byte-order mark and line breaks in quotes are handled."""
    df = spark.read.option("header", True).option("multiLine", True).option("encoding", "UTF-8").option("escape", '"').csv(path)
    return df.select(*(F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in df.columns))


def read_texts(spark: SparkSession, path: str, hour: int = 19) -> DataFrame:
    """Whole text files with the time that their names tell (yyyymmdd or yyyy-mm-dd, at the hour)."""
    df = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file"))
    part = lambda i: F.regexp_extract("file", r"(\d{4})-?(\d{2})-?(\d{2})", i)
    return df.withColumn("time", F.try_to_timestamp(F.concat_ws("-", part(1), part(2), part(3)), F.lit("yyyy-MM-dd")) + F.expr(f"INTERVAL {hour} HOURS"))


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Paths of all files below a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found, out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True), []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return out


def discovered(spark: SparkSession, folder: str, patterns: Sequence[str], prefer: str = "") -> list[str]:
    """Files below a folder whose name fits any of the patterns, each once: names with the preferred word first, then shorter paths, then by path."""
    name = lambda p: p.rsplit("/", 1)[-1]
    fit = {p for p in listed(spark, folder) if any(fnmatch.fnmatchcase(name(p), x) for x in patterns)}
    return sorted(fit, key=lambda p: (prefer.lower() not in name(p).lower(), len(p), p))


def by_year(spark: SparkSession, path: str, years: list[int], pattern: str = "*.parquet") -> DataFrame:
    """path and content of the files whose name has one of the years; lock files (~$...) and other years are never opened."""
    year = lambda n: re.search(r"(?:19|20)\d{2}", n)
    fit = [p for p in discovered(spark, path, [pattern]) if not (n := p.rsplit("/", 1)[-1]).startswith("~$") and year(n) and int(year(n)[0]) in years]
    files = spark.read.format("binaryFile")
    return files.load(fit) if fit else files.load(path).limit(0)


def sheet_rows(data: bytes) -> Iterator[list[str]]:
    """Rows of a workbook's first sheet; cells stand where their letters say."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.parse(z.open("xl/sharedStrings.xml")).getroot().iter(f"{MAIN}si")]
        first = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0]))[0]
        for _, row in ElementTree.iterparse(z.open(first)):
            if row.tag != f"{MAIN}row":
                continue
            out: list[str] = []
            for c in row.iter(f"{MAIN}c"):
                at = 0
                for letter in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                    at = at * 26 + ord(letter) - 64
                at = at - 1 if at else len(out)
                out += [""] * (at + 1 - len(out))
                value = c.find(f"{MAIN}v")
                if c.get("t") == "s" and value is not None:
                    out[at] = shared[int(value.text)]
                elif c.get("t") == "inlineStr":
                    out[at] = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                elif value is not None:
                    out[at] = value.text or ""
            row.clear()
            yield out


#: Pages that a paged source is asked for at most; fields of an item by which it is known, the first that is not blank.
MOST_PAGES, ITEM_KEYS = 8, ("url", "id", "title")


def read_pages(spark: SparkSession, path: str, *, most: int = MOST_PAGES, items: str = "items", fields: str = "id string, url string, title string, summary string") -> DataFrame:
    """page, position and the fields of a paged service's items, from recorded pages (a JSON object a file, its number the digits before the file's suffix).

    Reading stops as a client's would: at the first page that is missing, cannot be parsed or has no item, and after `most` pages. Items that were seen before, by url, else id, else title, are left out; those with none of them stay. Later files of a page's number take no part."""
    texts = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.[^.]*$", 1).try_cast("int").alias("page"), F.col("_metadata.file_name").alias("_name"), F.from_json("value", f"{items} array<struct<{fields}>>")[items].alias("_items"))
    pages = texts.filter(F.col("page").between(1, most)).groupBy("page").agg(F.min_by("_items", "_name").alias("_items")).filter(F.size(F.coalesce("_items", F.array())) > 0)
    w = Window.orderBy("page")  # `most` rows
    pages = pages.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") == F.col("page"))
    rows = pages.select("page", F.posexplode("_items").alias("position", "_i")).select("page", "position", "_i.*")
    known = F.coalesce(*(F.when(F.trim(c) != "", F.concat(F.lit(f"{c}:"), F.trim(c))) for c in ITEM_KEYS if c in rows.columns), F.concat_ws(":", F.lit("row"), "page", "position"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(known).orderBy("page", "position"))).filter("_n = 1").drop("_n")


def event_parts(lines: DataFrame) -> DataFrame:
    """lines (with a column value) of event streams, those that begin with data: alone, with kind (delta, done or other) and delta: the text that a JSON event adds. A batch and a stream of lines take it alike."""
    body = F.trim(F.substring("value", 6, 1 << 30))
    parsed = F.coalesce(F.get_json_object(body, "$.delta"), F.get_json_object(body, "$.choices[0].delta.content"))
    found = lines.filter(F.col("value").startswith("data:"))
    return found.withColumns({"kind": F.when(body == "[DONE]", "done").when(parsed.isNotNull(), "delta").otherwise("other"), "delta": parsed})


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """file, answer, events, done of recorded event streams: the deltas before the first [DONE] in the order of lines, how many there were, and whether [DONE] came. Files without a data line have no row."""
    parts = event_parts(numbered_lines(spark, path))
    end = F.min(F.when(F.col("kind") == "done", F.col("line"))).over(Window.partitionBy("file"))
    told = parts.withColumn("_end", end).filter(F.col("_end").isNull() | (F.col("line") <= F.col("_end")))
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "delta", F.struct("line", "delta")))), lambda x: x["delta"])
    return told.groupBy("file").agg(F.array_join(texts, "").alias("answer"), F.count_if(F.col("kind") == "delta").alias("events"), F.bool_or(F.col("kind") == "done").alias("done"))


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """path, row (from 0) and cells of every workbook's first sheet; one task reads a workbook."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sheet, at = sheet_rows(data), 0
                while rows := list(islice(sheet, runtime.BATCH_ROWS)):  # a sheet of any length goes out in parts
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(range(at, at + len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["path", "row", "cells"])
                    at += len(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).filter(~F.element_at(F.split("path", "/"), -1).startswith("~$"))
    return files.select("path", "content").mapInArrow(each, "path string, row long, cells array<string>")


def write_jsonl(df: DataFrame, path: str, *, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path)


def write_sections(sections: dict[str, DataFrame], path: str) -> None:
    """Report sections of two columns (label, value) in one CSV."""
    out = None
    for name, df in sections.items():
        one = df.select(F.lit(name).alias("section"), F.col(df.columns[0]).cast("string").alias("label"), F.col(df.columns[1]).cast("string").alias("value"))
        out = one if out is None else out.unionByName(one)
    out.write.mode("overwrite").option("header", True).csv(path)


def overwrite_part(df: DataFrame, path: str, column: str) -> None:
    """Replace only the partitions that df has: an idempotent reload."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def target(df: DataFrame, path: str, *, recreate: bool = False, append: bool = False, dimension: tuple[str, int] | None = None) -> None:
    """Write a table: made new, emptied and made anew, or appended to; one that exists is refused otherwise. dimension: a vector column and its length, which every row must have, or nothing is written."""
    if dimension is not None:
        column, size = dimension
        if not df.filter(F.col(column).isNull() | (F.size(column) != size)).isEmpty():
            raise ValueError(f"a vector of {column} is not of length {size}")
    df.write.mode("overwrite" if recreate else "append" if append else "errorifexists").parquet(path)


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame], *, seconds: int = 3600, now: float | None = None) -> DataFrame:
    """A result that was kept under a key less than `seconds` ago, else made and kept for the next reader. Whatever goes wrong with the folder is a miss: the result is then made and not kept. Entries that are over stay until drop_cached()."""
    now = time.time() if now is None else now
    kept = f"{folder.rstrip('/')}/{hashlib.sha256(key.encode()).hexdigest()}"
    try:
        times = [int(p.rsplit("/at=", 1)[1].split("/")[0]) for p in listed(spark, kept) if "/at=" in p and p.endswith("/_SUCCESS")]
    except Exception:  # no entry, or no folder
        times = []
    fresh = [t for t in times if 0 <= now * 1000 - t < seconds * 1000]
    if fresh:
        try:
            return spark.read.parquet(f"{kept}/at={max(fresh)}")
        except Exception:  # dropped meanwhile
            pass
    df = make()
    try:
        df.write.mode("overwrite").parquet(f"{kept}/at={int(now * 1000)}")
        return spark.read.schema(df.schema).parquet(f"{kept}/at={int(now * 1000)}")
    except Exception:  # the folder cannot be written
        return df


def drop_cached(spark: SparkSession, folder: str, key: str) -> None:
    """Forget what is kept under a key."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{hashlib.sha256(key.encode()).hexdigest()}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def digest(df: DataFrame, key: str) -> str:
    """A digest of all rows that does not depend on their order or place."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    halves = df.select(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)").alias("a"), F.conv(F.substring(row, 16, 15), 16, 10).cast("decimal(38,0)").alias("b")).agg(F.count("*"), F.sum("a"), F.sum("b")).first()
    return hashlib.sha256("|".join(map(str, (*halves, key))).encode()).hexdigest()


def promote(spark: SparkSession, staged: str, official: str, backup: str, *, confirm: str, blockers: DataFrame | None = None) -> dict:
    """Put a staged table in the official one's place: only with the token, rows to promote and no blocker; the old table is kept, and the digest of what was written is told. The new table is written beside the old one and takes its place by renaming, so that a promotion which breaks off leaves one of them whole."""
    if confirm != "promote":
        raise PermissionError("the confirmation token is missing")
    new = spark.read.parquet(staged)
    if new.isEmpty():
        raise ValueError("nothing to promote")
    if blockers is not None and not blockers.isEmpty():
        raise ValueError("validation has blockers")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, beside, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (official, f"{official}.promoting", f"{official}.replaced"))
    store = at.getFileSystem(conf)
    if store.exists(old) and not store.exists(at):
        store.rename(old, at)  # a promotion broke off between its two renames
    new.write.mode("overwrite").parquet(str(beside))
    if store.exists(at):
        spark.read.parquet(official).write.mode("overwrite").parquet(backup)
        store.delete(old, True)
        if not store.rename(at, old):
            raise OSError(f"{official} cannot be moved")
    if not store.rename(beside, at):
        store.rename(old, at)
        raise OSError(f"{official} cannot be replaced")
    store.delete(old, True)
    return {"digest": digest(spark.read.parquet(official), "official"), "backup": backup, "official": official}


def roll_back(spark: SparkSession, report: dict, *, confirm: str) -> None:
    """Undo a promotion, if the official table is still what the promotion wrote."""
    if confirm != "rollback":
        raise PermissionError("the confirmation token is missing")
    if digest(spark.read.parquet(report["official"]), "official") != report["digest"]:
        raise ValueError("the official table has changed since")
    spark.read.parquet(report["backup"]).write.mode("overwrite").parquet(report["official"])
