"""Large tables that take upserts and deletions by key: a merge rewrites the slots that it touches, and the old side is not shuffled.

A table is a folder. Rows lie in slots (partitions by a hash of the key) and within those in buckets by
the key, each sorted. A version is a small file that names each slot's folder; a merge writes the
touched slots' new folders first, and then the next version's file under a name of its own. Whatever
breaks off before that leaves the version before, whole; slots that a merge does not touch keep their files.
Readers see a version as a bucketed table of the session, so joins and groupings by the key need no exchange of it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import runtime
from ..operators import relational

SLOT = "_slot"


class MergeConflict(RuntimeError):
    """Another merge wrote the version; the merge can be run again on that one."""


@dataclass(frozen=True)
class Version:
    """What a version's file says: the key, the numbers of slots and buckets, the columns and each written slot's folder below the table's."""

    number: int
    key: str
    slots: int
    buckets: int
    schema: str
    places: dict[int, str]


def _paths(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_versions")
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a table's versions, in order; none where there is no table."""
    _, at, store = _paths(spark, path)
    if not store.exists(at):
        return []
    names = [s.getPath().getName() for s in store.listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """A version, the last one unless a number is given."""
    known = versions(spark, path)
    if not known or (number is not None and number not in known):
        raise FileNotFoundError(f"no version {'' if number is None else number} of a table in {path}")
    number = known[-1] if number is None else number
    jvm, at, store = _paths(spark, path)
    stream = store.open(jvm.org.apache.hadoop.fs.Path(at, f"{number:012d}.json"))
    try:
        told = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    return Version(number, told["key"], told["slots"], told["buckets"], told["schema"], {int(k): v for k, v in told["places"].items()})


def _commit(spark: SparkSession, path: str, v: Version) -> Version:
    """Write a version's file beside and rename it, which fails if the name is taken."""
    jvm, at, store = _paths(spark, path)
    store.mkdirs(at)
    beside = jvm.org.apache.hadoop.fs.Path(at, f".{uuid.uuid4().hex}")
    stream = store.create(beside, False)
    stream.write(json.dumps({"key": v.key, "slots": v.slots, "buckets": v.buckets, "schema": v.schema, "places": v.places}).encode())
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(beside, jvm.org.apache.hadoop.fs.Path(at, f"{v.number:012d}.json"), options)
    except Exception as e:
        store.delete(beside, False)
        raise MergeConflict(f"version {v.number} of {path} is there already") from e
    return v


def slot_of(key: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def _write(df: DataFrame, path: str, key: str, buckets: int) -> dict[int, str]:
    """Write rows with their slot, in buckets; the folder of each slot that has rows."""
    spark, folder = df.sparkSession, f"data/{uuid.uuid4().hex}"
    name = f"quern_{uuid.uuid4().hex}"
    full = f"{path.rstrip('/')}/{folder}"
    df.write.partitionBy(SLOT).bucketBy(buckets, key).sortBy(key).option("path", full).format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files stay
    jvm, _, store = _paths(spark, path)
    names = [s.getPath().getName() for s in store.listStatus(jvm.org.apache.hadoop.fs.Path(full))]
    return {int(n.split("=")[1]): f"{folder}/{n}" for n in names if n.startswith(f"{SLOT}=")}


def _checked(df: DataFrame, key: str) -> DataFrame:
    """df, failing when a key is null."""
    if SLOT in df.columns:
        raise ValueError(f"a column may not be called {SLOT}")
    return df.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit(f"{key} is null"))).otherwise(F.col(key)).cast(df.schema[key].dataType))


def _one_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Of rows that share a key the last by the order's columns and then by all. Keys are counted alone first: rows of keys that come once stay where they are, the others are folded before their shuffle, so that a key of any number of rows is one row a task."""
    again = runtime.written(df.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(key).alias("_k")), "repeated")
    if again.isEmpty():
        return df
    here = df[key] == again["_k"]
    last = F.max_by(F.struct(*df.columns), F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate([*order, *df.columns]))))
    folded = df.join(again, here, "left_semi").groupBy(F.col(key).alias("_k")).agg(last.alias("_r")).select("_r.*")
    return df.join(again, here, "left_anti").unionByName(folded)


def create(df: DataFrame, path: str, key: str, *, slots: int = 16, buckets: int = 8, order: Sequence[str] = ()) -> Version:
    """A new table of df's rows, one for each key (of several the last by `order`); an error where there is one. A merge of few keys rewrites a `slots`-th or so for each; a bucket of a slot is a file, so slots * buckets files hold the table."""
    spark = df.sparkSession
    if versions(spark, path):
        raise FileExistsError(f"there is a table in {path}")
    rows = _one_per_key(_checked(df, key), key, order)
    rows = rows.withColumn(SLOT, slot_of(F.col(key), slots)).repartition(buckets, key)
    return _commit(spark, path, Version(1, key, slots, buckets, df.schema.json(), _write(rows, path, key, buckets)))


def _view(spark: SparkSession, path: str, v: Version) -> DataFrame:
    """A version's rows and slots: a bucketed external table in the session's catalog, with each slot's folder as a partition's location."""
    name = f"quern_{uuid.uuid5(uuid.NAMESPACE_URL, path.rstrip('/')).hex}_{v.number}"
    schema = T.StructType.fromJson(json.loads(v.schema))
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
        quoted = f"`{v.key.replace('`', '``')}`"
        spark.sql(f"CREATE TABLE {name} ({columns}, {SLOT} INT) USING parquet PARTITIONED BY ({SLOT}) CLUSTERED BY ({quoted}) SORTED BY ({quoted}) INTO {v.buckets} BUCKETS LOCATION '{path.rstrip('/')}/_view'")
        if v.places:
            parts = " ".join(f"PARTITION ({SLOT}={s}) LOCATION '{path.rstrip('/')}/{p}'" for s, p in sorted(v.places.items()))
            spark.sql(f"ALTER TABLE {name} ADD {parts}")
    return spark.table(name)


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The rows of the last version, or of a numbered one."""
    return _view(spark, path, version(spark, path, number)).drop(SLOT)


def _rewritten(spark: SparkSession, path: str, new: DataFrame, change, after: int | None) -> Version:
    """The next version: change(old rows of the touched slots, new rows) in place of those slots. Both come placed by the key's buckets, the new rows by an exchange, the old ones by their files."""
    v = version(spark, path, after)
    new = runtime.written(new.withColumn(SLOT, slot_of(F.col(v.key), v.slots)), "merge")
    touched = sorted(r[0] for r in new.select(SLOT).distinct().collect())  # slots at most
    if not touched:
        return v
    old = _view(spark, path, v).filter(F.col(SLOT).isin(touched))
    rows = change(old, new.repartition(v.buckets, v.key), v.key)
    places = {s: p for s, p in v.places.items() if s not in touched}
    return _commit(spark, path, Version(v.number + 1, v.key, v.slots, v.buckets, v.schema, {**places, **_write(rows, path, v.key, v.buckets)}))


def _as_stored(spark: SparkSession, path: str, new: DataFrame, after: int | None) -> tuple[str, DataFrame]:
    """The key, and new with the table's columns in their types; columns it lacks are null, others are an error."""
    v = version(spark, path, after)
    schema = T.StructType.fromJson(json.loads(v.schema))
    if unknown := set(new.columns) - set(schema.names):
        raise ValueError(f"the table has no column {sorted(unknown)}")
    return v.key, _checked(new, v.key).select(*((F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def merge(path: str, new: DataFrame, overwrite: Sequence[str], *, order: Sequence[str] = (), after: int | None = None) -> Version:
    """An upsert. A key that the table has takes the named columns from the new row (a null there keeps the old value) and keeps all others; a key that it lacks comes as it is. Of new rows that share a key the last by `order`, then by all columns, counts; a null key is an error, and no new rows leave the version as it is. `after` names the version that the merge must follow (the last one): with two merges on one version, the second is a MergeConflict."""
    key, rows = _as_stored(new.sparkSession, path, new, after)
    rows = _one_per_key(rows, key, order)
    return _rewritten(new.sparkSession, path, rows, lambda old, fresh, k: relational.merge_into(old, fresh, k, overwrite), after)


def delete(path: str, gone: DataFrame, *, after: int | None = None) -> Version:
    """The table without the keys of gone; keys it lacks, null ones too, change no row."""
    spark = gone.sparkSession
    v = version(spark, path, after)
    kind = T.StructType.fromJson(json.loads(v.schema))[v.key].dataType
    keys = gone.select(F.col(v.key).cast(kind).alias(v.key)).filter(F.col(v.key).isNotNull()).distinct()
    return _rewritten(spark, path, keys, lambda old, some, k: old.join(some.select(k), k, "left_anti").select(*old.columns), after)


def forget(spark: SparkSession, path: str, keep: int = 1) -> list[int]:
    """Delete all but the last `keep` versions, their names in the session, and folders that no version names (a merge that broke off leaves such); the numbers deleted. Not beside a running merge or a reader of an old version."""
    known = versions(spark, path)
    old, kept = known[:-keep], [version(spark, path, n) for n in known[-keep:]]
    jvm, at, store = _paths(spark, path)
    for n in old:
        spark.sql(f"DROP TABLE IF EXISTS quern_{uuid.uuid5(uuid.NAMESPACE_URL, path.rstrip('/')).hex}_{n}")
        store.delete(jvm.org.apache.hadoop.fs.Path(at, f"{n:012d}.json"), False)
    named = {p for v in kept for p in v.places.values()}
    data = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/data")
    for folder in store.listStatus(data) if store.exists(data) else []:
        for part in store.listStatus(folder.getPath()):
            if part.isDirectory() and f"data/{folder.getPath().getName()}/{part.getPath().getName()}" not in named:
                store.delete(part.getPath(), True)
    return old
