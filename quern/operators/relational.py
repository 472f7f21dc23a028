"""Relational access: pages, lookups, counters, latest-wins views, upserts, searches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import runtime
from ..functions import text as X


def page(df: DataFrame, order: Sequence[Column], skip: int = 0, limit: int = 10) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(limit)


def page_envelope(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 10) -> DataFrame:
    """A page's rows with the total and whether more follow."""
    total = df.agg(F.count("*").alias("total"))
    rows = page(df, order, (number - 1) * size, size)
    return rows.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > number * size)  # one row


def lookup(df: DataFrame, **keys) -> DataFrame:
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == kv[1]), keys.items(), df).limit(1)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key: what an upsert leaves."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return latest(df, keys, order)


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """The exact row number (from 1) within each key by the order's columns, which must be a total order; a key of any size spreads over many tasks."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), keys, order, "_one", name).drop("_one")


def related(df: DataFrame, key: str, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """For each row the first n others of its group: key, related, rank. Of a group its first n + 1 rows are enough, so a row meets those alone."""
    first = top_per(df, [group], order, n + 1, "_r").select(group, F.col(key).alias("related"), "_r")
    both = df.select(key, group).join(first, group).filter(F.col(key) != F.col("related"))
    return top_per(both, [key], [F.asc("_r")], n).select(key, "related", "rank")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """The sum of a value over the rows of a key up to each row, by the order's columns. Rows are range-partitioned by keys and order, so that a key of any size spreads over many tasks; to the sum within a row's part comes that of its key in the parts before."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = runtime.written(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()), "running")
    inside = placed.withColumn("_in", F.sum(value).over(Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    sizes = placed.groupBy("_part", *keys).agg(F.sum(value).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.coalesce(earlier, F.lit(0)).alias("_before"))
    same = [F.col("_part") == F.col("_p"), *(F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys))]
    return inside.join(before, reduce(lambda a, b: a & b, same)).select(*df.columns, (F.col("_in") + F.col("_before")).alias(name))


def merge_into(old: DataFrame, new: DataFrame, key: str, overwrite: Sequence[str]) -> DataFrame:
    """An upsert that on conflict takes the named columns from the new row (a null there keeps the old value) and all others from the old one."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    kept = F.col(f"o.{key}").isNotNull()
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in overwrite or c == key else F.when(kept, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return joined.select(*(pick(c).alias(c) for c in old.columns))


def patch(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A partial update: columns that the new row sets and that are not null."""
    fields = [c for c in new.columns if c != key]
    n = new.select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    return old.join(n, key, "left").select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in old.columns))


def without(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and the new rows whose key it lacks; of new rows that share a key the first by all columns."""
    fresh = latest(new, [key], [F.col(c).asc_nulls_last() for c in new.columns]).join(old.select(key), key, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def live_owner(tokens: DataFrame, owners: DataFrame, token: str, owner: str, until: str, now: Column) -> DataFrame:
    """token and the owner's row, for tokens that are not over by now; a token that is over, or whose owner is gone, has none."""
    live = tokens.filter(F.col(until) >= now).select(token, F.col(owner).alias("_o"))
    return live.join(owners, F.col("_o") == F.col(owner)).drop("_o")


def incremental(old: DataFrame, new: DataFrame, kinds: Mapping[str, int], *, kind: str, key: str, default: int) -> DataFrame:
    """The rows of new that a load adds: keys that old lacks (of rows that share one the first by all columns), with category_id for their kind, the default for an unknown one."""
    category = F.lit(default)
    for name, number in kinds.items():
        category = F.when(F.col(kind) == name, number).otherwise(category)
    fresh = latest(new, [key], [F.col(c).asc_nulls_last() for c in new.columns])
    return fresh.join(old.select(key), key, "left_anti").withColumn("category_id", category)


def any_contains(columns: Sequence[str], terms: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(t.lower())) for c in columns for t in terms))


def relevance(title: Column, body: Column, terms: Sequence[str], phrase: str, category: Column | None = None) -> Column:
    """5 for each term in the title, 1 for each in the body, 8 for the whole phrase in the title, 1 for a matched category."""
    t, b = F.lower(X.text(title)), F.lower(X.text(body))
    has = lambda c, x: F.contains(c, F.lit(x.lower())).cast("int")
    total = reduce(lambda a, c: a + c, (5 * has(t, x) + has(b, x) for x in terms), F.lit(0))
    total = total + (8 * has(t, phrase) if phrase else 0)
    return total + F.coalesce(category.cast("int"), F.lit(0)) if category is not None else total


def keyword_search(news: DataFrame, terms: Sequence[str], phrase: str, *, limit: int = 5, title_pool: int = 200, broad_pool: int = 400) -> DataFrame:
    """Title hits and the newest broad hits, first wins by id, by score and time; the limit is held to 1..8."""
    newest = [F.desc("publish_ts"), F.asc("doc_id")]
    titles = news.filter(any_contains(["title"], terms)).orderBy(*newest).limit(title_pool)
    broad = news.filter(any_contains(["title", "content"], terms) | F.col("category").isin(*[t.lower() for t in terms])).orderBy(*newest).limit(broad_pool)
    pool = titles.withColumn("_p", F.lit(0)).unionByName(broad.withColumn("_p", F.lit(1)))
    pool = first_wins(pool, ["doc_id"], [F.asc("_p")]).drop("_p")
    score = relevance(F.col("title"), F.col("content"), terms, phrase, F.col("category").isin(*[t.lower() for t in terms]))
    return pool.withColumn("relevance", score).orderBy(F.desc("relevance"), *newest).limit(max(1, min(8, limit)))


def in_requested_order(df: DataFrame, key: str, wanted: DataFrame, position: str) -> DataFrame:
    """Rows by a list of keys, in the list's order; keys that df lacks come as rows of nulls, so that the caller can fail on them."""
    return wanted.join(df, key, "left").orderBy(position)


def multi_key(wanted: DataFrame, stores: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """The best hit of each wanted row in stores that are tried in order, by any of its keys in order. wanted: request, key_rank, key; stores: columns among keys."""
    hits = None
    for s, (name, df) in enumerate(stores.items()):
        for k in keys:
            if k in df.columns:
                one = df.filter(F.col(k).isNotNull()).select(F.col(k).cast("string").alias("key"), F.lit(s).alias("_store"), F.lit(name).alias("store"), F.struct(*df.columns).cast("string").alias("payload"))
                hits = one if hits is None else hits.unionByName(one)
    found = wanted.join(hits, "key")
    return first_wins(found, ["request"], [F.asc("_store"), F.asc("key_rank"), F.asc("payload")]).drop("_store")


def two_way_contains(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of left and right of which either text contains the other, letter case aside. Pairs of different texts are found by the runs of characters that the contained one has, whatever the size of either table."""
    from .evaluation import containing

    texts = lambda df, c: df.select(F.lower(F.col(c)).alias("t")).filter("t IS NOT NULL").distinct()
    one, other = texts(left, a), texts(right, b)
    pairs = containing(one, "t", other, "t").select(F.col("text").alias("_a"), F.col("passage").alias("_b")).unionByName(containing(other, "t", one, "t").select(F.col("passage").alias("_a"), F.col("text").alias("_b"))).distinct()
    return left.join(pairs, F.lower(F.col(a)) == F.col("_a")).join(right, F.lower(F.col(b)) == F.col("_b")).drop("_a", "_b")


def recommended(news: DataFrame, order: Sequence[Column], limit: int = 5) -> DataFrame:
    return news.orderBy(*order).limit(max(1, min(8, limit)))


def counter(events: DataFrame, key: str, start: DataFrame | None = None) -> DataFrame:
    """Counts of appended events by key, on top of earlier counts if given."""
    now = events.groupBy(key).agg(F.count("*").alias("n"))
    return now if start is None else now.unionByName(start.select(key, "n")).groupBy(key).agg(F.sum("n").alias("n"))
