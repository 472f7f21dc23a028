"""Substring search by an index: which texts hold which three characters, as a written table; rare ones first, verified on texts.

A text in lower case, with two ends behind it, is the set of its grams of three characters. Postings
(gram, id) lie in folders by the gram's hash, sorted by gram, so that a search opens the folders of the
grams that it has chosen, and of those the row groups that can hold them. A term of three characters or
more takes the grams of which fewest texts have any; a shorter one takes all grams that begin with it,
which the folders cannot tell apart. What the postings leave is read as texts and compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import runtime

#: Characters of a gram; folders; grams that a term takes at most; what stands behind a text.
GRAM, FOLDERS, TAKEN = 3, 256, 3
END = "\x00" * (GRAM - 1)


@dataclass(frozen=True)
class Index:
    path: str
    key: str
    folders: int


def folder(gram: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(folders)).cast("int")


@F.pandas_udf(T.ArrayType(T.StringType()))
def grams(texts: pd.Series) -> pd.Series:
    """Distinct grams of a text in lower case and its ends; none of an empty text."""

    def of(t: str | None) -> list[str]:
        t = (t or "").lower()
        return sorted({(t + END)[i : i + GRAM] for i in range(len(t))})

    return texts.map(of)


def build(docs: DataFrame, key: str, text: str, *, path: str | None = None, folders: int = FOLDERS) -> Index:
    """An index of the texts of docs by a key. Null and empty texts have no gram and are found by no term; rows that repeat a key are one text with the grams of all, and verified each. An empty table gives an index that finds nothing."""
    spark = runtime.prepare(docs.sparkSession)
    index = Index(path or runtime.new_path(spark, "substrings"), key, folders)
    add(index, docs, text)
    return index


def add(index: Index, docs: DataFrame, text: str) -> None:
    """More texts, appended as files of their own. A text that takes another's place leaves the old grams, which cost a comparison, and nothing more."""
    spark = runtime.prepare(docs.sparkSession)
    postings = docs.filter(F.col(index.key).isNotNull()).select(F.explode(grams(text)).alias("gram"), F.col(index.key)).distinct()
    postings = runtime.written(postings.withColumn("_folder", folder(F.col("gram"), index.folders)), "postings")
    parts = max(1, min(index.folders, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # a folder's grams go to one task, or to several where they are many: the gram and the key deal them out
    postings.repartitionByRange(parts, "_folder", "gram", index.key).sortWithinPartitions("_folder", "gram", index.key).write.partitionBy("_folder").mode("append").parquet(f"{index.path}/postings")
    counts = postings.groupBy("_folder", "gram").agg(F.count("*").alias("n"))
    counts.repartition(parts, "_folder").sortWithinPartitions("_folder", "gram").write.partitionBy("_folder").mode("append").parquet(f"{index.path}/counts")


def read(spark: SparkSession, index: Index, kind: str | None = None, table: str = "postings") -> DataFrame:
    """A table of the index; an index of no text has tables without rows."""
    schema = {"postings": f"gram string, {index.key} {kind or 'long'}, _folder int", "counts": "gram string, n long, _folder int"}[table]
    return spark.read.schema(schema).parquet(f"{index.path}/{table}")


def chosen(index: Index, terms: DataFrame, term: str = "term") -> DataFrame:
    """term, gram, _folder, needed: for each distinct term its rarest grams, all of which a text needs; a short term's grams, of which a text needs one. A term with a gram that no text has has none."""
    spark = terms.sparkSession
    wanted = terms.select(F.lower(F.col(term)).alias("term")).filter("term <> ''").distinct()
    counts = read(spark, index, table="counts").groupBy("_folder", "gram").agg(F.sum("n").alias("n"))  # each add() has its own
    long = wanted.filter(F.char_length("term") >= GRAM).select("term", F.explode(grams("term")).alias("gram")).filter(~F.contains(F.col("gram"), F.lit("\x00")))
    long = long.withColumn("_folder", folder(F.col("gram"), index.folders)).join(counts, ["_folder", "gram"], "left")
    w = Window.partitionBy("term")
    long = long.withColumns({"_least": F.min(F.coalesce("n", F.lit(0))).over(w), "_k": F.row_number().over(w.orderBy("n", "gram"))}).filter((F.col("_least") > 0) & (F.col("_k") <= TAKEN))
    long = long.select("term", "gram", "_folder", F.count("*").over(w).alias("needed"))
    short = wanted.filter(F.char_length("term") < GRAM).select("term")
    begins = counts.select("gram", "_folder", F.explode(F.array(*(F.substring("gram", 1, k) for k in range(1, GRAM)))).alias("term"))
    short = short.join(begins, "term").select("term", "gram", "_folder", F.lit(1).cast("long").alias("needed"))
    return long.unionByName(short)


def candidates(index: Index, terms: DataFrame, term: str = "term") -> DataFrame:
    """term (in lower case) and the keys of texts that can hold it. The folders to open are named to the scan: at most TAKEN for each term, so that a few terms open a few folders; many terms open all."""
    spark = runtime.prepare(terms.sparkSession)
    grams_ = runtime.written(chosen(index, terms, term), "grams")
    folders = [r[0] for r in grams_.select("_folder").distinct().collect()]  # index.folders at most
    postings = read(spark, index)
    if len(folders) < index.folders:
        postings = postings.filter(F.col("_folder").isin(folders) if folders else F.lit(False))
    hits = postings.join(grams_, ["_folder", "gram"])
    return hits.groupBy("term", index.key).agg(F.count_distinct("gram").alias("_n"), F.max("needed").alias("_needed")).filter(F.col("_n") >= F.col("_needed")).select("term", index.key)


def search(index: Index, docs: DataFrame, text: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """The rows of docs (with the columns that they have) that hold a term, letter case aside, once for each term: the same as a scan of all texts for all terms. An empty or null term finds nothing."""
    near = candidates(index, terms, term).withColumnRenamed("term", "_term")
    both = docs.join(near, index.key).filter(F.contains(F.lower(F.col(text)), F.col("_term")))
    return both.withColumnRenamed("_term", "term")


def holding_any(index: Index, docs: DataFrame, terms: list[str]) -> DataFrame:
    """The rows of docs whose text can hold any of a few terms: what a predicate on the text need read."""
    asked = docs.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    return docs.join(candidates(index, asked).select(index.key).distinct(), index.key, "left_semi")
