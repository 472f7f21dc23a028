"""From raw documents to packed training sequences, one stage after another.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the
last return the columns of documents; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common, line_dedup, packing, pii, rule_classifier, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The near-duplicate stage takes shingles of five words and this similarity.
SHINGLE, SIMILARITY = 5, 0.8


def with_text(docs: DataFrame, text: str) -> DataFrame:
    """docs with another column as its text, and its length."""
    return docs.withColumns({"text": F.col(text), "n_chars": F.char_length(F.col(text)).cast("long")}).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts to be good; it is fitted on the labels of those documents that are not held out."""
    common.prepare(spark)
    rules = rule_classifier.train(docs, common.table(spark, sf_dir, "labels"))
    return rule_classifier.score(docs.select(*COLUMNS), rules).filter(F.col("_predicted") == 1).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others repeat."""
    common.prepare(spark)
    return with_text(line_dedup.dedup(docs.select(*COLUMNS)), "_text")


def one_row_each(docs: DataFrame) -> DataFrame:
    """docs with one row for each id: of rows that repeat one, that with the smallest hash of all columns; rows without an id stay."""
    rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_row"))
    repeated = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_n"), F.min("_row").alias("_least")).filter("_n > 1")
    repeated = common.materialize(repeated, "repeated")
    if repeated.isEmpty():
        return docs.select(*COLUMNS)
    joined = rows.join(repeated, "doc_id", "left").filter("_least IS NULL OR _row = _least")
    again = joined.filter("_least IS NOT NULL").dropDuplicates(["doc_id"])  # rows of one id and hash are equal
    return common.materialize(joined.filter("_least IS NULL").unionByName(again).select(*COLUMNS), "single")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest id's row. Of rows that repeat an id that with the smallest hash takes part; rows without an id stay."""
    common.prepare(spark)
    docs = one_row_each(docs)
    groups = simhash.grouped_documents(docs, shingle=SHINGLE, similarity=SIMILARITY)
    first = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id")
    return docs.join(first, "doc_id", "left_semi").select(*COLUMNS).unionByName(docs.filter(F.col("doc_id").isNull()))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in place of personal data."""
    common.prepare(spark)
    return with_text(pii.pseudonymize(docs.select(*COLUMNS)), "_text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    common.prepare(spark)
    return packing.pack(docs, common.tokenizer_path())


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("pii", private), ("packing", packed)]
#: SQL expresses neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as a table that the next one reads."""
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.materialize(docs, f"stage-{name}")
    return docs
