"""Corpus preparation in five stages, each of which works on all rows that the one before it kept.

toxicity (documents that the scorer rejects go), exact dedup, SimHash near-dedup (one document of each group stays), benchmark
decontamination, best-fit packing. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import decontam, exact_dedup, packing, simhash, toxicity
from engram.llm.common import remove, scratch, shared_dir, table, texts
from engram.llm.queries import tokenizer, toxicity_model


def _rows_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, t and row (a struct of all columns, so that no name can clash) of the rows of docs that chosen (doc_id, th) names."""
    chosen = chosen.select("doc_id", "th").distinct()
    a, b = texts(docs, keep=docs.columns).withColumn("th", F.xxhash64("t")).alias("a"), chosen.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th")))
    return joined.select("a.doc_id", "a.t", "a.row")


def _one_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Like _rows_of, for choices of one row of a group: where a row is repeated, one of its repeats stays."""
    rows = _rows_of(docs, chosen)
    repeats = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1)
    rows = rows if repeats.isEmpty() else rows.dropDuplicates(["doc_id", "t"])
    return rows.select("row.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score(docs, toxicity_model(docs, spark, sf_dir), keep=docs.columns)
    return scored.filter("predicted = 0").select("row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _one_each(docs, exact_dedup.exact_groups(docs).filter("kept"))


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row with the smallest doc_id, null ids last, and of those the one with the smallest text hash."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("first")
    return _one_each(docs, simhash.near_duplicates(docs, keyed=True).groupBy("root").agg(first).select("first.doc_id", "first.th"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns)
    return found.filter("not contaminated").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer(), capacity=2048)


STAGES = [("toxicity", clean), ("exact_dedup", distinct), ("simhash", apart), ("decontamination", decontaminated), ("packing", packed)]

#: The toxicity scores come from a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES:
        path = shared_dir(spark)
        with scratch(spark):  # the stage's own tables go when its output is written, and so does its input
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
