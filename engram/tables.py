"""The given tables as the engine's collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan of fewer pieces than there are cores, dealt to all of them by the key; what is larger stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def memunits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_id, group_id, lang, subject (first line), summary (first 200 characters), narrative."""
    text = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("unit_id"), F.col("source").alias("group_id"), "lang",
        F.split_part(text, F.lit("\n"), F.lit(1)).alias("subject"), F.substring(text, 1, 200).alias("summary"), text.alias("narrative"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, sender, content, at (epoch seconds): conversations start an hour apart, turns are 30 s apart."""
    start = 1_704_067_200  # 2024-01-01
    return read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("role").alias("sender"), F.coalesce("text", F.lit("")).alias("content"), (F.lit(start) + F.col("conv_id") * 3600 + F.col("turn") * 30).alias("at")
    )


def behaviors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value, props, ts, at (epoch seconds)."""
    ts = F.col("ts").cast("timestamp")
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", ts.alias("ts"), F.unix_seconds(ts).alias("at"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, vector (doubles)."""
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))


def profile_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, version (months since 1992), order_id, priority, price: an order is a saved profile."""
    month = (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate")
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"), month.cast("long").alias("version"), F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price")
    )
