"""Message sources for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "group_id string, message_id string, sender string, content string, ts timestamp"


def from_bus(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Messages of a Kafka topic; needs Spark's Kafka package. The record key is the group, so a group stays in one partition in order."""
    rows = spark.readStream.format("kafka").options(**options).load()
    body = F.from_json(F.col("value").cast("string"), MESSAGE)
    return rows.select(F.col("key").cast("string").alias("key"), body.alias("m"), "offset").select(F.coalesce("m.group_id", "key").alias("group_id"), "m.message_id", "m.sender", "m.content", "m.ts")


def from_files(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """The same rows from JSON files that arrive in a folder."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_at_once).json(folder)


def once_each(messages: DataFrame, late: str = "1 day") -> DataFrame:
    """Messages of a group once each, however often they are sent within the lateness."""
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["group_id", "message_id"])
