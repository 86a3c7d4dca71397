"""Chained jobs with a table between stages; stages that are done are read, not run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def run_stages(spark: SparkSession, folder: str, stages: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]]) -> dict[str, DataFrame]:
    """Each stage gets the tables of those before it. A stage is done once the mark that is written after its table can be read, so a
    stage that was broken off runs again."""
    tables: dict[str, DataFrame] = {}
    for name, stage in stages:
        path, mark = f"{folder}/{name}", f"{folder}/{name}.done"
        if not _readable(spark, mark):
            stage(tables).write.mode("overwrite").parquet(path)
            spark.range(1).write.mode("overwrite").parquet(mark)
        tables[name] = spark.read.parquet(path)
    return tables


def _readable(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True
