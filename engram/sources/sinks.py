"""Tables kept as partitions, of which a write replaces only those that it has rows for.

Every operation may be repeated after a failure: it ends in the same table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from engram.operators.ordered import ranked
from engram.shared import remove, shared_dir


@dataclass(frozen=True)
class Deleted:
    """deleted: rows that went; partitions: how many were written anew or removed."""

    deleted: int
    partitions: int


def replace(rows: DataFrame, path: str, by: list[str]) -> int:
    """Writes rows as partitions by columns; partitions of other values keep their files. How many rows were written, counted as they were."""
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return seen.get["n"]


def append(rows: DataFrame, path: str, by: list[str]) -> int:
    """Adds rows to what is there; unlike replace, doing it twice adds them twice."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy(*by).parquet(path)
    return seen.get["n"]


def delete(spark: SparkSession, path: str, by: list[str], *conditions: Column) -> Deleted:
    """Deletes the rows of the table at path for which all conditions hold; at least one is needed. Only partitions that lose a row are
    read whole and written anew, and those that lose all go."""
    if not conditions:
        raise ValueError("a deletion needs a condition")
    table = spark.read.parquet(path)
    gone = F.coalesce(reduce(lambda a, b: a & b, conditions), F.lit(False))
    touched = table.filter(gone).select(*by).distinct().collect()  # partitions, not rows
    if not touched:
        return Deleted(0, 0)
    same = lambda r: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(r[c])) for c in by])
    within = table.filter(reduce(lambda a, b: a | b, map(same, touched)))  # prunes the scan to these partitions
    folder = F.regexp_extract(F.input_file_name(), "^(.*)/[^/]*$", 1)
    staged, seen = shared_dir(spark), Observation()
    kept = within.withColumn("__folder", folder).observe(seen, F.count(F.when(gone, 1)).alias("deleted")).filter(~gone)
    kept.write.parquet(staged)
    left = spark.read.parquet(staged)
    full = {r[0] for r in left.select("__folder").distinct().collect()}
    every = {r[0] for r in within.select(folder).distinct().collect()}
    left.drop("__folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    for empty in every - full:
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(empty))
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    remove(spark, staged)
    return Deleted(seen.get["deleted"], len(touched))


def fan_out(children: DataFrame, parents: DataFrame, key: str, kinds: list[str]) -> dict[str, DataFrame]:
    """children: key, kind, embedding and others. By kind the children whose parent is there and that have an embedding, ready for sinks of
    their own. parents: key."""
    usable = children.filter(F.coalesce(F.size("embedding") > 0, F.lit(False))).join(parents.select(key).distinct(), key, "left_semi")
    return {kind: usable.filter(F.col("kind") == kind).drop("kind") for kind in kinds}


def in_chunks(rows: DataFrame, key: str, order: list[str], fields: list[str], most: int = 1000) -> DataFrame:
    """key, chunk (from 0), content: the rows of a key in order as JSON lists of at most most rows, so that a key of any size is many
    values of bounded size."""
    numbered = ranked(rows.select(key, *dict.fromkeys([*order, *fields])), [key], order).withColumn("chunk", F.floor((F.col("nth") - 1) / most))
    lists = numbered.groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct("nth", F.struct(*fields).alias("row")))).alias("rows"))
    return lists.select(key, "chunk", F.to_json(F.transform("rows", lambda r: r["row"])).alias("content"))


class ClusterStore:
    """Cluster indexes of conversations: a partition for each, of rows cluster_id, topic, unit_id, at."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def save(self, members: DataFrame) -> int:
        """members: conv_id, cluster_id, topic, unit_id, at. Replaces the indexes of the conversations that it has."""
        return replace(members.select("conv_id", "cluster_id", "topic", "unit_id", "at"), self.path, ["conv_id"])

    def load(self, conv_id=None) -> DataFrame:
        return self._table() if conv_id is None else self._table().filter(F.col("conv_id") == F.lit(conv_id))

    def conversations(self) -> DataFrame:
        return self._table().select("conv_id").distinct()

    def exists(self, conv_id) -> bool:
        return not self.load(conv_id).isEmpty()

    def delete(self, conv_id) -> bool:
        """Whether there was one."""
        return delete(self.spark, self.path, ["conv_id"], F.col("conv_id") == F.lit(conv_id)).partitions > 0
