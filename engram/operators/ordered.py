"""Ranks and running sums within keys of any size.

A window over a key sorts all of its rows in one task. Here the rows are dealt in ranges of key and order, so a key that holds a
third of all rows is cut over many tasks; what stands before a range is known from one row for each key and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.shared import written


def ranked(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "nth") -> DataFrame:
    """Adds the row number in its key, from 1, in the order given: as row_number over a window. Of rows that are equal in the order any
    may be first, the same for all who read the result."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = rows.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.lit(0).alias("__0")] * (not by))
    sort = [*[F.col(f"`{k}`").asc_nulls_first() for k in keys], *by]
    # ids that grow along a sorted partition, and from one range to the next
    placed = written(dealt.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    own = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]
    names = [f"__k{i}" for i in range(len(keys))]
    runs = placed.groupBy(*own, part.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*names).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = written(runs.select(*names, "__part", "__first", before.alias("__before")))  # a row for each key, and range that it reaches into
    same = part == F.col("__part")
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(n))
    nth = F.col("__before") + F.col("__at") - F.col("__first") + 1
    return placed.join(runs, same).select(*[F.col(f"`{c}`") for c in rows.columns], nth.alias(name))


def running_sum(rows: DataFrame, keys: list[str], place: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """Adds the sum of value over the rows of a key up to and with each row, in order of place: whole numbers of which a key has few in
    any ``block`` that follow one another, as ``ranked`` gives them."""
    rows = rows.withColumn("__block", F.floor(F.col(place) / block))
    sums = rows.groupBy(*keys, "__block").agg(F.sum(value).alias("__sum"))
    w = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = written(sums.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__b"), F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__before")))
    same = F.col("__block") == F.col("__b")
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
    inside = F.sum(value).over(Window.partitionBy(*keys, "__block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in ("__block", name)]
    return rows.withColumn("__inside", inside).join(before, same).select(*kept, (F.col("__before") + F.col("__inside")).alias(name))
