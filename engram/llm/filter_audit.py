"""Filter interaction audit by a recursive CTE.

Each document becomes a mask of the filters that it fails; masks are counted in cells by part of the corpus. A recursive CTE then
extends prefixes of filter orders by unused letters: each level joins a part's cells, carries the bits that are applied, and emits
the metrics of that step. 325 prefixes of five filters stand for the 600 steps of the 120 orders.
"""

from __future__ import annotations

from functools import reduce
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_SPACES = r"[^\x20\x09-\x0D]+"


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """The failure conditions that a text decides. words: its words, repeats included."""
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > 3 * F.length(text),
        "D": F.length(F.translate(text, "#$%&*|", "")) < F.length(text),
    }


def cells(docs: DataFrame, labels: DataFrame, filters=text_filters, copies: str = "E", part: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, mask, n, good, toxic: the documents of each part (null: empty string) by the filters they fail, bit i for the i-th of
    ``filters`` and the last bit for ``copies``.

    A document fails ``copies`` if a smaller doc_id has the identical text (null: empty; told apart by SHA-256) anywhere in the
    table. Null ids come after all others and are equal among themselves, so of rows with the smallest id none fails. good and
    toxic count documents of which a row of labels (doc_id, quality, toxic) says 1. Long texts are single values; a text or id
    that a third of all rows share is counted before it is dealt, or split by the join. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.select("*", F.regexp_extract_all("t", F.lit(_SPACES), F.lit(0)).alias("w"))
    failing = filters(F.col("t"), F.col("w"))
    bits = reduce(lambda a, b: a + b, [F.when(when, 1 << i).otherwise(0) for i, when in enumerate(failing.values())], F.lit(0))
    measured = written(rows.select("doc_id", F.col("doc_id").isNull().alias("no_id"), "part", bits.alias("mask"), F.unhex(F.sha2("t", 256)).alias("th")))
    of = F.struct("no_id", "doc_id")
    # read anew as tables, so that Spark can split what one text or id has very many rows of
    firsts = written(measured.groupBy("th").agg(F.min(of).alias("first"), F.count("*").alias("size")).filter("size > 1").select(F.col("th").alias("h"), "first"))
    known = written(labels.groupBy(F.col("doc_id").alias("id")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(k) for c, k in (("quality", "q"), ("toxic", "x"))]))
    joined = measured.join(firsts, F.col("th") == F.col("h"), "left").join(known, F.col("doc_id") == F.col("id"), "left")
    copy = F.when(F.col("first") < of, 1 << len(failing)).otherwise(0)
    return joined.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(F.count("*").alias("n"), F.coalesce(F.sum("q"), F.lit(0)).alias("good"), F.coalesce(F.sum("x"), F.lit(0)).alias("toxic"))


#: Sums over the cells x of a part: of documents that fail the new letter and none before, and so on.
_SUM = "aggregate(c.cells, CAST(0 AS BIGINT), (s, x) -> s + CASE WHEN {when} THEN x.{what} ELSE 0 END)"
_HERE = "(x.mask & l.bit) <> 0 AND (x.mask & w.applied) = 0"


def _metric(when: str, what: str = "n") -> str:
    return _SUM.format(when=when, what=what)


def prefixes(counted: DataFrame, letters: str) -> DataFrame:
    """part, prefix, step and the metrics of its last letter, for every order in which some of the letters can be applied. counted: from
    ``cells``, at most 2^n rows a part."""
    spark = counted.sparkSession
    packed = written(counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")))
    names = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(letters))
    walk = f"""WITH RECURSIVE l(letter, bit) AS (VALUES {names}),
        w(part, prefix, applied, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost) MAX RECURSION LEVEL {len(letters) + 1} AS (
        SELECT part, '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {{packed}}
        UNION ALL
        SELECT w.part, concat(w.prefix, l.letter), w.applied | l.bit, w.step + 1, {_metric("(x.mask & (w.applied | l.bit)) = 0")}, {_metric(_HERE)},
            {_metric("(x.mask & l.bit) <> 0 AND (x.mask & w.applied) <> 0")}, {_metric("x.mask = l.bit")}, {_metric(_HERE, "good")}, {_metric(_HERE, "toxic")}
        FROM w JOIN l ON (w.applied & l.bit) = 0 JOIN {{packed}} c ON w.part = c.part)
        SELECT part, prefix, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost FROM w LIMIT ALL"""
    return spark.sql(walk, packed=packed).filter("step > 0")


def audit(counted: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row per part, filter_order (all permutations of the letters) and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley (what the step's filter removes, summed over all orders). Zeros are rows too; no cells give no rows."""
    n = len(letters)
    steps = written(prefixes(counted, letters))
    orders = steps.filter(F.col("step") == n).select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    orders = orders.select("part", "filter_order", F.substring("filter_order", F.lit(1), F.col("step")).alias("prefix"))
    whole = reduce(lambda a, k: F.when(F.col("step") == k, factorial(n - k)).otherwise(a), range(1, n + 1), F.lit(0))  # orders that begin with a prefix
    shapley = steps.groupBy("part", F.right("prefix", F.lit(1)).alias("letter")).agg(F.sum(F.col("removed") * whole).alias("shapley"))
    rows = orders.join(steps, ["part", "prefix"]).withColumn("letter", F.right("prefix", F.lit(1))).join(shapley, ["part", "letter"])
    return rows.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
