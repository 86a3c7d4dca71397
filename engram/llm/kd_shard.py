"""K-d tree sharding by bytes, with DataFrame operations only.

A node of the tree stands for a number of shards. It is split along its widest dimension, at the place where the bytes
before it are the left shards' share: the weighted median where both sides have as many. The place comes from histograms of
bytes over the dimension, narrowed until the share is met; the driver sees bins, never rows. Leaves are shards.

Dimensions are metadata that the text decides (bytes, share of multi-byte characters, line breaks), and the text's
hash orders what is equal in them. So equal texts lie in one shard. Only a group of equal texts of more bytes than a
whole shard should have is dealt row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

_BINS = 4096
DIMENSIONS = 3


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = F.col(text_col).cast("string")
    size = F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 1
    chars = F.coalesce(F.length(t), F.lit(0)).cast("long")
    lines = F.coalesce(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))), F.lit(0)).cast("long")
    text = F.coalesce(t, F.lit("")).cast("binary")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        size.alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
        size.alias("d0"),
        ((size - 1 - chars) * 1_000_000 / size).cast("long").alias("d1"),
        lines.alias("d2"),
        (F.rand(7) * (1 << 40)).cast("long").alias("salt"),
    )


def _case(branches: list[tuple[Column, Column]], default: Column) -> Column:
    out = default
    for when, value in reversed(branches):
        out = F.when(when, value).otherwise(out)
    return out


def _splits(rows: DataFrame, shards: int, tolerance: float) -> Column:
    """The shard of a row. rows: size and the places k0.. of the dimensions, integers of 62 bits."""
    leaves: list[tuple[Column, int, int]] = [(F.lit(True), 0, shards)]  # condition, first shard, how many
    spans = rows.agg(*[f(f"k{d}").alias(f"{n}{d}") for d in range(DIMENSIONS) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    whole = [max(1, (spans[f"hi{d}"] or 0) - (spans[f"lo{d}"] or 0)) for d in range(DIMENSIONS)]
    while any(n > 1 for _, _, n in leaves):
        node = _case([(when, F.lit(i)) for i, (when, _, _) in enumerate(leaves)], F.lit(-1))
        placed = rows.withColumn("node", node)
        found = {
            r.node: r
            for r in placed.groupBy("node")
            .agg(F.sum("size").alias("bytes"), *[f(f"k{d}").alias(f"{n}{d}") for d in range(DIMENSIONS) for n, f in (("lo", F.min), ("hi", F.max))])
            .collect()  # a row for each node
        }
        open_nodes = {}
        for i, (_, _, n) in enumerate(leaves):
            if n > 1 and i in found:
                r = found[i]
                d = max(range(DIMENSIONS), key=lambda d: ((r[f"hi{d}"] - r[f"lo{d}"]) / whole[d], -d))
                open_nodes[i] = {"d": d, "lo": r[f"lo{d}"], "hi": r[f"hi{d}"], "before": 0, "want": r.bytes * (n // 2) / n, "slack": tolerance * r.bytes / n, "at": None}
        while any(x["at"] is None for x in open_nodes.values()):
            own = {i: x for i, x in open_nodes.items() if x["at"] is None}
            for x in own.values():
                x["width"] = max(1, -(-(x["hi"] - x["lo"] + 1) // _BINS))
            at = _case([(F.col("node") == i, F.col(f"k{x['d']}")) for i, x in own.items()], F.lit(None).cast("long"))
            low, high, width = (_case([(F.col("node") == i, F.lit(x[k]).cast("long")) for i, x in own.items()], F.lit(None).cast("long")) for k in ("lo", "hi", "width"))
            inside = placed.select("node", "size", at.alias("at"), low.alias("low"), high.alias("high"), width.alias("width")).filter("at >= low and at <= high")
            bins = inside.groupBy("node", F.expr("(at - low) div width").alias("bin")).agg(F.sum("size").alias("bytes"))
            by_node: dict[int, list] = {}
            for r in bins.collect():  # at most _BINS rows for each node
                by_node.setdefault(r.node, []).append((r.bin, r.bytes))
            for i, x in own.items():
                total = x["before"]
                for k, size in sorted(by_node[i]):
                    if total + size >= x["want"]:
                        start = x["lo"] + k * x["width"]
                        if x["width"] == 1 or min(x["want"] - total, total + size - x["want"]) <= x["slack"]:
                            x["at"] = start if x["want"] - total <= total + size - x["want"] else start + x["width"]
                        else:
                            x["lo"], x["hi"], x["before"] = start, min(x["hi"], start + x["width"] - 1), total
                        break
                    total += size
                else:
                    x["at"] = x["hi"] + 1
        new = []
        for i, (when, first, n) in enumerate(leaves):
            if i in open_nodes:
                x, left = open_nodes[i], n // 2
                before = F.col(f"k{x['d']}") < F.lit(x["at"])
                new += [(when & before, first, left), (when & ~before, first + left, n - left)]
            else:
                new.append((when, first, n if n == 1 else 1))  # an empty node needs no split
        leaves = new
    return _case([(when, F.lit(first)) for when, first, _ in leaves], F.lit(0)).cast("int")


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.002, rows_a_bucket: int = 50_000) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus 1; null counts as empty here and lies with the empty texts. Shards are 0 .. shards-1
    and of nearly equal bytes; equal texts, repeated rows included, lie in one shard unless they alone exceed one. Slots are
    gapless from 0 in each shard. Null ids are rows like others. An empty table gives no rows; other columns are not read.
    """
    rows = written(_measured(docs, id_col, text_col))
    total = rows.agg(F.sum("size"), F.count("*")).first()
    if not total[1]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # groups of more bytes than a shard: fewer than there are shards
    large = [r["hash"] for r in rows.groupBy("hash", "size").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > total[0] / shards).collect()]
    row_hash = F.xxhash64("salt", "hash")  # whatever their ids: they may be null or one
    tie = F.when(F.col("hash").isin(large), row_hash).otherwise(F.col("hash")) if large else F.col("hash")
    low = tie.bitwiseAND(F.lit((1 << 31) - 1))
    placed = rows.select("*", *[(F.shiftleft(F.least(F.col(f"d{d}"), F.lit((1 << 31) - 1)), 31) + low).alias(f"k{d}") for d in range(DIMENSIONS)])
    dealt = placed.select("doc_id", "size", "text_crc32", "hash", "salt", _splits(placed, shards, tolerance).alias("shard"))
    # slots: rows are counted in buckets, and numbered in each bucket after those before it
    buckets = max(1, -(-total[1] // (rows_a_bucket * shards)))
    dealt = dealt.withColumn("bucket", F.pmod("salt", F.lit(buckets)))  # even where ids are null or repeated
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    counts = counts.select("shard", "bucket", before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "hash")) - 1
    return dealt.withColumn("nth", nth).join(counts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth")).cast("long").alias("slot"))
