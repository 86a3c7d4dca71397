"""Exact dedup by content-defined chunk recipes.

Each text is cut where its content says so; a chunk's identifier is a digest. Chunks are compared byte by byte with all
chunks of the same identifier, in one exchange of distinct chunks (copies combine before the shuffle), so identifiers are
verified. After that only recipes, the ordered lists of identifiers, are compared: a text moves once, as chunks.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_type, texts, written

_SPACES = re.compile(rb"[ \t-\r]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: bytes) -> bytes:
    return _SPACES.sub(b" ", text)


def cuts(text: bytes, least: int, mean_bits: int, most: int) -> list[int]:
    """Ends of the chunks. An end depends on the 8 bytes before it and on the end before that."""
    n = len(text)
    if n <= least:
        return [n] if n else []
    grams = np.ndarray((n - 7,), "<u8", text, 0, (1,)) * _MULTIPLIER
    ends, last = [], 0
    for at in (np.flatnonzero(grams >> np.uint64(64 - mean_bits) == 0) + 8).tolist():
        while at - last > most:
            last += most
            ends.append(last)
        if at - last >= least:
            ends.append(at)
            last = at
    while n - last > most:
        last += most
        ends.append(last)
    return ends if last == n else [*ends, n]


def _chunks(text: bytes, shape: tuple[int, int, int], id_bytes: int) -> list[tuple[bytes, bytes]]:
    at, out = 0, []
    for end in cuts(text, *shape):
        piece = text[at:end]
        out.append((hashlib.sha256(piece).digest()[:id_bytes], piece))
        at = end
    return out


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 256, mean_bits: int = 11, most: int = 65536, id_bytes: int = 16
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chunks, th (hash of the raw text).

    Texts are equal when identical after each run of [\\x20\\x09-\\x0D] became one space; null counts as empty, so null
    and empty texts form one group, and " " is another. The row with the smallest doc_id stays; null ids come last, and of
    repeated rows exactly one stays. An empty table gives no rows. Other columns of docs are not read, so their names
    can't clash. Long texts become many chunks; a chunk has at most ``most`` bytes.
    """
    shape = (least, mean_bits, most)
    rows = texts(docs, id_col, text_col).withColumn("th", F.xxhash64("t"))

    def recipes(batches):
        for b in batches:
            out: list[tuple] = []
            for text in b.column("t").to_pylist():
                text = normalised(text)
                ids = [i for i, _ in _chunks(text, shape, id_bytes)]
                out.append((b"".join(ids), len(ids), hashlib.sha256(text).hexdigest()))
            recipe, n, sha = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array(recipe, pa.binary()), pa.array(n, pa.int32()), pa.array(sha, pa.string())],
                ["doc_id", "th", "recipe", "n_chunks", "text_sha256"],
            )

    def pieces(batches):
        for b in batches:
            for text in b.column("t").to_pylist():
                if found := _chunks(normalised(text), shape, id_bytes):
                    ids, parts = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(parts, pa.binary())], ["chunk_id", "chunk"])

    # each distinct chunk moves once; an identifier with two contents is not verified yet
    contents = rows.select("t").mapInArrow(pieces, "chunk_id binary, chunk binary").groupBy("chunk_id", "chunk").agg(F.lit(1).alias("one"))
    twofold = written(contents.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").select("chunk_id"))
    lists = rows.mapInArrow(recipes, f"doc_id {id_type(rows)}, th bigint, recipe binary, n_chunks int, text_sha256 string")
    lists = written(lists.withColumn("row", F.monotonically_increasing_id()))
    if not twofold.isEmpty():
        lists = _told_apart(rows, lists, twofold, contents, shape, id_bytes)
    else:
        lists = lists.withColumn("variants", F.lit("").cast("binary"))

    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row"))
    groups = lists.groupBy("recipe", "variants").agg(F.min(order).alias("first"), F.count("*").alias("size")).filter("size > 1")
    groups = written(groups)  # read anew, it is dealt by the join itself, which can then split a large group's rows
    a, b = lists.alias("a"), groups.alias("b")
    joined = a.join(b, (F.col("a.recipe") == F.col("b.recipe")) & (F.col("a.variants") == F.col("b.variants")), "left")
    alone = F.col("b.size").isNull()
    return joined.select(
        F.col("a.doc_id").alias("doc_id"),
        F.when(alone, F.col("a.doc_id")).otherwise(F.col("b.first.id")).alias("keep_id"),
        F.coalesce(F.col("b.size"), F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("a.row") == F.col("b.first.row"))).alias("kept"),
        F.col("a.text_sha256").alias("text_sha256"),
        F.col("a.n_chunks").alias("n_chunks"),
        F.col("a.th").alias("th"),
    )


def _told_apart(rows: DataFrame, lists: DataFrame, twofold: DataFrame, contents: DataFrame, shape, id_bytes: int) -> DataFrame:
    """Where one identifier stands for several contents: their numbers, in the order of the recipe, tell texts apart."""
    numbered = (
        contents.join(twofold, "chunk_id", "left_semi").withColumn("variant", F.row_number().over(Window.partitionBy("chunk_id").orderBy("chunk"))).drop("one")
    )
    numbered = written(numbered)

    def places(batches):
        for b in batches:
            for doc_id, th, text in zip(b.column("doc_id"), b.column("th").to_pylist(), b.column("t").to_pylist(), strict=True):
                if found := _chunks(normalised(text), shape, id_bytes):
                    ids, parts = zip(*found, strict=True)
                    n = len(ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id.as_py()] * n, b.schema.field("doc_id").type), pa.array([th] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(ids, pa.binary()), pa.array(parts, pa.binary())],
                        ["doc_id", "th", "place", "chunk_id", "chunk"],
                    )

    placed = rows.mapInArrow(places, f"doc_id {id_type(rows)}, th bigint, place int, chunk_id binary, chunk binary")
    found = placed.join(numbered, ["chunk_id", "chunk"]).select("doc_id", "th", "place", "variant").distinct()
    marks = found.groupBy("doc_id", "th").agg(F.to_json(F.array_sort(F.collect_list(F.struct("place", "variant")))).cast("binary").alias("variants"))
    a, b = lists.alias("a"), marks.alias("b")
    on = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th"))
    return written(a.join(b, on, "left").select("a.*", F.coalesce(F.col("b.variants"), F.lit("").cast("binary")).alias("variants")))
