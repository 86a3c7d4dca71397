"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.shared import remove, scratch, shared_dir, written  # noqa: F401  the operators take them from here

#: Bytes that are no word bytes: \x00-\x2F \x3A-\x60 \x7B-\x7F (after A-Z became a-z).
_TO_WORDS = bytes(
    ord(chr(b).lower()) if 0x41 <= b <= 0x5A else (b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20)
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and returns the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of UTF-8 bytes."""
    return text.translate(_TO_WORDS).split()


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Only what the operators read: doc_id, and t, the text as UTF-8 bytes (null: empty). keep: columns to carry along, in a
    struct named row, so that their names can't clash with others."""
    row = [F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")] if keep else []
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"), *row)


def carried_type(df: DataFrame, carried: list[str]) -> str:
    return "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in carried)


def id_type(df: DataFrame, name: str = "doc_id") -> str:
    return df.schema[name].dataType.simpleString()
