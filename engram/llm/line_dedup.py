"""Line dedup: line hashes are range-partitioned with document and position as secondary sort keys; a stream over each sorted
partition sees the first occurrence of every line, and what comes back is a compressed keep bitmap for each document, not text.

A line is dropped where a smaller document has its key. The ranges are over hash, document and row, so a line that a third of all
documents share is cut over several partitions; only the first and the last hash of a partition can reach into others, and
those exchange one row for each partition.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried_type, id_type, texts, written

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SPACE = b" \t\n\x0b\x0c\r"
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point
_DROPPED, _OPEN, _EDGE = 0, 1, 2


def line_keys(text: bytes, least: int) -> list[bytes | None]:
    """The key of each line; None where it has fewer than ``least`` code points."""
    keys = (line.strip(_SPACE) for line in text.translate(_LOWER).split(b"\n"))
    return [k if len(k) >= least and (len(k) >= 4 * least or len(k.translate(None, _FOLLOWING)) >= least) else None for k in keys]


def pack(n: int, gone) -> bytes:
    """A compressed bitmap of n lines: 1 stays."""
    keep = np.ones(n, np.uint8)
    keep[gone] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def unpack(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(bool)


def _entries(least: int):
    """A row for each different key of a text: its hash and the places where it stands."""

    def entries(batches):
        for b in batches:
            at, th, n_lines, hashes, places = [], [], [], [], []
            for i, (text, own) in enumerate(zip(b.column("t").to_pylist(), b.column("th").to_pylist(), strict=True)):
                seen: dict[bytes, list[int]] = {}
                keys = line_keys(text, least)
                for place, key in enumerate(keys):
                    if key is not None:
                        seen.setdefault(key, []).append(place)
                at += [i] * len(seen)
                th += [own] * len(seen)
                n_lines += [len(keys)] * len(seen)
                hashes += [hashlib.blake2b(key, digest_size=16).digest() for key in seen]
                places += [struct.pack(f"<{len(p)}i", *p) for p in seen.values()]
                if at and (len(at) > 50_000 or i + 1 == b.num_rows):
                    columns = [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(th, pa.int64()), pa.array(n_lines, pa.int32()), pa.array(hashes, pa.binary()), pa.array(places, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "n_lines", "h", "places"])
                    at, th, n_lines, hashes, places = [], [], [], [], []

    return entries


def _firsts(batches):
    """Of entries in order of hash, document and row: what a smaller document has before it (dropped), what only the partition before
    can tell (open: the first hash's entries of its first document), and the first document of the hashes at either edge."""
    hash_now, first, last, groups = None, None, None, 0
    names = ["kind", "h", "no_id", "doc_id", "th", "n_lines", "places"]
    ids = pa.null()

    def batch(out):
        kinds = [pa.int8(), pa.binary(), pa.bool_(), ids, pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for b in batches:
        ids, out = b.schema.field("doc_id").type, []
        for h, no_id, doc, th, n, places in zip(*(b.column(c).to_pylist() for c in ("h", "no_id", "doc_id", "th", "n_lines", "places")), strict=True):
            if h != hash_now:
                if groups == 1:
                    out.append((_EDGE, hash_now, *first, None, None, None))
                hash_now, first, last, groups = h, (no_id, doc), None, groups + 1
            if (no_id, doc, th) == last:
                continue  # a repeated row
            last = (no_id, doc, th)
            if (no_id, doc) != first:
                out.append((_DROPPED, h, no_id, doc, th, n, places))
            elif groups == 1:
                out.append((_OPEN, h, no_id, doc, th, n, places))
        if out:
            yield batch(out)
    if groups:
        yield batch([(_EDGE, hash_now, *first, None, None, None)])


def _bitmaps(batches):
    for b in batches:
        gone = [np.unique(np.frombuffer(b"".join(lists), "<i4")) for lists in b.column("places").to_pylist()]
        n = b.column("n_lines").to_pylist()
        columns = [b.column("doc_id"), b.column("th"), b.column("n_lines"), pa.array([len(g) for g in gone], pa.int64()), pa.array([pack(k, g) for k, g in zip(n, gone, strict=True)], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), n_lines, n_dropped, keep (zlib of a bitmap of the lines, 1 stays): a row for each document that
    loses a line; of all others every line stays.

    A line's key is the line without [\\x20\\x09-\\x0D] at its ends, A-Z lower-cased; keys of at least ``least`` code points that
    several documents have stay in the smallest doc_id only, where all their lines stay. Keys are told apart by 128 bits of a
    cryptographic hash. Null and empty texts are one empty line, which stays. Rows with one doc_id are one document, whatever
    their texts, and rows without an id are one document that comes last; repeated rows get one bitmap. Lines, texts and documents
    may be of any number and length; an empty table gives no rows; other columns are not read.
    """
    rows = texts(docs, id_col, text_col).withColumn("th", F.xxhash64("t"))
    kind = id_type(rows)
    entries = rows.mapInArrow(_entries(least), f"doc_id {kind}, th bigint, n_lines int, h binary, places binary")
    # the salt parts rows that are repeated very often
    entries = written(entries.select("h", F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", (F.rand(11) * (1 << 30)).cast("int").alias("salt"), "n_lines", "places"))
    ranged = entries.repartitionByRange("h", "no_id", "doc_id", "th", "salt").sortWithinPartitions("h", "no_id", "doc_id", "th")
    found = written(ranged.drop("salt").mapInArrow(_firsts, f"kind tinyint, h binary, no_id boolean, doc_id {kind}, th bigint, n_lines int, places binary"))
    document = F.struct("no_id", "doc_id")
    edges = found.filter(F.col("kind") == _EDGE).groupBy("h").agg(F.min(document).alias("first"))  # two rows for each partition at most
    late = found.filter(F.col("kind") == _OPEN).join(edges, "h").filter(F.col("first") < document)
    gone = found.filter(F.col("kind") == _DROPPED).select("doc_id", "th", "n_lines", "places").unionByName(late.select("doc_id", "th", "n_lines", "places"))
    lists = gone.groupBy("doc_id", "th").agg(F.first("n_lines").alias("n_lines"), F.collect_list("places").alias("places"))  # the lines of one document
    return lists.mapInArrow(_bitmaps, f"doc_id {kind}, th bigint, n_lines int, n_dropped bigint, keep binary")


def kept_texts(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, digest: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept (the lines that stay, joined by \\n; digest: kept_sha256 instead), and
    row, a struct of the columns named in keep. bitmaps: of the same documents, from ``keep_bitmaps``; read anew, as a table, so that
    either side of the join can be split where rows are repeated very often."""
    rows = texts(docs, id_col, text_col, keep).withColumn("th", F.xxhash64("t"))
    carried = ["row"] if keep else []
    a, b = rows.alias("a"), written(bitmaps.select("doc_id", "th", "keep")).alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th")), "left").select("a.doc_id", "a.t", "b.keep", *[f"a.{c}" for c in carried])
    last = "kept_sha256" if digest else "kept"

    def apply(batches):
        for b in batches:
            n_lines, n_dropped, out = [], [], []
            for text, bitmap in zip(b.column("t").to_pylist(), b.column("keep").to_pylist(), strict=True):
                n_lines.append(text.count(b"\n") + 1)
                if bitmap is None:
                    n_dropped.append(0)
                else:
                    stays = unpack(bitmap, n_lines[-1])
                    n_dropped.append(int((~stays).sum()))
                    text = b"\n".join(line for line, k in zip(text.split(b"\n"), stays.tolist(), strict=True) if k)
                out.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace"))
            columns = [b.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(out, pa.string()), *[b.column(c) for c in carried]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", last, *carried])

    return joined.mapInArrow(apply, f"doc_id {id_type(rows)}, n_lines bigint, n_dropped bigint, {last} string" + carried_type(joined, carried))
