"""Best-fit packing by hierarchical residual packing.

Each partition tokenizes its documents and packs its own pieces best-fit, largest first, which needs no shuffle. Bins that
are full but for a few tokens are final. The others become items themselves: groups of them meet in a tree, level by
level, and are packed best-fit again until one group is left. Only bins move, never pieces.

In a best-fit packing no two bins fit together, so each group has at most one bin of half the capacity or less; only such
small bins can join a bin of another group. So a group passes on its small bin and, of the bins with room, for each size
of room as many as the groups below it have small bins. What a level receives is bounded by the capacity and the fan, not
by the corpus.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, texts, written


def best_fit(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, each item taken by the bin with the least room that has enough, largest item first."""
    at: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    rooms: list[int] = []  # sorted distinct rooms
    bins: dict[int, list[int]] = {}
    n = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        k = bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            own = bins[room].pop()
            if not bins[room]:
                del bins[room]
                rooms.pop(k)
        else:
            room, own, n = capacity, n, n + 1
        at[i] = (own, capacity - room)
        if left := room - size:
            if left not in bins:
                insort(rooms, left)
                bins[left] = []
            bins[left].append(own)
    return at


_SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Printable ASCII but for <, which may begin a special token, and the lower-case letters of Latin-1, in UTF-8: what normalizing leaves alone.
_SIMPLE = re.compile(rb"(?:[!-;=-~]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Bytes as 1 (ASCII letters and digits), 8 (other printable ASCII but for <) or 20: from a 1 to an 8 it goes up by 7.
_KINDS = bytes(1 if chr(c).isalnum() and c < 128 else 8 if 32 < c < 127 and c != 0x3C else 20 for c in range(256))


class _Ids(dict):
    """Word (no white space in it) to its ids as little-endian unsigned 32-bit integers.

    Words not seen yet are encoded when they are looked up. When there are ``most`` of them, they become the old generation and
    what was the old one goes; old words that are looked up again are new ones, so frequent words stay."""

    def __init__(self, path: str, most: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each task has its one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces, self.most, self.old = self.tokenizer.model.tokenize, most, {}
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.split = _splitter(json.loads(self.tokenizer.to_str()))
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            four, own = self.four, ()
            if self.split and word.isalpha():
                own = self.pieces(word.lower().decode())
            elif self.split and _SIMPLE.fullmatch(word):
                text = word.lower().decode()
                own = [t for p in ([text] if text.isalpha() else self.split.findall(text)) for t in self.pieces(p.translate(self.bytes_of))]
            # the tokenizer drops white space and splits at it, so each word is encoded alone
            ids = b"".join([four[t.id] for t in own] if own else [four[i] for i in self.tokenizer.encode(word.decode(), add_special_tokens=False).ids])
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def parted(self, text: bytes) -> bytes:
        """The text with the same ids but fewer different words: in lower case, a blank before each mark that follows a plain
        letter or digit, for the tokenizer splits there anyway."""
        if not self.split or b"<" in text:
            return text
        text = text.lower()
        kinds = np.frombuffer(text.translate(_KINDS), np.int8)
        at = (np.flatnonzero(kinds[1:] - kinds[:-1] == 7) + 1).tolist()
        return b" ".join([text[i:j] for i, j in zip([0, *at], [*at, len(text)], strict=True)])


def _splitter(spec: dict) -> regex.Pattern | None:
    """The pattern by which a tokenizer of lower-case byte-level pieces splits, if it is one; others encode each word whole."""
    normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if normal == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"]:
        split, level = steps
        if split["behavior"] == "Removed" and split["invert"] and not level["add_prefix_space"] and not level["use_regex"]:
            return regex.compile(split["pattern"]["Regex"])
    return None


_TABLES: dict[str, _Ids] = {}


def _table(path: str) -> _Ids:
    """One for each worker process."""
    if path not in _TABLES:
        _TABLES[path] = _Ids(path)
    return _TABLES[path]


def _chunks(batches, most: int = 4_000_000):
    """(chunk, whether it is its text's last): texts in turn, long ones cut at white space."""
    for b in batches:
        for text in b.column("t"):
            text, at = text.as_py(), 0
            while len(text) - at > most and (cut := _SPACE.search(text, at + most)):
                yield text[at : cut.start()], False
                at = cut.start()
            yield text[at:], True


def _encoded(chunks: list[bytes], table: _Ids) -> list[bytes]:
    """The bytes of each chunk's ids. Arrow splits the words and tells them apart, so that each is looked up once."""
    words = pc.ascii_split_whitespace(pa.array(list(map(table.parted, chunks)), pa.binary()).cast(pa.string()))
    distinct = words.values.dictionary_encode()
    known = list(map(table.__getitem__, distinct.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()))
    starts = np.cumsum([0, *map(len, known)], dtype=np.int64) // 4
    ids = pa.LargeListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(known), "<u4"))).take(distinct.indices)
    stream = ids.flatten().to_numpy().tobytes()
    ends = (4 * ids.offsets.to_numpy()[words.offsets.to_numpy()]).tolist()
    return [stream[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _streams(batches, table: _Ids, most: int = 4_000_000):
    """The bytes of each text's ids, in turn. A few MB of text are split at once: as words, a text takes several times its size."""
    block, size, rest = [], 0, []

    def flush():
        for (_, last), own in zip(block, _encoded([c for c, _ in block], table), strict=True):
            rest.append(own)
            if last:
                yield b"".join(rest)
                rest.clear()

    for chunk, last in _chunks(batches, most):
        block.append((chunk, last))
        size += len(chunk)
        if size >= most:
            yield from flush()
            block, size = [], 0
    if block:
        yield from flush()


def _pieces(batches, path: str, capacity: int, end_id: int, partition_bits: int):
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() << partition_bits
    end = end_id.to_bytes(4, "little")
    table = _table(path)
    ids, rows, pieces, starts, sizes, sums = [], [], [], [], [], []

    def read():
        for b in batches:
            ids.append(b.column("doc_id"))
            yield b

    for i, stream in enumerate(_streams(read(), table)):
        stream += end
        for piece, at in enumerate(range(0, len(stream), 4 * capacity)):
            cut = stream[at : at + 4 * capacity]
            rows.append(i)
            pieces.append(piece)
            starts.append(at // 4)
            sizes.append(len(cut) // 4)
            sums.append(zlib.crc32(cut))
    if not sizes:
        return
    at = best_fit(sizes, capacity)
    yield pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays(ids).take(pa.array(rows)),
            pa.array(pieces, pa.int32()),
            pa.array(starts, pa.int64()),
            pa.array(sizes, pa.int64()),
            pa.array(sums, pa.int64()),
            pa.array([part + own for own, _ in at], pa.int64()),
            pa.array([offset for _, offset in at], pa.int64()),
        ],
        ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "bin_offset"],
    )


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    slack: int = 0,
    fan: int = 8,
    partition_bits: int = 40,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and end_id; only documents longer than capacity are cut, into pieces of capacity, of which
    the last may be shorter. Null texts count as empty and give one piece of one token. Repeated rows are packed as often
    as they occur; null ids stay null. An empty table gives no rows. Other columns are not read.
    Tokenizers without words that span white space are supported (word_bpe files): words are encoded apart.
    """
    rows = texts(docs, id_col, text_col)
    pieces = rows.mapInArrow(
        lambda batches: _pieces(batches, tokenizer_path, capacity, end_id, partition_bits),
        f"doc_id {id_type(rows)}, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, bin_offset bigint",
    )
    pieces = written(pieces)  # the numbers of partitions' bins are fixed from here on
    bins = pieces.groupBy("bin").agg(F.sum("length").alias("fill"))
    group = F.shiftright("bin", partition_bits)
    moved = None
    groups = pieces.select(F.max(group) + 1).first()[0] or 1
    # what a partition passes on
    level = _passed_on(bins.withColumn("group", group), capacity, slack, fan)
    width = 1
    while width < groups:
        width *= fan
        dealt = level.withColumn("group", (F.shiftright("bin", partition_bits) / width).cast("long"))
        packed = written(dealt.groupBy("group").applyInPandas(_merge(capacity), "bin bigint, fill bigint, host bigint, base bigint, group_fill bigint"))
        step = packed.filter("bin <> host").select(F.col("bin").alias("from"), "host", "base")
        if moved is None:
            moved = step
        else:
            # what lies in a bin that moves now moves along
            on = moved.join(step.select(F.col("from").alias("host"), F.col("host").alias("host2"), F.col("base").alias("base2")), "host", "left")
            moved = on.select("from", F.coalesce("host2", "host").alias("host"), (F.col("base") + F.coalesce("base2", F.lit(0))).alias("base")).unionByName(step)
        moved = written(moved)
        kept = packed.filter("bin = host").select("bin", F.col("group_fill").alias("fill"))
        level = _passed_on(kept.withColumn("group", (F.shiftright("bin", partition_bits) / width).cast("long")), capacity, slack, fan)
    if moved is None:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("bin_offset").alias("offset"))
    joined = pieces.join(moved, pieces.bin == moved["from"], "left")
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("host", "bin").alias("sequence_id"), (F.col("bin_offset") + F.coalesce("base", F.lit(0))).alias("offset")
    )


def _passed_on(bins: DataFrame, capacity: int, slack: int, fan: int) -> DataFrame:
    """bins: bin, fill, group. Rows of one group and fill are alike, so the first of them are as good as any."""
    from pyspark.sql import Window

    open_bins = bins.filter(F.col("fill") < capacity - slack)
    ranked = open_bins.withColumn("nth", F.row_number().over(Window.partitionBy("group", "fill").orderBy("bin")))
    return ranked.filter((2 * F.col("fill") <= capacity) | (F.col("nth") <= fan)).select("bin", "fill")


def _merge(capacity: int):
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["fill", "bin"], ascending=[False, True], kind="stable")
        fills, names = group["fill"].tolist(), group["bin"].tolist()
        at = best_fit(fills, capacity)
        first: dict[int, int] = {}
        total: dict[int, int] = {}
        for name, fill, (own, offset) in zip(names, fills, at, strict=True):
            if offset == 0:
                first[own] = name
            total[own] = total.get(own, 0) + fill
        hosts = [first[own] for own, _ in at]
        return pd.DataFrame({"bin": names, "fill": fills, "host": hosts, "base": [o for _, o in at], "group_fill": [total[own] for own, _ in at]})

    return merge
