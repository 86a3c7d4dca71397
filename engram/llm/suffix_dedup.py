"""Removal of repeated byte strings by a sparse, distributed suffix array.

Which suffixes are sorted. Each window of ``length`` bytes has an anchor: the 48-gram of least hash in it (the first such).
Equal windows have equal anchors at equal places, so repeats are found among suffixes that start at anchors; all windows
with one anchor form a segment of text. Anchors whose gram occurs once in the corpus are dropped (counts with map-side
combining), and equal segments become one entry with a count, so copies are never compared and no group of them gathers.

The merge sort. Each task sorts the suffixes of its segments as runs and exchanges them front-coded: a suffix is the length of
the prefix that it shares with the one before it, and the rest. The tasks of the second half merge the runs of their share
of the grams with a loser tree that keeps with each loser how long a prefix it shares with the suffix that beat it:
suffixes of different lengths there are ordered without looking at them, others are compared only from there on.

Windows of a gram are then decided from the shared prefixes of the sorted suffixes and the bytes left of the anchors. The windows
of a gram with very many different segments are counted instead, by 128 bits of hash, with map-side combining, so that no group
of them gathers.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, texts, written

GRAM = 48
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9)]


def gram_hashes(text: bytes) -> np.ndarray:
    """Of each GRAM bytes."""
    h = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
    h = (h ^ (h >> np.uint64(32))) * _C[0]
    h16 = h[:-8] * _C[1] + h[8:]
    h = h16[:-16] * _C[2] + h16[16:]
    h = h[:-16] * _C[3] + h16[32:]
    h ^= h >> np.uint64(29)
    h *= _C[4]
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        a = np.minimum(a[:-step], a[step:])
        have += step
    return a


def anchors(text: bytes, length: int, most: int = 1 << 23) -> tuple[np.ndarray, ...]:
    """first, last window, anchor and gram hash of each segment, in order; they cover all windows of the text. Of longer texts
    ``most`` windows are looked at once; a segment ends there."""
    if len(text) < length:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    if len(text) - length >= most:
        parts = [(at, anchors(text[at : at + most + length - 1], length, most)) for at in range(0, len(text) - length + 1, most)]
        return (*(np.concatenate([p[k] + at for at, p in parts]) for k in range(3)), np.concatenate([p[3] for _, p in parts]))
    h = gram_hashes(text)
    place = np.uint64((1 << 30) - 1)  # more than there are places
    least = _sliding_min((h & ~place) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1) & place
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    anchor = least[first].astype(np.int64)
    return first, np.append(first[1:] - 1, len(least) - 1), anchor, h[anchor]


def shared_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, whose first ``at`` bytes are known to agree."""
    n = min(len(a), len(b))
    x, y = a[at:n], b[at:n]
    return n if x == y else n - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7 >> 3)


def shared_suffix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x, y = a[len(a) - n :], b[len(b) - n :]
    if x == y:
        return n
    z = int.from_bytes(x) ^ int.from_bytes(y)
    return (z & -z).bit_length() - 1 >> 3


def front_code(entries: list[tuple]) -> dict[str, bytes]:
    """entries: (suffix, left, h, s, least, most), sorted. Each as the prefix shared with the one before it, and the rest."""
    shared, rests, before = [], [], b""
    for e in entries:
        k = shared_prefix(before, e[0], 0)
        shared.append(k)
        rests.append(e[0][k:])
        before = e[0]
    numbers = lambda x, kind: np.array(x, kind).tobytes()
    return {
        "shared": numbers(shared, "<u2"),
        "sizes": numbers([len(r) for r in rests], "<u2"),
        "rests": b"".join(rests),
        "left_sizes": numbers([len(e[1]) for e in entries], "<u2"),
        "lefts": b"".join(e[1] for e in entries),
        "ids": numbers([e[2:4] for e in entries], "<i8"),
        "reach": numbers([e[4:6] for e in entries], "<u2"),
    }


def decode(run: dict[str, bytes]):
    """(suffix, prefix length shared with the one before, left, h, s, least, most) of a front-coded run, one by one."""
    suffix, at, left_at = b"", 0, 0
    ids, reach = np.frombuffer(run["ids"], "<i8").reshape(-1, 2).tolist(), np.frombuffer(run["reach"], "<u2").reshape(-1, 2).tolist()
    sizes = (np.frombuffer(run[k], "<u2").tolist() for k in ("shared", "sizes", "left_sizes"))
    rests, lefts = run["rests"], run["lefts"]
    for shared, size, left_size, own, own_reach in zip(*sizes, ids, reach, strict=True):
        suffix = suffix[:shared] + rests[at : at + size]
        yield suffix, shared, lefts[left_at : left_at + left_size], *own, *own_reach
        at += size
        left_at += left_size


def merge(runs: list):
    """Merges sorted runs of tuples (suffix, prefix length shared with the one before in the run, ...): yields them in order,
    the second field now the prefix length shared with the one before in the merged order.

    A tree of losers. With each loser stands the length of the prefix that it shares with the entry that beat it.
    """
    k = 1
    while k < len(runs):
        k *= 2
    streams = [iter(r) for r in runs] + [iter(())] * (k - len(runs))
    heads = [next(s, None) for s in streams]
    shares = [0] * k  # of a stream's head with the last winner, or with what beat it
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two streams whose shares refer to the same entry."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = shares[a], shares[b]
        if p != q:  # the longer shared prefix is the smaller suffix; the loser's share with the winner is its own
            return (a, b) if p > q else (b, a)
        n = shared_prefix(x[0], y[0], p)
        won, lost = (a, b) if x[0][n : n + 1] <= y[0][n : n + 1] else (b, a)
        shares[lost] = n
        return won, lost

    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    winner = winners[1] if k > 1 else 0
    while (head := heads[winner]) is not None:
        yield head[0], shares[winner], *head[2:]
        heads[winner] = new = next(streams[winner], None)
        shares[winner] = new[1] if new is not None else 0
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def decide(family: list[tuple], length: int, few: int = 12) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """family: merged entries of one gram. For each entry (h, s), the ranges of offsets d, window start = anchor - d, at
    which some other entry has the same window."""
    found: dict[tuple[int, int], list] = defaultdict(list)
    if len(family) <= few:
        for i, (_, _, left, h, s, least, most) in enumerate(family):
            right = 1 << 30
            for _, share, left2, h2, s2, least2, most2 in family[i + 1 :]:
                right = min(right, share)
                a, b = max(length - right, least, least2), min(most, most2)
                if a <= b and (b := min(b, shared_suffix(left, left2))) >= a:
                    found[h, s].append((a, b))
                    found[h2, s2].append((a, b))
        return found
    for d in range(min(e[5] for e in family), max(e[6] for e in family) + 1):
        seen: dict[bytes, list] = defaultdict(list)
        for suffix, _, left, h, s, least, most in family:
            if least <= d <= most:
                seen[left[len(left) - d :] + suffix[: length - d]].append((h, s))
        for own in seen.values():
            if len(own) > 1:
                for key in own:
                    found[key].append((d, d))
    return found


def joined_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_RUN = "bucket bigint, shared binary, sizes binary, rests binary, left_sizes binary, lefts binary, ids binary, reach binary"


def repeated_spans(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", share: int = 20_000, run_bytes: int = 64_000_000) -> tuple[DataFrame, DataFrame]:
    """Spans (row, spans: array of [from, to)) and rows (row, doc_id, th): the bytes covered by a string of ``length`` bytes
    that also starts elsewhere. share: about how many segments a merging task gets; run_bytes: of a sorted run."""
    rows = texts(docs, id_col, text_col).withColumn("th", F.xxhash64("t"))

    def segments(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text in b.column("t").to_pylist():
                first, last, anchor, h = anchors(text, length)
                s = [xxhash.xxh64_intdigest(text[x : y + length]) for x, y in zip(first.tolist(), last.tolist(), strict=True)]
                out[0].append(h.view(np.int64))
                out[1].append(np.array(s, np.uint64).view(np.int64))
                out[2].append(anchor.astype(np.int32))
                out[3].append(((anchor - last) | (anchor - first) << 16).astype(np.int32))
            kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), *(pa.array(x, pa.list_(k)) for x, k in zip(out, kinds, strict=True))], ["doc_id", "th", "h", "s", "p", "d"])

    found = rows.mapInArrow(segments, f"doc_id {id_type(rows)}, th bigint, h array<bigint>, s array<bigint>, p array<int>, d array<int>")
    found = written(found.withColumn("row", F.monotonically_increasing_id()))
    names = found.select("row", "doc_id", "th")
    # tables between aggregation and join: the join deals both sides itself and can split the rows of a hot gram
    grams = written(found.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    entries = found.select("row", F.inline(F.arrays_zip("h", "s", "p", "d")))
    entries = written(entries.join(grams, "h"))  # segments whose gram is repeated
    kinds = written(entries.groupBy("h", "s").agg(F.count("*").alias("n"), F.min(F.struct("row", "p", "d")).alias("one")))
    families = written(kinds.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1"))
    to_sort = kinds.join(families, "h").select("h", "s", "one.*", (F.col("m") > share).alias("large"))
    all_of, largest = families.agg(F.sum("m"), F.max("m")).first()
    buckets = max(1, all_of or 0) // share + 1

    of_row = to_sort.groupBy("row").agg(F.collect_list(F.struct("h", "s", "p", "d", "large")).alias("own")).join(names, "row")
    a, b = rows.alias("a"), of_row.alias("b")
    with_text = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th"))).select("a.t", "b.own")

    def sorted_runs(batches):
        dealt: dict[int, dict] = defaultdict(dict)
        held = 0

        def run():
            for bucket, entries in sorted(dealt.items()):
                coded = front_code(sorted(entries.values()))
                yield pa.RecordBatch.from_pylist([{"bucket": bucket, **coded}], pa.schema([("bucket", pa.int64()), *((k, pa.binary()) for k in coded)]))

        for b in batches:
            for text, own in zip(b.column("t").to_pylist(), b.column("own").to_pylist(), strict=True):
                for e in own:
                    if not e["large"]:
                        h, s, p, least, most = e["h"], e["s"], e["p"], e["d"] & 0xFFFF, e["d"] >> 16
                        dealt[h % buckets][h, s] = (text[p : p - least + length], text[p - most : p], h, s, least, most)
                        held += length + most + 100
            if held > run_bytes:
                yield from run()
                dealt.clear()
                held = 0
        yield from run()

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        found: dict[tuple[int, int], list] = defaultdict(list)

        def close(family: list[tuple]) -> None:
            if len(family) > 1:
                for key, ranges in decide(family, length).items():
                    found[key] += ranges

        family: list[tuple] = []
        for entry in merge([decode(run) for run in group.to_dict("records")]):
            if entry[1] < GRAM:
                close(family)
                family = []
            family.append(entry)
        close(family)
        flat = [(h, s, a, b) for (h, s), ranges in found.items() for a, b in joined_ranges(ranges)]
        return pd.DataFrame(flat, columns=["h", "s", "least", "most"]).astype({"h": "int64", "s": "int64", "least": "int32", "most": "int32"})

    def windows(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text, own in zip(b.column("t").to_pylist(), b.column("own").to_pylist(), strict=True):
                for e in own:
                    if e["large"]:
                        for d in range(e["d"] & 0xFFFF, (e["d"] >> 16) + 1):
                            w = xxhash.xxh128_intdigest(text[e["p"] - d : e["p"] - d + length])
                            for column, value in zip(out, (e["h"], e["s"], d, (w >> 64) - (1 << 63), (w & (1 << 64) - 1) - (1 << 63)), strict=True):
                                column.append(value)
            kinds = pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["h", "s", "d", "w1", "w2"])

    if (largest or 0) > share:
        with_text = written(with_text)
    runs = with_text.mapInArrow(sorted_runs, _RUN)
    shared = runs.groupBy("bucket").applyInPandas(merged, "h bigint, s bigint, least int, most int")
    if (largest or 0) > share:  # equal windows of different segments
        single = written(with_text.mapInArrow(windows, "h bigint, s bigint, d int, w1 bigint, w2 bigint"))
        repeated = written(single.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2"))
        shared = shared.unionByName(single.join(repeated, ["w1", "w2"]).select("h", "s", F.col("d").alias("least"), F.col("d").alias("most")))
    whole = kinds.filter("n > 1").select("h", "s", F.col("one.d").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("least"), F.shiftright("one.d", 16).cast("int").alias("most"))
    ranges = whole.unionByName(shared).groupBy("h", "s").agg(F.collect_list(F.struct("least", "most")).alias("ranges"))
    ranges = written(ranges)
    spans = entries.join(ranges, ["h", "s"]).select(
        "row", F.transform("ranges", lambda r: F.struct((F.col("p") - r["most"]).alias("from"), (F.col("p") - r["least"] + length).alias("to"))).alias("spans")
    )
    return spans.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans")), names


def without_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept (the bytes that stay), th.

    Each byte goes that a string of ``length`` bytes covers which also starts anywhere else, in the same text or another;
    strings are judged on the input, overlaps count, and matches never cross texts. Null counts as empty. Shorter texts
    stay whole. Repeated rows are repeats of each other. An empty table gives no rows; other columns are not read.
    """
    spans, names = repeated_spans(docs, length, id_col, text_col)
    rows = texts(docs, id_col, text_col).withColumn("th", F.xxhash64("t"))
    found = spans.join(names, "row").select("doc_id", "th", "spans").dropDuplicates(["doc_id", "th"])
    a, b = rows.alias("a"), found.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th")), "left").select("a.*", "b.spans")

    def removed(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column("t").to_pylist(), b.column("spans"), strict=True):
                cut: list[tuple[int, int]] = []
                if spans.is_valid:
                    pairs = spans.values
                    for x, y in sorted(set(zip(pairs.field("from").to_pylist(), pairs.field("to").to_pylist(), strict=True))):
                        if cut and x <= cut[-1][1]:
                            cut[-1] = (cut[-1][0], max(y, cut[-1][1]))
                        else:
                            cut.append((x, y))
                edges = [0, *(e for c in cut for e in c), len(text)]
                kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)) if cut else text
                out.append((len(text), len(text) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), [list(c) for c in cut], kept))
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()
            columns = zip(*out, strict=True) if out else ((),) * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), b.column("th")], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", "th"]
            )

    return joined.mapInArrow(removed, f"doc_id {id_type(rows)}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<array<bigint>>, kept binary, th bigint")
