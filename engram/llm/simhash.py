"""SimHash near-duplicates, found by pigeonring filtering.

A 64-bit fingerprint is a ring of 8 segments of 8 bits. If two fingerprints differ in at most 3 bits, some segment starts
a chain in which, for every length l, the first l segments differ in at most floor(3 l / 8) bits: none in the first two,
at most one in the first five. So two segments and one half of the next three are equal, which gives 28-bit join keys, two
for each of the 8 starts. Within a key the whole chain is tested before the full Hamming distance.

Copies collapse to one fingerprint before the join. Each key yields a spanning forest of its links, not all its pairs;
keys with very many fingerprints are dealt again by a further 9 bits, of which any link keeps one of four, and what still has very
many is compared in pairs of blocks, each pair in a group of its own. Components of the links are found by alternating large-star and small-star rounds over tables in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, texts, written

BITS = 3
SEGMENTS = 8
QUOTAS = [BITS * k // SEGMENTS for k in range(1, SEGMENTS + 1)]


def fingerprint(text: bytes, width: int = 3) -> int:
    """Unsigned; bit i is 1 if it is set in over half of the XXH64 (seed 42) of the shingles."""
    words = text.lower().split()
    if not words:
        return 0
    hash64, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= width:
        return hash64(join(words), 42)
    # shingles as slices of the words joined once: word ends give their places
    whole = join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -width] + 1)).tolist()
    hashes = np.fromiter((hash64(whole[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, th (hash of the text), fp (the fingerprint's 64 bits as a signed long); one row per row of docs."""
    rows = texts(docs, id_col, text_col).withColumn("th", F.xxhash64("t"))

    def prints(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t, width) for t in b.column("t").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fp.view(np.int64))], ["doc_id", "th", "fp"])

    return rows.mapInArrow(prints, f"doc_id {id_type(rows)}, th bigint, fp bigint")


def _turned(fp, start: int):
    bits = 8 * start
    return F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits)) if bits else fp


def ring_keys(prints: DataFrame) -> DataFrame:
    """key, fp: 16 rows for each distinct fp. The key's high bits are start and half, its low 28 bits are equal in any link."""
    fp, keys = F.col("fp"), []
    for start in range(SEGMENTS):
        top = F.shiftrightunsigned(_turned(fp, start), 24)  # 16 bits of two segments, 24 of the next three
        two, three = F.shiftrightunsigned(top, 24), top.bitwiseAND(F.lit((1 << 24) - 1))
        for half, twelve in enumerate((F.shiftrightunsigned(three, 12), three.bitwiseAND(F.lit(0xFFF)))):
            keys.append(F.shiftleft(two, 12).bitwiseOR(twelve) + F.lit((2 * start + half) << 28))
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _spanning(values: np.ndarray, start: int, block: int = 256) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints that share a chain's start."""
    n, found = len(values), []
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ring = np.uint64(8 * start), np.uint64((64 - 8 * start) % 64)
    turned = (values << ring[0]) | (values >> ring[1]) if start else values
    for at in range(0, n, block):
        apart = turned[at : at + block, None] ^ turned[None, at:]
        near = np.ones(apart.shape, bool)
        for k, quota in enumerate(QUOTAS, 1):
            near &= np.bitwise_count(apart >> np.uint64(64 - 8 * k)) <= quota
        for i, j in zip(*np.nonzero(near), strict=True):
            if i < j and (a := top(int(at + i))) != (b := top(int(at + j))):
                root[b] = a
                found.append((int(at + i), int(at + j)))
    return found


def _links_of(lists: DataFrame) -> DataFrame:
    def links(batches):
        for b in batches:
            left, right = [], []
            for key, fps in zip(b.column("key").to_pylist(), b.column("fps"), strict=True):
                values = np.unique(np.asarray(fps.values).view(np.uint64))
                for i, j in _spanning(values, (key >> 29) & 7):
                    left.append(values[i])
                    right.append(values[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (left, right)], ["a", "b"])

    return lists.mapInArrow(links, "a bigint, b bigint")


def links(distinct_prints: DataFrame, large: int = 4096) -> DataFrame:
    """a, b: links among distinct fingerprints that connect all that are within 3 bits, directly or over others."""
    keys = ring_keys(distinct_prints)
    # tables between aggregation and join: the join deals both sides itself and can split a large key's rows
    sizes = written(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    shared = written(keys.join(sizes, "key"))
    usual = shared.filter(F.col("n") <= large).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    hot = shared.filter(F.col("n") > large)
    rest = F.col("rest")  # the 36 bits outside the key, in four blocks of 9
    start = F.shiftright("key", 29)
    turned = F.coalesce(*[F.when(start == s, _turned(F.col("fp"), s)) for s in range(SEGMENTS)])
    half = F.shiftright("key", 28).bitwiseAND(F.lit(1))
    inner = F.when(half == 0, F.shiftrightunsigned(turned, 24)).otherwise(F.shiftrightunsigned(turned, 36)).bitwiseAND(F.lit(0xFFF))
    hot = hot.withColumn("rest", F.shiftleft(turned.bitwiseAND(F.lit((1 << 24) - 1)), 12).bitwiseOR(inner))
    parts = F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(rest, 9 * i).bitwiseAND(F.lit(511)).alias("nine")) for i in range(4)])
    lists = usual
    if not hot.isEmpty():
        dealt = written(hot.select("key", "fp", F.explode(parts).alias("part")))
        sizes = written(dealt.groupBy("key", "part").agg(F.count("*").alias("n")).filter("n > 1"))
        dealt = written(dealt.join(sizes, ["key", "part"]))
        small = dealt.filter(F.col("n") <= large).groupBy("key", "part").agg(F.collect_list("fp").alias("fps"))
        # blocks of half the bound; each fingerprint goes to all pairs of its block
        count = F.ceil(2 * F.col("n") / large).cast("int")
        block = F.pmod(F.xxhash64("fp"), count).cast("int")
        blocks = dealt.filter(F.col("n") > large).select("key", "part", "fp", block.alias("block"), F.explode(F.sequence(F.lit(0), count - 1)).alias("other"))
        pair = F.struct(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
        pairs = blocks.groupBy("key", "part", pair.alias("pair")).agg(F.collect_list("fp").alias("fps"))
        lists = lists.unionByName(small.select("key", "fps")).unionByName(pairs.select("key", "fps"))
    return _links_of(lists.filter(F.size("fps") > 1)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each end of an edge reaches. edges: a, b of one orderable type."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # tables between aggregation and join: the join can then split the rows of a hub
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u")
        edges = written(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, keyed: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), th; and, if keyed,
    root, which is never null and names the component.

    Null texts count as empty. Texts without words have fingerprint zero and link like any other. Equal fingerprints,
    repeated rows included, are in one component. Null ids: the component's smallest id that isn't null, null if there is
    none. Texts of any length are read whole. An empty table gives no rows; other columns are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col, width))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = written(components(links(prints.select("fp").distinct())))
    least = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = written(least)
    named = written(least.groupBy("root").agg(F.min("least_id").alias("component_id")))
    members = least.join(named, "root").select("fp", "component_id", "root")
    return prints.join(members, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "th", *(["root"] if keyed else []))
