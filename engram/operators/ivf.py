"""Approximate nearest neighbours: an inverted file with residual codes, kept as tables.

Coarse centroids are fitted on a bounded sample; every row goes to the lists of its nearest centroids (two, so that a row near
a border is found from either side) and is kept as one byte a dimension, with how far the code is off. A search reads the lists nearest to a query, bounds each cosine from below and above by
its code, and scores exactly, from the whole vectors, only what can still be among the best. So what is found is exact for the
lists that were read, and exact for all rows if all lists are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.operators.rank import cosine, top
from engram.shared import shared_dir, written

_SLACK = 2e-6  # scores are rounded to six digits
_CELLS = 1 << 20  # of a matrix that a task holds
#: Of the tables; one that is kept from before a change of it is not read.
FORMAT = 2


@dataclass
class Index:
    """path: the folder of its tables, centroids (list, centroid, copies) and codes (list, doc_id, code, scale, slip). copies: how many
    lists a row is in."""

    path: str
    centroids: np.ndarray
    copies: int = 2

    @property
    def lists(self) -> int:
        return len(self.centroids)


def _unit(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors of length 1; zeros for those that are null, of another width, or without direction."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors.to_pylist()):
        if v is not None and len(v) == width and None not in v:
            out[i] = v
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    good = np.isfinite(norm) & (norm > 0)
    return np.where(good, out / np.where(good, norm, 1), 0)


def _fitted(sample: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means. Lists that run empty take the rows that are farthest from their own."""
    draw = np.random.default_rng(seed)
    centroids = sample[draw.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        near = sample @ centroids.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[empty] = sample[near.max(axis=1).argsort()[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    return centroids


def build(corpus: DataFrame, path: str | None = None, lists: int | None = None, most_sample: int = 20_000, most_bytes: int = 1 << 25, rounds: int = 8, seed: int = 7, copies: int = 2) -> Index:
    """corpus: doc_id, vector. lists: of the square root of the rows by default, no more than an eighth of the sample and than
    centroids of most_bytes, which every task holds. The sample, at most most_sample rows with the smallest hashes, only places
    the centroids; every row is put into a list. Null vectors, zeros and vectors of another width than the sample's most
    frequent one have no direction and score 0."""
    spark = corpus.sparkSession
    path = path or shared_dir(spark)
    rows = corpus.select("doc_id", "vector")
    n = rows.count()
    picked = rows.filter("vector is not null and size(vector) > 0").select("vector", F.xxhash64("vector", "doc_id").alias("o")).orderBy("o").limit(most_sample).select("vector").toArrow().column("vector")
    widths = [len(v) for v in picked]
    width = max(set(widths), key=widths.count) if widths else 1
    sample = _unit(picked, width)
    sample = sample[np.linalg.norm(sample, axis=1) > 0]
    wanted = lists or max(1, int(n**0.5))
    count = max(1, min(wanted, len(sample) // 8 if lists is None else len(sample), most_bytes // (8 * width)))
    centroids = _fitted(sample, count, rounds, seed) if len(sample) else np.zeros((count, width))
    table = pa.table({"list": pa.array(range(count), pa.int32()), "centroid": pa.array(centroids.tolist(), pa.list_(pa.float64())), "copies": pa.array([copies] * count, pa.int32())})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/centroids")
    index = Index(path, centroids, copies)
    add(index, rows)
    return index


def load(spark: SparkSession, path: str) -> Index:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # bounded by most_bytes
    return Index(path, np.array([r.centroid for r in rows], float), rows[0].copies)


def add(index: Index, rows: DataFrame) -> None:
    """Puts more rows (doc_id, vector) into the lists; nothing that is there is read or written again."""
    shared, copies = rows.sparkSession.sparkContext.broadcast(index.centroids), index.copies
    kind = rows.schema["doc_id"].dataType.simpleString()

    def code(batches):
        c = shared.value
        step = max(1, _CELLS // len(c))
        for b in (batch.slice(at, step) for batch in batches for at in range(0, batch.num_rows, step)):
            x = _unit(b.column("vector"), c.shape[1])
            near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :copies]
            row, own = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
            rest = x[row] - c[own]
            scale = np.abs(rest).max(axis=1) / 127
            codes = np.rint(rest / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
            slip = np.linalg.norm(rest - codes * scale[:, None], axis=1) + 1e-9
            columns = [pa.array(own, pa.int32()), b.column("doc_id").take(pa.array(row)), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(scale), pa.array(slip)]
            yield pa.RecordBatch.from_arrays(columns, ["list", "doc_id", "code", "scale", "slip"])

    coded = rows.select("doc_id", "vector").mapInArrow(code, f"list int, doc_id {kind}, code binary, scale double, slip double")
    # in order of list, so that a scan of some lists skips the row groups of others; a list of any size is cut over files
    coded.repartitionByRange("list", "doc_id").sortWithinPartitions("list").write.mode("append").parquet(f"{index.path}/codes")


def _probed(index: Index, queries: DataFrame, probes: int, first: np.ndarray, parts: np.ndarray) -> DataFrame:
    """query_id, qvector, lists, part: the probes lists nearest to a query as bits, a row for each part that any of them is in. first,
    parts: of each list its first part and how many it reaches over."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, first, parts))
    types = dict(queries.dtypes)

    def near(batches):
        c, first, parts = shared.value
        k, step = min(probes, len(c)), max(1, _CELLS // len(c))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                q = _unit(b.column("qvector"), c.shape[1])
                lists = np.argsort(-(q @ c.T), axis=1, kind="stable")[:, :k]
                asked = np.zeros((len(q), len(c)), bool)
                np.put_along_axis(asked, lists, True, axis=1)
                bits = [r.tobytes() for r in np.packbits(asked, axis=1)]
                into = [np.unique(np.repeat(first[r] - (np.cumsum(parts[r]) - parts[r]), parts[r]) + np.arange(parts[r].sum())).tolist() for r in lists]
                columns = [b.column("query_id"), b.column("qvector"), pa.array(bits, pa.binary()), pa.array(into, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "qvector", "lists", "parts"])

    found = queries.select("query_id", "qvector").mapInArrow(near, f"query_id {types['query_id']}, qvector {types['qvector']}, lists binary, parts array<int>")
    return found.select("query_id", "qvector", "lists", F.explode("parts").alias("part"))


def _largest(best: np.ndarray, at: np.ndarray, low: np.ndarray) -> np.ndarray:
    """best: of each query its largest values; the same with more values, low, of the queries at."""
    order = np.lexsort((-low, at))
    at, low = at[order], low[order]
    nth = np.arange(len(at)) - np.searchsorted(at, at)
    kept = nth < best.shape[1]
    more = np.full_like(best, -np.inf)
    more[at[kept], nth[kept]] = low[kept]
    return -np.partition(-np.concatenate((best, more), axis=1), best.shape[1] - 1, axis=1)[:, : best.shape[1]]


def _bounded(index: Index, k: int, step_rows: int = 4096, step_queries: int = 256):
    """Of the queries and the codes of a part, the pairs of lists that a query reads that can be among the k best of the part, with the
    bounds of their cosines. Some rows are compared with some queries at a time."""
    centroids, most = index.centroids, k * index.copies  # a row counts once, but is there for each of its lists

    def bounded(asked: pa.Table, rows: pa.Table) -> pa.Table:
        q = _unit(asked.column("qvector"), centroids.shape[1])
        bits = np.frombuffer(b"".join(asked.column("lists").to_pylist()), np.uint8).reshape(len(q), (len(centroids) + 7) // 8)
        some = bool((np.bitwise_count(bits).sum(axis=1) < len(centroids)).any())
        best = np.full((len(q), most), -np.inf)
        found, size = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]], 0

        def possible() -> list[np.ndarray]:
            whole = [np.concatenate(c) for c in zip(*found, strict=True)]
            kept = whole[3] >= best.min(axis=1, initial=np.inf)[whole[0]] - _SLACK
            return [c[kept] for c in whole]

        for row in range(0, rows.num_rows if len(q) else 0, step_rows):
            part = rows.slice(row, step_rows)
            own = part.column("list").to_numpy()
            codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.int8).reshape(part.num_rows, -1)
            slip = part.column("slip").to_numpy()
            x = centroids[own] + codes * part.column("scale").to_numpy()[:, None]
            for at in range(0, len(q), step_queries):
                near = q[at : at + step_queries] @ x.T
                if some:
                    near[((bits[at : at + step_queries, own >> 3] >> (7 - (own & 7)).astype(np.uint8)) & 1) == 0] = -np.inf
                low, own_best = near - slip, best[at : at + step_queries]
                least = own_best.min(axis=1)
                if np.isinf(least).any() and low.shape[1] >= most:
                    least = np.maximum(least, np.partition(low, -most, axis=1)[:, -most])
                high = near + slip
                i, j = np.nonzero((high >= least[:, None] - _SLACK) & (high > -np.inf))
                best[at : at + step_queries] = _largest(own_best, i, low[i, j])
                found.append([i + at, j + row, low[i, j], high[i, j]])
                size += len(i)
            if size > _CELLS:
                found = [possible()]
                size = len(found[0][0]) // 2
        i, j, low, high = possible()
        return pa.table({"query_id": asked.column("query_id").take(pa.array(i)), "doc_id": rows.column("doc_id").take(pa.array(j)), "low": pa.array(low), "high": pa.array(high)})

    return bounded


def candidates(index: Index, queries: DataFrame, k: int, probes: int = 16, part_rows: int = 200_000, most_query_rows: int = 5_000, task_rows: int = 500_000) -> DataFrame:
    """query_id, doc_id: what can be among the k best of the lists that were read. Lists that follow one another make parts of about
    part_rows rows, a longer list is several; queries are dealt into blocks, each pair of a part and a block is a group of its own.
    What the groups find is dealt by query to tasks of about task_rows."""
    spark = queries.sparkSession
    codes = spark.read.parquet(f"{index.path}/codes")
    cores = spark.sparkContext.defaultParallelism
    sizes = np.zeros(index.lists, np.int64)
    for r in codes.groupBy("list").agg(F.count("*").alias("n")).collect():  # a row for each list, of which there are fewer than fit most_bytes
        sizes[r.list] = r.n
    n = int(sizes.sum())
    width = max(1, -(-n // max(1, -(-n // part_rows), min(cores, n // 1000))))
    ends = np.cumsum(sizes)
    first = ((ends - sizes) // width).astype(np.int32)
    parts = np.where(sizes > width, (np.maximum(ends, 1) - 1) // width - first + 1, sizes > 0).astype(np.int32)
    plan = F.broadcast(spark.createDataFrame(pa.table({"list": pa.array(range(index.lists), pa.int32()), "first": pa.array(first), "parts": pa.array(parts)})))
    asked = written(_probed(index, queries, probes, first, parts))
    blocks = max(1, -(-queries.count() // most_query_rows))
    left = asked.select("query_id", "qvector", "lists", "part", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    dealt = F.col("first") + F.pmod(F.xxhash64("doc_id", "code"), F.col("parts")).cast("int")
    right = codes.join(plan, "list").select("doc_id", "list", "code", "scale", "slip", dealt.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    groups = blocks * max(1, -(-n // width))
    tasks = min(groups, max(4 * cores, groups // 16))
    left, right = (df.repartition(tasks, "part", "block").groupBy("part", "block") for df in (left, right))
    types = dict(queries.dtypes)["query_id"], dict(codes.dtypes)["doc_id"]
    found = written(left.cogroup(right).applyInArrow(_bounded(index, k), "query_id {}, doc_id {}, low double, high double".format(*types)))
    found = found.repartition(max(cores, -(-found.count() // task_rows)), "query_id")
    found = found.groupBy("query_id", "doc_id").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    by = Window.partitionBy("query_id")
    nth = found.withColumn("nth", F.row_number().over(by.orderBy(F.desc("low"))))
    possible = nth.withColumn("least", F.max(F.when(F.col("nth") == k, F.col("low"))).over(by)).filter((F.col("least").isNull()) | (F.col("high") >= F.col("least") - _SLACK))
    return possible.select("query_id", "doc_id")


def search(index: Index, queries: DataFrame, corpus: DataFrame, k: int, probes: int = 16) -> DataFrame:
    """query_id, doc_id, score, rank: of each query (query_id, qvector) the k best by cosine, of the rows of corpus (doc_id, vector) that
    lie in the probes lists nearest to it. With as many probes as lists the answer is that of ``rank.knn``; a query has fewer
    than k hits where its lists have fewer rows."""
    pairs = candidates(index, queries, k, probes)
    rows = pairs.join(corpus.select("doc_id", "vector"), "doc_id").join(queries.select("query_id", "qvector"), "query_id")
    return top(rows.select("query_id", "doc_id", F.round(cosine(F.col("qvector"), F.col("vector")), 6).alias("score")), k)
