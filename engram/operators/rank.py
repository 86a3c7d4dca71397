"""Rankers and rank fusion. Queries are rows, so a batch of any size is one job."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.text import text_score, tokens
from engram.shared import written


_RUNS = re.compile(r"[\w-]+")


def postings(docs: DataFrame, id_col: str, text_col: str, stopwords: list[str] | None = None) -> DataFrame:
    """doc_id, dl, term, tf: each document's terms with their count, and the document's length. The words of ``tokens``, counted
    inside the row, so that no token is shuffled."""
    stop = frozenset(stopwords or ())

    def counted(batches):
        for b in batches:
            rows, lengths, terms, counts = [], [], [], []
            for i, text in enumerate(pc.utf8_lower(b.column("text")).to_pylist()):
                words = [w for w in _RUNS.findall(text or "") if len(w) > 1 and w.isalpha() and w not in stop]
                found = Counter(words)
                rows += [i] * len(found)
                lengths += [len(words)] * len(found)
                terms += found.keys()
                counts += found.values()
                if len(rows) > 100_000 or i + 1 == b.num_rows:
                    columns = [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()), pa.array(terms, pa.string()), pa.array(counts, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "dl", "term", "tf"])
                    rows, lengths, terms, counts = [], [], [], []

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(counted, f"doc_id {kind}, dl bigint, term string, tf bigint")


def term_counts(posts: DataFrame) -> DataFrame:
    """term, df, cf: documents and occurrences of each term."""
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: n documents and their average length, also those without terms."""
    return docs.agg(F.count("*").alias("n")).crossJoin(terms.agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("all"))).select("n", (F.col("all") / F.col("n")).alias("avgdl"))


def indexed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, term counts and corpus statistics. The counts are written once; the postings are counted again where they are scored."""
    posts = postings(docs, id_col, text_col)
    terms = written(term_counts(posts))
    return posts, terms, corpus_stats(docs, terms)


def okapi_terms(terms: DataFrame, stats: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """term, df, idf: ln(n - df + .5) - ln(df + .5), and epsilon times the mean of all where that is negative."""
    terms = terms.join(F.broadcast(stats.select("n")))  # one row
    terms = terms.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = terms.agg(F.avg("raw").alias("mean"))
    return terms.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def lucene_terms(terms: DataFrame, stats: DataFrame) -> DataFrame:
    return terms.join(F.broadcast(stats.select("n"))).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def query_words(queries: DataFrame) -> DataFrame:
    """query_id, term, weight: repeated words of a query count."""
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").cast("double").alias("weight"))


def bm25_parts(queries: DataFrame, posts: DataFrame, terms: DataFrame, stats: DataFrame, k1: float, b: float, small_bytes: int = 32_000_000) -> DataFrame:
    """query_id, doc_id, term, tf, part. queries: query_id, term, weight; they are broadcast if their counted bytes fit ``small_bytes``, else
    they meet the postings in a shuffle."""
    wanted = queries.join(terms, "term")
    size = queries.agg(F.sum(F.octet_length("term") + 96)).first()[0] or 0  # with what a hash table adds to a row
    if size <= small_bytes:
        wanted = F.broadcast(wanted)
    tf, dl = F.col("tf"), F.col("dl")
    return (
        posts.join(wanted, "term")
        .join(F.broadcast(stats.select("avgdl")))
        .select("query_id", "doc_id", "term", "tf", (F.col("weight") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))).alias("part"))
    )


def top(hits: DataFrame, k: int, score: str = "score", by: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """The k best of each query, rank from 1, ties by document; planned as a group limit before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(score), doc)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25(queries: DataFrame, docs: DataFrame, k: int, id_col: str = "unit_id", text_col: str = "narrative", k1: float = 1.5, b: float = 0.75, index: tuple | None = None) -> DataFrame:
    """Okapi BM25. queries: query_id, text; repeated query words count. query_id, doc_id, score, rank. Of a query with words, documents
    without any of them score 0 and come last, by id, up to k in all; a query without words has no hits. index: of the same
    documents, from ``indexed``, where several searches share it."""
    posts, terms, stats = index or indexed(docs, id_col, text_col)
    words = written(query_words(queries))
    parts = bm25_parts(words, posts, okapi_terms(terms, stats), stats, k1, b).select("query_id", "doc_id", "part")
    best = written(top(parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score")), k).drop("rank"))
    few = words.select("query_id").distinct().join(best.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k), "query_id", "left_anti")
    # fewer than k hits leave at least k of the first 2 k documents
    first = docs.select(F.col(id_col).alias("doc_id")).orderBy("doc_id").limit(2 * k)
    zeros = few.join(F.broadcast(first)).withColumn("score", F.lit(0.0)).join(best.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return top(best.unionByName(zeros), k)


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    both = norm(a) * norm(b)
    return F.when(both > 0, dot / both).otherwise(F.lit(0.0))


def _matrix(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors padded by zeros to one length, their lengths, and whether each is known: neither null nor with a null."""
    flat = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], vectors.type)
    size = pc.fill_null(pc.list_value_length(flat), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values, of = pc.list_flatten(flat), pc.list_parent_indices(flat).to_numpy(zero_copy_only=False)
    known = pc.is_valid(flat).to_numpy(zero_copy_only=False).copy()
    known[of[pc.is_null(values).to_numpy(zero_copy_only=False)]] = False
    out = np.zeros((len(size), np.where(known, size, 0).max(initial=0)))
    place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    kept = known[of]
    out[of[kept], place[kept]] = values.to_numpy(zero_copy_only=False)[kept]
    size = np.where(known, size, 0)
    return out, size, known


def _cosines(asked: pa.Table, rows: pa.Table, cells: int = 1 << 18):
    """Of two groups, queries and rows, for some queries at a time: where they begin, their cosines with all rows, not rounded, and
    which of them are null; as ``cosine`` has them. cells: how many cosines are held at a time, of one query at least."""
    (q, q_size, q_known), (x, x_size, x_known) = _matrix(asked.column("qvector")), _matrix(rows.column("vector"))
    width = min(q.shape[1], x.shape[1])
    norms = []
    for m in (q, x):
        total = np.zeros(len(m))
        for d in range(m.shape[1]):  # one value after another, as in the JVM
            total += m[:, d] * m[:, d]
        norms.append(np.sqrt(total))
    x_t, step = np.ascontiguousarray(x.T), max(1, cells // max(1, len(x)))
    for at in range(0, len(q), step):
        part = slice(at, at + step)
        score = np.zeros((len(q[part]), len(x)))
        other = np.empty_like(score)
        for d in range(width):
            score += np.multiply(q[part, d, None], x_t[d], out=other)
        both = np.multiply(norms[0][part, None], norms[1], out=other)
        zero = (both <= 0) | ~(q_known[part, None] & x_known)
        with np.errstate(all="ignore"):
            score /= both
        score[zero] = 0.0
        yield at, score, ~zero & (q_size[part, None] != x_size)


def _best(k: int, by_document: bool = False):
    """Of two groups, queries and rows, the pairs that can be among the k best. by_document: the best row counts for its document."""

    def best(asked: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows.column("doc_id").combine_chunks(), null_placement="at_start"))
        docs, starts = rows.column("doc_id").combine_chunks(), None
        if by_document:
            same = pc.fill_null(pc.equal(docs[1:], docs[:-1]), False).to_numpy(zero_copy_only=False) if len(docs) else np.zeros(0, bool)
            starts = np.flatnonzero(np.concatenate(([True], ~same))) if len(docs) else np.zeros(0, np.int64)
            docs = docs.take(pa.array(starts))
        from_q, from_x, scores, unknown = [], [], [], []
        for at, score, null in _cosines(asked, rows):
            # NaN comes first and null last
            order = np.where(null, -np.inf, np.where(np.isnan(score), np.inf, score))
            if by_document and order.shape[1]:
                order = np.maximum.reduceat(order, starts, axis=1)
                score, null = np.where(order == np.inf, np.nan, order), order == -np.inf
            least = np.partition(order, -k, axis=1)[:, -k] if order.shape[1] > k else np.full(len(order), -np.inf)
            for i in range(len(order)):
                near = np.flatnonzero(order[i] >= least[i] - 2e-6)  # rounded later to six digits
                if len(near) > k:  # of equal scores the first k rows
                    near = near[np.argsort(-order[i, near], kind="stable")]
                    o = order[i, near]
                    start = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
                    near = near[np.arange(len(o)) - np.repeat(start, np.diff(np.append(start, len(o)))) < k]
                from_q.append(np.full(len(near), at + i))
                from_x.append(near)
                scores.append(score[i, near])
                unknown.append(null[i, near])
        return _pairs(asked, docs, from_q, from_x, scores, unknown)

    return best


def _above(least: float):
    """Of two groups, queries and rows, the pairs whose rounded cosine reaches ``least``."""

    def above(asked: pa.Table, rows: pa.Table) -> pa.Table:
        from_q, from_x, scores = [], [], []
        for at, score, null in _cosines(asked, rows):
            i, j = np.nonzero(~null & ((score >= least - 1e-6) | np.isnan(score)))
            from_q.append(i + at)
            from_x.append(j)
            scores.append(score[i, j])
        return _pairs(asked, rows.column("doc_id"), from_q, from_x, scores, [np.zeros(len(x), bool) for x in scores])

    return above


def _pairs(asked: pa.Table, docs, *found: list) -> pa.Table:
    at_q, at_x, score, null = (np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(found, (np.int64, np.int64, float, bool), strict=True))
    return pa.table({"query_id": asked.column("query_id").take(pa.array(at_q)), "doc_id": docs.take(pa.array(at_x)), "score": pa.array(score, pa.float64(), mask=null)})


def _compared(queries: DataFrame, corpus: DataFrame, compare, most_query_rows: int, most_corpus_rows: int) -> DataFrame:
    """Every query with every row, block by block: queries are dealt into blocks, the corpus into parts, each block meets each part in a
    group of its own, which keeps only what ``compare`` finds."""
    blocks = max(-(-queries.count() // most_query_rows), 1)
    n, cores = corpus.count(), corpus.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-n // most_corpus_rows), min(n, cores), 1)
    dealt = lambda of, *by: F.pmod(F.xxhash64(*by), F.lit(of)).cast("int")  # noqa: E731  by what a row holds, so that a task that runs again deals alike
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    asked = queries.select("query_id", "qvector", dealt(blocks, "query_id", "qvector").alias("block")).withColumn("part", every(parts))
    rows = corpus.select("doc_id", "vector", dealt(parts, "doc_id", "vector").alias("part")).withColumn("block", every(blocks))
    tasks = min(blocks * parts, max(4 * cores, blocks * parts // 16))
    asked, rows = (df.repartition(tasks, "block", "part").groupBy("block", "part") for df in (asked, rows))
    types = dict(queries.dtypes)["query_id"], dict(corpus.dtypes)["doc_id"]
    found = asked.cogroup(rows).applyInArrow(compare, "query_id {}, doc_id {}, score double".format(*types))
    return found.withColumn("score", F.round("score", 6))


def knn(queries: DataFrame, corpus: DataFrame, k: int, most_query_rows: int = 10_000, most_corpus_rows: int = 20_000, allowed: Column | None = None, least: float | None = None) -> DataFrame:
    """Exact. queries: query_id, qvector, of any number; corpus: doc_id, vector and what the filter ``allowed`` reads, which holds
    before scores are made. Of each query the k best by cosine, of those that reach the radius ``least``, if it is given. A query or row
    without a direction (norm 0, null) scores 0 with all: give a radius above 0 where it shall have no hits."""
    corpus = corpus if allowed is None else corpus.filter(allowed)
    found = _compared(queries, corpus, _best(k), most_query_rows, most_corpus_rows)
    return top(found if least is None else found.filter(F.col("score") >= least), k)


def knn_within(queries: DataFrame, corpus: DataFrame, group: str, k: int, part_rows: int = 5_000, most_query_rows: int = 2_000, least: float | None = None) -> DataFrame:
    """As ``knn``, but a query (group, query_id, qvector) meets only the rows of its own group (group, doc_id, vector). A group of many rows
    or queries is several parts and blocks, each pair of them compared in a task of its own."""
    sizes = corpus.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("n")).join(queries.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__asked")), "__g")
    plan = written(sizes.select("__g", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"), F.ceil(F.col("__asked") / most_query_rows).cast("int").alias("blocks")))
    dealt = lambda of, *by: F.pmod(F.xxhash64(*by), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    asked = queries.join(plan, F.col(group) == F.col("__g")).select("query_id", "qvector", "__g", "parts", dealt("blocks", "query_id", "qvector").alias("block")).withColumn("part", every("parts")).drop("parts")
    rows = corpus.join(plan, F.col(group) == F.col("__g")).select("doc_id", "vector", "__g", "blocks", dealt("parts", "doc_id", "vector").alias("part")).withColumn("block", every("blocks")).drop("blocks")
    types = dict(queries.dtypes)["query_id"], dict(corpus.dtypes)["doc_id"]
    asked, rows = asked.toDF("query_id", "qvector", "qg", "qblock", "qpart"), rows.toDF("doc_id", "vector", "dg", "dpart", "dblock")
    pairs = asked.groupBy("qg", "qpart", "qblock").cogroup(rows.groupBy("dg", "dpart", "dblock"))
    found = pairs.applyInArrow(_best(k), "query_id {}, doc_id {}, score double".format(*types)).withColumn("score", F.round("score", 6))
    return top(found if least is None else found.filter(F.col("score") >= least), k)


def within(queries: DataFrame, corpus: DataFrame, least: float, most_query_rows: int = 10_000, most_corpus_rows: int = 20_000) -> DataFrame:
    """query_id, doc_id, score: all rows whose cosine reaches ``least``."""
    return _compared(queries, corpus, _above(least), most_query_rows, most_corpus_rows).filter(F.col("score") >= least)


def max_sim(queries: DataFrame, facts: DataFrame, k: int, fields: DataFrame | None = None, most_query_rows: int = 10_000, most_corpus_rows: int = 20_000) -> DataFrame:
    """Best cosine over a document's vectors. facts: doc_id, vector, several rows a document. fields, alike, has the vectors of whole
    fields; they count for documents that have no fact."""
    rows = facts.select("doc_id", "vector")
    if fields is not None:
        rows = rows.unionByName(fields.select("doc_id", "vector").join(facts.select("doc_id").distinct(), "doc_id", "left_anti"))
    found = _compared(queries, rows, _best(k, by_document=True), most_query_rows, most_corpus_rows)
    return top(found.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k)


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """lists: query_id, list_no, doc_id, rank. Sum of 1 / (k + rank)."""
    return lists.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))


def fused(lists: DataFrame, n: int, k: int = 60) -> DataFrame:
    """lists: query_id, list_no, doc_id, rank, score. Reciprocal rank fusion of a query's lists, the best n: query_id, doc_id, score,
    rank. A query with one list keeps it as it is, with its scores and order."""
    one = lists.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"), F.max("score").alias("own"), F.min("rank").alias("first"))
    sides = lists.groupBy("query_id").agg(F.count_distinct("list_no").alias("sides"))
    single = F.col("sides") == 1
    both = one.join(sides, "query_id").select("query_id", "doc_id", F.when(single, F.col("own")).otherwise(F.col("rrf")).alias("score"), F.when(single, -F.col("first")).otherwise(F.col("rrf")).alias("key"))
    return top(both, n, "key").drop("key")


def retrieved(queries: DataFrame, vectors: DataFrame, docs: DataFrame, rows: DataFrame, k: int, modes: tuple[str, ...] = ("bm25", "embedding", "rrf"), each: int = 50, search: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """One row shape for every mode over a source of data: mode, query_id, doc_id, score, rank. queries: query_id, text; vectors: query_id,
    qvector; docs (unit_id, narrative) and rows (doc_id, vector): the source's texts and vectors. search: gives the rows of ``bm25`` for
    queries and their number of hits, by a kept index."""
    words = written(search(queries, each) if search else bm25(queries, docs, each)) if {"bm25", "rrf"} & {*modes} else None
    near = written(knn(vectors, rows, each)) if {"embedding", "rrf"} & {*modes} else None
    parts = {
        "bm25": lambda: words.filter(F.col("rank") <= k),
        "embedding": lambda: near.filter(F.col("rank") <= k),
        "rrf": lambda: top(rrf(words.withColumn("list_no", F.lit(0)).unionByName(near.withColumn("list_no", F.lit(1)))), k),
    }
    out = None
    for mode in modes:
        found = parts[mode]().select(F.lit(mode).alias("mode"), "query_id", "doc_id", "score", "rank")
        out = found if out is None else out.unionByName(found)
    return out


def in_turn(lists: DataFrame) -> DataFrame:
    """lists: query_id, list_no, doc_id, rank. The lists of a query one after another, documents only where they come first."""
    first = lists.groupBy("query_id", "doc_id").agg(F.min(F.struct("list_no", "rank")).alias("at"))
    return first.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "doc_id")).alias("rank"))


def origins(*rounds: tuple[str, DataFrame]) -> DataFrame:
    """query_id, doc_id, origin: the first of the named rounds (query_id, doc_id) that has the document."""
    rows = None
    for no, (name, hits) in enumerate(rounds):
        own = hits.select("query_id", "doc_id", F.struct(F.lit(no).alias("no"), F.lit(name).alias("name")).alias("o"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("query_id", "doc_id").agg(F.min("o")["name"].alias("origin"))


def rerank(hits: DataFrame, scores: DataFrame, least_success: float = 0.3) -> DataFrame:
    """hits: query_id, doc_id, rank, of documents that have a text; scores: query_id, doc_id, rerank_score. New order by the scores, the
    old one for queries of which fewer than least_success of the hits have any; in the new order unscored hits come last."""
    joined = hits.join(scores, ["query_id", "doc_id"], "left")
    share = F.avg(F.when(F.col("rerank_score").isNotNull(), 1.0).otherwise(0.0)).over(Window.partitionBy("query_id"))
    joined = joined.withColumn("reranked", share >= least_success)
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("reranked"), -F.col("rerank_score")).asc_nulls_last(), "rank")
    return joined.withColumn("new_rank", F.row_number().over(order))


def merge_rounds(first: DataFrame, second: DataFrame, most: int) -> DataFrame:
    """query_id, doc_id, origin, place: the first round's hits in order, then those that only the second has, at most ``most``."""
    new = second.join(first.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    of = lambda hits, name: hits.select("query_id", "doc_id", F.lit(name).alias("origin"), "rank")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("origin", "rank")).cast("long")
    both = of(first, "round1").unionByName(of(new, "round2")).withColumn("place", place)
    return both.filter(F.col("place") <= most).select("query_id", "doc_id", "origin", "place")


def explain(queries: DataFrame, docs: DataFrame, k: int, id_col: str = "unit_id", text_col: str = "narrative", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, term, tf, part: what each term adds to the BM25 score of the k best of each query."""
    posts, terms, stats = indexed(docs, id_col, text_col)
    parts = bm25_parts(written(query_words(queries)), posts, okapi_terms(terms, stats), stats, k1, b)
    best = top(parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score")), k).select("query_id", "doc_id")
    return parts.join(best, ["query_id", "doc_id"], "left_semi").select("query_id", "doc_id", "term", "tf", F.round("part", 6).alias("part"))


def normalised(hits: DataFrame, by: str, score: str) -> DataFrame:
    """Scores of each group from 0 to 1: the sigmoid if all are below 1, else by minimum and maximum, 0.5 where those are equal."""
    w, x = Window.partitionBy(by), F.col(score)
    most, least = F.max(score).over(w), F.min(score).over(w)
    return hits.withColumn(score, F.when(most < 1, 1 / (1 + F.exp(-x))).when(most == least, F.lit(0.5)).otherwise((x - least) / F.nullif(most - least, F.lit(0.0))))


def boosted(queries: DataFrame, docs: DataFrame, k: int, allowed: Column | None = None, id_col: str = "unit_id", text_col: str = "narrative", words: int = 10) -> DataFrame:
    """Keyword search: of a query its ``words`` words with the highest text score count, each boosted by it; at least one must
    be found. Only documents for which ``allowed`` holds are hits; frequencies are those of all. query_id, doc_id, score, rank."""
    posts, terms, stats = indexed(docs, id_col, text_col)
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).withColumn("weight", text_score(F.col("term")))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "term"))
    asked = asked.withColumn("nth", nth).filter(F.col("nth") <= words).select("query_id", "term", "weight")
    asked = written(asked)
    some = posts if allowed is None else postings(docs.filter(allowed), id_col, text_col)
    parts = bm25_parts(asked, some, lucene_terms(terms, stats), stats, 1.2, 0.75)
    return top(parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score")), k)


def two_rounds(first: DataFrame, second: DataFrame, sufficient: DataFrame, scores: DataFrame, k: int = 20, most: int = 40) -> DataFrame:
    """Queries whose first hits are sufficient (query_id, is_sufficient; unknown: they are) keep the best k of them; of the others the
    first and second round are merged, at most ``most``, and reordered by scores (query_id, doc_id, rerank_score), the best k kept."""
    known = first.select("query_id").union(second.select("query_id")).distinct().join(sufficient, "query_id", "left")
    enough = known.select("query_id", F.coalesce("is_sufficient", F.lit(True)).alias("enough"))
    done = first.join(enough.filter("enough"), "query_id").filter(F.col("rank") <= k).select("query_id", "doc_id", F.col("rank").cast("long").alias("place"), F.lit(1).alias("rounds"))
    open_ids = enough.filter("not enough").select("query_id")
    merged = merge_rounds(first.filter(F.col("rank") <= k).join(open_ids, "query_id"), second.join(open_ids, "query_id"), most).withColumnRenamed("place", "rank")
    again = rerank(merged, scores).filter(F.col("new_rank") <= k)
    return done.unionByName(again.select("query_id", "doc_id", F.col("new_rank").cast("long").alias("place"), F.lit(2).alias("rounds")))
