"""The kept indexes: inverted file of vectors and inverted index of words, against exact search over all rows."""

import inspect
import random
import threading
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engram import tables as T
from engram import shared
from engram.functions import text as X
from engram.operators import inverted, ivf, rank

from .conftest import TINY

BIG = "/root/testdata/sf0.1"


def hits(df):
    return {(r.query_id, r.rank): (r.doc_id, r.score) for r in df.collect()}


def test_recall_of_some_lists(spark):
    rows = T.vectors(spark, BIG).select(F.col("vec_id").alias("doc_id"), "vector")
    queries = T.vectors(spark, BIG).filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("qvector"))
    index = ivf.build(rows)
    assert index.lists > 16
    exact = {}
    for r in rank.knn(queries, rows, 20).collect():
        exact.setdefault(r.query_id, set()).add(r.doc_id)
    recall = {}
    for probes in (index.lists // 4, index.lists // 2, index.lists):
        found = {}
        for r in ivf.search(index, queries, rows, 20, probes).collect():
            found.setdefault(r.query_id, set()).add(r.doc_id)
        recall[probes] = np.mean([len(found.get(q, set()) & docs) / len(docs) for q, docs in exact.items()])
    assert recall[index.lists // 2] >= 0.9 and recall[index.lists] == 1.0, recall
    # codes leave few rows to be scored whole
    few = ivf.candidates(index, queries, 20, index.lists // 2).count()
    assert few < 0.2 * len(exact) * rows.count()


def test_hot_lists_ties_and_odd_vectors(spark):
    draw = np.random.default_rng(4)
    x = np.round(draw.normal(size=(400, 5)), 1)
    x[50:250] = x[50]  # one list holds half of all rows
    x[300] = 0
    vectors = [v.tolist() for v in x]
    vectors[301], vectors[302] = None, [1.0, 2.0]
    some = [(i, v) for i, v in enumerate(vectors) if i != 302]
    corpus = spark.createDataFrame(some, "doc_id long, vector array<double>")
    queries = spark.createDataFrame([(i, vectors[i]) for i in (0, 50, 51, 300, 399)], "query_id long, qvector array<double>")
    index = ivf.build(corpus, lists=9)
    pairs = ivf.candidates(index, queries, 7, 9, part_rows=30, most_query_rows=2)
    assert pairs.count() > 0
    assert hits(ivf.search(index, queries, corpus, 7, probes=9)) == hits(rank.knn(queries, corpus, 7))
    # more rows, without building again
    more = spark.createDataFrame([(1000 + i, (x[399] + 0.01 * i).tolist()) for i in range(5)], corpus.schema)
    ivf.add(index, more)
    again = ivf.load(spark, index.path)
    assert hits(ivf.search(again, queries, corpus.unionByName(more), 7, probes=99)) == hits(rank.knn(queries, corpus.unionByName(more), 7))


def test_cosines_hold_few_at_a_time():
    draw = np.random.default_rng(5)
    q, x = draw.normal(size=(600, 16)), draw.normal(size=(5000, 16))
    q[7] = 0
    kind = pa.list_(pa.float64())
    asked, rows = pa.table({"qvector": pa.array(q.tolist(), kind)}), pa.table({"vector": pa.array(x.tolist(), kind)})
    with np.errstate(invalid="ignore"):
        wanted = np.nan_to_num((q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1))
    seen = 0
    tracemalloc.start()
    for at, score, null in rank._cosines(asked, rows):
        assert np.allclose(score, wanted[at : at + len(score)], atol=1e-12) and not null.any()
        seen += len(score)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 600 and most < 24_000_000, most


def test_queries_meet_parts_not_lists(spark, monkeypatch):
    rows = T.vectors(spark, BIG).select(F.col("vec_id").alias("doc_id"), "vector")
    queries = rows.filter("doc_id % 20 = 0").toDF("query_id", "qvector")
    index = ivf.build(rows)
    sizes = []

    def counted(df):
        table = shared.written(df)
        sizes.append(table.count())
        return table

    monkeypatch.setattr(ivf, "written", counted)
    found = ivf.search(index, queries, rows, 20, index.lists)
    assert hits(found) == hits(rank.knn(queries, rows, 20))
    # k of each list and query, and a row for each list and query, are not written
    assert index.lists > 40 and sum(sizes) < queries.count() * index.lists * 20 / 2, sizes


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, vector array<double>")
    index = ivf.build(none)
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, qvector array<double>")
    assert ivf.search(index, queries, none, 3).count() == 0


def corpus_of(seed, n, start=0):
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "lmnopqrstu"]
    weights = [1 / (k + 1) for k in range(len(words))]
    return [(start + i, " ".join(draw.choices(words, weights, k=draw.choice([0, 3, 40, 200])))) for i in range(n)]


@pytest.mark.parametrize("k", [1, 5, 40])
def test_pruned_search_is_exact(spark, k):
    docs = spark.createDataFrame([*corpus_of(1, 500), *[(900 + i, "al al bm same") for i in range(60)], (999, None)], "unit_id long, narrative string")
    asked = [(i, t) for i, t in corpus_of(2, 25)] + [(100, "same bm"), (101, "nowhere"), (102, ""), (103, "al bl cl"), (104, "al al al hu")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    index = inverted.build(docs)
    wanted = hits(rank.bm25(queries, docs, k))
    assert hits(inverted.bm25(index, queries, k)) == wanted
    assert hits(inverted.bm25(index, queries, k, share=1, least_cells=0)) == wanted  # some by blocks
    assert hits(inverted.bm25(index, queries, k, share=0, least_cells=0)) == wanted  # all by blocks


def test_postings_read(spark):
    """Far fewer than there are pairs of query and document, and than the words have postings."""
    docs = T.memunits(spark, BIG)
    index = inverted.build(docs)
    texts = docs.filter("unit_id % 40 = 0").select(F.col("unit_id").alias("query_id"), F.array_join(F.slice(X.tokens(F.col("narrative")), 3, 3), " ").alias("text"))
    words = rank.query_words(texts)
    seen = inverted.search(index, words, 10).read.agg(F.sum(F.when(~F.col("unread") | F.col("seed"), F.col("n"))).alias("read"), F.sum("n").alias("all")).first()
    pairs = texts.count() * docs.count()
    assert seen["read"] < pairs / 5 and seen["read"] < seen["all"] / 2, (seen, pairs)


def test_added_documents_are_merged(spark):
    first, second = corpus_of(5, 300), corpus_of(6, 100, 1000) + [(2000, "onlyhere al bm")]
    frame = lambda rows: spark.createDataFrame(rows, "unit_id long, narrative string")
    queries = spark.createDataFrame(corpus_of(7, 12) + [(50, "onlyhere"), (51, "al bm cn")], "query_id long, text string")
    index = inverted.build(frame(first))
    files = set(index.blocks.inputFiles())
    for _ in range(2):  # the same batch again replaces itself
        index = inverted.add(frame(second), index.path, batch=1)
    assert files < set(index.blocks.inputFiles())
    assert hits(inverted.bm25(index, queries, 10)) == hits(rank.bm25(queries, frame(first + second), 10))


def test_kept_until_the_table_changes(spark, tmp_path):
    built = []
    def build(path):
        built.append(path)
        spark.range(3).write.parquet(path)
    source = str(tmp_path / "t.parquet")
    spark.range(5).write.parquet(source)
    with shared.scratch(spark):
        a = shared.kept(spark, "x", source, build)
    assert shared.kept(spark, "x", source, build) == a and len(built) == 1 and spark.read.parquet(a).count() == 3
    spark.range(6).write.mode("overwrite").parquet(source)
    assert shared.kept(spark, "x", source, build) != a and len(built) == 2


def test_scopes_of_threads(spark):
    """Two threads write tables in scopes of their own; the end of one leaves those of the other."""
    inside, done, out = threading.Event(), threading.Event(), []
    def other():
        with shared.scratch(spark):
            table = shared.written(spark.range(4))
            inside.set()
            done.wait(60)
            out.append(table.count())
    t = threading.Thread(target=other)
    t.start()
    inside.wait(60)
    with shared.scratch(spark):
        assert shared.written(spark.range(2)).count() == 2
    done.set()
    t.join()
    assert out == [4]


def test_dealt_by_what_a_row_holds(spark):
    """The parts of the exact search don't depend on the order of rows in partitions."""
    x = np.random.default_rng(0).normal(size=(200, 4))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vector array<double>")
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(5)], "query_id long, qvector array<double>")
    plan = rank._compared(queries, corpus, rank._best(3), 10, 20)._jdf.queryExecution().toString()
    assert "monotonically" not in plan
    assert hits(rank.knn(queries, corpus.orderBy(F.desc("doc_id")), 3, 2, 20)) == hits(rank.knn(queries, corpus, 3, 2, 20))


def test_boosted_words_by_the_index(spark):
    docs = spark.createDataFrame([*corpus_of(1, 200), (999, None)], "unit_id long, narrative string").withColumn("odd", F.col("unit_id") % 2 == 1)
    queries = spark.createDataFrame([*corpus_of(2, 10), (101, "nowhere"), (102, "")], "query_id long, text string")
    index = inverted.build(docs)
    assert hits(inverted.boosted(index, queries, 7)) == hits(rank.boosted(queries, docs, 7))
    some = docs.filter("odd").select(F.col("unit_id").alias("doc_id"))
    assert hits(inverted.boosted(index, queries, 7, some)) == hits(rank.boosted(queries, docs, 7, allowed=F.col("odd")))


def test_tiny_index(spark):
    assert inverted.build(T.memunits(spark, TINY)).docs.count() == T.memunits(spark, TINY).count()


def test_texts_become_objects_in_small_pieces():
    """A batch of ten thousand texts is never a list of Python objects as a whole."""
    texts = ["ab " * (i % 50) for i in range(10_000)] + [None, "x" * 3_000_000, "", "last"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    parts = list(inverted._pieces(batch))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(p.num_rows == 1 or (p.num_rows <= 256 and sum(len(t or "") for t in p.column("text").to_pylist()) <= 1 << 20) for p in parts)
    assert list(inverted._pieces(batch.slice(0, 0))) == []


def test_few_copies_are_dealt():
    """Of half a million queries of three words over as many documents, no document goes to more than a few blocks."""
    names = ("block_words", "block_queries", "part_docs")
    sizes = [inspect.signature(inverted._scanned).parameters[n].default for n in names]
    blocks, parts = inverted._dealing(1_500_000, 500_000, 500_000, 12, *sizes)
    assert blocks <= 5 and parts <= 50
    assert inverted._dealing(3, 1, 2, 12, *sizes) == (1, 2) and inverted._dealing(0, 0, 0, 12, *sizes) == (1, 1)


@pytest.mark.parametrize(("words", "least"), [(3, 0.1), (60, 0.1), (20, -2.0)])
def test_scores_of_common_and_rare_words(words, least):
    """By matrix, row by row or by postings, also with weights below 0, in steps of several sizes: the sums of each pair."""
    r = np.random.default_rng(words)
    share = 1 / np.arange(1, 301)
    docs = [np.unique(r.choice(300, size=r.integers(0, 90), p=share / share.sum()), return_counts=True) for _ in range(70)]
    asked = [(q, int(t), float(r.uniform(least, 5))) for q in range(40) for t in np.unique(r.choice(300, size=words, p=share / share.sum()))]
    told = pa.table({"query_id": [a[0] for a in asked], "term": [f"w{a[1]}" for a in asked], "w": [a[2] for a in asked]})
    rows = pa.table({"doc_id": list(range(70)), "dl": [int(c.sum()) for _, c in docs], "terms": pa.array([[f"w{t}" for t in d] for d, _ in docs], pa.list_(pa.string())), "tfs": pa.array([c.tolist() for _, c in docs], pa.list_(pa.int32()))})
    wanted = {}
    for q in range(40):
        found = {}
        for d, (terms, counts) in enumerate(docs):
            tf, dl = dict(zip(terms.tolist(), counts.tolist(), strict=True)), counts.sum()
            own = [w * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * dl / 30)) for p, t, w in asked if p == q and t in tf]
            if own:
                found[d] = round(sum(own), 6)
        wanted |= {(q, d): found[d] for d in sorted(found, key=lambda d: (-found[d], d))[:5]}
    for cells in (1, 500, 1_000_000):
        got = inverted._dense(5, 30.0, 1.5, 0.75, most_cells=cells)(told, rows)
        assert dict(zip(zip(got.column("query_id").to_pylist(), got.column("doc_id").to_pylist(), strict=True), got.column("score").to_pylist(), strict=True)) == pytest.approx(wanted, abs=2e-6)


def test_groups_of_vectors_are_small():
    """No cosines of more than 256 queries with 5,000 rows are held at once; nulls, null values and lengths are told apart."""
    defaults = {n: inspect.signature(rank.knn_within).parameters[n].default for n in ("part_rows", "most_query_rows")}
    assert defaults["part_rows"] <= 5_000 and defaults["most_query_rows"] <= 5_000
    rows = pa.chunked_array([[[1.0, 2.0], None, []], [[3.0, None, 4.0], [5.0, 6.0, 7.0]]], pa.list_(pa.float64()))
    values, size, known = rank._matrix(rows)
    assert values.tolist() == [[1, 2, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0], [5, 6, 7]]
    assert size.tolist() == [2, 0, 0, 0, 3] and known.tolist() == [True, False, True, False, True]
    assert rank._matrix(pa.chunked_array([], pa.list_(pa.float64())))[0].shape == (0, 0)


def test_scored_texts_are_sliced():
    from engram.llm import quality_mil

    batches = [pa.RecordBatch.from_pydict({"t": list(range(n))}) for n in (1000, 0, 3)]
    slices = list(quality_mil._slices(iter(batches)))
    assert max(s.num_rows for s in slices) <= 256 and [x for s in slices for x in s.column("t").to_pylist()] == [*range(1000), 0, 1, 2]



def test_blocks_are_cut_when_a_search_goes_by_them(spark):
    """Searches over the documents need none."""
    docs = spark.createDataFrame(corpus_of(1, 200), "unit_id long, narrative string")
    queries = spark.createDataFrame(corpus_of(2, 10), "query_id long, text string")
    path, asked = shared.shared_dir(spark), []
    inverted.build(docs, path=path, blocks=False)

    def cut():
        asked.append(shared.shared_dir(spark))
        inverted.cut(spark, path, asked[-1])
        return asked[-1]

    index, wanted = inverted.load(spark, path, cut), hits(rank.bm25(queries, docs, 5))
    assert hits(inverted.bm25(index, queries, 5)) == wanted and not asked
    assert hits(inverted.bm25(index, queries, 5, share=0, least_cells=0)) == wanted and len(asked) == 1


def test_part_of_an_index_is_a_corpus(spark):
    """Its frequencies, lengths and documents without any word of a query are those of the part alone."""
    docs = spark.createDataFrame([*corpus_of(1, 200), (999, None)], "unit_id long, narrative string")
    queries = spark.createDataFrame([*corpus_of(2, 10), (101, "nowhere"), (102, "")], "query_id long, text string")
    some = inverted.within(inverted.build(docs, blocks=False), F.col("doc_id") % 3 == 0)
    own = docs.filter("unit_id % 3 = 0")
    assert hits(inverted.bm25(some, queries, 7)) == hits(rank.bm25(queries, own, 7))
    assert hits(inverted.bm25(some, queries, 7, share=0, least_cells=0)) == hits(rank.bm25(queries, own, 7))
    v = spark.createDataFrame([(1, [1.0])], "query_id long, qvector array<double>")
    x = own.select(F.col("unit_id").alias("doc_id"), F.array(F.lit(1.0)).alias("vector"))
    found = rank.retrieved(queries, v, docs.limit(0), x, 5, search=lambda q, k: inverted.bm25(some, q, k))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rank.retrieved(queries, v, own, x, 5).collect()))


def test_explained_by_the_index(spark):
    docs = spark.createDataFrame([*corpus_of(1, 200), (999, None)], "unit_id long, narrative string")
    queries = spark.createDataFrame([*corpus_of(2, 10), (101, "nowhere"), (102, ""), (103, "al al bm")], "query_id long, text string")
    rows = lambda df: sorted((r.query_id, r.doc_id, r.term, r.tf, round(r.part, 6)) for r in df.collect())
    found = inverted.explain(inverted.build(docs, blocks=False), queries, 5)
    wanted = rank.explain(queries, docs, 5)
    assert rows(found) == rows(wanted) and found.schema["tf"].dataType == wanted.schema["tf"].dataType
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()  # no text is read again


def test_documents_are_dealt_to_one_block():
    """Of half a million queries of three words over as many documents a document is shuffled once, and a query and its hits to no more parts than cores."""
    sizes = [inspect.signature(inverted._scanned).parameters[n].default for n in ("block_words", "block_queries", "part_docs")]
    assert inverted._dealing(1_500_000, 512_820, 512_820, 12, *sizes) == (1, 12)


@pytest.mark.parametrize(("words", "least"), [(3, 0.1), (60, 0.1), (20, -2.0)])
def test_documents_in_a_stream(words, least):
    """The k best of a part that is read in slices, also with equal scores, queries of the same frequent words and weights below 0, are those of all its documents at once."""
    r = np.random.default_rng(words)
    share = 1 / np.arange(1, 301)
    share /= share.sum()
    drawn = [np.unique(r.choice(300, size=r.integers(1, 90), p=share), return_counts=True) for _ in range(200)]
    docs = [drawn[i % 150] for i in range(300)]  # half of them twice
    asked = [(q, [f"w{t}" for t in ts], r.uniform(least, 5, len(ts)).tolist() if q % 2 else [1.5] * len(ts)) for q in range(90) for ts in [np.unique(r.choice(300, size=words, p=share))]]
    told = pa.table({"query_id": [q for q, ts, _ in asked for _ in ts], "term": [t for _, ts, _ in asked for t in ts], "w": [w for *_, ws in asked for w in ws]})
    rows = pa.table({"doc_id": list(range(300)), "dl": [int(c.sum()) for _, c in docs], "terms": pa.array([[f"w{t}" for t in d] for d, _ in docs], pa.list_(pa.string())), "tfs": pa.array([c.tolist() for _, c in docs], pa.list_(pa.int32()))})
    names = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("dl", pa.int64()), ("words", pa.string()), ("ws", pa.list_(pa.float64())), ("tfs", pa.list_(pa.int32()))])
    lines = [(q, None, None, " ".join(ts), ws, None) for q, ts, ws in asked] + [(None, i, int(c.sum()), " ".join(f"w{t}" for t in d), None, c.tolist()) for i, (d, c) in enumerate(docs)]
    table = pa.Table.from_pylist([dict(zip(names.names, line, strict=True)) for line in lines], names)
    best = lambda found: sorted(zip(*(found.column(c).to_pylist() for c in ("query_id", "doc_id", "score")), strict=True))
    wanted = best(inverted._dense(5, 30.0, 1.5, 0.75, most_cells=1_000_000)(told, rows))
    for cells, most in ((1, 20), (700, 90), (1_000_000, 20)):
        dense = inverted._dense(5, 30.0, 1.5, 0.75, most_cells=cells, most_words=most)
        for size in (1, 64, 1000):
            found = pa.Table.from_batches(inverted._streamed(dense, most_rows=40, most_posts=500, first_rows=3)(iter(table.to_batches(size))))
            assert best(found) == wanted


def test_parts_of_vectors_are_large():
    """At 615,384 vectors a query goes to no more than some 30 parts, each of which gives its k best."""
    for f in (rank.knn, rank.within, rank.max_sim):
        assert 615_384 / inspect.signature(f).parameters["most_corpus_rows"].default < 32


def test_scanned_documents_are_not_held():
    """Of a slice of a part only the ids stay, not the batch that it came in."""
    words = " ".join(f"w{i}" for i in range(2000))
    names = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("dl", pa.int64()), ("words", pa.string()), ("ws", pa.list_(pa.float64())), ("tfs", pa.list_(pa.int32()))])
    line = lambda *x: pa.RecordBatch.from_pylist([dict(zip(names.names, x, strict=True))], names)
    held = []

    def batches():
        yield line(1, None, None, "w0", [1.0], None)
        for i in range(200):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, names) as out:
                out.write_batch(line(None, i, 2000, words, None, [1] * 2000))
            held.append(pa.total_allocated_bytes())
            with pa.ipc.open_stream(sink.getvalue()) as got:  # as they come from Spark: all columns in one buffer
                yield from got

    (found,) = inverted._streamed(inverted._dense(3, 30.0, 1.5, 0.75))(batches())
    assert found.column("doc_id").to_pylist() == [0, 1, 2] and held[-1] - held[20] < 1_000_000
