"""Every query with SQL against DuckDB, and fixtures whose results are known."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.operators import clusters, profiles, rank
from engram.plans import queries as plans
from engram.streaming import state

from .conftest import SMALL, TINY
from .oracle import connect, difference


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, duck, name):
    assert difference(plans.QUERIES[name](spark, SMALL), plans.SQL[name], duck) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("n", "code"), [(0, "0"), (61, "Z"), (62, "10"), (1_000_000, "4c92")])
def test_base62(spark, n, code):
    assert one(spark, X.base62(F.lit(n))) == code


@pytest.mark.parametrize("n", [62**4 - 1, 62**4, 62**5 - 1, 62**7 - 2, 62**10 - 1, 2**63 - 1])
def test_base62_is_exact(spark, n):
    """One less than a power: its quotients are just below whole numbers."""
    digits, rest = "", n
    while rest:
        digits, rest = X.BASE62[rest % 62] + digits, rest // 62
    assert one(spark, X.base62(F.lit(n).cast("long"))) == digits


@pytest.mark.parametrize("n", [62**4 - 1, 62**5 - 1, 2**63 - 1])
def test_codes_are_read_back(spark, n):
    assert one(spark, X.unbase62(X.short_code(F.lit(n).cast("long")))) == n


def test_sessions_count_whole_seconds(spark):
    """From 00:00:00.9 to 06:00:00.1 are six hours in whole seconds, as the SQL counts; to 05:59:59.9 they are not."""
    from engram.streaming import state

    rows = [("a", "2024-01-01 00:00:00.9"), ("a", "2024-01-01 06:00:00.1"), ("b", "2024-01-01 00:00:00.9"), ("b", "2024-01-01 05:59:59.9"), ("c", "2024-01-01 00:00:00"), ("c", "2024-01-01 06:00:00")]
    events = spark.createDataFrame(rows, "user_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.user_id, r.n) for r in state.sessions(events).collect()) == [("a", 1), ("a", 1), ("b", 2), ("c", 1), ("c", 1)]


@pytest.mark.parametrize(("answer", "found"), [("(B)", "(b)"), ("b)", "(b)"), ("B.", "(b)"), (" b ", "(b)"), ("no choice", None)])
def test_choice(spark, answer, found):
    assert one(spark, X.choice(F.lit(answer))) == found


def test_normalised(spark):
    rows = spark.createDataFrame([("low", 0.0), ("low", 0.5), ("flat", 2.0), ("flat", 2.0), ("wide", 1.0), ("wide", 3.0)], "q string, x double")
    found = defaultdict(list)
    for r in rank.normalised(rows, "q", "x").orderBy("q", "x").collect():
        found[r.q].append(round(r.x, 4))
    assert found == {"low": [0.5, 0.6225], "flat": [0.5, 0.5], "wide": [0.0, 1.0]}


def test_text_score(spark):
    assert one(spark, X.text_score(F.lit("Hello World 你好世界"))) == pytest.approx(2 * 1.5 + 2 * 0.3 + 4 * 1.0)
    assert one(spark, X.text_score(F.lit("a1, é"))) == pytest.approx(1.5 + 0.8 + 0.5 + 0.3 + 0.5)
    assert one(spark, F.array_join(X.tokens(F.lit("The co-op sat; x a2 Été on")), " ")) == "the sat été on"


def test_reciprocal_rank_fusion(spark):
    lists = [("q", i, d, r) for i, x in enumerate(("ABC", "BDA", "AEB")) for r, d in enumerate(x, 1)]
    found = {r.doc_id: r.score for r in rank.rrf(spark.createDataFrame(lists, "query_id string, list_no int, doc_id string, rank int")).collect()}
    assert found["A"] == pytest.approx(1 / 61 + 1 / 63 + 1 / 61, abs=1e-9) and found["B"] == pytest.approx(1 / 62 + 1 / 61 + 1 / 63, abs=1e-9)


def test_level_merges(spark):
    rows = spark.createDataFrame([(1, "Python", "high", "ev1", 1), (1, " Python ", "medium", "ev2", 2), (1, "Python", "", "ev1", 3), (1, " ", "high", "e", 4), (2, "Go", None, "e", 1)], "u int, value string, level string, evidence string, seq int")
    found = {r.u: r for r in profiles.merge_values(rows, ["u"], "highest").collect()}
    assert (found[1].level, found[1].evidences) == ("high", ["ev1", "ev2"])
    found = {r.u: r for r in profiles.merge_values(rows, ["u"]).collect()}
    assert (found[1].level, found[2].level) == ("medium", None)


def test_neighbours(spark):
    members = spark.createDataFrame([("c", "003", 3), ("c", "007", 7), ("c", "015", 15), ("c", "023", 23)], "cluster_id string, doc_id string, seq int")
    hits = spark.createDataFrame([("q", "007")], "query_id string, doc_id string")
    assert [r.member_id for r in clusters.neighbours(hits, members).orderBy("nth").collect()] == ["015", "003", "023"]


def test_insert_after_hits(spark):
    members = spark.createDataFrame([("c", d, d) for d in range(1, 8)] + [("e", 20, 1), ("e", 21, 2)], "cluster_id string, doc_id long, seq long")
    hits = [("q", 4, 1, 1.0), ("q", 5, 2, 0.9), ("q", 20, 3, 0.8), ("q", 99, 4, 0.7)]
    frame = spark.createDataFrame(hits, "query_id string, doc_id long, rank int, score double")
    found = [(r.doc_id, round(r.score, 3), r.hit_id) for r in clusters.insert_after_hits(frame, members, share=2.0, most=6).orderBy("place").collect()]
    # 5 comes as a neighbour of 4, so it isn't repeated; its own neighbours still follow, and the budget ends them
    assert found == [(4, 1.0, None), (5, 0.7, 4), (3, 0.7, 4), (6, 0.7, 4), (7, 0.63, 5), (2, 0.63, 5), (1, 0.63, 5), (20, 0.8, None), (99, 0.7, None)]
    none = clusters.insert_after_hits(frame, members.filter("cluster_id = 'x'")).orderBy("place").collect()
    assert [r.doc_id for r in none] == [4, 5, 20, 99]


@pytest.mark.parametrize(("shown", "at"), [("6:07 pm on 13 January, 2023", 1673633220), ("Unknown", None)])
def test_session_time(spark, shown, at):
    assert one(spark, X.session_time(F.lit(shown))) == at


def test_json_in_text(spark):
    assert one(spark, X.json_in(F.lit('a {"b": {"c": 1}} d'))) == '{"b": {"c": 1}}' and one(spark, X.json_in(F.lit("none"))) is None
    assert one(spark, X.decisions(F.lit("gec_001, then gec_12"))) == "gec_001,gec_12" and one(spark, X.decisions(F.lit("?"))) == "NEW"


def test_gap_buckets(spark):
    rows = spark.createDataFrame([("a", i, t) for i, t in enumerate([0, 59, 119, 3719, 90119, 90118])], "k string, i int, at long")
    found = [r.bucket for r in state.gaps(rows, "k", ["i"]).orderBy("i").collect()]
    assert found == [None, "immediate", "recent", "pause", "long gap", "out of order"]


def test_rerank_falls_back(spark):
    hits = spark.createDataFrame([("a", d, d) for d in range(1, 5)] + [("b", d, d) for d in range(1, 5)], "query_id string, doc_id int, rank int")
    scores = spark.createDataFrame([("a", 3, 0.9), ("a", 4, 0.5), ("b", 4, 1.0)], "query_id string, doc_id int, rerank_score double")
    found = defaultdict(list)
    for r in rank.rerank(hits, scores).orderBy("query_id", "new_rank").collect():
        found[r.query_id].append(r.doc_id)
    assert found == {"a": [3, 4, 1, 2], "b": [1, 2, 3, 4]}


def test_online_clusters_like_a_loop(spark):
    from engram import tables as T

    found = {r.unit_id: (r.group_id, r.cluster_id) for r in plans.c1_online_clusters(spark, TINY).collect()}
    rows = sorted((r.label, r.vec_id, r.vector) for r in T.vectors(spark, TINY).collect())
    groups = defaultdict(list)
    for g, i, v in rows:
        v, best, score = np.array(v, np.float32), None, 0.0
        for k, c in enumerate(groups[g]):
            s = float(c["v"] @ v / ((np.linalg.norm(c["v"]) + 1e-9) * (np.linalg.norm(v) + 1e-9)))
            if i * 3600 - c["at"] <= 7 * 86400 and s >= 0.3 and s > score:
                best, score = k, s
        if best is None:
            best = len(groups[g])
            groups[g].append({"v": v, "n": 1, "at": i * 3600})
        else:
            c = groups[g][best]
            c["v"] = (c["v"] * np.float32(c["n"]) + v) / np.float32(c["n"] + 1)
            c["n"], c["at"] = c["n"] + 1, i * 3600
        assert found[i] == (g, f"cluster_{best:03d}")


@pytest.mark.parametrize("operator", [state.tumbling_counts, state.sessions])
def test_stream_equals_batch(spark, operator, tmp_path):
    from engram import tables as T

    events = T.behaviors(spark, TINY)
    T.read(spark, TINY, "events").coalesce(1).write.parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema(T.read(spark, TINY, "events").schema).parquet(str(tmp_path / "in"))
    name = f"out_{operator.__name__}"
    stream = operator(raw.withColumn("ts", F.col("ts").cast("timestamp")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, operator(events).collect()))


def test_cosine_of_zero_vectors(spark):
    assert math.isclose(one(spark, rank.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))), 0.0)


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_more_queries_than_a_block(spark, broadcast):
    r = np.random.default_rng(1)
    x = np.round(r.normal(size=(300, 4)), 1)
    x[7:60] = x[7]  # ties
    q, docs = x[::5], [(i, v.tolist()) for i, v in enumerate(x)]
    score = (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)
    score = np.round(score, 6)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, qvector array<double>")
    corpus = spark.createDataFrame(docs, "doc_id long, vector array<double>")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        found = {(h.query_id, h.rank): (h.doc_id, round(h.score, 6)) for h in rank.knn(queries, corpus, 3, 7, 10).collect()}
        best = rank.max_sim(queries, corpus.withColumn("doc_id", F.col("doc_id") % 10), 1, most_query_rows=7, most_corpus_rows=10).collect()
        near = {(h.query_id, h.doc_id) for h in rank.within(queries, corpus, 0.7, 7, 10).collect()}
        some = rank.knn(queries, corpus.withColumn("kind", F.col("doc_id") % 2), 3, 7, 10, allowed=F.col("kind") == 1, least=0.5).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    wanted = {(i, n + 1): (d, round(score[i, d], 6)) for i in range(len(q)) for n, d in enumerate(sorted(range(len(x)), key=lambda d: (-score[i, d], d))[:3])}
    assert found == wanted and len(found) == 180
    assert near == {(i, d) for i in range(len(q)) for d in range(len(x)) if score[i, d] >= 0.7}
    odd = {(i, n): d for i in range(len(q)) for n, d in enumerate([d for d in sorted(range(len(x)), key=lambda d: (-score[i, d], d)) if d % 2 and score[i, d] >= 0.5][:3], 1)}
    assert {(h.query_id, h.rank): h.doc_id for h in some} == odd
    assert {b.query_id: round(b.score, 6) for b in best} == {i: round(score[i].max(), 6) for i in range(len(q))}


def test_odd_vectors_among_neighbours(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [math.nan, 1.0]), (7, [2.0, 1.0]), (None, [2.0, 1.0]), (8, [-1.0, 0.5]), (9, [])]
    corpus = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    queries = corpus.select(F.col("doc_id").alias("query_id"), F.col("vector").alias("qvector")).filter("doc_id is not null")
    plain = corpus.crossJoin(queries).select("query_id", "doc_id", F.round(rank.cosine(F.col("qvector"), F.col("vector")), 6).alias("score"))
    for k in (1, 4, 20):
        found, wanted = (sorted(map(repr, df.select("query_id", "doc_id", "score", "rank").collect())) for df in (rank.knn(queries, corpus, k, 2, 3), rank.top(plain, k)))
        assert found == wanted


def test_more_query_vectors_than_any_block(spark):
    queries = spark.range(20_001).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("qvector"))
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, vector array<double>")
    found = rank.knn(queries, corpus, 1)
    assert found.count() == 20_001 and found.filter("(query_id > 1) <> (doc_id = 2) and query_id <> 1").isEmpty()


def test_fields_count_where_facts_are_missing(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, qvector array<double>")
    facts = spark.createDataFrame([(1, [0.6, 0.8]), (1, [0.0, 1.0]), (2, [0.0, 0.0])], "doc_id long, vector array<double>")
    fields = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.8, 0.6]), (3, [0.0, 1.0])], "doc_id long, vector array<double>")
    assert [(r.doc_id, r.score, r.rank) for r in rank.max_sim(queries, facts, 9, fields).orderBy("rank").collect()] == [(3, 0.8, 1), (1, 0.6, 2), (2, 0.0, 3)]


def test_lists_are_fused_or_kept(spark):
    rows = [(1, 0, "A", 1, 0.9), (1, 0, "B", 2, 0.8), (1, 0, "C", 3, 0.7), (1, 1, "B", 1, 9.0), (1, 1, "D", 2, 8.0), (1, 1, "A", 3, 7.0), (2, 1, "X", 1, 3.0), (2, 1, "Y", 2, 3.0)]
    lists = spark.createDataFrame(rows, "query_id int, list_no int, doc_id string, rank int, score double")
    found = {(r.query_id, r.rank): (r.doc_id, r.score) for r in rank.fused(lists, 3).collect()}
    assert found == {(1, 1): ("B", round(1 / 62 + 1 / 61, 9)), (1, 2): ("A", round(1 / 61 + 1 / 63, 9)), (1, 3): ("D", round(1 / 62, 9)), (2, 1): ("X", 3.0), (2, 2): ("Y", 3.0)}
    turn = {(r.query_id, r.rank): r.doc_id for r in rank.in_turn(lists).collect()}
    assert [turn[1, i] for i in (1, 2, 3, 4)] == ["A", "B", "C", "D"] and turn[2, 2] == "Y"
    first, second = lists.filter("list_no = 0"), lists.filter("list_no = 1")
    assert {(r.query_id, r.doc_id): r.origin for r in rank.origins(("round1", first), ("round2", second)).collect()} == {(1, "A"): "round1", (1, "B"): "round1", (1, "C"): "round1", (1, "D"): "round2", (2, "X"): "round2", (2, "Y"): "round2"}


def test_documents_without_any_word_come_last(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "blue sea", None, "red red", "x1 y_2 a-b c"])], "unit_id long, narrative string")
    asked = spark.createDataFrame([(1, "the red fox"), (2, "x1 y"), (3, "green")], "query_id long, text string")
    hits = {(r.query_id, r.rank): (r.doc_id, r.score) for r in rank.bm25(asked, docs, 4).collect()}
    assert {q for q, _ in hits} == {1, 3} and [hits[1, i][0] for i in (1, 2, 3, 4)] == [0, 3, 1, 2] and hits[1, 2][1] > 0 == hits[1, 3][1]
    assert [hits[3, i] for i in (1, 2, 3, 4)] == [(0, 0.0), (1, 0.0), (2, 0.0), (3, 0.0)]
    assert sorted((r.doc_id, r.dl, r.term, r.tf) for r in rank.postings(docs, "unit_id", "narrative").collect()) == [(0, 2, "fox", 1), (0, 2, "red", 1), (1, 2, "blue", 1), (1, 2, "sea", 1), (3, 2, "red", 2)]


def test_clusters_of_all_hits(spark):
    hits, found = plans.r6_knn(spark, TINY), plans.j1_hit_clusters(spark, TINY).collect()
    assert {r.query_id for r in found} == {r.query_id for r in hits.select("query_id").distinct().collect()} and max(r.query_id for r in found) >= 20
    assert sum(r.hits for r in found) == hits.count() and all(r.others >= 0 for r in found)


def test_facts_with_their_vectors(spark):
    rows = [(1, ["a", "b", "c"], [[1.0] * 9, [2.0]]), (2, ["x"], [[3.0], [4.0]]), (3, [], [[5.0]]), (4, None, [[6.0]]), (5, ["y"], None)]
    found = plans.flat_facts(spark.createDataFrame(rows, "id int, facts array<string>, vectors array<array<double>>")).orderBy("id", "fact_no").collect()
    assert [tuple(r) for r in found] == [(1, 0, "a", [1.0] * 9), (1, 1, "b", [2.0]), (2, 0, "x", [3.0])]
    whole = plans.s17_zipped_facts(spark, TINY).collect()
    assert whole and {len(r.millionths.split(",")) for r in whole} == {64}
