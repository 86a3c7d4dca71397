"""Fixtures with known results for annotation, routing, expansion, converters, merges and stages."""

import json
import os
import shutil
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from engram.functions import questions as Q
from engram.functions import text as X
from engram.operators import clusters, matching, profiles
from engram.plans import queries as plans
from engram.plans import staged
from engram.sources import converters, streams

from .conftest import TINY


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


COUNT = {"cjk": 1.0, "word": 1.0, "number": 1.0, "punctuation": 0.0, "whitespace": 0.0, "other": 0.0}


@pytest.mark.parametrize(("text", "most", "weights", "cut"), [
    ("Hello World 你好世界", 4, COUNT, "Hello World 你好..."), ("Hello World 你好世界", 4, COUNT | {"cjk": 0.5}, "Hello World 你好世界"),
    ("", 3, None, ""), ("wordy", 0.5, None, "wordy"), ("a b c", 2, None, "a..."), (None, 3, None, None),
])
def test_truncated(spark, text, most, weights, cut):
    assert one(spark, X.truncated(F.lit(text).cast("string"), most, weights)) == cut


def test_relative_dates(spark):
    base = F.lit("2024-03-15").cast("date")
    text = X.relative_dates(F.lit("Last month, next week; todays 这个月 昨天"), base)
    once = "Last month (2024-02-29), next week (2024-03-22); todays 这个月 (2024-03-31) 昨天 (2024-03-14)"
    assert one(spark, text) == once and one(spark, X.relative_dates(text, base)) == once
    assert one(spark, X.relative_dates(F.lit("today"), F.lit(None).cast("date"))) == "today"


def test_mentions(spark):
    refs = F.expr("array(named_struct('name', 'A.$x', 'user_id', 'u1'), named_struct('name', '', 'user_id', 'u2'), named_struct('name', 'Bo', 'user_id', cast(null as string)))")
    text = X.mentions(F.lit("@A.$x and @Aa$x and @Bo, A.$x"), refs)
    assert one(spark, text) == "@A.$x(user_id:u1) and @Aa$x and @Bo, A.$x" == one(spark, X.mentions(text, refs))


@pytest.mark.parametrize(("src", "url"), [("a.jpg", "http://h.org/x/a.jpg"), ("/a.jpg", "http://h.org/a.jpg"), ("//c.org/a.jpg", "http://c.org/a.jpg"), ("https://d.org/a", "https://d.org/a"), ("my_icon.png", None)])
def test_first_image(spark, src, url):
    assert one(spark, X.first_image(F.lit(f'<p><IMG data-src="no" src="{src}" width=500 height="x">'), F.lit("http://h.org/x/y?z=/q"))) == url


def test_routing(spark):
    kind = Q.classify(F.lit("How long has Ann known Bo?"))
    assert one(spark, kind).asDict() == {"type": "time_calculation", "strategy": "agentic_only", "confidence": 0.8}
    assert one(spark, Q.route(kind, {"time_calculation": "gec_cluster_rerank"})) == "gec_cluster_rerank"
    assert one(spark, Q.route(kind, {"time_calculation": "none such"}, ["gec_insert_after_hit"])) == "gec_insert_after_hit"
    assert one(spark, Q.classify(F.lit("")))["confidence"] == 0.3


HITS = "query_id int, doc_id string, rank int, score double"
MEMBERS = "cluster_id string, doc_id string, seq int"


def test_expansion_places(spark):
    ids = [f"{i:03d}" for i in (3, 7, 15, 23)]
    members = spark.createDataFrame([("c", d, i) for i, d in enumerate(ids)], MEMBERS)
    hits = spark.createDataFrame([(1, d, r, 1 - r / 20) for r, d in enumerate(["007", "a", "b", "003", "e", "f", "g", "h"], 1)], HITS)
    show = lambda p: [(r.doc_id, round(r.score, 3)) for r in clusters.insert_after_hits(hits, members, place=p).orderBy("place").collect()]
    assert [d for d, _ in show("end")] == ["007", "a", "b", "003", "e", "f", "g", "h", "015", "023"]
    by_score = show("score")
    assert [d for d, _ in by_score] == ["007", "a", "b", "003", "e", "f", "015", "023", "g", "h"]
    assert dict(by_score)["015"] == pytest.approx(0.95 * 0.7)


def test_cluster_rerank_overlapping(spark):
    rows = [("a", d, i) for i, d in enumerate("pqrs")] + [("b", d, i) for i, d in enumerate("qtu")] + [("c", "z", 1)]
    hits = spark.createDataFrame([(1, "t", 1, 0.9), (1, "q", 2, 0.8), (1, "x", 3, 0.5), (2, "y", 1, 0.4)], HITS)
    found = clusters.rerank_by_cluster(hits, spark.createDataFrame(rows, MEMBERS), each=3, most=5).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.doc_id, round(r.score, 3), r.cluster_id) for r in found] == [
        (1, "q", 1.0, "b"), (1, "t", 1.0, "b"), (1, "u", 1.0, "b"), (1, "p", 0.9, "a"), (1, "r", 0.9, "a"), (1, "x", 0.4, None), (2, "y", 0.4, None),
    ]


def test_strategies_one_by_one(spark):
    found = defaultdict(list)
    for r in plans.QUERIES["d3_strategies"](spark, TINY).orderBy("query_id", "place").collect():
        found[r.query_id, r.strategy].append(r.doc_id)
    assert len(found) > 3
    hits = plans.r6_knn(spark, TINY)
    plain = defaultdict(list)
    for r in hits.orderBy("query_id", "rank").collect():
        plain[r.query_id].append(r.doc_id)
    for (q, s), docs in found.items():
        assert docs == plain[q] if s == "agentic_only" else set(docs) != set()
        assert len(docs) == len(set(docs)) and (s != "gec_insert_after_hit" or set(plain[q]) <= set(docs))


def test_contained_ids(spark):
    e = spark.createDataFrame([("D1:3",), ("x D1:3 y",), ("D1:3-4-5",), ("ab",), ("none",)], "evidence_id string")
    u = spark.createDataFrame([("D1:3",), ("zz D1:3-4-5",), ("ab",), ("abc",)], "unit_id string")
    assert {(r.evidence_id, r.unit_id, r.how) for r in matching.containing(e, u).collect()} == {
        ("D1:3", "D1:3", "equal"), ("x D1:3 y", "D1:3", "contained"), ("D1:3-4-5", "D1:3", "contained"), ("ab", "ab", "equal"),
    }


def test_payload_edges(spark):
    rows = spark.createDataFrame([(1, '{"a":["e1"],"b":"e2","evidences":["x"],"level":"low"}'), (2, "plain"), (3, "[]"), (4, None), (5, "{}")], "id int, payload string")
    found = {(r.id, r.value, r.evidence, r.level) for r in profiles.payload_rows(rows, "id", "payload").collect()}
    assert found == {(1, "a", "e1", "low"), (1, "b", "e2", "low"), (2, "plain", None, None)}


def test_haystack_time_and_persona(spark, tmp_path):
    assert one(spark, converters.dialogue_time(F.lit("2023/05/20 (Sat) 14:05"))) == "2:05 pm on 20 May, 2023"
    assert one(spark, converters.options(F.lit("""['(a) one, two', "(b) it's three"]"""))) == {"(a)": "one, two", "(b)": "it's three"}
    (tmp_path / "q.csv").write_text('question_id,shared_context_id,end_index_in_shared_context,all_options\nq1,c1,2,"[""(a) x""]"\nq2,c1,2,[]\nq3,gone,1,[]\n')
    said = [("system", "Name: Kim\nAge: 3"), ("user", "User: hi\nUser: there"), ("assistant", "Assistant: yes"), ("user", "later")]
    (tmp_path / "c.jsonl").write_text(json.dumps({"c1": [{"role": r, "content": c} for r, c in said]}) + "\n")
    rows = converters.persona_dialogues(*converters.read_persona(spark, str(tmp_path / "q.csv"), str(tmp_path / "c.jsonl"))).orderBy("dia_id").collect()
    assert [tuple(r) for r in rows] == [("c1", 2, "D0:0", "Kim", "hi\nthere"), ("c1", 2, "D0:1", "Assistant", "yes")]


def test_messages_once_each(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    m = {"group_id": "g", "message_id": "m1", "sender": "s", "content": "c", "ts": "2024-01-01T00:00:00Z"}
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(x) for x in (m, m, m | {"message_id": "m2"}, m | {"group_id": "h"})))
    rows = streams.once_each(streams.from_files(spark, str(tmp_path / "in")))
    q = rows.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted((r.group_id, r.message_id) for r in spark.table("once").collect()) == [("g", "m1"), ("g", "m2"), ("h", "m1")]


def test_stages_skip_what_is_done(spark, tmp_path):
    ran = []

    def first(_):
        ran.append("first")
        return spark.range(5)

    def second(tables):
        ran.append("second")
        return tables["first"].agg(F.sum("id").alias("s"))

    for _ in range(2):
        tables = staged.run_stages(spark, str(tmp_path), [("first", first), ("second", second)])
        assert tables["second"].first().s == 10
    assert ran == ["first", "second"]
    shutil.rmtree(tmp_path / "second.done")
    staged.run_stages(spark, str(tmp_path), [("first", first), ("second", second)])
    assert ran == ["first", "second", "second"]


def test_project_ties_go_to_the_first_row(spark):
    """Rows with one seq: those of the least place tell the date and the level, in whatever order they come."""
    said = [(1, "p", "n", "f", "v", level, 10, 5, date, no) for level, date, no in [("A", "2024-03-01", 7), ("N", "2024-01-01", 9), ("R", "2024-02-01", 8)]]
    names = "user_id long, project_id string, project_name string, field string, value string, level string, evidence long, seq long, entry_date string, no long"
    for rows in (said, said[::-1], [said[1], said[0], said[2]]):
        df = spark.createDataFrame(rows, names).repartition(1).withColumn("place", F.struct("no", F.lit("x").alias("name"))).drop("no")
        got = profiles.merge_projects(df).first()
        assert (got.entry_date, got.level, got.evidences) == ("2024-03-01", "A", [10])
