"""Chat files, profiles, event clusters, stems and streams against known results."""

import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from engram import tables as T
from engram.functions import text as X
from engram.functions.stems import stem
from engram.operators import clusters, matching, profiles
from engram.plans import parsing
from engram.sources import chats
from engram.streaming import state

from .conftest import TINY


def test_group_chat_file(spark):
    chat = {
        "version": "1",
        "conversation_meta": {"group_id": "g", "name": "Team", "default_timezone": "Asia/Shanghai", "user_details": {"u1": {"full_name": "Ann"}, "u2": {"role": "x"}}},
        "conversation_list": [
            {"message_id": "m1", "create_time": "2024-03-01T10:00:00", "sender": "u1", "content": "hi", "refer_list": []},
            {"message_id": "m2", "create_time": "2024-03-01T02:00:30Z", "sender": "u2", "content": "yo", "refer_list": ["m1", {"message_id": "m0", "content": "old"}, {"x": 1}]},
            {"message_id": "m3", "create_time": "2024-03-01T10:01:00+08:00", "sender": "u3", "sender_name": "Cy", "content": None},
        ],
    }
    rows = [(json.dumps(chat),), ('{"conversation_meta": {}, "conversation_list": []}',), ("broken",), (None,)]
    found = chats.group_chat(spark.createDataFrame(rows, "chat string")).orderBy("place").collect()
    assert [(r.message_id, r.full_name, r.content, r.refs, r["at"]) for r in found] == [
        ("m1", "Ann", "hi", [], 1709258400), ("m2", "u2", "yo", ["m1", "m0"], 1709258430), ("m3", "Cy", "", [], 1709258460),
    ]
    assert {(r.group_id, r.group_name, r.current_at) for r in found} == {("g", "Team", 1709258460)}


def test_dialogue_file(spark):
    said = lambda n, **more: [{"speaker": "Ann Lee", "text": f"t{i}", "dia_id": f"D{i}", **more} for i in range(n)]
    talk = {"speaker_a": "Ann Lee", "session_10": said(2), "session_10_date_time": "Unknown", "session_2": said(3, img_url=["x"], blip_caption="a cat"), "session_2_date_time": "6:07 pm on 13 January, 2023", "session_9": said(1), "session_9_date_time": "6:08 pm on 13 January, 2023"}
    talk["session_2"][0]["img_url"] = None
    found = chats.dialogue_messages(spark.createDataFrame([(7, json.dumps(talk))], "conv_id long, conversation string")).collect()
    start = 1673633220
    # of session_2 nine tenths of a minute are left for three messages
    assert sorted((r.session, r.no, r["at"], r.is_fake) for r in found) == [("session_10", 0, 1704074400.0, True), ("session_10", 1, 1704074430.0, True), ("session_2", 0, start, False), ("session_2", 1, start + 27.0, False), ("session_2", 2, start + 54.0, False), ("session_9", 0, start + 60, False)]
    assert {r.speaker_id for r in found} == {"ann_lee_7"} and {r.content for r in found if r.session == "session_2"} == {"t0", "[Ann Lee shared an image: a cat] t1", "[Ann Lee shared an image: a cat] t2"}


def test_messages_are_checked(spark):
    rows = [(1, "a", " x  y "), (None, "a", "t"), (2, " ", "t"), (3, "b", None)]
    found = chats.checked_messages(spark.createDataFrame(rows, "id long, who string, said string"), ["id", "who", "said"]).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(1, "a", "x y", None), (None, "a", "t", "id"), (2, " ", "t", "who"), (3, "b", None, "said")], key=repr)
    split = chats.history_and_new(spark.createDataFrame([(1, i) for i in range(5)] + [(2, 0)], "b long, i long"), "b", [F.col("i")])
    assert {(r.b, r.i): r.part for r in split.collect()} == {(1, 0): "history", (1, 1): "history", (1, 2): "history", (1, 3): "history", (1, 4): "new", (2, 0): "new"}


def test_deletion_needs_a_condition(spark):
    with pytest.raises(ValueError):
        matching.without(spark.range(3))
    assert [r.id for r in matching.without(spark.range(5), F.col("id") > 1, F.col("id") < 4).collect()] == [0, 1, 4]


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, 10.0), ("a", 3, 30.0), ("b", 2, 5.0)], "user string, v int, x double")
    new = spark.createDataFrame([("a", 1, 11.0, 1), ("a", None, 33.0, 2), ("a", None, 34.0, 3), ("b", 7, 7.0, 1), ("c", None, 1.0, 1), ("d", 4, 4.0, 1)], "user string, v int, x double, seq int")
    rows, failed = profiles.versioned_upsert(old, new, ["user"], "v", ["x"], "seq")
    assert sorted((r.user, r.v, r.x, r.is_latest) for r in rows.collect()) == [("a", 1, 11.0, False), ("a", 3, 34.0, True), ("b", 2, 5.0, False), ("b", 7, 7.0, True), ("d", 4, 4.0, True)]
    assert [r.user for r in failed.collect()] == ["c"]


def test_item_evidences(spark):
    kind = "p int, field string, pos int, item map<string,string>, evidences array<string>"
    original = [(1, "skills", 0, {"value": "Go", "level": "high"}, ["e0"]), (1, "skills", 1, {"value": "Go", "level": "low"}, ["e0"]), (1, "skills", 2, {"name": " Rust "}, []), (2, "skills", 0, {"value": "Go", "level": "low"}, ["e0"])]
    completed = [(1, "skills", 0, {"level": "low", "value": "Go"}, ["2024-01-02|c1", "c2", "c9"]), (1, "skills", 1, {"value": "Go"}, ["c3", "c3"]), (1, "skills", 2, {"name": "Rust", "value": "none"}, ["c1"]), (1, "skills", 3, {"value": "Java"}, ["c1"]), (1, "other", 0, {"value": "Go"}, ["c1"]), (2, "skills", 0, {"value": "Go", "level": "low"}, ["c9"])]
    dates = spark.createDataFrame([("c1", "2024-05-01"), ("c2", "2024-05-02"), ("c3", "2024-05-03")], "evidence string, date string")
    found = profiles.merge_item_evidences(spark.createDataFrame(original, kind), spark.createDataFrame(completed, kind), dates, ["p", "field"])
    assert {(r.p, r.pos): r.evidences for r in found.collect()} == {(1, 0): ["2024-05-03|c3"], (1, 1): ["2024-05-01|c1", "2024-05-02|c2"], (1, 2): ["2024-05-01|c1"], (2, 0): ["e0"]}


def test_topics_are_updated_and_replaced(spark):
    day = 86400
    topics = [("g", f"t{i}", f"T{i}", "implemented" if i in (1, 3) else "exploring", (50 + i) * day, [f"e{i}"]) for i in range(5)]
    updates = [("g", 0, "update", "t2", "T2b", "exploring", ["e7", "bad", "e2"]), ("g", 1, "new", None, "fresh", "exploring", ["e8"]), ("g", 2, "update", "t9", "lost", "exploring", ["e8"]), ("g", 3, "new", None, "more", "exploring", []), ("h", 0, "new", None, "first", "exploring", ["e7"])]
    units = [("g", f"e{i}", (50 + i) * day) for i in range(5)] + [("g", "e7", 90 * day), ("g", "e8", 95 * day), ("h", "e7", 90 * day)]
    found = profiles.updated_topics(
        spark.createDataFrame(topics, "group_id string, topic_id string, name string, status string, last_at long, evidences array<string>"),
        spark.createDataFrame(updates, "group_id string, seq int, update_type string, topic_id string, name string, status string, evidences array<string>"),
        spark.createDataFrame(units, "group_id string, unit_id string, at long"),
    )
    got = {(r.group_id, r.place): (r.topic_id, r.name, r.last_at // day, r.evidences) for r in found.collect()}
    # t1 is implemented and longest inactive, so it goes first, then t3
    assert got == {("g", 1): ("new_1", "fresh", 95, ["e8"]), ("g", 2): ("new_3", "more", 95, []), ("g", 3): ("t2", "T2b", 90, ["e2", "e7"]), ("g", 4): ("t4", "T4", 54, ["e4"]), ("g", 5): ("t0", "T0", 50, ["e0"]), ("h", 1): ("new_0", "first", 90, ["e7"])}


def test_event_clusters(spark):
    kind = "conv_id int, unit_id int, at int, assigned array<struct<type:string,cluster_id:string,new_topic:string>>"
    old, new = lambda c: ("EXISTING", c, None), lambda t: ("NEW", None, t)
    rows = [(1, 5, 1, [new("a"), new("b")]), (1, 4, 2, [old("gec_001"), new("c")]), (1, 3, 3, [old("gec_007"), old("gec_2")]), (1, 2, 4, [new("d"), old("gec_004")]), (1, 1, 5, None), (2, 9, 1, [])]
    found = clusters.event_clusters(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.conv_id, r.unit_id, r.nth, r.cluster_id, r.is_new, r.topic) for r in found) == [
        (1, 1, 1, "gec_005", True, None), (1, 2, 1, "gec_004", True, "d"), (1, 2, 2, "gec_004", False, None), (1, 3, 1, "gec_003", True, None),
        (1, 4, 1, "gec_001", False, None), (1, 4, 2, "gec_002", True, "c"), (1, 5, 1, "gec_001", True, None), (2, 9, 1, "gec_001", True, None),
    ]


def test_online_clusters_in_parts(spark):
    """A silence of more than the gap parts a group; numbers go on."""
    rows = [("g", i, at, v) for i, (at, v) in enumerate([(0.0, [1.0, 0.0]), (1.0, [0.0, 1.0]), (2.0, [1.0, 0.1]), (50.0, [1.0, 0.0]), (51.0, None), (52.0, [1.0, 0.0])])]
    found = clusters.online_clusters(spark.createDataFrame(rows, "group_id string, unit_id int, at double, vector array<double>"), least=0.65, most_gap=10.0)
    assert {r.unit_id: r.cluster_id for r in found.collect()} == {0: "cluster_000", 1: "cluster_001", 2: "cluster_000", 3: "cluster_002", 4: "cluster_003", 5: "cluster_002"}


def test_stems():
    known = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl hopping hop falling fall failing fail filing file happy happi sky sky relational relat conditional condit valenci valenc digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope formaliti formal triplicate triplic formative form formalize formal electrical electr goodness good revival reviv allowance allow adjustable adjust replacement replac adoption adopt activate activ effective effect probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil"
    words = known.split()
    assert [stem(w) for w in words[::2]] == words[1::2]
    assert stem("is") == "is" and stem("été") == "été"


def test_stemmed_terms(spark):
    from engram.operators import rank

    words = rank.term_counts(rank.postings(T.memunits(spark, TINY), "unit_id", "narrative", X.STOPWORDS)).collect()
    wanted = {}
    for w in words:
        n, cf = wanted.get(stem(w.term), (0, 0))
        wanted[stem(w.term)] = (n + 1, cf + w.cf)
    assert {r.stem: (r.words, r.cf) for r in parsing.x1_stemmed_terms(spark, TINY).collect()} == wanted


def events_in(spark, folder, frames):
    """A stream that reads one file a batch."""
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows).coalesce(1).write.mode("append").parquet(str(folder / f"in/b{i}"))
    schema = spark.createDataFrame(frames[0]).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder / "in"))


def run_stream(stream, folder, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(folder / "state")).start()
    q.awaitTermination()
    return stream.sparkSession.table(name).collect()


def test_segments_of_a_stream(spark, tmp_path):
    e = T.behaviors(spark, TINY).select("user_id", "event_id", "at", F.expr(parsing._BOUNDARY).alias("boundary")).orderBy("at", "event_id").toPandas()
    third = len(e) // 3
    frames = [e.iloc[:third], e.iloc[third : 2 * third], e.iloc[2 * third :]]
    found = run_stream(state.segment_stream(events_in(spark, tmp_path, frames), "user_id", "long", expires=None), tmp_path, "segments")
    batch = parsing.k1_decided_segments(spark, TINY).filter("done").drop("done")
    assert sorted(map(tuple, found)) == sorted((r.user_id, r.no, r.n, r.first_id, r.last_id) for r in batch.collect())


def test_limits_of_a_stream(spark, tmp_path):
    e = T.behaviors(spark, TINY).select("user_id", "event_id", "at").orderBy("at", "event_id").toPandas()
    half = len(e) // 2
    found = run_stream(state.limit_stream(events_in(spark, tmp_path, [e.iloc[:half], e.iloc[half:]]), "user_id", "long", 86400, 5), tmp_path, "limits")
    batch = {r.event_id: (r.n, r.limited) for r in state.over_limit(T.behaviors(spark, TINY), "user_id", 86400, 5).collect()}
    assert {r.event_id: (r.n, r.limited) for r in found} == batch and len(found) == len(e)


def test_history_of_a_stream(spark, tmp_path):
    e = pd.DataFrame({"user_id": [1] * 9 + [2], "event_id": range(10), "at": range(10)})
    found = run_stream(state.history_stream(events_in(spark, tmp_path, [e.iloc[:6], e.iloc[6:]]), "user_id", "long", most=4, idle=None), tmp_path, "history", "update")
    assert [5, 6, 7, 8] in [list(r.event_ids) for r in found if r.user_id == 1] and [list(r.event_ids) for r in found if r.user_id == 2] == [[9]]


def test_clusters_of_a_stream(spark, tmp_path):
    v = T.vectors(spark, TINY).select(F.col("label").cast("long").alias("group_id"), F.col("vec_id").alias("event_id"), (F.col("vec_id") * 3600.0).alias("at"), "vector")
    rows = v.orderBy("at").toPandas()
    rows["vector"] = rows["vector"].map(list)
    half = len(rows) // 2
    found = run_stream(state.cluster_stream(events_in(spark, tmp_path, [rows.iloc[:half], rows.iloc[half:]]), "group_id", "long", least=0.3), tmp_path, "clusters")
    batch = clusters.online_clusters(v.withColumnRenamed("event_id", "unit_id"), least=0.3).collect()
    assert {r.event_id: (r.group_id, r.cluster_id) for r in found} == {r.unit_id: (r.group_id, r.cluster_id) for r in batch}
    seen = {}
    for r in sorted(found, key=lambda r: r.event_id):
        seen[r.group_id, r.cluster_id] = seen.get((r.group_id, r.cluster_id), 0) + 1
        assert r.version == seen[r.group_id, r.cluster_id]


def test_late_rows(spark):
    e = spark.createDataFrame([(1, 100), (2, 200), (3, 290)], "id int, at long")
    assert [r.id for r in state.late_rows(e, spark.createDataFrame([(300,)], "newest long"), 100).collect()] == [1]


def wait_for(ready, seconds=90):
    end = time.time() + seconds
    while not ready():
        assert time.time() < end
        time.sleep(0.5)


def test_state_expires(spark, tmp_path):
    """What waits is forgotten after a silence: the unit that a boundary ends later has only what came after it."""
    frame = lambda ids, boundary: spark.createDataFrame([(1, i, i, boundary) for i in ids], "user_id long, event_id long, at long, boundary boolean").coalesce(1)
    frame([1, 2], False).write.parquet(str(tmp_path / "in/b0"))
    raw = spark.readStream.schema(frame([1], True).schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    stream = state.segment_stream(raw, "user_id", "long", expires="3 seconds")
    q = stream.writeStream.outputMode("append").format("memory").queryName("expired").trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        rows = lambda: sum(s["numRowsTotal"] for p in q.recentProgress[-1:] for s in p["stateOperators"])
        wait_for(lambda: rows() == 1)
        wait_for(lambda: rows() == 0)  # the state is gone
        frame([3, 4], True).write.parquet(str(tmp_path / "in/b1"))
        wait_for(lambda: spark.table("expired").count() == 2)
        assert sorted((r.no, r.n, r.first_id, r.last_id) for r in spark.table("expired").collect()) == [(0, 1, 3, 3), (1, 1, 4, 4)]
    finally:
        q.stop()


def test_values_are_merged_in_parts_of_bounded_size(spark):
    """Both aggregates have as many tasks as the rows need, whatever Spark makes of the shuffles' sizes; a constant key adds no shuffle."""
    rows = spark.range(4000).select((F.col("id") % 50).alias("user_id"), F.lit(1).alias("group_id"), (F.col("id") % 3 == 0).alias("important"), F.lit("f").alias("field"), (F.col("id") % 7).cast("string").alias("value"), F.lit("low").alias("level"), F.col("id").alias("evidence"), F.col("id").alias("seq"))
    merged = profiles.merge_values(rows, ["user_id", "field"], part_rows=300)
    assert merged.rdd.getNumPartitions() == 14
    whole = profiles.merge_values(rows, ["user_id", "field"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 350
    assert sum(len(r.evidences) for r in profiles.merge_groups(rows, ["f"]).collect()) == 1334  # each user has important rows


def test_topics_of_a_group_fold_without_a_frame(spark):
    """A group costs a row, not a frame of its own; groups without updates, topics or known units keep what they have."""
    topics = spark.createDataFrame([("a", "t", "T", "exploring", 5, ["e"]), ("b", "t", "T", "implemented", None, ["e"])], "group_id string, topic_id string, name string, status string, last_at long, evidences array<string>")
    updates = spark.createDataFrame([("c", 0, None, None, "N", "exploring", ["e"]), ("b", 0, "update", "t", "T2", "exploring", ["e", "u"])], "group_id string, seq int, update_type string, topic_id string, name string, status string, evidences array<string>")
    units = spark.createDataFrame([("b", "u", 9), ("c", "v", 4)], "group_id string, unit_id string, at long")
    found = profiles.updated_topics(topics, updates, units)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("a", 1, "t", "T", "exploring", 5, ["e"]), ("b", 1, "t", "T2", "exploring", 9, ["e", "u"]), ("c", 1, "new_0", "N", "exploring", 4, [])]
