"""Joins, ranks and writes against brute force, with keys, intervals and partitions that hold a large share of all rows."""

import itertools
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.functions import questions as Q
from engram.functions import text as X
from engram.operators import clusters, matching, profiles, rank
from engram.operators.ordered import ranked, running_sum
from engram.sources import sinks


def test_interval_pairs(spark):
    draw = random.Random(3)
    points = [(i, draw.choice([None, 7, 7, 7, draw.randrange(-50, 3000)])) for i in range(400)]
    intervals = [(i, a, a + draw.randrange(-2, 400)) for i in range(150) for a in [draw.randrange(-100, 3000)]]
    intervals += [(1000, None, None), (1001, None, 7), (1002, 7, None), (1003, 7, 7), (1004, -(10**9), 10**12), (1005, 8, 7), (1006, 5000, 6000), (1007, None, -1000)]
    p = spark.createDataFrame(points, "id long, at long")
    v = spark.createDataFrame(intervals, "interval_id long, a long, b long")
    found = [tuple(r) for r in matching.interval_pairs(p, v).collect()]
    low, high = -(10**18), 10**18
    wanted = {(i, k) for i, t in points if t is not None for k, a, b in intervals if (low if a is None else a) <= t <= (high if b is None else b) and not (a is not None and b is not None and a > b)}
    assert len(found) == len(set(found)) and set(found) == wanted
    assert matching.interval_pairs(p.filter("at is null"), v).count() == 0 and matching.interval_pairs(p, v.limit(0)).count() == 0


@pytest.mark.parametrize("small", [32_000_000, 0])
def test_interval_pairs_in_shares(spark, small):
    """Broadcast, and in a shuffle with crowded buckets in shares."""
    draw = random.Random(4)
    points = [(i, draw.choice([None, 7, 7, 7, draw.randrange(-50, 90_000)])) for i in range(400)]
    intervals = [(i, a, a + draw.randrange(-2, 9000)) for i in range(150) for a in [draw.randrange(-100, 90_000)]] + [(1000, None, None), (1001, None, 7), (1002, 8, None), (1003, 7, 7)]
    found = matching.interval_pairs(spark.createDataFrame(points, "id long, at long"), spark.createDataFrame(intervals, "interval_id long, a long, b long"), 500, small)
    wanted = [(i, k) for i, t in points if t is not None for k, a, b in intervals if (a is None or a <= t) and (b is None or t <= b)]
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted)


def test_interval_pairs_are_dealt(spark):
    p = spark.range(0, 8000, 1, 1).select("id", (F.col("id") % 5).alias("at"))  # one piece, few times
    v = spark.createDataFrame([(1, None, None), (2, 0, 4), (3, 2, 2)], "interval_id long, a long, b long")
    assert matching.interval_pairs(p, v).groupBy(F.spark_partition_id()).count().count() == 4
    for small in (32_000_000, 0):
        found = matching.interval_pairs(p, v, 2000, small)
        tasks = [r.n for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(tasks) == 17_600 and max(tasks) < 7000


def test_points_are_shuffled_for_few_sizes():
    """As at 36 million events: a point is a row of three sizes instead of 22; and no other sizes have fewer rows."""
    kept = matching._sizes_kept({k: 540_000 for k in range(10)} | {k: 5_400 for k in range(10, 22)}, 36_000_000)
    assert len(kept) == 3

    def rows(kept, buckets, points):
        return points * len(kept) + sum(n << (k - max(t for t in kept if t <= k)) for k, n in buckets.items())

    draw = random.Random(6)
    for _ in range(30):
        buckets, points = {k: draw.randrange(1, 50) for k in draw.sample(range(12), draw.randrange(1, 8))}, draw.choice([1, 40, 900])
        low, *others = sorted(buckets)
        least = min(rows([low, *some], buckets, points) for n in range(len(others) + 1) for some in itertools.combinations(others, n))
        assert rows(matching._sizes_kept(buckets, points), buckets, points) == least


def test_containing_of_any_length(spark):
    draw = random.Random(5)
    word = lambda n: "".join(draw.choices("abAé1", k=n))
    units = [word(draw.choice([1, 2, 3, 8, 40, 300, 2000])) for _ in range(120)] + [""]
    evidences = [word(draw.choice([1, 2, 3, 5])) for _ in range(40)] + [u[draw.randrange(len(u)) :][:50] for u in units if u] + [u + "x" for u in units[:10]] + units[:20] + ["", None, "none of them"]
    e = spark.createDataFrame([(x,) for x in evidences], "evidence_id string")
    for kept in (units, [u for u in units if u]):
        u = spark.createDataFrame([(x,) for x in [*kept, None]], "unit_id string")
        wanted = {}
        for x in {x for x in evidences if x}:
            same = sorted(y for y in set(kept) if x in y or y in x)
            if same:
                wanted[x] = (x, "equal") if x in same else (same[0], "contained")
        for chars, texts in ((500_000, 50_000), (300, 17)):
            found = [tuple(r) for r in matching.containing(e, u, chars, texts).collect()]
            assert len(found) == len(wanted) and {a: (b, c) for a, b, c in found} == wanted


@pytest.mark.parametrize("partitions", [1, 9])
def test_ranks_in_a_large_key(spark, partitions):
    """A key with most rows is cut over tasks; null keys and ties count."""
    draw = random.Random(1)
    rows = [(draw.choice(["a"] * 8 + ["b", None, "c"]), draw.choice([None, *range(50)]), i, draw.randrange(9)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, o int, i int, v int").repartition(5)
    before, name = spark.conf.get("spark.sql.shuffle.partitions"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set(name, "false")
    try:
        found = ranked(df, ["k"], [F.desc_nulls_last("o"), "i"]).collect()
        sums = running_sum(ranked(df, ["k"], ["i"]).select("k", "i", "v", F.col("nth").alias("place")), ["k"], "place", "v", "total", block=7).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset(name)
    by = defaultdict(list)
    for k, o, i, v in rows:
        by[k].append((o is None, -(o or 0), i, v))
    wanted = {(k, i): n for k, own in by.items() for n, (_, _, i, _) in enumerate(sorted(own), 1)}
    assert {(r.k, r.i): r.nth for r in found} == wanted
    totals = {}
    for k, own in by.items():
        total = 0
        for _, _, i, v in sorted(own, key=lambda r: r[2]):
            total += v
            totals[k, i] = total
    assert {(r.k, r.i): r.total for r in sums} == totals


def test_ranks_of_nothing(spark):
    assert ranked(spark.createDataFrame([], "k int, o int"), ["k"], ["o"]).count() == 0


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def parts(names):
    return {p.split("/table/")[1].rpartition("/")[0] for p in names}


def test_replaced_partitions(spark, tmp_path):
    path, kinds = str(tmp_path / "table"), ["a b", "c/d", None, "é"]
    rows = spark.createDataFrame([(i, kinds[i % 4], i % 3) for i in range(120)], "id int, kind string, day int")
    assert sinks.replace(rows, path, ["kind", "day"]) == 120
    before = files(path)
    assert sinks.replace(rows.filter("kind = 'a b' and day = 1").limit(4), path, ["kind", "day"]) == 4
    changed = {*before.items()} ^ {*files(path).items()}
    assert len(parts(p for p, _ in changed)) == 1 and spark.read.parquet(path).count() == 114


def test_deletions(spark, tmp_path):
    path, kinds = str(tmp_path / "table"), ["a b", "c/d", None, "é"]
    rows = [(i, kinds[i % 4], i % 10) for i in range(120)]
    sinks.replace(spark.createDataFrame(rows, "id int, kind string, n int"), path, ["kind"])
    with pytest.raises(ValueError):
        sinks.delete(spark, path, ["kind"])
    for conditions, which in (([F.col("n") == 3], lambda r: r[2] == 3), ([F.col("id") >= 40, F.col("id") < 44, F.col("kind") == "é"], lambda r: 40 <= r[0] < 44 and r[1] == "é"), ([F.col("kind") == "c/d"], lambda r: r[1] == "c/d"), ([F.col("kind").isNull()], lambda r: r[1] is None)):
        before, gone = files(path), [r for r in rows if which(r)]
        done = sinks.delete(spark, path, ["kind"], *conditions)
        rows = [r for r in rows if not which(r)]
        assert done.deleted == len(gone) and done.partitions == len({r[1] for r in gone})
        assert sorted(map(repr, map(tuple, spark.read.parquet(path).select("id", "kind", "n").collect()))) == sorted(map(repr, rows))
        assert len(parts(p for p, _ in {*before.items()} ^ {*files(path).items()})) == done.partitions
        again = files(path)
        assert sinks.delete(spark, path, ["kind"], *conditions) == sinks.Deleted(0, 0) and files(path) == again
    assert not list(Path(path).glob("kind=c*"))


def test_cluster_store(spark, tmp_path):
    store = sinks.ClusterStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(c, k, "t", u, u) for c in (1, 2) for k in ("x", "y") for u in range(c * 3)], "conv_id long, cluster_id string, topic string, unit_id long, at long")
    assert store.save(rows) == 18 and store.exists(1) and store.load(2).count() == 12
    store.save(rows.filter("conv_id = 2 and cluster_id = 'x'"))
    assert store.load(2).count() == 6 and {r[0] for r in store.conversations().collect()} == {1, 2}
    assert store.delete(1) and not store.exists(1) and not store.delete(1)


def test_chunks(spark):
    rows = spark.createDataFrame([(k, i) for k, n in (("a", 25), ("b", 3)) for i in range(n)], "k string, i int")
    found = {(r.k, r.chunk): r.content for r in sinks.in_chunks(rows, "k", ["i"], ["i"], 10).collect()}
    assert {key: c.count("{") for key, c in found.items()} == {("a", 0): 10, ("a", 1): 10, ("a", 2): 5, ("b", 0): 3}
    assert found["b", 0] == '[{"i":0},{"i":1},{"i":2}]'


# what was wrong before


@pytest.mark.parametrize(("levels", "kept"), [
    (["low", "expert"], "expert"), (["专家", "medium"], "专家"), (["", "n/a"], "n/a"), ([None, " Beginner "], "Beginner"), (["n/a", "weak"], "weak"), (["HIGH", "high"], "HIGH"), (["", None], ""), (["低", "低级"], "低级"), (["unheard", "of"], "unheard"),
])
def test_highest_level(spark, levels, kept):
    rows = spark.createDataFrame([(1, "v", x, f"e{i}", i) for i, x in enumerate(levels)], "u int, value string, level string, evidence string, seq int")
    assert profiles.merge_values(rows, ["u"], "highest").first().level == kept


def test_payload_of_many_evidences(spark):
    many = ",".join(f'"e{i}"' for i in range(1500))
    rows = spark.createDataFrame([(1, f'[{{"value":"v","evidences":[{many}],"level":"low"}},{{"value":"v","evidences":["x","e3"],"level":"high"}}]')], "id int, payload string")
    found = profiles.merge_values(profiles.payload_rows(rows, "id", "payload"), ["id"]).first()
    assert found.evidences == [f"e{i}" for i in range(1500)] + ["x"] and found.level == "high"


def test_all_hits_stay(spark):
    """Fifty hits: all are shown, and co-members of hits beyond the twentieth, too, while there is room."""
    members = spark.createDataFrame([("c", f"m{i:03d}", i) for i in range(200)], "cluster_id string, doc_id string, seq int")
    docs = [f"x{i}" for i in range(40)] + [f"m{i:03d}" for i in range(100, 110)]
    hits = spark.createDataFrame([(1, d, r, 1 - r / 100) for r, d in enumerate(docs, 1)], "query_id int, doc_id string, rank int, score double")
    found = [(r.doc_id, r.hit_id) for r in clusters.insert_after_hits(hits, members).orderBy("place").collect()]
    assert {d for d, _ in found} >= set(docs) and sum(h is not None for _, h in found) == 10
    assert [d for d, h in found if h == "m100"] == ["m101", "m099", "m102"]


def test_no_clusters_chosen(spark):
    members = spark.createDataFrame([(c, f"{c}{i}", i) for c in "ab" for i in range(3)], "cluster_id string, doc_id string, seq int")
    hits = spark.createDataFrame([(q, d, r, 1 - r / 10) for q in (1, 2, 3) for r, d in enumerate(["a0", "b1", "b2"], 1)], "query_id int, doc_id string, rank int, score double")
    choices = spark.createDataFrame([(1, ["z", "a"], True), (2, [], False), (3, None, None)], "query_id int, cluster_ids array<string>, relevant boolean")
    found = defaultdict(list)
    for r in clusters.rerank_by_cluster(hits, members, choices=choices).orderBy("query_id", "place").collect():
        found[r.query_id].append((r.doc_id, round(r.score, 2)))
    assert found[1] == [("a0", 1.0), ("a1", 1.0), ("a2", 1.0), ("b1", 0.64), ("b2", 0.56)]
    assert found[2] == [("a0", 0.9), ("b1", 0.8), ("b2", 0.7)]
    assert [d for d, _ in found[3]] == ["b0", "b1", "b2", "a0", "a1", "a2"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("answer", "wanted"), [
    ('{"queries": ["Where IS it? ", "who was there", "abcd", "x12345"]}', ["who was there", "x12345"]), ("no object", ["where is it?"]), ('so {"queries": []}', ["where is it?"]),
    ('{"queries": "text"}', ["where is it?"]), ('{"queries": ["one one", "two two", " three ", "four four"]}', ["one one", "two two", "three"]), (None, ["where is it?"]),
])
def test_query_variants(spark, answer, wanted):
    assert one(spark, X.query_variants(F.lit(answer).cast("string"), F.lit("where is it?"))) == wanted


def test_names_and_mentions(spark):
    refs = F.array(F.struct(F.lit("Al").alias("name"), F.lit(1).alias("user_id")), F.struct(F.lit("a.b").alias("name"), F.lit(2).alias("user_id")))
    assert one(spark, X.mentions(F.lit("Al met Alan and pal, a.b axb"), refs, sign="")) == "Al(user_id:1) met Al(user_id:1)an and pal, a.b(user_id:2) axb"


def test_knn_in_groups(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(300, 4))
    group = [0 if i < 200 else i % 5 for i in range(300)]  # one group holds two thirds
    corpus = spark.createDataFrame([(i, group[i], x[i].tolist()) for i in range(300)], "doc_id long, g long, vector array<double>")
    queries = spark.createDataFrame([(i, group[i], x[i].tolist()) for i in range(0, 300, 7)], "query_id long, g long, qvector array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    wanted = {}
    for i in range(0, 300, 7):
        own = sorted((-round(float(unit[i] @ unit[j]), 6), j) for j in range(300) if group[j] == group[i])[:5]
        wanted.update({(i, r): j for r, (s, j) in enumerate(own, 1) if -s >= -0.5})
    found = rank.knn_within(queries, corpus, "g", 5, part_rows=30, most_query_rows=4, least=-0.5)
    assert {(r.query_id, r.rank): r.doc_id for r in found.collect()} == wanted


def test_majority_and_selection(spark):
    rows = spark.createDataFrame([("c1", 1, {"a": True, "b": True, "c": False}), ("c1", None, {"a": True, "b": None}), ("c2", 1, {}), ("c2", 2, None)], "conv_id string, category int, judgments map<string,boolean>")
    found = {(r.conv_id, r.category): (r.n, r.correct) for r in profiles.majority_roll_up(rows).collect()}
    assert found == {(None, None): (4, 1), ("c1", None): (2, 1), ("c2", None): (2, 0), (None, "1"): (2, 1), (None, "2"): (1, 0), (None, "unknown"): (1, 0)}
    none = spark.createDataFrame([], "query_id int, cluster_id int, unit_id int")
    _, total = clusters.selection_quality(none, none, none, none)
    assert tuple(total.first()) == (0, 0, 0.0, 0, 0.0, 0.0)


def test_role_evidences(spark):
    history = spark.createDataFrame([("coordinator", "u", "e9", 0, "weak"), ("coordinator", "u", "e1", 1, "weak"), ("joker", "u", "e2", 0, "strong"), ("opinion_leader", "v", "e2", 0, "strong")], "role string, user_id string, evidence string, pos int, confidence string")
    new = spark.createDataFrame([("coordinator", "u", "e3", "strong"), ("coordinator", "u", "e2", "weak"), ("coordinator", "u", "e1", "weak"), ("coordinator", "u", "gone", "weak"), ("core_contributor", "v", "e3", "weak"), ("coordinator", "", "e3", "weak")], "role string, user_id string, evidence string, confidence string")
    units = spark.createDataFrame([("e1", "u", 1), ("e2", "u", 2), ("e3", "u", 3)], "evidence string, user_id string, at long")
    found = {(r.role, r.user_id): (r.confidence, r.evidences) for r in profiles.role_evidences(history, new, units).collect()}
    assert found == {("coordinator", "u"): ("strong", ["e9", "e1", "e2", "e3"]), ("core_contributor", "v"): ("weak", [])}


def test_index_stats_of_several_clusters(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 3), ("c", 3)], "cluster_id string, unit_id int")
    r = clusters.index_stats(rows).first()
    assert (r.clusters, r.units, r.multi_cluster_units, r.largest, r.smallest, r.singletons, round(r["mean"], 3)) == (3, 3, 1, 2, 1, 2, 1.333)
    assert Counter(r.asDict().values())[None] == 0


def test_long_part_without_silence(spark):
    """3,000 units of one group, of which few clusters are alive at a time, and silences elsewhere; null ids of groups are a group."""
    draw = np.random.default_rng(2)
    rows = [(g, i, 40.0 * i + (90_000.0 if g and i > 100 else 0.0) + (200_000.0 if g == 2 and i > 150 else 0), None if i % 97 == 3 else draw.normal(size=3).tolist()) for g, n in ((0, 3000), (1, 200), (2, 200), (None, 50)) for i in range(n)]
    units = spark.createDataFrame([(g, i, at, v) for g, i, at, v in rows], "group_id long, unit_id long, at double, vector array<double>").repartition(4)
    found = {(r.group_id, r.unit_id): (r.cluster_id, r.similarity) for r in clusters.online_clusters(units, least=0.9, most_gap=5000.0).collect()}
    wanted = {}
    for g in (0, 1, 2, None):
        fold = clusters.OnlineClusters(0.9, 5000.0)
        for _, i, at, v in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])):
            k, score = fold.add(at, v)
            wanted[g, i] = (f"cluster_{k:03d}", score)
    assert found == wanted and len({c for (g, _), (c, _) in wanted.items() if g == 0}) > 100
    plan = clusters._parts(units, "group_id", 5000.0)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # over buckets, in a table of their own


#: Own questions of every type: type, strategy.
QUESTIONS = {
    ("event_temporal", "agentic_only"): ["When did Ada go to the choir rehearsal?", "When did Ben paint a harbour?", "When did Ada sign up for a sailing class?", 'When did Ben read the book "small boats"?', "When is Ada going to the poetry festival?", "When is Ben planning on going climbing?", "WHEN DID ADA GO?", "when did ada go?"],
    ("event_activity", "gec_cluster_rerank"): ["What activities does Ben partake in?", "What does Ben do to relax?"],
    ("event_aggregation", "gec_insert_after_hit"): ["What experiences did Ben have?", "What kinds of music does Ada play?"],
    ("counting", "agentic_only"): ["What books has Ben read?", "Where has Ben camped?", "How many times did Ada sing?", "List all the places."],
    ("attribute_identity", "agentic_only"): ["What is Ada's identity?", "What is Ada's relationship status?"],
    ("attribute_preference", "agentic_only"): ["What do Ben's kids like?"],
    ("attribute_location", "agentic_only"): ["Where did Ada move from 4 years ago?"],
    ("reasoning_hypothetical", "gec_insert_after_hit"): ["Would Ada still want to pursue teaching as a career if she hadn't had help?", "Would Ada likely have poems on her shelf?", "Would Ada pursue singing as a career option?"],
    ("time_calculation", "agentic_only"): ["How long has Ada had her current group of friends for?", "How long ago was Ada's 18th birthday?"],
    ("general", "gec_insert_after_hit"): ["What fields would Ada be likely to pursue in her education?", "What did Ada research?", "What career path has Ada decided to pursue?", "", "Tell me."],
}


def test_types_of_questions(spark):
    asked = [(q, *kind) for kind, own in QUESTIONS.items() for q in own]
    rows = spark.createDataFrame(asked, "q string, type string, strategy string").withColumn("k", Q.classify(F.col("q"))).withColumn("route", Q.route(F.col("k"))).collect()
    assert [(r.q, r.k.type, r.k.strategy, r.route) for r in rows] == [(q, t, s, s) for q, t, s in asked]
    assert all(0 <= r.k.confidence <= 1 for r in rows)


def test_texts_are_read_once_for_many_patterns(spark, monkeypatch):
    """Evidences of 1.2 million characters are one part, and units that are longer than all of them are looked for in none."""
    import pyarrow as pa

    def spy(direction):
        def seen(patterns, texts):
            told = [f"{direction} {sum(map(len, t.column('id').to_pylist()))}" for t in (patterns, texts) if patterns.num_rows and texts.num_rows]
            return pa.table({"evidence_id": pa.array([f"{i} {x} {hash((x, i, texts.num_rows))}" for i, x in enumerate(told)], pa.string()), "unit_id": pa.array([""] * len(told), pa.string())})

        return seen

    monkeypatch.setattr(matching, "_first_inside", spy)
    e = spark.range(24_000).select(F.rpad(F.md5(F.col("id").cast("string")), 50, "x").alias("evidence_id"))
    u = spark.range(40).select(F.rpad(F.md5(F.col("id").cast("string")), 900, "y").alias("unit_id"))
    rows = [r.evidence_id.split() for r in matching.containing(e, u).collect()]
    assert sum(int(n) for i, d, n, _ in rows if i == "1" and d == "evidence") == 40 * 900
    assert [r for r in rows if r[1] == "unit"] == []


def test_windows_meet_texts_of_any_alphabet(spark):
    """Pieces of every length at every place, some a character short or long, repeated letters and several bytes a letter."""
    draw = random.Random(8)
    for letters in ("ab", "aé漢😀", "abc \n"):
        word = lambda n: "".join(draw.choice(letters) for _ in range(n))  # noqa: E731, B023
        units = [word(draw.choice([1, 4, 9, 70, 200])) for _ in range(40)]
        evidences = [u[a : a + n] for u in units for a, n in [(draw.randrange(len(u)), draw.choice([1, 2, 3, 8, 15, 16, 17, 31, 64, 65]))]] + [word(n) for n in range(1, 40)] + ["a" * 33]
        e, u = (spark.createDataFrame([(x,) for x in rows], f"{c} string") for rows, c in ((evidences, "evidence_id"), (units, "unit_id")))
        wanted = {x: min((y for y in units if x in y or y in x), key=str.encode, default=None) for x in set(evidences) - set(units)}
        assert {r.evidence_id: r.unit_id for r in matching.containing(e, u).collect() if r.how == "contained"} == {x: y for x, y in wanted.items() if y is not None}


def test_no_more_places_are_looked_up_than_can_be_nearest(spark):
    """As many on each side as are wanted; at a cluster's ends all come from one side."""
    members = spark.createDataFrame([("c", i, i) for i in range(12)] + [("d", 50, 0), ("d", 51, 1)], "cluster_id string, doc_id int, seq int")
    hits = spark.createDataFrame([(i, i) for i in range(12)] + [(50, 50)], "query_id int, doc_id int")
    found = clusters.neighbours(hits, members, 4)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r.nth] = r.member_id
    near = lambda i: sorted((j for j in range(12) if j != i), key=lambda j: (abs(j - i), i - j))[:4]
    assert {q: [m for _, m in sorted(own.items())] for q, own in got.items()} == {**{i: near(i) for i in range(12)}, 50: [51]}
    assert "* most" not in found._jdf.queryExecution().analyzed().toString()
