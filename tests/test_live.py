"""Event-time streams against their batch twins, whatever the order of arrival, and what stays of their state."""

import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from engram.operators import clusters
from engram.plans import queries as plans
from engram.streaming import live

from .conftest import TINY

SCHEMAS = {
    "units": "group_id long, event_id long, ts timestamp, vector array<double>",
    "cache": "user_id long, event_id long, ts timestamp, is_read boolean, first long, last long",
    "events": "user_id long, ts timestamp",
}
T0 = 1_700_000_000


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    live.use_state_store(spark)
    yield
    spark.conf.set(name, before)


def source(spark, folder, kind, batches):
    """A stream of one file a batch, in the order given."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMAS[kind]).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return spark.readStream.schema(SCHEMAS[kind]).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def run(stream, folder, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(folder / "state")).start()
    q.awaitTermination()
    return q, stream.sparkSession.table(name)


def in_batches(rows, n, seed):
    rows = rows[:]
    random.Random(seed).shuffle(rows)
    return [rows[i::n] for i in range(n)]


def at(seconds):
    return pd.Timestamp(T0 + seconds, unit="s", tz="UTC").to_pydatetime()


def test_clusters_of_shuffled_batches(spark, store, tmp_path):
    draw = np.random.default_rng(3)
    means = draw.normal(size=(4, 6))
    rows = [(g, 1000 * g + i, at(600 * i + (200_000 if i > 40 else 0)), None if i % 17 == 5 else (means[draw.integers(4)] + 0.3 * draw.normal(size=6)).tolist()) for g in (1, 2) for i in range(80)]
    end = [(99, 1, at(900_000), [1.0] * 6)]
    end2 = [(99, 2, at(990_000), [1.0] * 6)]
    stream = live.clusters(source(spark, tmp_path, "units", [*in_batches(rows, 4, 5), end, end2]), "group_id", least=0.6, most_gap=50_000.0, late="4 days")
    q, table = run(stream, tmp_path, "live_clusters")
    found = {(r.group_id, r.event_id): (r.cluster_id, round(r.similarity, 5), r.version) for r in table.collect() if r.group_id != 99}
    batch = spark.createDataFrame([(g, i, float(t.timestamp()), v) for g, i, t, v in rows], "group_id long, unit_id long, at double, vector array<double>")
    twin = clusters.online_clusters(batch, least=0.6, most_gap=50_000.0).collect()
    seen: Counter = Counter()
    wanted = {}
    for r in sorted(twin, key=lambda r: r.unit_id):
        seen[r.group_id, r.cluster_id] += 1
        wanted[r.group_id, r.unit_id] = (r.cluster_id, round(r.similarity, 5), seen[r.group_id, r.cluster_id])
    assert found == wanted and len({c for c, _, _ in wanted.values()}) > 4
    # all clusters of groups 1 and 2 are dead at the end
    left = spark.read.format("statestore").option("stateVarName", "clusters").load(str(tmp_path / "state")).select("key.*").collect()
    assert {r.group_id for r in left} <= {99}


def test_cache_purges_and_reads_ranges(spark, store, tmp_path):
    draw = random.Random(4)
    hour = 3600
    rows = [(u, 10_000 * u + i, at(draw.randrange(12 * hour)), False, None, None) for u in (1, 2, 3) for i in range(150)]
    for u in (1, 2, 3, 4):
        for i in range(30):
            s = draw.randrange(12 * hour)
            low = (T0 + s - draw.randrange(4 * hour)) * 1000
            rows.append((u, 90_000 + 100 * u + i, at(s), True, low, low + draw.randrange(5 * hour) * 1000))
    ends = [[(9, 1, at(40 * hour), False, None, None)], [(9, 2, at(50 * hour), False, None, None)]]
    stream = live.window_cache(source(spark, tmp_path, "cache", [*in_batches(rows, 5, 6), *ends]), "user_id", "1 hour", "13 hours")
    q, table = run(stream, tmp_path, "live_cache")
    found = {(r.user_id, r.event_id): r.found for r in table.collect()}
    wanted = {}
    for u, e, t, read, first, last in rows:
        if read:
            now = int(t.timestamp() * 1000)
            seen = sorted((int(s.timestamp() * 1000), i) for v, i, s, is_read, _, _ in rows if v == u and not is_read)
            wanted[u, e] = [i for ms, i in seen if first <= ms <= last and now - 2 * hour * 1000 < ms <= now]
    assert found == wanted and sum(map(len, wanted.values())) > 100
    twin = live.cached(spark.createDataFrame(rows, SCHEMAS["cache"]), "user_id", "1 hour")
    assert {(r.user_id, r.event_id): r.found for r in twin.collect()} == wanted
    left = spark.read.format("statestore").option("stateVarName", "rows").load(str(tmp_path / "state")).select("key.*").collect()
    assert {r.user_id for r in left} <= {9}


def sliding(rows):
    out = Counter()
    for u, t in rows:
        minute = int(t.timestamp()) // 60 * 60
        for end in range(minute + 60, minute + 3660, 60):
            out[end, u, False] += 1
            out[end, None, True] += 1
    return out


def test_throughput(spark, tmp_path):
    draw = random.Random(8)
    rows = [(draw.choice([1, 1, 1, 2, 3]), at(draw.randrange(3 * 3600))) for _ in range(400)]
    key = lambda r: (r.end, r.user_id, r.is_total)
    wanted = sliding(rows)
    assert {key(r): r.n for r in live.throughput(spark.createDataFrame(rows, SCHEMAS["events"]), "user_id").collect()} == wanted
    ends = [[(9, at(30 * 3600))], [(9, at(40 * 3600))]]
    stream = live.throughput(source(spark, tmp_path, "events", [*in_batches(rows, 3, 2), *ends]), "user_id", late="4 hours")
    _, table = run(stream, tmp_path, "live_rates")
    found = {key(r): r.n for r in table.collect() if r.end <= T0 + 5 * 3600}
    assert found == wanted


def test_late_rows_correct_closed_windows(spark, tmp_path):
    draw = random.Random(1)
    day = 86400
    rows = [(draw.randrange(5), at(draw.randrange(20 * day))) for _ in range(600)]
    folder = tmp_path / "tables"
    sink = live.WindowCounts(str(folder), "user_id")
    batches = [*in_batches(rows, 6, 3), [(7, at(60 * day))]]
    stream = source(spark, tmp_path, "events", batches)
    q = stream.writeStream.foreachBatch(sink.batch).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination()
    width = lambda t: int(t.timestamp()) // day * day
    wanted = Counter((width(t), u) for u, t in rows)
    published = lambda: {(r.start, r.user_id): r.n for r in sink.counts(spark).collect()}
    assert published() == wanted
    assert spark.read.parquet(str(folder / "late")).count() > 100
    # one more late row: only its window's files change; the same batch again changes nothing
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (folder / "counts").rglob("*.parquet")}
    before = files()
    more = spark.createDataFrame([(3, at(5 * day))], SCHEMAS["events"])
    sink.batch(more, 7)
    wanted[width(at(5 * day)), 3] += 1
    assert published() == wanted
    changed = {p.split("start=")[1].split("/")[0] for p in {*before} ^ {*files()}}
    assert changed == {str(width(at(5 * day)))}
    sink.batch(more, 7)
    assert published() == wanted and sink.newest(spark) == T0 + 60 * day


def test_live_clusters_of_the_vectors(spark):
    found = {(r.group_id, r.event_id): (r.cluster_id, round(r.similarity, 5), r.version) for r in plans.QUERIES["k10_live_clusters"](spark, TINY).collect()}
    seen: Counter = Counter()
    for r in plans.c1_online_clusters(spark, TINY).orderBy("unit_id").collect():
        seen[r.group_id, r.cluster_id] += 1
        assert found.pop((r.group_id, r.unit_id)) == (r.cluster_id, round(r.similarity, 5), seen[r.group_id, r.cluster_id])
    assert not found
