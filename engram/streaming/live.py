"""Event-time streams with state of many small values, timers that expire it, and corrections of late rows.

The processors take rows in order of event time, whatever the order in which they arrive within the lateness: a row waits in the
state of its key until the watermark has passed it. So a stream gives the rows of its batch twin. They need the RocksDB state
store (``use_state_store``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from engram.operators.clusters import OnlineClusters


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _InOrder(StatefulProcessor):
    """Rows wait in a list until the watermark has passed them; then ``taken`` gets them in order of ts and event_id."""

    waiting_schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.opened(handle)

    def opened(self, handle: StatefulProcessorHandle) -> None: ...

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for batch in rows:
            if len(batch):
                ms = [int(t.timestamp() * 1000) for t in batch["ts"]]
                first = min(ms) if first is None else min(first, *ms)
                self.waiting.appendList([self.waiting_row(m, r) for m, r in zip(ms, batch.itertuples(index=False), strict=True)])
        if first is not None:
            self.handle.registerTimer(first + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: r[:2]) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] < passed], [r for r in rows if r[0] >= passed]
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self.handle.registerTimer(later[0][0] + 1)
        found = self.taken(key, due, passed)
        return iter([found] if found is not None and len(found) else [])

    def waiting_row(self, ms: int, row) -> tuple:
        raise NotImplementedError

    def taken(self, key, rows: list[tuple], passed: int) -> pd.DataFrame | None:
        raise NotImplementedError


class _Clusters(_InOrder):
    """A map of the group's clusters, one value each: only those that a unit joins are written, and dead ones leave."""

    waiting_schema = "ms long, event_id long, vector array<double>"

    def __init__(self, key: str, least: float, most_gap: float):
        self.key, self.least, self.most_gap = key, least, most_gap

    def opened(self, handle):
        self.count = handle.getValueState("count", "n long")
        self.live = handle.getMapState("clusters", "no long", "centroid array<float>, size long, last double, version long")

    def waiting_row(self, ms, row):
        return ms, int(row.event_id), None if row.vector is None else [float(x) for x in row.vector]

    def taken(self, key, rows, passed):
        if not self.live.exists() and not rows:
            return None
        began = int(self.count.get()[0]) if self.count.exists() else 0
        held = {int(k[0]): v for k, v in self.live.iterator()} if self.live.exists() else {}
        versions, out, touched = {no: int(v[3]) for no, v in held.items()}, [], set()
        if rows:
            clusters = OnlineClusters(self.least, self.most_gap)
            numbers = sorted(held)  # the live ones, in the order in which they began
            for no in numbers:
                clusters.restore([*held[no][0]], int(held[no][1]), float(held[no][2]))
            for ms, event, vector in rows:
                at, score = clusters.add(ms / 1000, vector)
                if at == len(numbers):
                    numbers.append(began)
                    began += 1
                no = numbers[at]
                versions[no] = versions.get(no, 0) + 1
                touched.add(at)
                out.append((key[0], event, f"cluster_{no:03d}", score, versions[no]))
            self.count.update((began,))
            for at in touched:
                centroid, size, last = clusters.kept(at)
                held[numbers[at]] = (centroid, size, last, versions[numbers[at]])
                self.live.updateValue((numbers[at],), held[numbers[at]])
        # what no unit can join any more
        ends = {no: int((float(v[2]) + self.most_gap) * 1000) for no, v in held.items()}
        for no, end in ends.items():
            if end < passed:
                self.live.removeKey((no,))
        if left := [end for end in ends.values() if end >= passed]:
            self.handle.registerTimer(min(left) + 1)
        return pd.DataFrame(out, columns=[self.key, "event_id", "cluster_id", "similarity", "version"])


def clusters(units: DataFrame, key: str, least: float = 0.65, most_gap: float = 7 * 86400.0, late: str = "1 day") -> DataFrame:
    """A stream of key, event_id, ts, vector: each unit with its cluster, the similarity and the version of the cluster's profile after
    it, as ``online_clusters`` numbers them. A cluster leaves the state when the watermark is most_gap seconds past its last unit."""
    kind = dict(units.dtypes)[key]
    rows = units.select(key, "event_id", "ts", F.col("vector").cast("array<double>").alias("vector")).withWatermark("ts", late)
    return rows.groupBy(key).transformWithStateInPandas(_Clusters(key, least, most_gap), f"{key} {kind}, event_id long, cluster_id string, similarity double, version long", "Append", "EventTime")


class _Cache(_InOrder):
    """The rows of the last two windows of a key, oldest first; a read gives the ids of a range of time."""

    waiting_schema = "ms long, event_id long, is_read boolean, first long, last long"

    def __init__(self, key: str, window_ms: int):
        self.key, self.window_ms = key, window_ms

    def opened(self, handle):
        self.rows = handle.getListState("rows", "ms long, event_id long")

    def waiting_row(self, ms, row):
        read = bool(row.is_read)
        return ms, int(row.event_id), read, int(row.first) if read else 0, int(row.last) if read else 0

    def taken(self, key, rows, passed):
        kept = [(int(a), int(b)) for a, b in self.rows.get()] if self.rows.exists() else []
        before, out = len(kept), []
        for ms, event, read, first, last in sorted(rows, key=lambda r: (r[0], r[2], r[1])):  # a read sees what has its own time
            if read:
                alive = ms - 2 * self.window_ms
                found = [i for at, i in kept if max(first, alive + 1) <= at <= last]
                out.append((key[0], event, found))
            else:
                kept.append((ms, event))
        kept = [r for r in kept if r[0] > passed - 2 * self.window_ms]
        if rows or len(kept) < before:
            self.rows.put(kept) if kept else self.rows.clear()
        if kept:
            self.handle.registerTimer(kept[0][0] + 2 * self.window_ms + 1)
        return pd.DataFrame(out, columns=[self.key, "event_id", "found"])


def window_cache(rows: DataFrame, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A stream of key, event_id, ts, is_read, first, last (epoch milliseconds): for each row that is a read the ids (found) of the key's
    rows with first <= time <= last, oldest first, as they were at the read's own time. Rows older than twice the window are gone."""
    kind, window_ms = dict(rows.dtypes)[key], int(pd.Timedelta(window).total_seconds() * 1000)
    given = rows.select(key, "event_id", "ts", "is_read", "first", "last").withWatermark("ts", late)
    return given.groupBy(key).transformWithStateInPandas(_Cache(key, window_ms), f"{key} {kind}, event_id long, found array<long>", "Append", "EventTime")


def cached(rows: DataFrame, key: str, window: str = "1 hour") -> DataFrame:
    """The batch twin of ``window_cache``: reads meet the rows of the hours that they can see, by equal hours."""
    window_ms = int(pd.Timedelta(window).total_seconds() * 1000)
    ms = F.unix_millis("ts")
    own = rows.filter("not is_read").select(key, F.col("event_id").alias("id"), ms.alias("ms"))
    reads = rows.filter("is_read").select(key, "event_id", F.greatest("first", ms - 2 * window_ms + 1).alias("first"), F.least("last", ms).alias("last"))
    hour = lambda c: F.floor(c / window_ms)
    wanted = reads.filter("first <= last").select("*", F.explode(F.sequence(hour(F.col("first")), hour(F.col("last")))).alias("hour"))
    hits = wanted.join(own.withColumn("hour", hour(F.col("ms"))), [key, "hour"]).filter("ms between first and last")
    found = hits.groupBy(key, "event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ms", "id"))), lambda r: r["id"]).alias("found"))
    return reads.select(key, "event_id").join(found, [key, "event_id"], "left").withColumn("found", F.coalesce("found", F.array().cast("array<long>")))


def throughput(events: DataFrame, key: str, pane: str = "1 minute", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows of each key, and of all (null key, is_total), in the time ``width`` up to the end of each pane: end (epoch seconds), key,
    is_total, n; panes whose width is empty have no row. A stream or a table.

    Rows are counted by pane first; only these counts, one for each key and pane, are spread over the windows that hold them, so
    no frame ever holds a key's rows, and the total adds up one count for each key."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    panes = rows.groupBy(F.window("ts", pane), key).agg(F.count("*").alias("n"))
    at = F.window_time("window") if events.isStreaming else F.col("window.start")
    named = F.explode(F.array(F.struct(F.col(key).alias(key), F.lit(False).alias("is_total")), F.struct(F.lit(None).cast(dict(events.dtypes)[key]).alias(key), F.lit(True).alias("is_total"))))
    parts = panes.select(at.alias("ts"), "n", named.alias("k")).select("ts", "n", f"k.{key}", "k.is_total")
    sums = parts.groupBy(F.window("ts", width, pane), key, "is_total").agg(F.sum("n").alias("n"))
    return sums.select(F.unix_seconds("window.end").alias("end"), key, "is_total", "n")


class WindowCounts:
    """Counts by window and key as tables that late rows correct.

    ``batch`` is a sink for foreachBatch. Each batch adds its own counts, as a partition that a repeated batch replaces. A window is
    published when the newest time seen is ``late`` seconds past its end. Rows of a published window are late: they are written
    aside, and of the published counts only the windows that they touch are made anew. The state between batches is the table
    ``newest``, so a restarted stream goes on where it was.
    """

    def __init__(self, path: str, key: str, width: int = 86400, late: int = 86400):
        self.path, self.key, self.width, self.late = path, key, width, late

    def _read(self, spark: SparkSession, name: str) -> DataFrame | None:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return spark.read.parquet(f"{self.path}/{name}") if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None

    def _put(self, df: DataFrame, name: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.path}/{name}")

    def newest(self, spark: SparkSession, before: int | None = None) -> int | None:
        """The newest time (epoch seconds) seen by the batches before."""
        seen = self._read(spark, "newest")
        if seen is None:
            return None
        return (seen if before is None else seen.filter(F.col("batch") < before)).agg(F.max("at")).first()[0]

    def batch(self, rows: DataFrame, no: int) -> None:
        """rows: key, ts."""
        spark = rows.sparkSession
        known = self.newest(spark, no)
        start = (F.floor(F.unix_seconds("ts") / self.width) * self.width).alias("start")
        rows = rows.select(F.col(self.key), F.col("ts"), start).persist()
        try:
            top = rows.agg(F.max(F.unix_seconds("ts"))).first()[0]
            if top is None:
                return
            newest = top if known is None else max(top, known)
            closed = lambda now: F.col("start") + self.width + self.late <= now
            self._put(rows.groupBy("start", self.key).agg(F.count("*").alias("n")).withColumn("batch", F.lit(no)), "parts", "start", "batch")
            touched = rows.filter(closed(known)) if known is not None else rows.limit(0)
            self._put(touched.withColumn("batch", F.lit(no)), "late", "batch")
            parts = self._read(spark, "parts")
            # windows that close now, and closed ones that got late rows: only their partitions are read and replaced
            new = closed(newest) & ~closed(known) if known is not None else closed(newest)
            late = touched.select("start").distinct()
            due = parts.filter(new).unionByName(parts.filter(~new).join(F.broadcast(late), "start", "left_semi"))
            self._put(due.groupBy("start", self.key).agg(F.sum("n").alias("n")), "counts", "start")
            self._put(spark.range(1).select(F.lit(newest).cast("long").alias("at"), F.lit(no).alias("batch")), "newest", "batch")
        finally:
            rows.unpersist()

    def counts(self, spark: SparkSession) -> DataFrame:
        """The published windows: start, key, n."""
        return self._read(spark, "counts").select(F.col("start").cast("long").alias("start"), self.key, "n")

