"""Streams and their batch twins: gaps, sessions, rates, tumbling counts."""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from engram.operators.clusters import OnlineClusters


def tumbling_counts(events: DataFrame, key: str = "user_id", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Works on a stream or a table: rows per key and window."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), key).agg(F.count("*").alias("n")).select(F.unix_seconds("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, key: str = "user_id", gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Segments of a key's messages, cut where the gap to the one before is reached, in whole seconds. A stream or a table."""
    rows = events.withColumn("ts", F.date_trunc("second", "ts"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    below = f"{int(pd.Timedelta(gap).total_seconds() * 1_000_000) - 1} microseconds"  # a window also takes what comes when it ends
    found = rows.groupBy(F.session_window("ts", below).alias("w"), key).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return found.select(key, F.unix_seconds("first").alias("first_at"), F.unix_seconds("last").alias("last_at"), "n")


def gaps(messages: DataFrame, key: str, order: list[str]) -> DataFrame:
    """gap: seconds to the message before; bucket: immediate, recent, pause, long gap or out of order."""
    gap = F.col("at") - F.lag("at").over(Window.partitionBy(key).orderBy(*order))
    bucket = F.when(gap < 0, "out of order").when(gap < 60, "immediate").when(gap < 3600, "recent").when(gap < 86400, "pause").when(gap.isNotNull(), "long gap")
    return messages.withColumn("gap", gap).withColumn("bucket", bucket)


def over_limit(events: DataFrame, key: str, period: int, most: int) -> DataFrame:
    """n: events of the key in the period up to each event; limited: more than most."""
    n = F.count("*").over(Window.partitionBy(key).orderBy("at").rangeBetween(-period + 1, 0))
    return events.withColumn("n", n).withColumn("limited", n > most)


def decided_segments(messages: DataFrame, key: str, order: list[str], row_id: str) -> DataFrame:
    """messages: key, row_id, boundary and what orders them. key, no (from 0), n, first_id, last_id, done: a segment ends with the message
    whose boundary holds; the last one of a key may wait for its own."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    no = F.coalesce(F.sum(F.col("boundary").cast("int")).over(w), F.lit(0))
    at = F.struct(*order)
    return messages.withColumn("no", no).groupBy(key, "no").agg(F.count("*").alias("n"), F.min_by(row_id, at).alias("first_id"), F.max_by(row_id, at).alias("last_id"), F.max("boundary").alias("done"))


def status(messages: DataFrame, key: str) -> DataFrame:
    """messages: key, at (epoch seconds), extracted (an extraction ended with this message). key, phase, old_start_ms, new_start_ms, last_ms."""
    last = F.max(F.when(F.col("extracted"), F.col("at")))
    rows = messages.groupBy(key).agg(F.count("*").alias("n"), F.min("at").alias("a"), F.max("at").alias("b"), last.alias("cut"))
    phase = F.when(F.col("cut") == F.col("b"), "extracted").when((F.col("n") == 1) & F.col("cut").isNull(), "new").otherwise("continuing")
    ms = lambda c: F.col(c) * 1000
    return rows.select(key, phase.alias("phase"), ms("a").alias("old_start_ms"), F.coalesce(ms("cut") + 1, ms("a")).alias("new_start_ms"), ms("b").alias("last_ms"))


def capped_history(messages: DataFrame, key: str, most: int, idle: int, since: int) -> DataFrame:
    """The last ``most`` messages of each key that was active at most ``idle`` seconds before the newest message of all, from ``since`` on."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("at"), F.desc("event_id")))
    now = messages.agg(F.max("at").alias("now"))
    active = messages.groupBy(key).agg(F.max("at").alias("newest")).crossJoin(F.broadcast(now)).filter(F.col("now") - F.col("newest") <= idle).select(key)  # now: one row
    return messages.withColumn("nth", nth).filter(F.col("nth") <= most).filter(F.col("at") >= since).join(active, key, "left_semi")


def _by_time(batches) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(["at", "event_id"])


def segment_stream(messages: DataFrame, key: str, key_type: str, expires: str | None = "24 hours") -> DataFrame:
    """A stream of key, event_id, at, boundary: a unit (key, no, n, first_id, last_id) when a message's boundary holds. What waits is kept
    as state, for ``expires`` after the key's last message, or for good (then the stream can also run until all is read)."""

    def update(group, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        no, ids = state.get if state.exists else (0, [])
        ids, out = list(ids), []
        for event, boundary in _by_time(batches)[["event_id", "boundary"]].itertuples(index=False):
            ids.append(int(event))
            if boundary:
                out.append((group[0], no, len(ids), ids[0], ids[-1]))
                no, ids = no + 1, []
        state.update((no, ids))
        if expires:
            state.setTimeoutDuration(int(pd.Timedelta(expires).total_seconds() * 1000))
        yield pd.DataFrame(out, columns=[key, "no", "n", "first_id", "last_id"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if expires else GroupStateTimeout.NoTimeout
    return messages.groupBy(key).applyInPandasWithState(update, f"{key} {key_type}, no long, n long, first_id long, last_id long", "no long, ids array<long>", "append", timeout)


def limit_stream(events: DataFrame, key: str, key_type: str, period: int, most: int) -> DataFrame:
    """A stream of key, event_id, at: each event with n, how many the key had in the period up to it, and limited. State: the times in it."""

    def update(group, batches, state: GroupState):
        times = list(state.get[0]) if state.exists else []
        rows, n = _by_time(batches), []
        for at in rows["at"]:
            times = [t for t in times if t > at - period] + [int(at)]
            n.append(len(times))
        state.update((times,))
        yield pd.DataFrame({key: rows[key], "event_id": rows["event_id"], "n": n, "limited": [x > most for x in n]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} {key_type}, event_id long, n long, limited boolean", "times array<long>", "append", GroupStateTimeout.NoTimeout)


def history_stream(messages: DataFrame, key: str, key_type: str, most: int = 100, idle: str | None = "60 minutes") -> DataFrame:
    """A stream of key, event_id, at: after each batch the ids of a key's last ``most`` messages, oldest first; forgotten after ``idle``."""

    def update(group, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        ids = list(state.get[0]) if state.exists else []
        ids = (ids + _by_time(batches)["event_id"].astype(int).tolist())[-most:]
        state.update((ids,))
        if idle:
            state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame({key: [group[0]], "event_ids": [ids]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return messages.groupBy(key).applyInPandasWithState(update, f"{key} {key_type}, event_ids array<long>", "ids array<long>", "update", timeout)


def cluster_stream(units: DataFrame, key: str, key_type: str, least: float = 0.65, most_gap: float = 7 * 86400.0) -> DataFrame:
    """A stream of key, event_id, at, vector: each unit with its cluster, the similarity, and the version that the cluster's profile has after
    it. State: the group's clusters and their counts."""

    def update(group, batches, state: GroupState):
        clusters, versions = pickle.loads(state.get[0]) if state.exists else (OnlineClusters(least, most_gap), {})
        rows, out = _by_time(batches), []
        for event, at, vector in rows[["event_id", "at", "vector"]].itertuples(index=False):
            no, score = clusters.add(at, vector)
            versions[no] = versions.get(no, 0) + 1
            out.append((group[0], int(event), f"cluster_{no:03d}", score, versions[no]))
        state.update((pickle.dumps((clusters, versions)),))
        yield pd.DataFrame(out, columns=[key, "event_id", "cluster_id", "similarity", "version"])

    return units.groupBy(key).applyInPandasWithState(update, f"{key} {key_type}, event_id long, cluster_id string, similarity double, version long", "clusters binary", "append", GroupStateTimeout.NoTimeout)


def late_rows(events: DataFrame, newest: DataFrame, late: int = 86400) -> DataFrame:
    """For a side table: the rows of a batch (at) that are more than ``late`` seconds older than the newest seen before (one row: newest),
    which a watermark would drop; the batch form of a query counts them again."""
    return events.crossJoin(F.broadcast(newest)).filter(F.col("at") < F.col("newest") - late).drop("newest")  # one row
