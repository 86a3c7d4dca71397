"""Event clusters: expansion of hits, caps, online clustering."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from engram.operators.ordered import ranked
from engram.shared import written


def neighbours(hits: DataFrame, members: DataFrame, per_hit: int = 3, with_hits: bool = False) -> DataFrame:
    """hits: query_id, doc_id; members: cluster_id, doc_id, seq (order in time). The co-members of each hit nearest in
    time: after, before, second after, second before ...; query_id, doc_id, cluster_id, member_id, nth. with_hits: as many more of
    them as the query has hits in the cluster."""
    placed = ranked(members.select("cluster_id", "doc_id", "seq"), ["cluster_id"], ["seq", "doc_id"], "place")
    mine = hits.join(placed, "doc_id").select("query_id", "doc_id", "cluster_id", F.col("place").alias("at"))
    # a member further than ``most`` places away can't be among the nearest, even at a cluster's ends, so only those places are looked up
    if with_hits:
        sizes = mine.groupBy("query_id", "cluster_id").agg(F.count("*").cast("int").alias("others"))
        mine = mine.join(sizes, ["query_id", "cluster_id"]).withColumn("most", F.col("others") + per_hit)
    else:
        mine = mine.withColumn("most", F.lit(per_hit))
    near = mine.select("*", F.explode(F.sequence(-F.col("most"), F.col("most"))).alias("d")).filter("d <> 0").withColumn("place", F.col("at") + F.col("d"))
    others = placed.select("cluster_id", F.col("doc_id").alias("member_id"), "place")
    found = near.join(others, ["cluster_id", "place"])
    order = Window.partitionBy("query_id", "doc_id", "cluster_id").orderBy(F.abs("d"), F.desc("d"))
    return found.withColumn("nth", F.row_number().over(order)).filter("nth <= most").select("query_id", "doc_id", "cluster_id", "member_id", "nth")


class OnlineClusters:
    """The clusters of one group. A unit joins the one with the most similar centroid, if that is at least ``least`` and its last unit at
    most ``most_gap`` seconds before; else it begins one. Centroids are running means in float32."""

    def __init__(self, least: float, most_gap: float):
        self.least, self.most_gap, self.n = least, most_gap, 0
        self.centroids, self.norms, self.sizes, self.last = np.zeros((8, 0), np.float32), np.zeros(8, np.float32), np.zeros(8, np.int64), np.full(8, -np.inf)

    def add(self, at: float, vector) -> tuple[int, float]:
        """The number of the unit's cluster and the similarity, 0 where it begins one."""
        v = None if vector is None or not len(vector) else np.asarray(vector, np.float32)
        if v is not None:
            if not self.centroids.shape[1]:
                self.centroids = np.zeros((len(self.sizes), len(v)), np.float32)
            norm = np.linalg.norm(v)
            live = np.flatnonzero((self.sizes[: self.n] > 0) & (at - self.last[: self.n] <= self.most_gap))
            if len(live):
                scores = (self.centroids[live] @ v / ((self.norms[live] + 1e-9) * (norm + 1e-9))).astype(float)
                i = int(scores.argmax())
                if scores[i] >= self.least and scores[i] > 0:
                    k = int(live[i])
                    self.centroids[k] = (self.centroids[k] * np.float32(self.sizes[k]) + v) / np.float32(self.sizes[k] + 1)
                    self.norms[k] = np.linalg.norm(self.centroids[k])
                    self.sizes[k] += 1
                    self.last[k] = max(at, self.last[k])
                    return k, float(scores[i])
        k = self._new(at)
        if v is not None:  # without a vector it stays alone: its size remains 0
            self.centroids[k], self.norms[k], self.sizes[k] = v, norm, 1
        return k, 0.0

    def _new(self, at: float) -> int:
        if self.n == len(self.sizes):
            self.centroids = np.concatenate((self.centroids, np.zeros_like(self.centroids)))
            self.norms, self.sizes, self.last = (np.concatenate((x, np.zeros_like(x))) for x in (self.norms, self.sizes, self.last))
        k, self.n = self.n, self.n + 1
        self.last[k] = at
        return k

    def kept(self, k: int) -> tuple[list[float], int, float]:
        """A cluster as plain values: centroid (empty without a vector), number of units that it averages, time of its last unit."""
        return (self.centroids[k].tolist() if self.sizes[k] else []), int(self.sizes[k]), float(self.last[k])

    def restore(self, centroid: list[float], size: int, last: float) -> None:
        """The next cluster, from what ``kept`` gave."""
        if size and not self.centroids.shape[1]:
            self.centroids = np.zeros((len(self.sizes), len(centroid)), np.float32)
        k = self._new(last)
        if size:
            self.centroids[k], self.sizes[k] = np.asarray(centroid, np.float32), size
            self.norms[k] = np.linalg.norm(self.centroids[k])


def _parts(units: DataFrame, group: str, most_gap: float) -> DataFrame:
    """Adds part: the number of silences of the unit's group before it that are longer than most_gap. Two units with such a silence between
    them lie in different buckets of that width, so only a row for each bucket is put in order."""
    bucket = F.floor(F.col("at") / most_gap) if most_gap > 0 else F.col("at")
    own = F.col(group).alias("__g"), bucket.alias("__b")
    ends = units.groupBy(*own).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    w = Window.partitionBy("__g").orderBy("__b")
    silent = F.coalesce((F.col("first") - F.lag("last").over(w) > most_gap).cast("int"), F.lit(0))
    parts = written(ends.withColumn("silent", silent).select("__g", "__b", F.sum("silent").over(w).alias("part")))
    return units.withColumn("bucket", bucket).join(parts, F.col(group).eqNullSafe(F.col("__g")) & F.col("bucket").eqNullSafe(F.col("__b"))).drop("__g", "__b", "bucket")


def _folded(least: float, most_gap: float, kinds: list[tuple[str, pa.DataType]]):
    """Units in order of group, part and time to their cluster's number in the part, read as a stream: only clusters that are alive are held."""

    def folded(batches):
        now, clusters, numbers, count, since = None, None, [], 0, 0
        for b in batches:
            out = []
            for g, part, unit, at, vector in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if now != (g, part):
                    now, clusters, numbers, count, since = (g, part), OnlineClusters(least, most_gap), [], 0, 0
                k, score = clusters.add(at, vector)
                if k == len(numbers):
                    numbers.append(count)
                    count += 1
                out.append((g, part, unit, numbers[k], score))
                since += 1
                if since >= 1024:  # forget the dead
                    alive, since = [k for k in range(clusters.n) if at - clusters.last[k] <= most_gap], 0
                    if 2 * len(alive) < clusters.n:
                        held = [clusters.kept(k) for k in alive]
                        clusters, numbers = OnlineClusters(least, most_gap), [numbers[k] for k in alive]
                        for c in held:
                            clusters.restore(*c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    return folded


def online_clusters(units: DataFrame, group: str = "group_id", least: float = 0.65, most_gap: float = 7 * 86400.0) -> DataFrame:
    """units: group, unit_id, at (seconds), vector. Adds cluster_id and similarity: units in order of time, folded by ``OnlineClusters``.

    Where a group is silent for longer than most_gap no cluster is alive, so its parts are folded apart, in tasks of their own, and the
    clusters of each are numbered after those of the parts before. A part is read as a stream of which the clusters that are alive are
    held, so one of any length takes bounded memory."""
    parts = _parts(units.select(group, "unit_id", "at", "vector"), group, most_gap).select(F.col(group).alias("g"), F.col("part").cast("long").alias("part"), "unit_id", F.col("at").cast("double").alias("at"), "vector")
    kinds = [("g", to_arrow_type(parts.schema["g"].dataType)), ("part", pa.int64()), ("unit_id", to_arrow_type(parts.schema["unit_id"].dataType)), ("no", pa.int64()), ("similarity", pa.float64())]
    ordered = parts.repartition("g", "part").sortWithinPartitions("g", "part", "at", "unit_id")
    types = dict(parts.dtypes)
    found = written(ordered.mapInArrow(_folded(least, most_gap, kinds), f"g {types['g']}, part long, unit_id {types['unit_id']}, no long, similarity double"))
    sizes = found.groupBy("g", "part").agg((F.max("no") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("part")) - F.col("n")
    sizes = written(sizes.select(F.col("g").alias("sg"), F.col("part").alias("sp"), before.alias("before")))
    rows = found.join(sizes, F.col("g").eqNullSafe(F.col("sg")) & (F.col("part") == F.col("sp")))
    no = F.col("no") + F.col("before")
    name = F.concat(F.lit("cluster_"), F.when(no < 1000, F.lpad(no.cast("string"), 3, "0")).otherwise(no.cast("string")))
    return rows.select(F.col("g").alias(group), "unit_id", name.alias("cluster_id"), "similarity")


def event_clusters(decisions: DataFrame) -> DataFrame:
    """decisions: conv_id, unit_id, at, assigned (array of struct type, cluster_id, new_topic). The members of each conversation's event
    clusters: conv_id, cluster_id (gec_NNN in the order they begin), unit_id, nth (of the unit's clusters), is_new, topic.

    Units come in order of time. EXISTING joins a cluster if there is one, NEW begins one, and a unit that ends up in none begins
    one, as a conversation's first unit does. Numbers depend on all decisions before, so a conversation is folded in one task."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        count, out = 0, []
        for unit, assigned in rows.sort_values(["at", "unit_id"])[["unit_id", "assigned"]].itertuples(index=False):
            nth = 0
            for a in assigned if count and assigned is not None else ():
                no = int(a["cluster_id"][4:]) if re.fullmatch(r"gec_\d+", a["cluster_id"] or "") else 0
                if a["type"] == "NEW":
                    count += 1
                    out.append((f"gec_{count:03d}", unit, nth := nth + 1, True, a["new_topic"]))
                elif a["type"] == "EXISTING" and 1 <= no <= count and a["cluster_id"] == f"gec_{no:03d}":
                    out.append((a["cluster_id"], unit, nth := nth + 1, False, None))
            if not nth:
                count += 1
                out.append((f"gec_{count:03d}", unit, 1, True, None))
        found = pd.DataFrame(out, columns=["cluster_id", "unit_id", "nth", "is_new", "topic"])
        return found.assign(conv_id=rows["conv_id"].iloc[0])[["conv_id", "cluster_id", "unit_id", "nth", "is_new", "topic"]]

    kinds = {f.name: f.dataType.simpleString() for f in decisions.schema}
    rows = decisions.select("conv_id", "unit_id", "at", "assigned").groupBy("conv_id")
    return rows.applyInPandas(fold, f"conv_id {kinds['conv_id']}, cluster_id string, unit_id {kinds['unit_id']}, nth int, is_new boolean, topic string")


def previews(members: DataFrame, last: int = 3, most: int = 100) -> DataFrame:
    """members: cluster_id, topic, at (timestamp text), summary, hits. cluster_id and preview: its topic and hits, number of members, the
    days it spans, and the last members' summaries, cut."""
    nth = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("at"), F.desc("summary")))
    short = F.when(F.length("summary") > most, F.concat(F.left("summary", F.lit(most)), F.lit("..."))).otherwise(F.col("summary"))
    few = members.select("cluster_id", "at", short.alias("short"), nth.alias("nth")).filter(F.col("nth") <= last)
    lines = few.groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "short")), False), lambda x: F.concat(F.lit("  - "), x["short"])), "\n").alias("lines"))
    all_of = members.groupBy("cluster_id").agg(F.max("topic").alias("topic"), F.max("hits").alias("hits"), F.count("*").alias("n"), F.left(F.min("at"), F.lit(10)).alias("a"), F.left(F.max("at"), F.lit(10)).alias("b"))
    head = F.concat(F.lit("["), F.col("cluster_id").cast("string"), F.lit("] "), "topic", F.when(F.col("hits") > 0, F.concat(F.lit(" (hits: "), "hits", F.lit(")"))).otherwise(""))
    days = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.concat("a", F.lit(" to "), "b"))
    text = F.concat_ws("\n", head, F.concat(F.lit("Members: "), "n"), F.concat(F.lit("Time: "), days), F.lit("Recent content:"), "lines")
    return all_of.join(lines, "cluster_id").select("cluster_id", text.alias("preview"))


def assignment_previews(members: DataFrame, most_clusters: int = 20, last: int = 3) -> DataFrame:
    """members: conv_id, no (of the cluster in its index), cluster_id, topic, at (timestamp), summary. conv_id and preview: what a model is
    shown that assigns a unit: the first clusters with their last members, dated, and how many clusters there are more."""
    recent = F.row_number().over(Window.partitionBy("conv_id", "cluster_id").orderBy(F.desc("at"), F.desc("summary")))
    few = members.filter(F.col("no") <= most_clusters).withColumn("nth", recent).filter(F.col("nth") <= last)
    line = F.concat(F.lit("  - ["), F.date_format("at", "yyyy-MM-dd HH:mm"), F.lit("] "), "summary")
    lines = few.groupBy("conv_id", "cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", line.alias("line"))), False), lambda x: x["line"]), "\n").alias("lines"))
    sizes = members.groupBy("conv_id", "cluster_id").agg(F.min("no").alias("no"), F.max("topic").alias("topic"), F.count("*").alias("n"))
    shown = sizes.join(lines, ["conv_id", "cluster_id"])
    block = F.concat(F.lit("\n### Cluster "), F.col("cluster_id").cast("string"), F.lit("\n- Topic: "), "topic", F.lit("\n- Members ("), "n", F.lit(" total):\n"), "lines")
    blocks = shown.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", block.alias("block")))), lambda x: x["block"]), "\n").alias("blocks"))
    totals = sizes.groupBy("conv_id").agg(F.count("*").alias("clusters"))
    more = F.when(F.col("clusters") > most_clusters, F.concat(F.lit("\n\n... and "), F.col("clusters") - most_clusters, F.lit(" more clusters"))).otherwise("")
    return blocks.join(totals, "conv_id").select("conv_id", F.concat("blocks", more).alias("preview"))


def index_stats(members: DataFrame) -> DataFrame:
    """members: cluster_id, unit_id. One row: clusters, units (each once), multi_cluster_units, mean, largest and smallest cluster, singletons."""
    pairs = members.select("cluster_id", "unit_id").distinct()
    units = pairs.groupBy("unit_id").agg(F.count("*").alias("k")).agg(F.count("*").alias("units"), F.count(F.when(F.col("k") > 1, 1)).alias("multi_cluster_units"))
    n = F.col("n")
    sizes = pairs.groupBy("cluster_id").agg(F.count("*").alias("n"))
    of = sizes.agg(F.count("*").alias("clusters"), F.coalesce(F.avg(n), F.lit(0.0)).alias("mean"), F.coalesce(F.max(n), F.lit(0)).alias("largest"), F.coalesce(F.min(n), F.lit(0)).alias("smallest"), F.count(F.when(n == 1, 1)).alias("singletons"))
    return of.crossJoin(units)  # one row each


def selection_quality(found: DataFrame, truth_clusters: DataFrame, truth_units: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """found: query_id, cluster_id, unit_id (what was selected); truth_*: query_id and cluster_id or unit_id; questions: query_id.

    Of each question cluster_hit, unit_hit and coverage, null where it has no truth; and one row over all: questions, hits, their rates
    over all questions, and the mean of the coverages that are known."""

    def hits(truth: DataFrame, c: str) -> DataFrame:
        both = truth.select("query_id", c).distinct().join(found.select("query_id", c, F.lit(1).alias("hit")).distinct(), ["query_id", c], "left")
        return both.groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("hit"))

    c, u = hits(truth_clusters, "cluster_id"), hits(truth_units, "unit_id")
    each = questions.select("query_id").join(c.select("query_id", (F.col("hit") > 0).alias("cluster_hit")), "query_id", "left")
    each = each.join(u.select("query_id", (F.col("hit") > 0).alias("unit_hit"), (F.col("hit") / F.col("n")).alias("coverage")), "query_id", "left")
    n, count = F.count("*"), lambda k: F.count(F.when(F.col(k), 1))
    rate = lambda k: F.coalesce(F.try_divide(count(k), n), F.lit(0.0))
    total = each.agg(
        n.alias("questions"), count("cluster_hit").alias("cluster_hits"), rate("cluster_hit").alias("cluster_hit_rate"),
        count("unit_hit").alias("unit_hits"), rate("unit_hit").alias("unit_hit_rate"), F.coalesce(F.avg("coverage"), F.lit(0.0)).alias("mean_coverage"),
    )
    return each, total


def run_stats(assigned: DataFrame) -> DataFrame:
    """assigned: group_id, cluster_id (null: failed), is_new. One row: units, groups, clusters, new_clusters, failed."""
    cluster = F.when(F.col("cluster_id").isNotNull(), F.struct("group_id", "cluster_id"))
    return assigned.agg(
        F.count("*").alias("units"), F.count_distinct("group_id").alias("groups"), F.count_distinct(cluster).alias("clusters"),
        F.count(F.when(F.col("is_new"), 1)).alias("new_clusters"), F.count(F.when(F.col("cluster_id").isNull(), 1)).alias("failed"),
    )


def insert_after_hits(hits: DataFrame, members: DataFrame, per_hit: int = 3, share: float = 0.3, most: int = 10, decay: float = 0.7, place: str = "after") -> DataFrame:
    """hits: query_id, doc_id, rank, score, all that a search gave; members: cluster_id, doc_id, seq.

    After each hit come its co-members nearest in time that were not shown yet, per_hit from each cluster, with decay times
    its score; a query gets at most ``most`` of them and at most ``share`` of its number of hits. A hit that was already
    shown as a co-member isn't repeated. query_id, place (from 1), doc_id, score, hit_id (null: itself a hit).
    place="end": co-members that aren't hits come after all hits (a reranker may order them); "score": the same, by score.

    A query's fold has its hits and, of each, as many neighbours as could have been shown before: the cluster's other hits and what was
    added, so its rows are bounded by the search's k.
    """
    near = neighbours(hits.select("query_id", "doc_id"), members, per_hit + most, with_hits=True)
    rows = hits.join(near, ["query_id", "doc_id"], "left").select("query_id", "doc_id", "rank", "score", "cluster_id", "member_id", "nth")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "cluster_id", "nth"])
        budget = min(most, int(rows["rank"].nunique() * share))
        shown, added = set() if place == "after" else set(rows["doc_id"]), 0
        hits_out, more = [], []
        if place == "after":
            more = hits_out  # one list: co-members stand behind their hit
        for (_, hit, score), own in rows.groupby(["rank", "doc_id", "score"], sort=False):
            if place != "after" or hit not in shown:
                shown.add(hit)
                hits_out.append((hit, score, None))
            for _, cluster in own.dropna(subset=["member_id"]).groupby("cluster_id", sort=False):
                new = [m for m in cluster["member_id"].astype(own["doc_id"].dtype) if m not in shown][:per_hit]
                for m in new[: budget - added]:
                    shown.add(m)
                    more.append((m, score * decay, hit))
                    added += 1
        out = hits_out if place == "after" else hits_out + more
        if place == "score":
            out.sort(key=lambda x: -x[1])
        found = pd.DataFrame(out, columns=["doc_id", "score", "hit_id"], dtype=object)
        return found.assign(query_id=rows["query_id"].iloc[0], place=range(1, len(out) + 1))[["query_id", "place", "doc_id", "score", "hit_id"]]

    kinds = {f.name: f.dataType.simpleString() for f in hits.schema}
    return rows.groupBy("query_id").applyInPandas(fold, f"query_id {kinds['query_id']}, place long, doc_id {kinds['doc_id']}, score double, hit_id {kinds['doc_id']}")


def rerank_by_cluster(hits: DataFrame, members: DataFrame, most_clusters: int = 3, each: int = 15, most: int = 30, originals: int = 10, total: int = 40, choices: DataFrame | None = None) -> DataFrame:
    """hits: query_id, doc_id, rank, score; members: cluster_id, doc_id, seq; choices: query_id, cluster_ids (a model's, in order), relevant
    (false: it said that none is). A query's chosen clusters that have a hit, the first ones, or, where it chose none of those, its
    clusters with most hits (ties: the one hit first), their members in order of time, ``each`` at most and ``most`` in all, none twice, score 1 less 0.1 for each
    cluster before; then hits not among them with 0.8 times their score, up to ``originals`` and ``total``. Queries of which no
    hit is in a cluster, or of which the model said that none is relevant, keep their hits. query_id, place, doc_id, score, cluster_id (null: a hit).

    A fold sees of each cluster only the first members that could be taken, so a query's rows are bounded by the parameters and its hits.
    """
    found = hits.join(members.select("cluster_id", "doc_id"), "doc_id").groupBy("query_id", "cluster_id").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "first", "cluster_id"))
    best = found.withColumn("pos", nth).filter(F.col("pos") <= most_clusters).select("query_id", "cluster_id", "pos")
    if choices is None:
        chosen = best
    else:
        said = choices.filter(F.coalesce("relevant", F.lit(True))).select("query_id", F.posexplode("cluster_ids").alias("at", "cluster_id"))
        said = said.join(found.select("query_id", "cluster_id"), ["query_id", "cluster_id"]).groupBy("query_id", "cluster_id").agg(F.min("at").alias("at"))
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy("at"))
        said = written(said.withColumn("pos", nth).filter(F.col("pos") <= most_clusters).select("query_id", "cluster_id", "pos"))
        none = choices.filter(~F.coalesce("relevant", F.lit(True))).select("query_id")
        chosen = said.unionByName(best.join(said.select("query_id"), "query_id", "left_anti").join(none, "query_id", "left_anti"))
    early = F.row_number().over(Window.partitionBy("cluster_id").orderBy("seq", "doc_id"))
    firsts = members.withColumn("at", early).filter(F.col("at") <= each + most).select("cluster_id", "doc_id", "at")
    rows = chosen.join(firsts, "cluster_id").select("query_id", "pos", "at", "doc_id", F.lit(None).cast("double").alias("score"), "cluster_id")
    own = hits.select("query_id", F.lit(most_clusters + 1).alias("pos"), F.col("rank").alias("at"), "doc_id", "score", F.lit(None).cast(members.schema["cluster_id"].dataType).alias("cluster_id"))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        clustered = rows["pos"].min() <= most_clusters
        for pos, part in rows.sort_values(["pos", "at"]).groupby("pos"):
            ours = pos <= most_clusters
            room = min(each, most - len(out)) if ours else min(originals, total - len(out)) if clustered else len(part)
            part = part[~part["doc_id"].isin(taken)].head(max(room, 0))
            taken.update(part["doc_id"])
            scores = [1 - 0.1 * (pos - 1)] * len(part) if ours else part["score"] * (0.8 if clustered else 1.0)
            out += zip(part["doc_id"], scores, [c if ours else None for c in part["cluster_id"]], strict=True)
        done = pd.DataFrame(out, columns=["doc_id", "score", "cluster_id"], dtype=object)
        return done.assign(query_id=rows["query_id"].iloc[0], place=range(1, len(out) + 1))[["query_id", "place", "doc_id", "score", "cluster_id"]]

    kinds = {f.name: f.dataType.simpleString() for f in [*hits.schema, *members.schema]}
    return rows.unionByName(own).groupBy("query_id").applyInPandas(fold, f"query_id {kinds['query_id']}, place long, doc_id {kinds['doc_id']}, score double, cluster_id {kinds['cluster_id']}")


#: Named strategies: hits and members to ordered documents (query_id, place, doc_id, score).
STRATEGIES = {
    "agentic_only": lambda hits, members: hits.select("query_id", F.col("rank").cast("long").alias("place"), "doc_id", "score"),
    "gec_insert_after_hit": lambda hits, members: insert_after_hits(hits, members).select("query_id", "place", "doc_id", "score"),
    "gec_cluster_rerank": lambda hits, members: rerank_by_cluster(hits, members).select("query_id", "place", "doc_id", "score"),
}


def by_strategy(hits: DataFrame, members: DataFrame, routed: DataFrame) -> DataFrame:
    """Each query's hits as its strategy orders them. routed: query_id, strategy, one row a query."""
    named = hits.join(routed, "query_id")
    parts = [f(named.filter(F.col("strategy") == name).drop("strategy"), members).withColumn("strategy", F.lit(name)) for name, f in STRATEGIES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
