"""Registered queries of writes that replace partitions, index stores, joins with intervals and within ids, rates of evaluation, and streams
over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram import tables as T
from engram.functions import text as X
from engram.operators import clusters, inverted, matching, profiles, rank
from engram.operators.ordered import ranked
from engram.plans.queries import _BM25, _EVENTS, _FUSE, _KNN, _UNITS, _VARIANTS, _VECTORS, _index, _queries, _variants, _vector_queries, query, r6_knn
from engram.plans.scopes import _members
from engram.plans.staged import run_stages
from engram.shared import shared_dir, written
from engram.sources import sinks, streams
from engram.streaming import live

# writes


@query(
    f"""WITH e AS (SELECT event_id, user_id, event_type, at, value FROM {_EVENTS}), a AS (SELECT * FROM e WHERE coalesce(user_id = 3, FALSE)), b AS (SELECT * FROM e WHERE event_id NOT IN (SELECT event_id FROM a) AND at >= 1704672000 AND at < 1704758400),
    c AS (SELECT * FROM e WHERE event_id NOT IN (SELECT event_id FROM a) AND event_id NOT IN (SELECT event_id FROM b) AND event_type = 'click' AND value > 90 AND user_id <= 20)
    SELECT 1 AS step, count(*) AS deleted, count(DISTINCT event_type) AS partitions, (SELECT count(*) FROM e) - count(*) AS left_rows FROM a UNION ALL SELECT 2, count(*), count(DISTINCT event_type), (SELECT count(*) FROM e) - (SELECT count(*) FROM a) - count(*) FROM b
    UNION ALL SELECT 3, count(*), count(DISTINCT event_type), (SELECT count(*) FROM e) - (SELECT count(*) FROM a) - (SELECT count(*) FROM b) - count(*) FROM c"""
)
def f7_deletions(spark, sf):
    """A kept table, a partition for each type, that loses a user's rows, those of a time range, and those of several filters: how many went,
    from how many partitions, and how many are left."""
    path, by = shared_dir(spark), ["event_type"]
    n = sinks.replace(T.behaviors(spark, sf).select("event_id", "user_id", "event_type", "at", "value"), path, by)
    of = F.col
    forms = [[of("user_id") == 3], [of("at") >= 1_704_672_000, of("at") < 1_704_758_400], [of("event_type") == "click", of("value") > 90, of("user_id") <= 20]]
    done = []
    for conditions in forms:
        gone = sinks.delete(spark, path, by, *conditions)
        n -= gone.deleted
        done.append((gone.deleted, gone.partitions, n))
    left = spark.read.parquet(path).agg(F.count("*").alias("n"))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(d).cast("long").alias("deleted"), F.lit(p).cast("long").alias("partitions"), F.lit(k).cast("long").alias("kept")) for i, (d, p, k) in enumerate(done, 1)]))
    rows = left.select("n", steps.alias("s")).select("s.*", "n")
    return rows.select("step", "deleted", "partitions", F.when(F.col("step") == len(done), F.col("n")).otherwise(F.col("kept")).alias("left_rows"))


@query(f"SELECT unit_id, group_id, coalesce(lang, '') AS lang, CASE WHEN group_id IN ('src1', 'src2') THEN 2 ELSE 1 END AS run, coalesce(nullif(substr(narrative, 1, 100), ''), summary) AS label FROM {_UNITS}")
def s10_synced_rows(spark, sf):
    """Index rows written by group, then two groups again: their partitions are replaced, the others stay, and doing it twice changes nothing."""
    label = F.coalesce(F.nullif(F.substring("narrative", 1, 100), F.lit("")), F.col("summary"))
    rows = T.memunits(spark, sf).select("unit_id", "group_id", F.coalesce("lang", F.lit("")).alias("lang"), label.alias("label"))
    path = shared_dir(spark)
    sinks.replace(rows.withColumn("run", F.lit(1)), path, ["group_id"])
    for _ in range(2):
        sinks.replace(rows.filter(F.col("group_id").isin("src1", "src2")).withColumn("run", F.lit(2)), path, ["group_id"])
    return spark.read.parquet(path).select("unit_id", "group_id", "lang", "run", "label")


@query(
    """SELECT 'append' AS mode, source AS group_id, 2 * count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'overwrite', source, count(*) FROM documents WHERE text IS NOT NULL GROUP BY 2"""
)
def s14_export_modes(spark, sf):
    """The same export twice: appended it is there twice, overwritten once."""
    d = T.read(spark, sf, "documents").filter("text is not null").select("doc_id", F.col("source").alias("group_id"), F.md5("text").alias("text_md5"))
    modes = {"append": sinks.append, "overwrite": sinks.replace}
    out = []
    for mode, put in modes.items():
        path = shared_dir(spark)
        for _ in range(2):
            put(d, path, ["group_id"])
        out.append(spark.read.parquet(path).groupBy("group_id").agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "group_id", "n"))
    return out[0].unionByName(out[1])


@query("SELECT vec_id % 7 AS conv_id, vec_id % 7 <> 3 AS there, CASE WHEN vec_id % 7 <> 3 THEN count(DISTINCT label) END AS clusters, CASE WHEN vec_id % 7 <> 3 THEN count(*) END AS members FROM embeddings GROUP BY 1")
def s7_cluster_store(spark, sf):
    """Indexes saved, one saved again and one deleted; then what is there of each conversation."""
    e = T.read(spark, sf, "embeddings").select((F.col("vec_id") % 7).alias("conv_id"), F.col("label").cast("long").alias("cluster_id"), F.concat(F.lit("t"), "label").alias("topic"), F.col("vec_id").alias("unit_id"), F.col("vec_id").alias("at"))
    store = sinks.ClusterStore(spark, shared_dir(spark))
    store.save(e)
    store.save(e.filter("conv_id = 2"))
    store.delete(3)
    found = store.load().groupBy("conv_id").agg(F.count_distinct("cluster_id").alias("clusters"), F.count("*").alias("members"))
    return e.select("conv_id").distinct().join(store.conversations().withColumn("there", F.lit(True)), "conv_id", "left").join(found, "conv_id", "left").select("conv_id", F.coalesce("there", F.lit(False)).alias("there"), "clusters", "members")


@query("SELECT CASE vec_id % 3 WHEN 0 THEN 'event_log' ELSE 'semantic' END AS kind, vec_id, vec_id // 4 AS doc_id, len(embedding)::BIGINT AS width FROM embeddings WHERE vec_id % 7 NOT IN (3, 5) AND vec_id // 4 IN (SELECT doc_id FROM labels)")
def s16_fan_out(spark, sf):
    """Children of two kinds, each to its sink: those without a saved parent or without an embedding go."""
    e = T.vectors(spark, sf).withColumn("doc_id", F.expr("vec_id div 4"))
    part = F.col("vec_id") % 7
    embedding = F.when(part == 3, F.lit(None)).when(part == 5, F.array().cast("array<double>")).otherwise(F.col("vector"))
    kind = F.when(F.col("vec_id") % 3 == 0, "event_log").otherwise("semantic")
    saved = T.read(spark, sf, "labels").select("doc_id")
    out = sinks.fan_out(e.select("vec_id", "doc_id", kind.alias("kind"), embedding.alias("embedding")), saved, "doc_id", ["event_log", "semantic"])
    rows = [df.select(F.lit(k).alias("kind"), "vec_id", "doc_id", F.size("embedding").cast("long").alias("width")) for k, df in out.items()]
    return rows[0].unionByName(rows[1])


@query(
    f"""WITH n AS (SELECT label, vec_id, len(vector) AS dim, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 100 AS chunk FROM {_VECTORS})
    SELECT label::BIGINT AS cluster_id, chunk, '[' || string_agg('{{"unit":' || vec_id || ',"dim":' || dim || '}}', ',' ORDER BY vec_id) || ']' AS content FROM n GROUP BY 1, 2"""
)
def c2_chunks(spark, sf):
    """Each cluster's assignments in numbered chunks of a hundred."""
    rows = T.vectors(spark, sf).select(F.col("label").cast("long").alias("cluster_id"), F.col("vec_id").alias("unit"), F.size("vector").alias("dim"))
    return sinks.in_chunks(rows, "cluster_id", ["unit"], ["unit", "dim"], 100)


# joins


@query(
    """SELECT e.event_id, p.user_id FROM (SELECT event_id, epoch_us(ts) // 1000000 AS at FROM events) e
    JOIN (SELECT user_id, epoch_us(min(ts)) // 1000000 AS a, CASE WHEN user_id % 50 = 0 THEN NULL ELSE epoch_us(min(ts)) // 1000000 + 900 END AS b FROM events WHERE user_id % 2 = 0 GROUP BY user_id) p ON e.at >= p.a AND (p.b IS NULL OR e.at <= p.b)"""
)
def j9_interval_pairs(spark, sf):
    """Which users' first quarters of an hour hold each event; some have no end."""
    e = T.behaviors(spark, sf)
    first = e.filter("user_id % 2 = 0").groupBy("user_id").agg(F.min("at").alias("a"))
    p = first.select(F.col("user_id").alias("interval_id"), "a", F.when(F.col("user_id") % 50 != 0, F.col("a") + 900).alias("b"))
    return matching.interval_pairs(e.select(F.col("event_id").alias("id"), "at"), p).select(F.col("id").alias("event_id"), F.col("interval_id").alias("user_id"))


@query(
    """WITH e AS (SELECT DISTINCT substr(text, (1 + doc_id % 90)::INT, (1 + doc_id % 60)::INT) AS evidence_id FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0), u AS (SELECT DISTINCT substr(text, 1, 2000) AS unit_id FROM documents WHERE text IS NOT NULL),
    p AS (SELECT evidence_id, unit_id FROM e JOIN u ON contains(unit_id, evidence_id) OR contains(evidence_id, unit_id) WHERE evidence_id <> '')
    SELECT md5(evidence_id) AS evidence_md5, md5(CASE WHEN bool_or(unit_id = evidence_id) THEN evidence_id ELSE min(unit_id) END) AS unit_md5, CASE WHEN bool_or(unit_id = evidence_id) THEN 'equal' ELSE 'contained' END AS how FROM p GROUP BY evidence_id"""
)
def j4_long_ids(spark, sf):
    """Ids of 1 to 2,000 characters, pieces of texts and texts."""
    d = T.read(spark, sf, "documents").filter("text is not null")
    piece = F.substring("text", (1 + F.col("doc_id") % 90).cast("int"), (1 + F.col("doc_id") % 60).cast("int"))
    found = matching.containing(d.filter("doc_id % 3 = 0").select(piece.alias("evidence_id")), d.select(F.substring("text", 1, 2000).alias("unit_id")))
    return found.select(F.md5("evidence_id").alias("evidence_md5"), F.md5("unit_id").alias("unit_md5"), "how")


# aggregates of indexes and evaluation


@query(
    """WITH m AS (SELECT DISTINCT l_suppkey AS c, l_orderkey AS u FROM lineitem), s AS (SELECT c, count(*) AS n FROM m GROUP BY 1), k AS (SELECT u, count(*) AS k FROM m GROUP BY 1)
    SELECT count(*) AS clusters, avg(n) AS mean, max(n) AS largest, min(n) AS smallest, count(*) FILTER (n = 1) AS singletons, (SELECT count(*) FROM k) AS units, (SELECT count(*) FROM k WHERE k > 1) AS multi_cluster_units FROM s"""
)
def a6_index_stats(spark, sf):
    """Orders in the clusters of their suppliers: most are in several."""
    return clusters.index_stats(T.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cluster_id"), F.col("l_orderkey").alias("unit_id")))


@query(
    """WITH q AS (SELECT l_suppkey AS conv_id, coalesce(l_linenumber::VARCHAR, 'unknown') AS category, ((l_returnflag <> 'R')::INT + (l_linestatus = 'O')::INT + (l_tax < 0.05)::INT >= 2)::INT AS ok FROM lineitem)
    SELECT conv_id, category, count(*) AS n, sum(ok)::BIGINT AS correct, round(avg(ok), 6) AS accuracy FROM q GROUP BY GROUPING SETS ((), (conv_id), (category))"""
)
def a15_majority(spark, sf):
    """Correct by two of three judgements, over all, by conversation and by category."""
    runs = F.create_map(F.lit("judgment_1"), F.col("l_returnflag") != "R", F.lit("judgment_2"), F.col("l_linestatus") == "O", F.lit("judgment_3"), F.col("l_tax") < 0.05)
    rows = profiles.majority_roll_up(T.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("conv_id"), F.col("l_linenumber").alias("category"), runs.alias("judgments")))
    return rows.select("conv_id", "category", "n", "correct", F.round("accuracy", 6).alias("accuracy"))


_SELECTED = f"""h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_KNN})) WHERE rank <= 20),
    f AS (SELECT query_id, label AS cluster_id, doc_id AS unit_id FROM h JOIN embeddings ON vec_id = doc_id WHERE rank <= 5),
    u AS (SELECT vec_id AS query_id, unnest([vec_id + 1, vec_id + 2, vec_id + 3]) AS unit_id FROM embeddings WHERE vec_id % 20 = 0 AND vec_id % 60 > 0),
    c AS (SELECT DISTINCT query_id, label AS cluster_id FROM u JOIN embeddings ON vec_id = unit_id)"""


def _selection(spark, sf):
    e = T.read(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cluster_id"))
    of = e.select(F.col("vec_id").alias("unit_id"), "cluster_id")
    found = r6_knn(spark, sf).filter("rank <= 5").select("query_id", F.col("doc_id").alias("unit_id")).join(of, "unit_id")
    q = F.col("vec_id")
    asked = e.filter("vec_id % 20 = 0").select(q.alias("query_id"))
    units = e.filter("vec_id % 20 = 0 and vec_id % 60 > 0").select(q.alias("query_id"), F.explode(F.array(q + 1, q + 2, q + 3)).alias("unit_id"))
    return clusters.selection_quality(found, units.join(of, "unit_id"), units, asked)


@query(
    f"""WITH {_SELECTED} SELECT q.vec_id AS query_id, CASE WHEN count(c.cluster_id) > 0 THEN bool_or(c.cluster_id IN (SELECT cluster_id FROM f WHERE f.query_id = q.vec_id)) END AS cluster_hit,
    any_value(k.hit) > 0 AS unit_hit, round(any_value(k.hit) / 3, 6) AS coverage FROM embeddings q LEFT JOIN c ON c.query_id = q.vec_id
    LEFT JOIN (SELECT query_id, count(f.unit_id) AS hit FROM u LEFT JOIN f USING (query_id, unit_id) GROUP BY 1) k ON k.query_id = q.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1"""
)
def a16_selection(spark, sf):
    """Of each question whether the clusters and units that were selected are right, and the share of the right units; null without truth."""
    return _selection(spark, sf)[0].select("query_id", "cluster_hit", "unit_hit", F.round("coverage", 6).alias("coverage"))


@query(
    f"""WITH {_SELECTED}, e AS (SELECT q.vec_id AS query_id, CASE WHEN count(c.cluster_id) > 0 THEN bool_or(c.cluster_id IN (SELECT cluster_id FROM f WHERE f.query_id = q.vec_id)) END AS ch, any_value(k.hit) AS hit
    FROM embeddings q LEFT JOIN c ON c.query_id = q.vec_id LEFT JOIN (SELECT query_id, count(f.unit_id) AS hit FROM u LEFT JOIN f USING (query_id, unit_id) GROUP BY 1) k ON k.query_id = q.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1)
    SELECT count(*) AS questions, count(*) FILTER (ch) AS cluster_hits, round(count(*) FILTER (ch) / count(*), 6) AS cluster_hit_rate, count(*) FILTER (hit > 0) AS unit_hits, round(count(*) FILTER (hit > 0) / count(*), 6) AS unit_hit_rate, round(avg(hit / 3), 6) AS mean_coverage FROM e"""
)
def a16_rates(spark, sf):
    """The rates over all questions, and the mean of the coverages that are known."""
    rates = ["cluster_hit_rate", "unit_hit_rate", "mean_coverage"]
    return _selection(spark, sf)[1].withColumns({c: F.round(c, 6) for c in rates})


@query(
    f"""WITH t AS (SELECT count(*) AS total FROM embeddings), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_KNN})) WHERE rank <= 20)
    SELECT query_id, total, count(DISTINCT doc_id) AS scored, count(DISTINCT CASE WHEN rank <= 10 OR doc_id % 2 = 0 THEN doc_id END) AS reranked, round(100 * count(DISTINCT CASE WHEN rank <= 10 OR doc_id % 2 = 0 THEN doc_id END) / total, 1) AS coverage_percent FROM h, t GROUP BY 1, 2"""
)
def a19_rerank_coverage(spark, sf):
    """Of each search how many units were scored and reranked, and the share of all units that was reranked."""
    total = T.read(spark, sf, "embeddings").agg(F.count("*").alias("total"))
    again = F.when((F.col("rank") <= 10) | (F.col("doc_id") % 2 == 0), F.col("doc_id"))
    each = r6_knn(spark, sf).groupBy("query_id").agg(F.count_distinct("doc_id").alias("scored"), F.count_distinct(again).alias("reranked")).join(F.broadcast(total))  # one row
    return each.select("query_id", "total", "scored", "reranked", F.round(100 * F.col("reranked") / F.col("total"), 1).alias("coverage_percent"))


# clusters and profiles


@query(
    f"""WITH m AS (SELECT vec_id % 2 AS conv_id, vec_id % 46 // 2 + 1 AS no, vec_id AS unit_id, strftime(to_timestamp(1704067200 + vec_id * 3600) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS at, md5(subject) AS summary FROM embeddings JOIN {_UNITS} ON vec_id = unit_id),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, no ORDER BY unit_id DESC) AS nth FROM m),
    b AS (SELECT conv_id, no, chr(10) || '### Cluster gec_' || no || chr(10) || '- Topic: t' || no || chr(10) || '- Members (' || count(*) || ' total):' || chr(10) || string_agg(CASE WHEN nth <= 3 THEN '  - [' || at || '] ' || summary END, chr(10) ORDER BY nth DESC) AS block FROM n GROUP BY 1, 2)
    SELECT conv_id, string_agg(CASE WHEN no <= 20 THEN block END, chr(10) ORDER BY no) || CASE WHEN count(*) > 20 THEN chr(10) || chr(10) || '... and ' || (count(*) - 20) || ' more clusters' ELSE '' END AS preview FROM b GROUP BY 1"""
)
def c6_assignment_previews(spark, sf):
    """What a model is shown that assigns a unit: twenty clusters, the last three members of each."""
    v = F.col("vec_id")
    e = T.read(spark, sf, "embeddings").select((v % 2).alias("conv_id"), (F.floor(v % 46 / 2) + 1).alias("no"), v.alias("unit_id"), F.timestamp_seconds(F.lit(1_704_067_200) + v * 3600).alias("at"))
    rows = e.join(T.memunits(spark, sf).select("unit_id", F.md5("subject").alias("summary")), "unit_id")
    no = F.col("no")
    return clusters.assignment_previews(rows.select("conv_id", "no", F.concat(F.lit("gec_"), no).alias("cluster_id"), F.concat(F.lit("t"), no).alias("topic"), "at", "summary"))


_ROLES = "CASE l_linenumber WHEN 1 THEN 'coordinator' WHEN 2 THEN 'opinion_leader' WHEN 3 THEN 'joker' ELSE 'decision_maker' END"


@query(
    f"""WITH r AS (SELECT l_suppkey AS user_id, {_ROLES} AS role, l_orderkey AS unit, l_linestatus = 'F' AS old, l_returnflag = 'R' AS strong FROM lineitem WHERE role <> 'joker' AND NOT (l_linestatus = 'O' AND l_suppkey % 5 = 0)),
    s AS (SELECT role, user_id, CASE WHEN bool_or(strong) THEN 'strong' ELSE 'weak' END AS confidence FROM r GROUP BY 1, 2 HAVING bool_or(NOT old)),
    f AS (SELECT role, user_id, unit, min(CASE WHEN old THEN 0 ELSE 1 END) AS part FROM r WHERE old OR user_id % 3 <> unit % 3 GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY role, user_id ORDER BY part DESC, unit DESC) AS nth FROM f)
    SELECT role, user_id, confidence, md5(coalesce(string_agg(unit::VARCHAR, ',' ORDER BY nth DESC) FILTER (nth <= 50), '')) AS evidences_md5 FROM s LEFT JOIN k USING (role, user_id) GROUP BY 1, 2, 3"""
)
def p11_role_evidences(spark, sf):
    """History (lines of one status) stays as it is; of new findings only those in whose unit the user takes part; and only roles that the new
    findings name."""
    l = T.read(spark, sf, "lineitem").filter("not (l_linestatus = 'O' and l_suppkey % 5 = 0)")
    confidence = F.when(F.col("l_returnflag") == "R", "strong").otherwise("weak")
    rows = l.select(F.expr(_ROLES).alias("role"), F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("evidence"), confidence.alias("confidence"), F.col("l_linestatus").alias("status"))
    units = rows.filter("user_id % 3 <> evidence % 3").select("evidence", "user_id", F.col("evidence").alias("at")).distinct()
    found = profiles.role_evidences(rows.filter("status = 'F'").withColumn("pos", F.col("evidence")), rows.filter("status = 'O'"), units)
    return found.select("role", "user_id", "confidence", F.md5(F.array_join("evidences", ",")).alias("evidences_md5"))


# retrieval


@query(
    f"""WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_KNN})) WHERE rank <= 20),
    g AS (SELECT query_id, label, count(*) AS n, min(rank) AS f FROM h JOIN embeddings ON vec_id = doc_id GROUP BY 1, 2), a AS (SELECT DISTINCT query_id, query_id // 20 % 4 AS kind FROM h),
    w AS (SELECT query_id, generate_subscripts(ids, 1) AS at, unnest(ids) AS label FROM (SELECT query_id, [(query_id // 20 + 3) % 10, 77, query_id // 20 % 10, (query_id // 20 + 3) % 10] AS ids FROM a WHERE kind < 2)),
    s AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY min(at)) AS pos FROM w JOIN g USING (query_id, label) GROUP BY 1, 2),
    c AS (SELECT * FROM s WHERE pos <= 3 UNION ALL SELECT query_id, label, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, f, label) AS pos FROM g) JOIN a USING (query_id) WHERE pos <= 3 AND kind <> 2 AND query_id NOT IN (SELECT query_id FROM s)),
    m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, doc_id) AS place FROM (SELECT query_id, pos, label, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id, label ORDER BY vec_id) AS nth FROM c JOIN embeddings USING (label)) WHERE nth <= 15) WHERE place <= 30),
    o AS (SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth, (SELECT count(*) FROM m WHERE m.query_id = h.query_id) AS had FROM h WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.query_id = h.query_id AND m.doc_id = h.doc_id)) WHERE had = 0 OR nth <= least(10, 40 - had))
    SELECT query_id, place, doc_id, round(1 - 0.1 * (pos - 1), 6)::DOUBLE AS score, label::BIGINT AS cluster_id FROM m UNION ALL SELECT query_id, had + nth, doc_id, round(score * CASE WHEN had = 0 THEN 1 ELSE 0.8::DOUBLE END, 6), NULL FROM o"""
)
def r21_chosen_clusters(spark, sf):
    """Clusters that a model chose, some of them unknown or named twice; where it chose none those with most hits; where it said that none is
    relevant the hits as they are."""
    no = F.expr("query_id div 20")
    chosen = F.array((no + 3) % 10, F.lit(77).cast("long"), no % 10, (no + 3) % 10)
    choices = _vector_queries(spark, sf).select("query_id", F.when(no % 4 < 2, chosen).otherwise(F.array().cast("array<bigint>")).alias("cluster_ids"), (no % 4 != 2).alias("relevant"))
    found = clusters.rerank_by_cluster(r6_knn(spark, sf), _members(spark, sf), choices=choices)
    return found.select("query_id", "place", "doc_id", F.round("score", 6).alias("score"), "cluster_id")


@query(
    _BM25.replace("{field}", "narrative").replace("FROM benchmark)", f"FROM {_VARIANTS})")
    + f""", v AS (SELECT item_id AS query_id, vector AS qvector FROM {_VARIANTS} JOIN {_VECTORS} ON vec_id = item_id),
    near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_KNN.partition(" FROM ")[0]} FROM v, {_VECTORS})),
    b AS (SELECT query_id, 0 AS list_no, doc_id, rank, score FROM hits WHERE rank <= 50 UNION ALL SELECT query_id, 1, doc_id, rank, score FROM near WHERE rank <= 50),
    o1 AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, max(score) AS own, min(rank) AS first FROM b GROUP BY 1, 2), n1 AS (SELECT query_id, count(DISTINCT list_no) AS sides FROM b GROUP BY 1),
    w1 AS (SELECT query_id, doc_id, CASE WHEN sides = 1 THEN own ELSE rrf END AS score, CASE WHEN sides = 1 THEN -first ELSE rrf END AS key FROM o1 JOIN n1 USING (query_id)),
    l AS (SELECT query_id // 4 AS query_id, query_id % 4 AS list_no, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY key DESC, doc_id) AS rank FROM w1) WHERE rank <= 50), """
    + _FUSE
)
def r14_hybrid_variants(spark, sf):
    """Vectors and BM25 for each variant, fused; then the variants of a question. The vector of a variant is the one of its number."""
    asked = _variants(spark, sf)
    words = inverted.bm25(_index(spark, sf), asked, 50).select("query_id", F.lit(0).alias("list_no"), "doc_id", "rank", "score")
    v = T.vectors(spark, sf)
    vectors = asked.join(v, F.col("query_id") == F.col("vec_id")).select("query_id", F.col("vector").alias("qvector"))
    near = rank.knn(vectors, v.select(F.col("vec_id").alias("doc_id"), "vector"), 50).select("query_id", F.lit(1).alias("list_no"), "doc_id", "rank", "score")
    each = written(rank.fused(words.unionByName(near), 50))
    lists = each.select(F.expr("query_id div 4").alias("query_id"), F.pmod("query_id", F.lit(4)).alias("list_no"), "doc_id", "rank", "score")
    return rank.fused(lists, 20).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""WITH d AS (SELECT *, CASE WHEN lang = 'en' THEN list_filter(string_split(narrative, chr(10)), lambda s: trim(s) <> '') END AS facts, CASE WHEN unit_id % 2 = 0 THEN '2024-01-0' || (1 + unit_id % 9) ELSE '' END AS time FROM {_UNITS}),
    t AS (SELECT unit_id, CASE WHEN len(facts) > 0 THEN CASE WHEN time <> '' THEN time || chr(10) ELSE '' END || array_to_string(facts, chr(10)) ELSE nullif(narrative, '') END AS text FROM d),
    h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_KNN})),
    j AS (SELECT h.*, text, CASE WHEN (doc_id + query_id) % 3 <> 0 AND (query_id % 40 = 0 OR doc_id % 5 = 0) THEN (doc_id * 7 % 101)::DOUBLE END AS rs FROM h JOIN t ON doc_id = unit_id WHERE rank <= 20 AND text IS NOT NULL),
    k AS (SELECT *, avg(CASE WHEN rs IS NOT NULL THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY query_id) >= 0.3 AS reranked FROM j)
    SELECT query_id, doc_id, md5(text) AS text_md5, reranked, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN reranked THEN -rs END NULLS LAST, rank) AS new_rank FROM k"""
)
def r15_reranked_texts(spark, sf):
    """The text that a reranker reads of each hit, time and facts or the narrative, and the order that its scores give."""
    u = T.memunits(spark, sf)
    facts = F.when(F.col("lang") == "en", F.filter(F.split("narrative", "\n", -1), lambda s: F.trim(s) != ""))
    time = F.when(F.col("unit_id") % 2 == 0, F.concat(F.lit("2024-01-0"), 1 + F.col("unit_id") % 9)).otherwise("")
    texts = u.select(F.col("unit_id").alias("doc_id"), X.rerank_text(time, facts, F.col("narrative")).alias("text")).filter("text is not null")
    hits = written(r6_knn(spark, sf).join(texts.select("doc_id", F.md5("text").alias("text_md5")), "doc_id"))
    d, q = F.col("doc_id"), F.col("query_id")
    scores = hits.filter(((d + q) % 3 != 0) & ((q % 40 == 0) | (d % 5 == 0))).select("query_id", "doc_id", (d * 7 % 101).cast("double").alias("rerank_score"))
    return rank.rerank(hits, scores).select("query_id", "doc_id", "text_md5", "reranked", F.col("new_rank").cast("long").alias("new_rank"))


def _source_sql(kind: str, which: str) -> str:
    units = _UNITS.replace("FROM documents", f"FROM documents WHERE {which}")
    words = _BM25.replace("{field}", "narrative").replace(_UNITS, units)
    vectors = _KNN.replace(f", {_VECTORS}", f", (SELECT * FROM {_VECTORS} WHERE {which.replace('doc_id', 'vec_id')})").replace("vec_id AS query_id", "vec_id // 20 AS query_id")
    return f"""SELECT '{kind}' AS source, * FROM ({words}, b AS (SELECT query_id, doc_id, score, rank FROM hits WHERE rank <= 50), e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({vectors}) WHERE query_id IN (SELECT item_id FROM benchmark)) WHERE rank <= 50),
    f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM b UNION ALL SELECT query_id, doc_id, rank FROM e) GROUP BY 1, 2)
    SELECT 'bm25' AS mode, query_id, doc_id, score, rank FROM b WHERE rank <= 10 UNION ALL SELECT 'embedding', query_id, doc_id, score, rank FROM e WHERE rank <= 10
    UNION ALL SELECT * FROM (SELECT 'rrf', query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10)"""


_SOURCES = {"episode": "doc_id % 3 = 0", "event_log": "doc_id % 3 = 1", "semantic_memory": "doc_id % 3 = 2"}


@query(" UNION ALL ".join(_source_sql(kind, which) for kind, which in _SOURCES.items()))
def r12_sources(spark, sf):
    """Every mode over every source of data: each source has rows, words and vectors of its own."""
    v, asked, index, out = T.vectors(spark, sf), _queries(spark, sf), _index(spark, sf), None
    vectors = _vector_queries(spark, sf).withColumn("query_id", F.expr("query_id div 20")).join(asked.select("query_id"), "query_id", "left_semi")
    for kind, which in _SOURCES.items():
        own = inverted.within(index, F.expr(which))
        docs = T.memunits(spark, sf).filter(which.replace("doc_id", "unit_id"))
        found = rank.retrieved(asked, vectors, docs, v.filter(which.replace("doc_id", "vec_id")).select(F.col("vec_id").alias("doc_id"), "vector"), 10, search=lambda q, k, own=own: inverted.bm25(own, q, k))
        rows = found.select(F.lit(kind).alias("source"), "mode", "query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))
        out = rows if out is None else out.unionByName(rows)
    return out


_JUDGED = "(SELECT doc_id AS query_id, quality = 1 AS is_sufficient FROM labels)"


@query(
    _BM25.replace("{field}", "narrative").replace("WITH ", "WITH a AS (WITH ", 1)
    + " SELECT query_id, doc_id, rank FROM hits WHERE rank <= 20), b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(list_no * 1000 + rank)) AS rank FROM ("
    + _BM25.replace("{field}", "narrative").replace("FROM benchmark)", f"FROM {_VARIANTS})")
    + f""" SELECT query_id // 4 AS query_id, query_id % 4 AS list_no, doc_id, rank FROM hits WHERE rank <= 50) GROUP BY query_id, doc_id),
    j AS (SELECT i.item_id AS query_id, coalesce(is_sufficient, TRUE) AS enough FROM benchmark i LEFT JOIN {_JUDGED} s ON s.query_id = i.item_id),
    m AS (SELECT query_id, doc_id, 'round1' AS origin, rank FROM a UNION ALL SELECT query_id, doc_id, 'round2', rank FROM b WHERE NOT EXISTS (SELECT 1 FROM a x WHERE x.query_id = b.query_id AND x.doc_id = b.doc_id)),
    c AS (SELECT p.*, l.quality::DOUBLE AS rs FROM (SELECT m.*, row_number() OVER (PARTITION BY m.query_id ORDER BY origin, rank) AS place FROM m JOIN j USING (query_id) WHERE NOT enough) p LEFT JOIN labels l USING (doc_id) WHERE place <= 40),
    d AS (SELECT *, avg(CASE WHEN rs IS NULL THEN 0.0 ELSE 1.0 END) OVER (PARTITION BY query_id) >= 0.3 AS ok FROM c)
    SELECT query_id, doc_id, rank AS place, 1 AS rounds FROM a JOIN j USING (query_id) WHERE enough UNION ALL
    SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN ok THEN -rs END NULLS LAST, place) AS place, 2 AS rounds FROM d) WHERE place <= 20"""
)
def r17_judged_rounds(spark, sf):
    """The judge and the reranker are a table: a question is sufficient as its label says, a document's score is its label, where it has one."""
    q, labels = _queries(spark, sf), T.read(spark, sf, "labels")
    first = written(inverted.bm25(_index(spark, sf), q, 20))
    lists = inverted.bm25(_index(spark, sf), _variants(spark, sf), 50).select(F.expr("query_id div 4").alias("query_id"), F.pmod("query_id", F.lit(4)).alias("list_no"), "doc_id", "rank")
    second = written(rank.in_turn(lists))
    judged = labels.select(F.col("doc_id").alias("query_id"), (F.col("quality") == 1).alias("is_sufficient"))
    both = first.select("query_id", "doc_id").union(second.select("query_id", "doc_id")).distinct()
    return rank.two_rounds(first, second, judged, both.join(labels.select("doc_id", F.col("quality").cast("double").alias("rerank_score")), "doc_id"))


# text


@query("SELECT c_custkey AS id, c_name || '(user_id:' || c_custkey || ') met x' || c_name || ' and ' || n_name || '(user_id:n' || n_nationkey || ')s, @' || c_name || '(user_id:' || c_custkey || ')' AS text FROM customer JOIN nation ON c_nationkey = n_nationkey")
def x12_names(spark, sf):
    """Names without @, at the begin of a word; doing it twice changes nothing."""
    n = T.read(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = T.read(spark, sf, "customer").join(n, "c_nationkey")
    text = F.concat("c_name", F.lit(" met x"), "c_name", F.lit(" and "), "n_name", F.lit("s, @"), "c_name")
    ref = lambda name, i: F.struct(F.col(name).alias("name"), i.alias("user_id"))
    refs = F.array(ref("c_name", F.col("c_custkey").cast("string")), ref("n_name", F.concat(F.lit("n"), "c_nationkey")))
    once = c.withColumn("refs", refs).withColumn("text", X.mentions(text, F.col("refs"), sign=""))
    return once.select(F.col("c_custkey").alias("id"), X.mentions(F.col("text"), F.col("refs"), sign="").alias("text"))


@query(
    f"""WITH t AS (SELECT unit_id, regexp_extract_all(lower(narrative), '[a-z]+')[1:40] AS t FROM {_UNITS}), w AS (SELECT unit_id, t, k FROM t, unnest(range(2, 6)) AS u(k)),
    s AS (SELECT unit_id, k, i, t[i : i + k - 1] AS g FROM w, unnest(range(1, len(t) - k + 2)) AS u(i))
    SELECT unit_id, string_agg(array_to_string(g, ' '), '|' ORDER BY k, i) AS spaced, string_agg(array_to_string(g, ''), '|' ORDER BY k, i) AS joined FROM s GROUP BY 1"""
)
def x21_wide_shingles(spark, sf):
    """Runs of two to five of a text's first forty words, with and without blanks."""
    words = F.slice(F.regexp_extract_all(F.lower("narrative"), F.lit("[a-z]+"), F.lit(0)), 1, 40)
    u = T.memunits(spark, sf).select("unit_id", words.alias("w")).filter("size(w) > 1")
    return u.select("unit_id", F.array_join(X.all_shingles(F.col("w")), "|").alias("spaced"), F.array_join(X.all_shingles(F.col("w"), separator=""), "|").alias("joined"))


# streams over tables


_READS = "SELECT user_id, event_id, at, (at - 7200) * 1000 AS first, (at - 600) * 1000 AS last FROM {} WHERE event_id % 5 = 0"


@query(
    f"""WITH e AS {_EVENTS}, r AS ({_READS.format(_EVENTS)}) SELECT r.user_id, r.event_id, coalesce(string_agg(e.event_id, ',' ORDER BY e.at, e.event_id), '') AS found
    FROM r LEFT JOIN e ON e.user_id = r.user_id AND e.event_id % 5 > 0 AND epoch_ms(e.ts) BETWEEN greatest(r.first, r.at * 1000 - 2 * 86400000 + 1) AND least(r.last, r.at * 1000) GROUP BY 1, 2"""
)
def k5_window_reads(spark, sf):
    """Every fifth event reads its user's cache of a day: the events of a range of time before it."""
    e = T.behaviors(spark, sf)
    read, ms = F.col("event_id") % 5 == 0, F.timestamp_seconds("at")
    rows = e.select("user_id", "event_id", F.when(read, ms).otherwise(F.col("ts")).alias("ts"), read.alias("is_read"), ((F.col("at") - 7200) * 1000).alias("first"), ((F.col("at") - 600) * 1000).alias("last"))
    return live.cached(rows, "user_id", "1 day").select("user_id", "event_id", F.array_join("found", ",").alias("found"))


@query(
    f"""WITH p AS (SELECT user_id, at // 3600 * 3600 AS pane, count(*) AS n FROM {_EVENTS} GROUP BY 1, 2), w AS (SELECT user_id, pane + 3600 * (k + 1) AS "end", n FROM p, unnest(range(24)) AS u(k))
    SELECT "end", user_id, FALSE AS is_total, sum(n)::BIGINT AS n FROM w GROUP BY 1, 2 UNION ALL SELECT "end", NULL, TRUE, sum(n)::BIGINT FROM w GROUP BY 1"""
)
def k7_sliding_counts(spark, sf):
    """Events of each user, and of all, in the day up to the end of every hour."""
    return live.throughput(T.behaviors(spark, sf), "user_id", pane="1 hour", width="1 day")


@query(f"SELECT at // 86400 * 86400 AS start, user_id, count(*) AS n FROM {_EVENTS} GROUP BY 1, 2")
def k11_corrected_counts(spark, sf):
    """Counts a day by a sink that gets the events in six batches, far out of order: each batch after the first has late rows, whose windows
    are counted anew. A last row, of no user, ends all windows."""
    e = T.behaviors(spark, sf).select("event_id", "user_id", "ts")
    sink = live.WindowCounts(shared_dir(spark), "user_id", late=3600)
    for no in range(6):
        sink.batch(e.filter(F.col("event_id") % 6 == no).select("user_id", "ts"), no)
    end = e.agg(F.max("ts").alias("ts")).select(F.lit(None).cast(dict(e.dtypes)["user_id"]).alias("user_id"), (F.col("ts") + F.expr("interval 9 days")).alias("ts"))
    sink.batch(end, 6)
    return sink.counts(spark).filter("user_id is not null")


@query(f"SELECT label::BIGINT AS group_id, vec_id AS unit_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM {_VECTORS}")
def s18_places(spark, sf):
    """The place of each unit in its group, however large that is."""
    v = T.read(spark, sf, "embeddings").select(F.col("label").cast("long").alias("group_id"), F.col("vec_id").alias("unit_id"))
    return ranked(v, ["group_id"], ["unit_id"], "place")


@query("SELECT user_id::VARCHAR AS group_id, event_id::VARCHAR AS message_id, event_type AS content FROM events WHERE user_id IS NOT NULL")
def s9_messages_once(spark, sf):
    """A stream of message files of which each arrives twice: every message once."""
    e = T.behaviors(spark, sf).filter("user_id is not null")
    told = e.select(F.col("user_id").cast("string").alias("group_id"), F.col("event_id").cast("string").alias("message_id"), F.lit("x").alias("sender"), F.col("event_type").alias("content"), "ts")
    folder, out = shared_dir(spark), shared_dir(spark)
    for _ in range(2):
        told.write.mode("append").json(f"{folder}/in")
    stream = streams.once_each(streams.from_files(spark, f"{folder}/in", 4), "400 days").select("group_id", "message_id", "content")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("group_id string, message_id string, content string").parquet(out)


@query("SELECT d.source, count(*) AS n, sum(l.quality)::BIGINT AS correct FROM documents d JOIN labels l USING (doc_id) WHERE d.source IS NOT NULL GROUP BY 1")
def e4_staged_run(spark, sf):
    """Add, search, evaluate as stages with a table each; a second run finds all of them done."""
    folder = shared_dir(spark)
    stages = [
        ("add", lambda t: T.read(spark, sf, "documents").filter("source is not null").select("doc_id", "source")),
        ("answer", lambda t: t["add"].join(T.read(spark, sf, "labels").select("doc_id", "quality"), "doc_id")),
        ("evaluate", lambda t: t["answer"].groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("correct"))),
    ]
    run_stages(spark, folder, stages)
    return run_stages(spark, folder, stages)["evaluate"]


@query()
def k10_live_clusters(spark, sf):
    """The vectors as a stream, each with the cluster that it joins and the version of the cluster's profile after it; tested against the
    batch form. Two rows of no group, long after all others, end the wait of the last."""
    at = lambda s: F.timestamp_seconds(F.lit(1_704_067_200) + s)
    v = T.vectors(spark, sf).select(F.col("label").cast("long").alias("group_id"), F.col("vec_id").alias("event_id"), at(F.col("vec_id") * 3600).alias("ts"), "vector")
    folder, out, name = shared_dir(spark), shared_dir(spark), "spark.sql.streaming.stateStore.providerClass"
    last = v.agg(F.max("event_id").alias("last"))
    end = lambda days: last.select(F.lit(None).cast("long").alias("group_id"), F.lit(-days).cast("long").alias("event_id"), at(F.coalesce("last", F.lit(0)) * 3600 + days * 86400).alias("ts"), F.lit(None).cast("array<double>").alias("vector"))
    before = spark.conf.get(name)
    live.use_state_store(spark)
    try:
        for rows in (v, end(60), end(120)):  # a run goes on where the one before ended
            rows.write.mode("append").parquet(f"{folder}/in")
            stream = live.clusters(spark.readStream.schema(v.schema).parquet(f"{folder}/in"), "group_id", least=0.3, late="30 days")
            q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set(name, before)
    found = spark.read.schema("group_id long, event_id long, cluster_id string, similarity double, version long").parquet(out)
    return found.filter("group_id is not null")
