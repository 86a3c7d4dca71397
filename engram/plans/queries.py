"""Registered queries over the given tables, each with the DuckDB SQL of the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram import tables as T
from engram.functions import text as X
from engram.operators import clusters, inverted, ivf, matching, profiles, rank
from engram.operators.ordered import ranked
from engram.shared import kept
from engram.streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = re.sub(r"(?<!\) )\bat\b", '"at"', sql)  # a keyword there
        return f

    return add


_UNITS = "(SELECT doc_id AS unit_id, source AS group_id, lang, split_part(coalesce(text, ''), chr(10), 1) AS subject, substr(coalesce(text, ''), 1, 200) AS summary, coalesce(text, '') AS narrative FROM documents)"
_MESSAGES = "(SELECT conv_id, turn, role AS sender, coalesce(text, '') AS content, 1704067200 + conv_id * 3600 + turn * 30 AS at FROM conversations)"
_EVENTS = "(SELECT *, epoch_us(ts) // 1000000 AS at FROM events)"
_VERSIONS = "(SELECT o_custkey AS user_id, ((year(o_orderdate) - 1992) * 12 + month(o_orderdate))::BIGINT AS version, o_orderkey AS order_id, o_orderpriority AS priority, o_totalprice AS price FROM orders)"
_TOKENS = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_-]+'), lambda w: regexp_full_match(w, '\p{{L}}{{2,}}'))"
_COS = "(CASE WHEN list_inner_product({0}, {0}) > 0 AND list_inner_product({1}, {1}) > 0 THEN list_cosine_similarity({0}, {1}) ELSE 0 END)"
_VECTORS = "(SELECT vec_id, label, embedding::DOUBLE[] AS vector FROM embeddings)"

# scans and sinks


@query(f"SELECT conv_id, turn, sender, at, length(content)::BIGINT AS n, max(at) OVER (PARTITION BY conv_id) AS current_at FROM {_MESSAGES}")
def s1_messages(spark, sf):
    m = T.messages(spark, sf)
    return m.select("conv_id", "turn", "sender", "at", F.length("content").cast("long").alias("n"), F.max("at").over(Window.partitionBy("conv_id")).alias("current_at"))


@query("SELECT coalesce(role, '') <> '' AND coalesce(trim(text), '') <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL AS valid, count(*) AS n FROM conversations GROUP BY 1")
def s2_validation(spark, sf):
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return T.read(spark, sf, "conversations").groupBy((filled("role") & filled("text") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).alias("valid")).agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, min(epoch_us(ts) // 1000000) AS start, count(*) AS n FROM events GROUP BY 1, 2),
    t AS (SELECT *, lead(start) OVER (PARTITION BY user_id ORDER BY day) AS nxt FROM s)
    SELECT user_id, start, n, i, start + i * CASE WHEN nxt IS NOT NULL AND n * 30 > 0.9 * (nxt - start) THEN floor(0.9 * (nxt - start) / n)::BIGINT ELSE 30 END AS at FROM t, unnest(range(n)) AS u(i)"""
)
def s3_interpolated_times(spark, sf):
    """Messages of a session get times 30 s apart, or closer if the next session begins too soon."""
    e = T.behaviors(spark, sf)
    s = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("at").alias("start"), F.count("*").alias("n"))
    s = s.withColumn("nxt", F.lead("start").over(Window.partitionBy("user_id").orderBy("day")))
    room = 0.9 * (F.col("nxt") - F.col("start"))
    step = F.when(F.col("nxt").isNotNull() & (F.col("n") * 30 > room), F.floor(room / F.col("n"))).otherwise(F.lit(30)).cast("long")
    s = s.select("user_id", "start", "n", step.alias("step"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    return s.select("user_id", "start", "n", "i", (F.col("start") + F.col("i") * F.col("step")).alias("at"))


@query(f"SELECT event_id, user_id, at FROM {_EVENTS} WHERE user_id = 7 AND at >= 1704067200 AND at < 1705276800 ORDER BY at, event_id LIMIT 1000")
def s8_history_range(spark, sf):
    e = T.behaviors(spark, sf).filter("user_id = 7 and at >= 1704067200 and at < 1705276800")
    return e.select("event_id", "user_id", "at").orderBy("at", "event_id").limit(1000)


@query(f"SELECT unit_id, group_id, concat_ws(' ', subject, summary, substr(narrative, 1, 500)) AS search_content, coalesce(nullif(substr(narrative, 1, 100), ''), summary) AS label FROM {_UNITS}")
def s10_index_rows(spark, sf):
    u = T.memunits(spark, sf)
    head = F.substring("narrative", 1, 500)
    return u.select("unit_id", "group_id", F.concat_ws(" ", "subject", "summary", head).alias("search_content"), F.coalesce(F.nullif(F.substring("narrative", 1, 100), F.lit("")), F.col("summary")).alias("label"))


@query(f"SELECT 'unit' AS kind, count(*) AS n, max(unit_id) AS last_id FROM {_UNITS} UNION ALL SELECT 'fact', count(*), max(vec_id) FROM embeddings UNION ALL SELECT 'behavior', count(*), max(event_id) FROM events")
def s11_counts_by_type(spark, sf):
    u = T.memunits(spark, sf).select(F.lit("unit").alias("kind"), F.col("unit_id").alias("id"))
    rows = u.unionByName(T.vectors(spark, sf).select(F.lit("fact").alias("kind"), F.col("vec_id").alias("id"))).unionByName(T.behaviors(spark, sf).select(F.lit("behavior").alias("kind"), F.col("event_id").alias("id")))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


@query(
    f"""SELECT unit_id, array_to_string(list_filter({_TOKENS.format('narrative')}, lambda w: NOT list_contains({X.STOPWORDS!r}, w)), ' ') AS terms,
    '{{"lang":"' || lang || '","group":"' || group_id || '","chars":' || length(narrative) || '}}' AS detail FROM {_UNITS}"""
)
def s12_search_terms(spark, sf):
    """Search rows: the words without stop words, and the details as JSON."""
    detail = F.to_json(F.struct("lang", F.col("group_id").alias("group"), F.length("narrative").alias("chars")))
    return T.memunits(spark, sf).select("unit_id", F.array_join(X.tokens(F.col("narrative"), X.STOPWORDS), " ").alias("terms"), F.when(F.col("lang").isNotNull() & F.col("group_id").isNotNull(), detail).alias("detail"))



@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def s15_pending(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id").join(T.read(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT l_orderkey AS parent_id, l_linenumber::BIGINT AS fact_no, epoch_us(o_orderdate) // 1000000 AS at, o_custkey AS user_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def s16_children_of_saved_parents(spark, sf):
    parents = T.read(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderdate")
    rows = T.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(parents, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("l_orderkey").alias("parent_id"), F.col("l_linenumber").cast("long").alias("fact_no"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"), F.col("o_custkey").alias("user_id"))


@query("SELECT vec_id, i AS fact_no, round(embedding[i + 1]::DOUBLE, 6) AS x FROM embeddings, unnest(range(len(embedding))) AS u(i)")
def s17_flat_facts(spark, sf):
    e = T.read(spark, sf, "embeddings")
    return e.select("vec_id", F.posexplode("embedding").alias("fact_no", "x")).select("vec_id", F.col("fact_no").cast("long").alias("fact_no"), F.round(F.col("x").cast("double"), 6).alias("x"))


def flat_facts(parents: DataFrame) -> DataFrame:
    """parents: facts and vectors, two lists, and any other columns. Fact i goes with vector i up to the end of the shorter list; the
    parent's other columns are copied. fact_no (from 0), fact, vector and those columns."""
    both = F.least(F.size("facts"), F.size("vectors"))
    zipped = F.arrays_zip(F.slice("facts", 1, both).alias("fact"), F.slice("vectors", 1, both).alias("vector"))
    kept = [c for c in parents.columns if c not in ("facts", "vectors")]
    rows = parents.filter(F.col("facts").isNotNull() & F.col("vectors").isNotNull()).select(*kept, F.posexplode(zipped).alias("fact_no", "z"))
    return rows.select(*kept, F.col("fact_no").cast("long").alias("fact_no"), F.col("z")["fact"].alias("fact"), F.col("z")["vector"].alias("vector"))


@query(
    """WITH v AS (SELECT vec_id // 4 AS doc_id, list({'id': vec_id, 'v': embedding} ORDER BY vec_id) AS vectors FROM embeddings GROUP BY 1),
    p AS (SELECT d.doc_id, source, list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: trim(s) <> '') AS facts, vectors FROM documents d JOIN v ON d.doc_id = v.doc_id)
    SELECT doc_id, source AS group_id, 1704067200 + doc_id * 3600 AS start, i AS fact_no, facts[i + 1] AS fact, vectors[i + 1].id AS vec_id,
    array_to_string(list_transform(vectors[i + 1].v, lambda x: floor(x::DOUBLE * 1000000)::BIGINT), ',') AS millionths FROM p, unnest(range(least(len(facts), len(vectors)))) AS u(i)"""
)
def s17_zipped_facts(spark, sf):
    """A document's lines are its facts, four vectors in a row belong to a document; the whole vectors, in millionths."""
    e = T.vectors(spark, sf).select(F.expr("vec_id div 4").alias("doc_id"), F.struct("vec_id", "vector").alias("v"))
    vectors = e.groupBy("doc_id").agg(F.sort_array(F.collect_list("v")).alias("vectors"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda s: F.trim(s) != "")
    d = T.read(spark, sf, "documents").select("doc_id", F.col("source").alias("group_id"), (F.lit(1_704_067_200) + F.col("doc_id") * 3600).alias("start"), lines.alias("facts"))
    rows = flat_facts(d.join(vectors, "doc_id"))
    millionths = F.array_join(F.transform(F.col("vector.vector"), lambda x: F.floor(x * 1_000_000.0).cast("string")), ",")
    return rows.select("doc_id", "group_id", "start", "fact_no", "fact", F.col("vector.vec_id").alias("vec_id"), millionths.alias("millionths"))


@query(
    """SELECT conv_id, turn, CASE WHEN turn_no <= greatest(floor(0.8 * n), 0) THEN 'history' ELSE 'new' END AS part FROM
    (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"""
)
def s18_history_split(spark, sf):
    c = T.read(spark, sf, "conversations")
    no, n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")), F.count("*").over(Window.partitionBy("conv_id"))
    return c.select("conv_id", "turn", F.when(no <= F.floor(0.8 * n), "history").otherwise("new").alias("part"))


# filters


@query(f"SELECT event_id, at FROM {_EVENTS} WHERE user_id = 3 ORDER BY at DESC, event_id LIMIT 20 OFFSET 10")
def f1_by_user_paged(spark, sf):
    return T.behaviors(spark, sf).filter("user_id = 3").select("event_id", "at").orderBy(F.desc("at"), "event_id").offset(10).limit(20)


@query("SELECT DISTINCT o_orderkey AS order_id FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE (o_custkey = 5 OR l_suppkey = 5) AND o_orderdate >= TIMESTAMP '1993-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def f2_owner_or_participant(spark, sf):
    o, l = T.read(spark, sf, "orders"), T.read(spark, sf, "lineitem")
    parts = l.filter("l_suppkey = 5").select(F.col("l_orderkey").alias("o_orderkey")).unionByName(o.filter("o_custkey = 5").select("o_orderkey")).distinct()
    time = (F.col("o_orderdate") >= F.lit("1993-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    return o.filter(time).join(parts, "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("order_id"))


@query(f"SELECT unit_id FROM {_UNITS} WHERE group_id = 'src3'")
def f3_by_group(spark, sf):
    return T.memunits(spark, sf).filter("group_id = 'src3'").select("unit_id")


@query(f"SELECT event_id, user_id, at FROM {_EVENTS} WHERE at >= 1704672000 AND at < 1705276800")
def f4_time_range(spark, sf):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    rows = T.read(spark, sf, "events").filter((F.col("ts") >= ts("2024-01-08")) & (F.col("ts") < ts("2024-01-15")))
    return rows.select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))


@query(f"SELECT unit_id, list_contains(t, 'the') OR list_contains(t, 'la') AS any_word, list_contains(t, 'the') AND list_contains(t, 'of') AS all_words FROM (SELECT unit_id, {_TOKENS.format('narrative')} AS t FROM {_UNITS}) WHERE any_word OR all_words")
def f5_array_match(spark, sf):
    u = T.memunits(spark, sf).select("unit_id", X.tokens(F.col("narrative")).alias("t"))
    asked = lambda *w: F.array(*map(F.lit, w))
    u = u.select("unit_id", F.arrays_overlap("t", asked("the", "la")).alias("any_word"), (F.size(F.array_except(asked("the", "of"), F.col("t"))) == 0).alias("all_words"))
    return u.filter("any_word or all_words")


@query("SELECT count(*) AS kept, (SELECT count(*) FROM events WHERE user_id = 3) AS deleted FROM events WHERE NOT coalesce(user_id = 3, FALSE)")
def f7_delete_by_user(spark, sf):
    e = T.read(spark, sf, "events")
    gone = F.coalesce(F.col("user_id") == 3, F.lit(False))
    return e.agg(F.count(F.when(~gone, 1)).alias("kept"), F.count(F.when(gone, 1)).alias("deleted"))


@query(f"SELECT event_id, at FROM {_EVENTS} WHERE user_id = 9 AND at BETWEEN 1704067200 AND 1705276800 ORDER BY at DESC, event_id LIMIT 100")
def f8_closed_range(spark, sf):
    return T.behaviors(spark, sf).filter("user_id = 9 and at between 1704067200 and 1705276800").select("event_id", "at").orderBy(F.desc("at"), "event_id").limit(100)


@query(f"SELECT event_id, user_id FROM {_EVENTS} e WHERE at >= 1706572800 - 48 * 3600 AND at <= 1706572800")
def f9_recent(spark, sf):
    return T.behaviors(spark, sf).filter("at >= 1706572800 - 48 * 3600 and at <= 1706572800").select("event_id", "user_id")


@query("SELECT id, count(*) AS degree FROM (SELECT 'c' || o_custkey AS id FROM orders UNION ALL SELECT 's' || l_suppkey FROM lineitem) GROUP BY id")
def f11_degrees(spark, sf):
    ends = T.read(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("id")).unionByName(T.read(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


@query("SELECT p_partkey AS id, (p_size - 10) AS starts, CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS ends FROM part WHERE (p_size - 10) <= 20 AND (p_size > 40 OR p_size >= 20)")
def f16_validity(spark, sf):
    p = T.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") - 10).alias("starts"), F.when(F.col("p_size") <= 40, F.col("p_size")).alias("ends"))
    return p.filter("(starts is null or starts <= 20) and (ends is null or ends >= 20)")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN '[click]' WHEN 'view' THEN '[view]' ELSE event_type END AS shown FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def f18_placeholders(spark, sf):
    e = T.read(spark, sf, "events").filter(F.col("event_type").isin("click", "view", "purchase"))
    kind = F.col("event_type")
    return e.select("event_id", F.when(kind.isin("click", "view"), F.concat(F.lit("["), kind, F.lit("]"))).otherwise(kind).alias("shown"))



# joins



@query("SELECT o_orderkey AS order_id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def j6_valid_ids(spark, sf):
    returned = T.read(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return T.read(spark, sf, "orders").select("o_orderkey").join(returned, "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("order_id"))



@query(f"SELECT user_id, version, order_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY version DESC, order_id DESC) AS nth FROM {_VERSIONS} WHERE version BETWEEN 49 AND 84) WHERE nth = 1")
def j8_as_of_version(spark, sf):
    return profiles.as_of(T.profile_versions(spark, sf), ["user_id"], "version", 49, 84, "order_id").select("user_id", "version", "order_id")


@query(
    """SELECT e.event_id, count(*) AS n FROM (SELECT event_id, epoch_us(ts) // 1000000 AS at FROM events) e
    JOIN (SELECT user_id, epoch_us(min(ts)) // 1000000 AS a, epoch_us(min(ts)) // 1000000 + 86400 AS b FROM events GROUP BY user_id) p ON e.at BETWEEN p.a AND p.b GROUP BY 1"""
)
def j9_point_in_interval(spark, sf):
    """How many users' first days hold the time of each event."""
    e = T.behaviors(spark, sf)
    p = e.groupBy("user_id").agg(F.min("at").alias("a")).select("a", (F.col("a") + 86400).alias("b"))
    return matching.covering(e.select(F.col("event_id").alias("id"), "at"), p).select(F.col("id").alias("event_id"), "n")


# aggregations


@query(f"SELECT user_id, count(*) AS n, min(at) AS first_at, max(at) AS last_at FROM {_EVENTS} GROUP BY 1")
def a1_counts(spark, sf):
    return T.behaviors(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


@query(f"SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id)::BIGINT AS total, min(min(at)) OVER (PARTITION BY user_id) AS first_at FROM {_EVENTS} GROUP BY 1, 2")
def a2_activity(spark, sf):
    by = T.behaviors(spark, sf).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("at").alias("a"))
    w = Window.partitionBy("user_id")
    return by.select("user_id", "event_type", "n", F.sum("n").over(w).alias("total"), F.min("a").over(w).alias("first_at"))


_IMPORTANCE = """WITH s AS (SELECT user_id, event_type AS grp, count(*) AS speak, count(*) FILTER (value > 50) AS refer FROM events GROUP BY 1, 2),
    t AS (SELECT *, sum(speak) OVER (PARTITION BY grp) AS total FROM s)
    SELECT user_id, grp, speak, refer, (speak + refer >= 5 OR speak / total > 0.1 OR refer >= 2) AS important FROM t"""


@query(_IMPORTANCE)
def a3_a4_importance(spark, sf):
    s = T.read(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("grp")).agg(F.count("*").alias("speak"), F.count(F.when(F.col("value") > 50, 1)).alias("refer"))
    total = F.sum("speak").over(Window.partitionBy("grp"))
    return s.withColumn("total", total).select("user_id", "grp", "speak", "refer", F.expr("speak + refer >= 5 or speak / total > 0.1 or refer >= 2").alias("important"))


@query("SELECT count(*) AS clusters, sum(n)::BIGINT AS members, round(avg(n), 6) AS mean, max(n) AS largest, min(n) AS smallest, count(*) FILTER (n = 1) AS singletons FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)")
def a6_cluster_stats(spark, sf):
    n = F.col("n")
    c = T.read(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("clusters"), F.sum(n).alias("members"), F.round(F.avg(n), 6).alias("mean"), F.max(n).alias("largest"), F.min(n).alias("smallest"), F.count(F.when(n == 1, 1)).alias("singletons"))


@query(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT unit_id, term, count(*) AS tf FROM (SELECT unit_id, unnest({_TOKENS.format('narrative')}) AS term FROM {_UNITS}) GROUP BY 1, 2) GROUP BY 1")
def a8_term_stats(spark, sf):
    return rank.term_counts(rank.postings(_units(spark, sf), "unit_id", "narrative"))


_EVIDENCE_SQL = """WITH r AS (SELECT p_brand AS value, l_suppkey AS user_id, l_orderkey AS evidence, l_orderkey * 10 + l_linenumber AS seq, {level} AS level FROM lineitem JOIN part ON l_partkey = p_partkey),
    f AS (SELECT user_id, value, evidence, min(seq) AS seq FROM r GROUP BY ALL), l AS (SELECT user_id, value, {pick} AS level FROM r GROUP BY ALL)
    SELECT f.user_id, f.value, array_to_string(list(f.evidence ORDER BY f.seq), ',') AS evidences, any_value(l.level) AS level FROM f JOIN l ON f.user_id = l.user_id AND f.value = l.value GROUP BY ALL"""


def _value_rows(spark, sf, level, *more):
    l, p = T.read(spark, sf, "lineitem"), T.read(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    rows = l.join(p, l.l_partkey == p.p_partkey)
    return rows.select(F.col("l_suppkey").alias("user_id"), F.col("p_brand").alias("value"), level.alias("level"), F.col("l_orderkey").alias("evidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), *more)


@query(_EVIDENCE_SQL.format(level="CASE WHEN l_linenumber > 4 THEN '' ELSE l_returnflag END", pick="arg_max(level, CASE WHEN level <> '' THEN seq END)"))
def a9_merge_last_level(spark, sf):
    rows = _value_rows(spark, sf, F.when(F.col("l_linenumber") > 4, "").otherwise(F.col("l_returnflag")))
    return profiles.merge_values(rows, ["user_id"]).select("user_id", "value", F.array_join("evidences", ",").alias("evidences"), "level")


#: Every label that has a rank, in several forms, unknown ones, blanks and none.
_LABELS = ["低级", "low", " Basic", "beginner", "初级", "Familiar", "weak ", "中级", "Medium", "intermediate", "高级", "HIGH", "advanced", "strong", "专家", "expert", "", " ", "unheard of", "n/a"]
_LABEL = "[" + ", ".join(f"'{x}'" for x in _LABELS) + ", NULL][(hash_of % 21 + 1)::BIGINT]"
_RANKED = "CASE WHEN lower(trim(level)) IN ('低级', 'low', 'basic', 'beginner', '初级', 'familiar', 'weak') THEN 1 WHEN lower(trim(level)) IN ('中级', 'medium', 'intermediate') THEN 2 WHEN lower(trim(level)) IN ('高级', 'high', 'advanced', 'strong', '专家', 'expert') THEN 3 ELSE 0 END"


@query(_EVIDENCE_SQL.format(level=_LABEL.replace("hash_of", "(l_orderkey * 7 + l_linenumber * 5 + l_partkey)"), pick=f"coalesce(trim(arg_min(level, (3 - {_RANKED}) * 1000000000000 + seq) FILTER (coalesce(level, '') <> '')), '')"))
def a10_merge_highest_level(spark, sf):
    at = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 5 + F.col("l_partkey")) % 21
    rows = _value_rows(spark, sf, F.get(F.array(*map(F.lit, _LABELS)), at.cast("int")))
    return profiles.merge_values(rows, ["user_id"], "highest").select("user_id", "value", F.array_join("evidences", ",").alias("evidences"), "level")



@query("SELECT d.source, d.lang, count(*) AS n, sum(l.quality)::BIGINT AS correct, round(avg(l.quality), 6) AS accuracy FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY GROUPING SETS ((), (d.source), (d.lang))")
def a15_roll_up(spark, sf):
    l = T.read(spark, sf, "labels").join(T.read(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")
    return l.groupingSets([[], ["source"], ["lang"]], "source", "lang").agg(F.count("*").alias("n"), F.sum("quality").alias("correct"), F.round(F.avg("quality"), 6).alias("accuracy"))


@query("SELECT event_type AS stage, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def a18_stage_usage(spark, sf):
    return T.read(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))



@query("SELECT source AS group_id, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1")
def a22_units_per_group(spark, sf):
    return T.read(spark, sf, "documents").filter("source is not null").groupBy(F.col("source").alias("group_id")).agg(F.count("*").alias("n"))


# windows


@query(f"SELECT user_id, version, order_id, version = max(version) OVER (PARTITION BY user_id) AS is_latest FROM {_VERSIONS}")
def w2_latest_flag(spark, sf):
    return profiles.latest(T.profile_versions(spark, sf), ["user_id"], "version").select("user_id", "version", "order_id", "is_latest")


@query(f"SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY at DESC, event_id) AS nth FROM {_EVENTS}) WHERE nth <= 5")
def w3_latest_n(spark, sf):
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("at"), "event_id"))
    return T.behaviors(spark, sf).withColumn("nth", nth).filter("nth <= 5").select("user_id", "event_id")


@query(
    f"""WITH g AS (SELECT event_id, user_id, at - lag(at) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM {_EVENTS})
    SELECT event_id, gap, CASE WHEN gap < 0 THEN 'out of order' WHEN gap < 60 THEN 'immediate' WHEN gap < 3600 THEN 'recent' WHEN gap < 86400 THEN 'pause' WHEN gap IS NOT NULL THEN 'long gap' END AS bucket FROM g"""
)
def w4_gaps(spark, sf):
    return state.gaps(T.behaviors(spark, sf), "user_id", ["event_id"]).select("event_id", "gap", "bucket")


@query(
    """WITH m AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
    x AS (SELECT h.vec_id AS doc_id, o.vec_id AS member_id, row_number() OVER (PARTITION BY h.vec_id ORDER BY abs(o.p - h.p), o.p - h.p DESC) AS nth FROM m h JOIN m o ON h.label = o.label AND h.p <> o.p)
    SELECT doc_id AS query_id, doc_id, member_id, nth FROM x WHERE nth <= 3"""
)
def w5_time_neighbours(spark, sf):
    e = T.read(spark, sf, "embeddings").select(F.col("label").alias("cluster_id"), F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("seq"))
    return clusters.neighbours(e.select(F.col("doc_id").alias("query_id"), "doc_id"), e).select("query_id", "doc_id", "member_id", F.col("nth").cast("long").alias("nth"))


@query(f"SELECT conv_id, turn, array_to_string(list(turn::VARCHAR) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ',') AS context FROM {_MESSAGES}")
def w8_context(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, -1)
    joined = F.array_join(F.collect_list(F.col("turn").cast("string")).over(w), ",")
    return T.messages(spark, sf).select("conv_id", "turn", F.nullif(joined, F.lit("")).alias("context"))



# order, sets


@query(f"SELECT unit_id, length(narrative)::BIGINT AS n FROM {_UNITS} ORDER BY n DESC, unit_id LIMIT 50")
def t1_top_k(spark, sf):
    return T.memunits(spark, sf).select("unit_id", F.length("narrative").cast("long").alias("n")).orderBy(F.desc("n"), "unit_id").limit(50)



@query("SELECT user_id, 'only_click' AS kind FROM (SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase') UNION ALL SELECT user_id, 'both' FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase')")
def u2_except_intersect(spark, sf):
    e = T.read(spark, sf, "events")
    of = lambda k: e.filter(F.col("event_type") == k).select("user_id")
    return of("click").subtract(of("purchase")).withColumn("kind", F.lit("only_click")).unionByName(of("click").intersect(of("purchase")).withColumn("kind", F.lit("both")))


# rankers

_POSTS = "posts AS (SELECT unit_id AS doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT unit_id, unnest(t) AS term, len(t) AS dl FROM toks) GROUP BY 1, 2)"
_BM25 = (
    "WITH toks AS (SELECT unit_id, "
    + _TOKENS.format("{field}")
    + " AS t FROM "
    + _UNITS
    + "), "
    + _POSTS
    + """, stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
    raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM (SELECT term, count(*) AS df FROM posts GROUP BY 1), stats), terms AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
    q AS (SELECT query_id, term, count(*) AS w FROM (SELECT item_id AS query_id, unnest("""
    + _TOKENS.format("coalesce(text, '')")
    + """) AS term FROM benchmark) GROUP BY 1, 2),
    matched AS (SELECT query_id, doc_id, sum(w * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN terms USING (term) JOIN posts USING (term), stats GROUP BY 1, 2),
    scored AS (SELECT query_id, doc_id, round(sum(score), 6) AS score FROM (SELECT * FROM matched UNION ALL SELECT query_id, unit_id, 0 FROM (SELECT DISTINCT query_id FROM q), toks) GROUP BY 1, 2),
    hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)"""
).replace("{{", "{").replace("}}", "}")


def _units(spark, sf):
    """The memory units for the rankers, whose work on each text is large."""
    return T.spread(T.memunits(spark, sf), "unit_id")


def _index(spark, sf):
    """The kept index of the units' texts: built by the first query that needs it, loaded by the others."""
    of = lambda name, build: kept(spark, f"{name}-{inverted.FORMAT}", f"{sf}/documents.parquet", build)
    path = of("terms", lambda to: inverted.build(_units(spark, sf), path=to, blocks=False))
    return inverted.load(spark, path, lambda: of("blocks", lambda to: inverted.cut(spark, path, to)))


def _queries(spark, sf):
    return T.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))


@query(_BM25.replace("{field}", "narrative") + " SELECT query_id, doc_id, score, rank FROM hits WHERE rank <= 50")
def r1_bm25(spark, sf):
    return inverted.bm25(_index(spark, sf), _queries(spark, sf), 50).withColumn("rank", F.col("rank").cast("long"))


_NAMED = f"""(SELECT unit_id AS item_id, array_to_string(list_slice({_TOKENS.format("narrative")}, 3, 5), ' ') AS text FROM {_UNITS})"""


@query(_BM25.replace("{field}", "narrative").replace("FROM benchmark)", f"FROM {_NAMED})") + " SELECT query_id, doc_id, score, rank FROM hits WHERE rank <= 5")
def r1_short_queries(spark, sf):
    """Three words of every unit as a query."""
    u = T.memunits(spark, sf)
    asked = u.select(F.col("unit_id").alias("query_id"), F.array_join(F.slice(X.tokens(F.col("narrative")), 3, 3), " ").alias("text"))
    return inverted.bm25(_index(spark, sf), asked, 5).withColumn("rank", F.col("rank").cast("long"))


_VQ = f"(SELECT vec_id AS query_id, vector AS qvector FROM {_VECTORS} WHERE vec_id % 20 = 0)"


def _vector_queries(spark, sf):
    v = T.vectors(spark, sf)
    return v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("qvector"))


_KNN = f"SELECT query_id, vec_id AS doc_id, round({_COS.format('qvector', 'vector')}, 6) AS score FROM {_VQ}, {_VECTORS}"


@query(f"SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_KNN})) WHERE rank <= 20")
def r6_knn(spark, sf):
    found = rank.knn(_vector_queries(spark, sf), T.vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "vector"), 20)
    return found.withColumn("rank", F.col("rank").cast("long"))


def _lists(spark, sf):
    """The kept inverted file of the vectors."""
    rows = T.vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "vector")
    path = kept(spark, f"vectors-{ivf.FORMAT}", f"{sf}/embeddings.parquet", lambda to: ivf.build(rows, path=to))
    return ivf.load(spark, path), rows


@query()
def r6_approximate(spark, sf):
    """The lists nearest to each query, half of them; tested for its recall against r6_knn."""
    lists, rows = _lists(spark, sf)
    return ivf.search(lists, _vector_queries(spark, sf), rows, 20, probes=max(1, lists.lists // 2)).withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_KNN})) WHERE rank <= 20")
def r6_all_lists(spark, sf):
    """All lists of the inverted file: the exact answer."""
    lists, rows = _lists(spark, sf)
    return ivf.search(lists, _vector_queries(spark, sf), rows, 20, probes=lists.lists).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""WITH h AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_KNN})) WHERE rank <= 20),
    c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
    SELECT query_id, c.label::BIGINT AS cluster_id, count(*) AS hits, any_value(c.n) - count(*) AS others FROM h JOIN embeddings e ON h.doc_id = e.vec_id JOIN c ON e.label = c.label GROUP BY 1, 2"""
)
def j1_hit_clusters(spark, sf):
    """The clusters of all hits of every search, with their numbers of hits and of other members."""
    e = T.read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("cluster_id"))
    sizes = e.groupBy("cluster_id").agg(F.count("*").alias("n"))
    hits = r6_knn(spark, sf).join(e, "doc_id").groupBy("query_id", "cluster_id").agg(F.count("*").alias("hits"))
    return hits.join(sizes, "cluster_id").select("query_id", "cluster_id", "hits", (F.col("n") - F.col("hits")).alias("others"))


@query(
    f"""WITH h AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_KNN})) WHERE rank <= 20),
    c AS (SELECT label, count(*) AS hits, count(DISTINCT query_id) AS queries FROM h JOIN embeddings e ON h.doc_id = e.vec_id GROUP BY 1)
    SELECT e.vec_id AS doc_id, e.label::BIGINT AS cluster_id, c.hits, c.queries, md5(d.text) AS text_md5 FROM c JOIN embeddings e ON c.label = e.label LEFT JOIN documents d ON d.doc_id = e.vec_id"""
)
def j1_cluster_members(spark, sf):
    """Hits to their clusters, clusters to their members, members to documents: each member once, with the hits and queries of its
    cluster, not once for each hit of a query."""
    e = T.read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("cluster_id"))
    found = r6_knn(spark, sf).join(e, "doc_id").groupBy("cluster_id").agg(F.count("*").alias("hits"), F.count_distinct("query_id").alias("queries"))
    texts = T.read(spark, sf, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    return e.join(found, "cluster_id").join(texts, "doc_id", "left").select("doc_id", "cluster_id", "hits", "queries", "text_md5")


@query(f"SELECT query_id, doc_id, score FROM ({_KNN}) WHERE score >= 0.4 AND doc_id <> query_id")
def f17_score_threshold(spark, sf):
    return rank.within(_vector_queries(spark, sf), T.vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "vector"), 0.4).filter("doc_id <> query_id")


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, label::BIGINT AS doc_id, max(round({_COS.format('qvector', 'vector')}, 6)) AS score FROM {_VQ}, {_VECTORS} GROUP BY 1, 2)) WHERE rank <= 5")
def r5_max_sim(spark, sf):
    """Documents are labels; those below seven have facts, the others only vectors of their fields."""
    rows = T.vectors(spark, sf).select(F.col("label").cast("long").alias("doc_id"), "vector")
    return rank.max_sim(_vector_queries(spark, sf), rows.filter("doc_id < 7"), 5, fields=rows).withColumn("rank", F.col("rank").cast("long"))




def _inserted(place: str) -> str:
    """CTEs up to x (query_id, place, doc_id, score, hit_id): hits with co-members put after each hit, at the end, or by score."""
    first = "[]::BIGINT[]" if place == "after" else "ids"
    hit = "CASE WHEN list_contains(s.shown, h.doc_id) THEN [] ELSE [{'doc_id': h.doc_id, 'score': h.score, 'hit_id': NULL::BIGINT}] END"
    now = "CASE WHEN list_contains(s.shown, h.doc_id) THEN s.shown ELSE list_append(s.shown, h.doc_id) END"
    added = "list_transform(new, lambda m: {'doc_id': m, 'score': score * 0.7::DOUBLE, 'hit_id': hit})"
    start = "[]::STRUCT(doc_id BIGINT, score DOUBLE, hit_id BIGINT)[]" if place == "after" else "rows_of"
    order = "rows[i].score DESC, i" if place == "score" else "i"
    return f"""WITH RECURSIVE h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_KNN})) WHERE rank <= 20),
    m AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
    near AS (SELECT a.vec_id AS doc_id, list(o.vec_id::BIGINT ORDER BY abs(o.p - a.p), o.p - a.p DESC) AS near FROM m a JOIN m o ON a.label = o.label AND a.p <> o.p GROUP BY 1),
    q AS (SELECT query_id, list(doc_id::BIGINT ORDER BY rank) AS ids, least(10, floor(0.3 * count(*)))::BIGINT AS budget, list({{'doc_id': doc_id::BIGINT, 'score': score, 'hit_id': NULL::BIGINT}} ORDER BY rank) AS rows_of FROM h GROUP BY 1),
    s AS (SELECT query_id, 0::BIGINT AS rank, {first} AS shown, {start} AS rows, budget FROM q UNION ALL
        SELECT query_id, rank, shown || new, rows || {added}, budget - len(new) FROM (SELECT *, list_slice(list_filter(near, lambda x: NOT list_contains(shown, x)), 1, least(3, budget)) AS new FROM
        (SELECT h.query_id, h.rank, h.doc_id::BIGINT AS hit, h.score, coalesce(n.near, []) AS near, {now} AS shown, s.rows || {hit} AS rows, s.budget FROM s JOIN h ON h.query_id = s.query_id AND h.rank = s.rank + 1 LEFT JOIN near n ON n.doc_id = h.doc_id))),
    e AS (SELECT query_id, arg_max(rows, rank) AS rows FROM s GROUP BY 1),
    x AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS place, rows[i].doc_id AS doc_id, rows[i].score AS score, rows[i].hit_id AS hit_id FROM e, unnest(range(1, len(rows) + 1)) AS u(i))"""


#: Of a relation l (query_id, list_no, doc_id, rank, score).
_FUSE = """o AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, max(score) AS own, min(rank) AS first FROM l GROUP BY 1, 2), n AS (SELECT query_id, count(DISTINCT list_no) AS sides FROM l GROUP BY 1),
    w AS (SELECT query_id, doc_id, CASE WHEN sides = 1 THEN own ELSE rrf END AS score, CASE WHEN sides = 1 THEN -first ELSE rrf END AS key FROM o JOIN n USING (query_id))
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY key DESC, doc_id) AS rank FROM w) WHERE rank <= 20"""


@query(
    _BM25.replace("{field}", "narrative")
    + f""", l AS (SELECT query_id, 0 AS list_no, doc_id, rank, score FROM hits WHERE rank <= 50 UNION ALL SELECT query_id // 20, 1, doc_id, rank, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_KNN})) WHERE rank <= 50 AND query_id // 20 IN (SELECT item_id FROM benchmark)), """
    + _FUSE
)
def r11_hybrid(spark, sf):
    """Vectors and BM25, 50 candidates of each fused by reciprocal rank; where one side is empty the other stays as it is. The vector of
    question i is the one numbered 20 i, so that later questions have none."""
    asked = _queries(spark, sf)
    words = inverted.bm25(_index(spark, sf), asked, 50).select("query_id", F.lit(0).alias("list_no"), "doc_id", "rank", "score")
    vectors = _vector_queries(spark, sf).withColumn("query_id", F.expr("query_id div 20")).join(asked.select("query_id"), "query_id", "left_semi")
    near = rank.knn(vectors, T.vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "vector"), 50).select("query_id", F.lit(1).alias("list_no"), "doc_id", "rank", "score")
    return rank.fused(words.unionByName(near), 20).withColumn("rank", F.col("rank").cast("long"))


_STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_USABLE = f"list_transform(list_slice(list_filter(string_split(text, '. '), lambda s: length(s) BETWEEN 5 AND 300 AND lower({_STRIP.format('s')}) <> lower({_STRIP.format('text')})), 1, 3), lambda s: {_STRIP.format('s')})"
_VARIANTS = f"""(SELECT item_id * 4 + generate_subscripts(vs, 1) - 1 AS item_id, unnest(vs) AS text FROM (SELECT item_id, CASE WHEN len(v) = 0 THEN [text] ELSE v END AS vs FROM
    (SELECT item_id, text, {_USABLE} AS v FROM (SELECT item_id, coalesce(text, '') AS text FROM benchmark))))"""
#: a: a question's first hits; b: those of its variants in turn.
_ROUNDS = (
    _BM25.replace("{field}", "narrative").replace("WITH ", "WITH a AS (WITH ", 1)
    + " SELECT query_id, doc_id, rank FROM hits WHERE rank <= 50), b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(list_no * 1000 + rank)) AS rank FROM ("
    + _BM25.replace("{field}", "narrative").replace("FROM benchmark)", f"FROM {_VARIANTS})")
    + " SELECT query_id // 4 AS query_id, query_id % 4 AS list_no, doc_id, rank FROM hits WHERE rank <= 50) GROUP BY query_id, doc_id)"
)


def _usable(text):
    return X.usable_variants(F.split(text, r"\. "), text)


def _variants(spark, sf):
    """Up to three variants of each question, its sentences, or itself: query_id (4 times the question's and the variant's number), text."""
    v = _queries(spark, sf).withColumn("v", _usable(F.col("text")))
    return v.select(F.posexplode(F.when(F.size("v") == 0, F.array("text")).otherwise(F.col("v"))).alias("no", "text"), "query_id").select((F.col("query_id") * 4 + F.col("no")).alias("query_id"), "text")


def _variant_lists(spark, sf):
    """query_id, list_no, doc_id, rank, score: the hits of each variant."""
    hits = inverted.bm25(_index(spark, sf), _variants(spark, sf), 50)
    return hits.select(F.expr("query_id div 4").alias("query_id"), F.pmod("query_id", F.lit(4)).alias("list_no"), "doc_id", "rank", "score")


@query(
    f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_KNN})),
    j AS (SELECT h.*, CASE WHEN (doc_id + query_id) % 3 <> 0 AND (query_id % 40 = 0 OR doc_id % 5 = 0) THEN (doc_id * 7 % 101)::DOUBLE END AS rs FROM h JOIN documents d USING (doc_id) WHERE rank <= 20 AND coalesce(trim(d.text), '') <> ''),
    k AS (SELECT *, avg(CASE WHEN rs IS NOT NULL THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY query_id) >= 0.3 AS reranked FROM j)
    SELECT query_id, doc_id, rank, reranked, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN reranked THEN -rs END NULLS LAST, rank) AS new_rank FROM k"""
)
def r15_rerank(spark, sf):
    """Hits of documents without a text go; a reranker scores most hits of some queries and few of others, which keep their order."""
    d, q = F.col("doc_id"), F.col("query_id")
    texts = T.read(spark, sf, "documents").filter(F.coalesce(F.trim("text"), F.lit("")) != "").select("doc_id")
    hits = r6_knn(spark, sf).join(texts, "doc_id", "left_semi")
    scores = hits.filter(((d + q) % 3 != 0) & ((q % 40 == 0) | (d % 5 == 0))).select("query_id", "doc_id", (d * 7 % 101).cast("double").alias("rerank_score"))
    return rank.rerank(hits, scores).select("query_id", "doc_id", "rank", "reranked", F.col("new_rank").cast("long").alias("new_rank"))


# clusters, profiles, scalar functions


@query()
def c1_online_clusters(spark, sf):
    """An ordered fold of each group; tested against a plain loop."""
    v = T.vectors(spark, sf)
    return clusters.online_clusters(v.select(F.col("label").alias("group_id"), F.col("vec_id").alias("unit_id"), (F.col("vec_id") * 3600.0).alias("at"), "vector"), least=0.3)


@query("SELECT label::BIGINT AS cluster_id, vec_id AS unit_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) % 5 = 0 AS refresh FROM embeddings")
def c5_refresh(spark, sf):
    e = T.read(spark, sf, "embeddings").select(F.col("label").cast("long").alias("cluster_id"), F.col("vec_id").alias("unit_id"))
    return ranked(e, ["cluster_id"], ["unit_id"]).select("cluster_id", "unit_id", (F.col("nth") % 5 == 0).alias("refresh"))


@query(
    """SELECT coalesce(a.k, b.k) AS user_id, CASE WHEN b.k IS NOT NULL THEN b.price ELSE a.price END AS price FROM (SELECT o_custkey AS k, round(max(o_totalprice), 2) AS price FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
    FULL JOIN (SELECT o_custkey AS k, round(max(o_totalprice), 2) AS price FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k"""
)
def p1_upsert(spark, sf):
    o = T.read(spark, sf, "orders")
    of = lambda s: o.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("user_id")).agg(F.round(F.max("o_totalprice"), 2).alias("price"))
    return profiles.upsert(of("F"), of("O"), ["user_id"], ["price"])


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events")
def p2_save_counter(spark, sf):
    return ranked(T.read(spark, sf, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], "version")


@query(f"SELECT unit_id, array_to_string({_TOKENS.format('narrative')}, ' ') AS words FROM {_UNITS}")
def x1_tokens(spark, sf):
    return T.memunits(spark, sf).select("unit_id", F.array_join(X.tokens(F.col("narrative")), " ").alias("words"))


@query(r"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS text FROM documents")
def x6_collapse(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", X.collapsed(F.coalesce("text", F.lit(""))).alias("text"))


@query("SELECT event_id, strftime(ts, '%B %d, %Y(%A) at %I:%M %p') AS shown FROM events")
def x8_event_time(spark, sf):
    return T.behaviors(spark, sf).select("event_id", X.event_time(F.col("ts")).alias("shown"))


@query("SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100 + 1 AS part FROM documents")
def x22_route(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", X.route(F.col("doc_id").cast("string")).alias("part"))


# streams, as batch twins


@query(
    f"""WITH g AS (SELECT user_id, at, coalesce(at - lag(at) OVER (PARTITION BY user_id ORDER BY at) >= 21600, TRUE) AS cut FROM {_EVENTS}), s AS (SELECT *, sum(cut::INT) OVER (PARTITION BY user_id ORDER BY at ROWS UNBOUNDED PRECEDING) AS no FROM g)
    SELECT user_id, min(at) AS first_at, max(at) AS last_at, count(*) AS n FROM s GROUP BY user_id, no"""
)
def k1_segments(spark, sf):
    return state.sessions(T.behaviors(spark, sf))


@query(f"SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at DESC, event_id DESC) AS nth FROM {_EVENTS}) WHERE nth <= 100")
def k4_capped_history(spark, sf):
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("at"), F.desc("event_id")))
    return T.behaviors(spark, sf).withColumn("nth", nth).filter("nth <= 100").select("event_id", "user_id")


@query(f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY at RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS n, n > 5 AS limited FROM {_EVENTS}")
def k9_rate_limit(spark, sf):
    return state.over_limit(T.behaviors(spark, sf), "user_id", 86400, 5).select("event_id", "n", "limited")


@query(f"SELECT at // 86400 * 86400 AS start, user_id, count(*) AS n FROM {_EVENTS} GROUP BY 1, 2")
def k12_tumbling(spark, sf):
    return state.tumbling_counts(T.behaviors(spark, sf))
