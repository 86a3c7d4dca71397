"""Registered queries of chat scans, index rows, deletions, evidence chains and versioned records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engram import tables as T
from engram.operators import clusters, matching, profiles, rank
from engram.plans.lookups import _joined
from engram.plans.queries import _EVENTS, _KNN, _MESSAGES, _UNITS, _VERSIONS, query, r6_knn
from engram.sources import chats

# scans and sinks


@query(
    f"""SELECT conv_id || '_' || turn AS message_id, 'g' || conv_id AS group_id, CASE WHEN turn % 3 = 0 THEN 'Name of ' || sender WHEN turn % 3 = 1 THEN 'The ' || sender ELSE sender END AS full_name, md5(content) AS content_md5,
    CASE WHEN no = 0 THEN '' ELSE conv_id || '_' || before END AS refs, at, max(at) OVER (PARTITION BY conv_id) AS current_at
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS no, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM {_MESSAGES})"""
)
def s1_group_chats(spark, sf):
    """Conversations written as group chat files and scanned again: every third message has its own name, every third one in the
    details, times are local or with an offset, references are ids or messages."""
    m = T.messages(spark, sf)
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_seconds("at").cast("timestamp_ntz"))
    iso = lambda t: F.replace(t.cast("string"), F.lit(" "), F.lit("T"))
    shown = F.when(F.col("turn") % 2 == 0, F.concat(iso(utc), F.lit("Z"))).otherwise(iso(utc + F.expr("interval 8 hours")))
    ref = F.concat_ws("_", "conv_id", "before")
    ref = F.when(F.col("turn") % 2 == 0, ref).otherwise(F.to_json(F.struct(ref.alias("message_id"))))
    third = F.col("turn") % 3
    one = F.struct(
        "turn", F.concat_ws("_", "conv_id", "turn").alias("message_id"), shown.alias("create_time"), F.when(third == 1, F.concat("sender", F.lit("1"))).otherwise(F.col("sender")).alias("sender"),
        F.when(third == 0, F.concat(F.lit("Name of "), "sender")).otherwise("").alias("sender_name"), "content", F.when(F.col("before").isNotNull(), F.array(ref)).alias("refer_list"),
    )
    details = F.create_map(*[x for name in ("user", "assistant", "system") for x in (F.lit(name + "1"), F.struct(F.lit(f"The {name}").alias("full_name")))])
    meta = F.struct(F.concat(F.lit("g"), "conv_id").alias("group_id"), F.lit("Asia/Shanghai").alias("default_timezone"), details.alias("user_details"))
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    files = m.withColumn("before", before).groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("conversation_list"))
    rows = chats.group_chat(files.select(F.to_json(F.struct(meta.alias("conversation_meta"), "conversation_list")).alias("chat")))
    return rows.select("message_id", "group_id", "full_name", F.md5("content").alias("content_md5"), F.array_join("refs", ",").alias("refs"), "at", "current_at")


@query(
    r"""WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN ' ' ELSE role END AS role, text FROM conversations)
    SELECT conv_id, turn, CASE WHEN conv_id IS NULL THEN 'conv_id' WHEN turn IS NULL THEN 'turn' WHEN coalesce(trim(role), '') = '' THEN 'role' WHEN trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) = '' THEN 'text' END AS reason,
    md5(CASE WHEN trim(role) <> '' AND trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) <> '' THEN trim(regexp_replace(text, '\s+', ' ', 'g')) ELSE text END) AS text_md5 FROM m"""
)
def s2_checked(spark, sf):
    """Every message, normalised if it is valid, else with the field that it lacks; every fifth turn lacks its role."""
    m = T.read(spark, sf, "conversations").withColumn("role", F.when(F.col("turn") % 5 == 4, " ").otherwise(F.col("role")))
    return chats.checked_messages(m, ["conv_id", "turn", "role", "text"]).select("conv_id", "turn", "reason", F.md5("text").alias("text_md5"))


@query(
    f"""WITH m AS (SELECT conv_id // 4 AS d, conv_id % 4 AS s, turn, sender, content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS no FROM {_MESSAGES}),
    g AS (SELECT d, s, count(*) AS n, row_number() OVER (PARTITION BY d ORDER BY s) - 1 AS nth FROM m GROUP BY 1, 2),
    t AS (SELECT *, CASE WHEN s = 2 THEN 1704067200 + nth * 3600 ELSE 1684606020 + s * 60 END AS start FROM g), r AS (SELECT *, lead(start) OVER (PARTITION BY d ORDER BY s) - start AS room FROM t)
    SELECT d AS conv_id, 'session_' || (s * 3 + 2) AS session, no, sender || '_' || d AS speaker_id, md5(CASE WHEN turn % 4 = 1 THEN '[' || sender || ' shared an image: ' || CASE WHEN turn % 8 = 1 THEN 'a cat' ELSE 'an image' END || '] ' ELSE '' END || content) AS content_md5,
    round(start + no * CASE WHEN room > 0 AND (n - 1) * 30 > room * 0.9 THEN room * 0.9 / (n - 1) ELSE 30 END, 3) AS at, s = 2 AS is_fake FROM m JOIN r USING (d, s)"""
)
def s3_dialogues(spark, sf):
    """Four conversations are the sessions 2, 5, 8 and 11 of a dialogue, a minute apart; the third has no time. Written and scanned again."""
    m = T.messages(spark, sf).withColumn("d", F.expr("conv_id div 4")).withColumn("s", F.col("conv_id") % 4)
    one = F.struct("turn", F.col("sender").alias("speaker"), F.col("content").alias("text"), F.when(F.col("turn") % 4 == 1, "/x.png").alias("img_url"), F.when(F.col("turn") % 8 == 1, "a cat").alias("blip_caption"))
    said = m.groupBy("d", "s").agg(F.array_sort(F.collect_list(one)).alias("said"))
    key = F.concat(F.lit("session_"), F.col("s") * 3 + 2)
    time = F.when(F.col("s") == 2, "Unknown").otherwise(F.concat(F.lit("6:"), F.lpad((F.col("s") + 7).cast("string"), 2, "0"), F.lit(" pm on 20 May, 2023")))
    entry = F.concat(F.lit('"'), key, F.lit('_date_time":"'), time, F.lit('","'), key, F.lit('":'), F.to_json("said"))
    files = said.groupBy(F.col("d").alias("conv_id")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("conversation"))
    rows = chats.dialogue_messages(files)
    return rows.select("conv_id", "session", F.col("no").cast("long").alias("no"), "speaker_id", F.md5("content").alias("content_md5"), F.round(F.col("at").cast("double"), 3).alias("at"), "is_fake")


@query(f"SELECT u.unit_id, u.group_id, len(e.embedding) AS dim, coalesce(nullif(substr(narrative, 1, 100), ''), summary) AS label FROM {_UNITS} u JOIN embeddings e ON e.vec_id = u.unit_id WHERE len(e.embedding) > 0")
def s10_vector_rows(spark, sf):
    """Vector rows of the index; units without a vector have none."""
    v = T.vectors(spark, sf).filter(F.size("vector") > 0).select(F.col("vec_id").alias("unit_id"), F.size("vector").cast("long").alias("dim"))
    label = F.coalesce(F.nullif(F.substring("narrative", 1, 100), F.lit("")), F.col("summary"))
    return T.memunits(spark, sf).join(v, "unit_id").select("unit_id", "group_id", "dim", label.alias("label"))


@query(
    f"""SELECT 'unit' AS kind, unit_id AS id, group_id AS owner, 1704067200000 + unit_id * 1000 AS at_ms FROM {_UNITS} UNION ALL SELECT 'fact', vec_id, label::VARCHAR, 1704067200000 + vec_id * 1000 FROM embeddings
    UNION ALL SELECT 'behavior', event_id, user_id::VARCHAR, at * 1000 FROM {_EVENTS}"""
)
def s11_typed_rows(spark, sf):
    """Rows of all types in one shape, their times, in seconds, milliseconds or as text, as milliseconds."""
    from engram.functions.text import any_epoch_ms

    base = F.lit(1_704_067_200)
    utc = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX")
    rows = [
        T.memunits(spark, sf).select(F.lit("unit").alias("kind"), F.col("unit_id").alias("id"), F.col("group_id").alias("owner"), (base + F.col("unit_id")).cast("string").alias("at")),
        T.vectors(spark, sf).select(F.lit("fact").alias("kind"), F.col("vec_id").alias("id"), F.col("label").cast("string").alias("owner"), ((base + F.col("vec_id")) * 1000).cast("string").alias("at")),
        T.behaviors(spark, sf).select(F.lit("behavior").alias("kind"), F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("owner"), utc.alias("at")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select("kind", "id", "owner", any_epoch_ms(F.col("at")).alias("at_ms"))


@query(
    """SELECT d.doc_id, row_number() OVER (ORDER BY d.doc_id DESC) AS place FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
    WHERE coalesce(trim(d.text), '') <> '' AND (e.vec_id IS NULL OR coalesce(len(e.embedding), 0) = 0 OR e.label <> 3) AND d.doc_id >= 7 ORDER BY d.doc_id DESC LIMIT 500"""
)
def s13_backfill_candidates(spark, sf):
    """Units with a text whose vector is missing, empty or of another model (its label), created from a time on, the newest 500."""
    d = T.read(spark, sf, "documents").filter((F.coalesce(F.trim("text"), F.lit("")) != "") & (F.col("doc_id") >= 7)).select("doc_id")
    e = T.read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.coalesce(F.size("embedding"), F.lit(0)).alias("dim"), "label")
    lacking = d.join(e, "doc_id", "left").filter(F.col("label").isNull() | (F.col("dim") <= 0) | (F.col("label") != 3)).select("doc_id")
    newest = lacking.orderBy(F.desc("doc_id")).limit(500)
    return newest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("doc_id"))).cast("long"))  # of the 500


# filters


@query(f"SELECT event_id FROM {_EVENTS} WHERE NOT coalesce(user_id = 3, FALSE) AND NOT coalesce(at >= 1704672000 AND at < 1704758400, FALSE) AND NOT coalesce(event_type = 'click' AND value > 90 AND user_id <= 20, FALSE)")
def f7_kept_rows(spark, sf):
    """What stays after a deletion by user, one by time range and one by several filters; these need at least one."""
    e = T.behaviors(spark, sf)
    e = matching.without(e, F.col("user_id") == 3)
    e = matching.without(e, F.col("at") >= 1_704_672_000, F.col("at") < 1_704_758_400)
    return matching.without(e, F.col("event_type") == "click", F.col("value") > 90, F.col("user_id") <= 20).select("event_id")


@query("SELECT p_partkey AS id, p_type AS kind FROM part WHERE list_contains(string_split(lower(p_name), ' ') || [lower(p_brand)], 'small') OR list_contains(string_split(lower(p_name), ' ') || [lower(p_brand)], 'brand#13')")
def f10_aliases(spark, sf):
    """Entities by an alias: the words of their name and their brand."""
    aliases = F.concat(F.split(F.lower("p_name"), " "), F.array(F.lower("p_brand")))
    p = T.read(spark, sf, "part").withColumn("aliases", aliases)
    return p.filter(F.array_contains("aliases", "small") | F.array_contains("aliases", "brand#13")).select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"))


@query("SELECT id FROM (SELECT p_partkey AS id, CASE WHEN p_size > 45 THEN NULL ELSE p_size - 10 END AS starts, CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS ends FROM part) WHERE starts <= 20 AND ends >= 20")
def f16_contained(spark, sf):
    """The closed form: intervals with both ends known that hold the time."""
    p = T.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") <= 45, F.col("p_size") - 10).alias("starts"), F.when(F.col("p_size") <= 40, F.col("p_size")).alias("ends"))
    return p.filter("starts <= 20 and ends >= 20").select("id")


@query(
    f"""WITH m AS (SELECT conv_id, string_agg(content, chr(10) ORDER BY no) AS said FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM {_MESSAGES}) WHERE no <= 6 GROUP BY 1)
    SELECT conv_id AS unit_id, md5(coalesce(nullif(trim(CASE WHEN lang = 'en' THEN narrative END), ''), nullif(trim(CASE WHEN lang = 'de' THEN summary END), ''), nullif(trim(said), ''), conv_id::VARCHAR)) AS best_md5
    FROM m LEFT JOIN {_UNITS} u ON u.unit_id = m.conv_id"""
)
def f19_best_text(spark, sf):
    """A unit's narrative, else its summary, else its first six messages, else its id. Units are conversations; of those whose document is
    English the narrative is known, of German ones the summary."""
    no = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    six = T.messages(spark, sf).withColumn("no", no).filter("no <= 6")
    said = six.groupBy(F.col("conv_id").alias("unit_id")).agg(_joined(F.struct("no", "content"), "content", "\n").alias("said"))
    u = T.memunits(spark, sf).select("unit_id", F.when(F.col("lang") == "en", F.col("narrative")).alias("narrative"), F.when(F.col("lang") == "de", F.col("summary")).alias("summary"))
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return said.join(u, "unit_id", "left").select("unit_id", F.md5(F.coalesce(filled("narrative"), filled("summary"), filled("said"), F.col("unit_id").cast("string"))).alias("best_md5"))


@query("SELECT o_custkey AS user_id, o_orderkey AS project_id, strftime(o_orderdate, '%Y-%m-%d') AS entry_date, '{\"priority\":\"' || o_orderpriority || '\",\"status\":\"' || o_orderstatus || '\"}' AS fields FROM orders")
def f20_project_fields(spark, sf):
    fields = F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")))
    return T.read(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("project_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("entry_date"), fields.alias("fields"))


# joins


@query(
    """WITH e AS (SELECT item_id, unnest([item_id, item_id * 7, item_id + 400, item_id + 100000000]) AS evidence FROM benchmark)
    SELECT item_id, evidence, CASE WHEN d.doc_id IS NULL THEN 'NOT_FOUND' ELSE 'unit_' || d.doc_id END AS unit, CASE WHEN v.vec_id IS NULL THEN 'NOT_FOUND' ELSE 'cluster_' || v.label END AS cluster
    FROM e LEFT JOIN documents d ON d.doc_id = e.evidence LEFT JOIN embeddings v ON v.vec_id = d.doc_id"""
)
def j3_evidence_to_cluster(spark, sf):
    """A question's evidences to their units, units to their clusters."""
    i = F.col("item_id")
    e = T.read(spark, sf, "benchmark").select("item_id", F.explode(F.array(i, i * 7, i + 400, i + 100_000_000)).alias("evidence"))
    units = T.read(spark, sf, "documents").select(F.col("doc_id").alias("evidence"), F.concat(F.lit("unit_"), "doc_id").alias("unit_id"))
    index = T.read(spark, sf, "embeddings").select(F.concat(F.lit("unit_"), "vec_id").alias("unit_id"), F.concat(F.lit("cluster_"), "label").alias("cluster_id"))
    found = matching.chain(e, units, index)
    return found.select("item_id", "evidence", F.col("unit_id").alias("unit"), F.col("cluster_id").alias("cluster"))


_NAMES = f"(SELECT user_id, event_type || ' ' || (user_id % 7) AS name, at, event_id FROM {_EVENTS} WHERE event_type <> 'error' OR user_id % 2 = 0)"


@query(
    f"""WITH n AS {_NAMES}, c AS (SELECT user_id, arg_max(name, at * 1000000 + event_id) AS name FROM n WHERE at >= 1706400000 GROUP BY 1), h AS (SELECT user_id, arg_max(name, at * 1000000 + event_id) AS name FROM n WHERE at < 1706400000 GROUP BY 1)
    SELECT coalesce(c.user_id, h.user_id) AS user_id, coalesce(c.name, h.name) AS name, c.name IS NOT NULL AS is_current FROM c FULL JOIN h ON c.user_id = h.user_id"""
)
def j7_name_resolution(spark, sf):
    """Names of current speakers, the latest of each, win; history fills the gaps."""
    e = T.behaviors(spark, sf).filter("event_type <> 'error' or user_id % 2 = 0")
    named = e.select("user_id", F.concat("event_type", F.lit(" "), F.col("user_id") % 7).alias("name"), "at", "event_id")
    return matching.resolved_names(named.filter("at >= 1706400000"), named.filter("at < 1706400000"), "user_id", "name", ["at", "event_id"])


# aggregations

_REFS = "CASE WHEN k % 3 = 0 THEN [] WHEN k % 3 = 1 THEN [k % 50] ELSE [k % 50, k % 20] END"


@query(
    f"""WITH m AS (SELECT user_id, event_type AS grp, json_extract(props, '$.k')::BIGINT AS k FROM events), r AS (SELECT grp, user_id, 1 AS speak, 0 AS refer FROM m UNION ALL SELECT grp, unnest({_REFS}), 0, 1 FROM m),
    t AS (SELECT grp, count(*) AS total FROM m GROUP BY 1) SELECT grp, user_id, sum(speak)::BIGINT AS chat_count, sum(refer)::BIGINT AS at_count, any_value(total) AS total,
    sum(speak) + sum(refer) >= 5 OR sum(speak) / any_value(total) > 0.1 OR sum(refer) >= 2 AS important FROM r JOIN t USING (grp) GROUP BY grp, user_id"""
)
def a3_group_importance(spark, sf):
    """How often each user speaks and is referred to in each group; a message refers to up to two users."""
    k = F.get_json_object("props", "$.k").cast("long")
    refs = F.when(k % 3 == 0, F.array().cast("array<bigint>")).when(k % 3 == 1, F.array(k % 50)).otherwise(F.array(k % 50, k % 20))
    m = T.read(spark, sf, "events").select(F.col("event_type").alias("grp"), "user_id", refs.alias("refs"))
    return profiles.importance(m, "grp")


@query(
    f"""WITH o AS (SELECT user_id, event_id, 0 AS part, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events WHERE event_type = 'error'), n AS (SELECT user_id, event_id, 1 AS part, row_number() OVER (PARTITION BY user_id ORDER BY at, event_id) AS pos FROM {_EVENTS} WHERE event_type = 'click')
    SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY nth) AS evidences FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY part, pos) AS nth FROM (SELECT * FROM o UNION ALL SELECT * FROM n)) WHERE nth <= 10 GROUP BY 1"""
)
def a5_first_evidences(spark, sf):
    """New evidences are appended to the existing ones, the first ten stay."""
    e = T.behaviors(spark, sf)
    no = lambda *order: F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    old = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("evidence"), no("event_id").alias("pos"))
    new = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("evidence"), no("at", "event_id").alias("pos"))
    return profiles.appended(old, new, ["user_id"], 10).select("user_id", F.array_join(F.transform("evidences", lambda x: x.cast("string")), ",").alias("evidences"))


@query(
    """WITH a AS (SELECT vec_id, vec_id % 7 AS grp, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE label END AS cluster, row_number() OVER (PARTITION BY vec_id % 7, label ORDER BY vec_id) = 1 AND vec_id % 11 <> 0 AS is_new FROM embeddings)
    SELECT count(*) AS units, count(DISTINCT grp) AS groups, count(DISTINCT CASE WHEN cluster IS NOT NULL THEN grp * 1000 + cluster END) AS clusters, count(*) FILTER (is_new) AS new_clusters, count(*) FILTER (cluster IS NULL) AS failed FROM a"""
)
def a7_clustering_stats(spark, sf):
    """Units, groups, clusters, how many a run made new, and units that failed (here every eleventh)."""
    first = F.row_number().over(Window.partitionBy(F.col("vec_id") % 7, "label").orderBy("vec_id")) == 1
    ok = F.col("vec_id") % 11 != 0
    a = T.read(spark, sf, "embeddings").select((F.col("vec_id") % 7).alias("group_id"), F.when(ok, F.col("label")).alias("cluster_id"), (first & ok).alias("is_new"))
    return clusters.run_stats(a)


@query(
    """WITH r AS (SELECT l_suppkey AS user_id, l_returnflag AS grp, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linenumber % 2 = 0 THEN 'n' || l_orderkey END AS name, CASE WHEN l_linenumber = 3 THEN 'why ' || l_orderkey ELSE '' END AS why FROM lineitem),
    g AS (SELECT user_id, string_agg(grp, ',' ORDER BY first) AS group_ids FROM (SELECT user_id, grp, min(seq) AS first FROM r GROUP BY 1, 2) GROUP BY 1)
    SELECT user_id, arg_max(name, CASE WHEN name IS NOT NULL THEN seq END) AS name, any_value(group_ids) AS group_ids, coalesce(string_agg(why, '$' ORDER BY seq) FILTER (why <> ''), '') AS reasoning FROM r JOIN g USING (user_id) GROUP BY user_id"""
)
def a11_group_info(spark, sf):
    """Of a user's group profiles: the last name that is known, the groups in the order they come, and all reasonings joined by $."""
    l, line = T.read(spark, sf, "lineitem"), F.col("l_linenumber")
    rows = l.select(
        F.col("l_suppkey").alias("user_id"), F.col("l_returnflag").alias("group_id"), (F.col("l_orderkey") * 10 + line).alias("seq"),
        F.when(line % 2 == 0, F.concat(F.lit("n"), "l_orderkey")).alias("name"), F.when(line == 3, F.concat(F.lit("why "), "l_orderkey")).otherwise("").alias("reasoning"),
    )
    return profiles.merge_group_info(rows)


_PROJECTS = """(SELECT l_suppkey AS user_id, coalesce(nullif(CASE WHEN l_partkey % 2 = 0 THEN p_brand ELSE '' END, ''), p_type) AS project, CASE l_linenumber % 4 WHEN 0 THEN 'subtasks' WHEN 1 THEN 'user_objective' WHEN 2 THEN 'contributions' ELSE 'user_concerns' END AS field,
    p_name AS value, l_returnflag AS level, l_orderkey AS evidence, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linenumber > 2 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '' END AS entry_date FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(
    f"""WITH r AS {_PROJECTS}, d AS (SELECT user_id, project, coalesce(arg_min(entry_date, CASE WHEN entry_date <> '' THEN seq END), '') AS entry_date FROM r GROUP BY 1, 2),
    f AS (SELECT user_id, project, field, value, evidence, min(seq) AS seq FROM r GROUP BY ALL), l AS (SELECT user_id, project, field, value, arg_max(level, seq) AS level FROM r GROUP BY ALL)
    SELECT user_id, project, field, value, any_value(level) AS level, md5(string_agg(evidence::VARCHAR, ',' ORDER BY seq)) AS evidences_md5, any_value(entry_date) AS entry_date FROM f JOIN l USING (user_id, project, field, value) JOIN d USING (user_id, project) GROUP BY 1, 2, 3, 4"""
)
def a12_project_merge(spark, sf):
    """Projects by id, else by name: their four lists merged value by value, and the first entry date that is not empty. An order has
    several lines of one number; of those the first in the table counts."""
    l = T.read(spark, sf, "lineitem").withColumn("place", F.struct(F.col("_metadata.row_index").alias("no"), F.col("_metadata.file_name").alias("name")))
    p = T.read(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    kind = F.element_at(F.array(*map(F.lit, ("subtasks", "user_objective", "contributions", "user_concerns"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    rows = l.join(p, l.l_partkey == p.p_partkey).select(
        F.col("l_suppkey").alias("user_id"), F.when(F.col("l_partkey") % 2 == 0, F.col("p_brand")).otherwise("").alias("project_id"), F.col("p_type").alias("project_name"), kind.alias("field"), F.col("p_name").alias("value"),
        F.col("l_returnflag").alias("level"), F.col("l_orderkey").alias("evidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_linenumber") > 2, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise("").alias("entry_date"), "place",
    )
    merged = profiles.merge_projects(rows)
    return merged.select("user_id", "project", "field", "value", "level", F.md5(F.array_join("evidences", ",")).alias("evidences_md5"), "entry_date")


_JUDGED = "(SELECT l_orderkey, l_linenumber::VARCHAR AS category, unnest(['judgment_1', 'judgment_2', 'judgment_3']) AS run, unnest([l_returnflag <> 'R', l_linestatus = 'O', l_tax < 0.05]) AS ok FROM lineitem)"


@query(
    f"""WITH j AS {_JUDGED}, r AS (SELECT CASE WHEN grouping(category) = 1 THEN 'all' ELSE category END AS scope, run, avg(ok::INT) AS x FROM j GROUP BY GROUPING SETS ((run), (run, category)))
    SELECT scope, count(*) AS runs, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM r GROUP BY 1"""
)
def a14_judge_accuracy(spark, sf):
    """Accuracy of each judge run, then mean and population deviation of the runs, over all and by category."""
    l = T.read(spark, sf, "lineitem")
    runs = F.create_map(F.lit("judgment_1"), F.col("l_returnflag") != "R", F.lit("judgment_2"), F.col("l_linestatus") == "O", F.lit("judgment_3"), F.col("l_tax") < 0.05)
    return profiles.judge_accuracy(l.select(F.col("l_linenumber").cast("string").alias("category"), runs.alias("judgments")))


_HITS20 = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_KNN})) WHERE rank <= 20)"


@query(
    f"""WITH h AS {_HITS20}, s AS (SELECT DISTINCT query_id, label FROM h JOIN embeddings ON vec_id = doc_id WHERE rank <= 5), e AS (SELECT DISTINCT q AS query_id, label FROM (SELECT vec_id AS q, unnest([vec_id + 1, vec_id + 2, vec_id + 3, vec_id + 4]) AS ev FROM embeddings WHERE vec_id % 20 = 0) JOIN embeddings v ON v.vec_id = ev)
    SELECT e.query_id, count(*) AS evidence_clusters, count(s.label) AS covered, round(count(s.label) / count(*), 6) AS coverage FROM e LEFT JOIN s USING (query_id, label) GROUP BY 1"""
)
def a17_cluster_coverage(spark, sf):
    """Which share of the clusters of a query's evidences (the four vectors after it) its best five hits lie in."""
    v = T.read(spark, sf, "embeddings").select("vec_id", "label")
    q = F.col("vec_id")
    evidence = v.filter("vec_id % 20 = 0").select(q.alias("query_id"), F.explode(F.array(q + 1, q + 2, q + 3, q + 4)).alias("vec_id")).join(v, "vec_id").select("query_id", "label").distinct()
    chosen = r6_knn(spark, sf).filter("rank <= 5").select("query_id", F.col("doc_id").alias("vec_id")).join(v, "vec_id").select("query_id", "label").distinct().withColumn("hit", F.lit(1))
    both = evidence.join(chosen, ["query_id", "label"], "left")
    found = both.groupBy("query_id").agg(F.count("*").alias("evidence_clusters"), F.count("hit").alias("covered"))
    return found.withColumn("coverage", F.round(F.col("covered") / F.col("evidence_clusters"), 6))


@query("SELECT conv_id, array_to_string(list_sort(list(DISTINCT id)), ',') AS participants FROM (SELECT conv_id, role AS id FROM conversations UNION ALL SELECT conv_id, unnest(CASE WHEN turn % 3 = 0 THEN ['u' || (turn % 5), 'user'] ELSE [] END) FROM conversations) WHERE id IS NOT NULL GROUP BY 1")
def a20_participants(spark, sf):
    """Who speaks in a unit or is referred to in it."""
    refs = F.when(F.col("turn") % 3 == 0, F.array(F.concat(F.lit("u"), F.col("turn") % 5), F.lit("user"))).otherwise(F.array().cast("array<string>"))
    c = T.read(spark, sf, "conversations").select("conv_id", F.array_append(refs, F.col("role")).alias("ids"))
    ids = c.select("conv_id", F.explode("ids").alias("id")).filter("id is not null").distinct()
    return ids.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("participants"))


@query("SELECT user_id, arg_max(run, no * 10000000000 + o) AS run, max(no) AS no FROM (SELECT o_custkey AS user_id, o_orderkey AS o, CASE WHEN o_orderkey % 5 = 0 THEN 'conv' || o_custkey ELSE 'conv' || o_custkey || '_run' || (o_orderkey % 997) END AS run, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 997 END AS no FROM orders) GROUP BY 1")
def w12_latest_run(spark, sf):
    """The run of each conversation with the highest number at its name's end; a name without one counts as run 0."""
    o = T.read(spark, sf, "orders")
    name = F.concat(F.lit("conv"), "o_custkey")
    run = F.when(F.col("o_orderkey") % 5 == 0, name).otherwise(F.concat(name, F.lit("_run"), F.col("o_orderkey") % 997))
    no = F.coalesce(F.nullif(F.regexp_extract("run", r"_run(\d+)$", 1), F.lit("")).cast("long"), F.lit(0))
    rows = o.select(F.col("o_custkey").alias("user_id"), "o_orderkey", run.alias("run")).withColumn("no", no)
    return rows.groupBy("user_id").agg(F.max_by("run", F.struct("no", "o_orderkey")).alias("run"), F.max("no").alias("no"))


@query(
    f"""SELECT user_id, arg_min(event_id, (CASE WHEN event_type = 'purchase' AND at < newest - 1209600 THEN 0 ELSE 1 END) * 10000000000000000 + at * 1000000 + event_id) AS evicted
    FROM (SELECT *, max(at) OVER () AS newest FROM {_EVENTS}) GROUP BY 1"""
)
def t5_eviction(spark, sf):
    """The topic to go: one that is implemented (here a purchase) and inactive for two weeks comes first, then the one longest inactive."""
    e = T.behaviors(spark, sf).select("user_id", F.col("event_id").alias("topic_id"), F.when(F.col("event_type") == "purchase", "implemented").otherwise("exploring").alias("status"), F.col("at").alias("last_at"))
    now = e.agg(F.max("last_at").alias("now"))
    return e.crossJoin(F.broadcast(now)).groupBy("user_id").agg(profiles.evicted(F.col("now"), 14 * 86400).alias("evicted"))  # now: one row


@query(
    f"""WITH h AS {_HITS20}, n AS (SELECT query_id, unnest([doc_id - 1, doc_id + 1]) AS doc_id FROM h WHERE rank <= 5), a AS (SELECT query_id, doc_id, 0 AS no FROM h WHERE rank <= 5 UNION ALL SELECT query_id, doc_id, 1 FROM h UNION ALL SELECT query_id, doc_id, 2 FROM n WHERE doc_id IN (SELECT vec_id FROM embeddings))
    SELECT query_id, doc_id, CASE min(no) WHEN 0 THEN 'round1' WHEN 1 THEN 'round2' ELSE 'cluster' END AS origin FROM a GROUP BY 1, 2"""
)
def u4_origins(spark, sf):
    """Where a document comes from: the first round (the best five), the second (the best twenty) or expansion (the vectors next to the best five)."""
    hits, d = r6_knn(spark, sf), F.col("doc_id")
    near = hits.filter("rank <= 5").select("query_id", F.explode(F.array(d - 1, d + 1)).alias("doc_id")).join(T.read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    return rank.origins(("round1", hits.filter("rank <= 5")), ("round2", hits), ("cluster", near))


# versioned profiles


@query(
    f"""WITH o AS (SELECT user_id, version, arg_max(price, order_id) AS price FROM {_VERSIONS} WHERE priority < '3' GROUP BY 1, 2), n AS (SELECT user_id, CASE WHEN order_id % 2 = 0 THEN version END AS version, price, order_id AS seq FROM {_VERSIONS} WHERE priority > '4'),
    t AS (SELECT user_id, max(version) AS top FROM o GROUP BY 1), g AS (SELECT n.user_id, coalesce(n.version, t.top) AS version, price, seq FROM n LEFT JOIN t USING (user_id)), u AS (SELECT user_id, version, arg_max(price, seq) AS price FROM g WHERE version IS NOT NULL GROUP BY 1, 2),
    m AS (SELECT coalesce(o.user_id, u.user_id) AS user_id, coalesce(o.version, u.version) AS version, coalesce(u.price, o.price) AS price FROM o FULL JOIN u ON o.user_id = u.user_id AND o.version = u.version)
    SELECT user_id, version, price, version = max(version) OVER (PARTITION BY user_id) AS is_latest, NULL::BIGINT AS failed FROM m UNION ALL SELECT user_id, NULL, NULL, NULL, count(*) FROM g WHERE version IS NULL GROUP BY 1"""
)
def p1_versioned_upsert(spark, sf):
    """Profiles with updates: those with a version update or make it, others update the latest one there was; those of users without any
    profile fail, with their number."""
    v = T.profile_versions(spark, sf)
    old = v.filter("priority < '3'").groupBy("user_id", "version").agg(F.max_by("price", "order_id").alias("price"))
    new = v.filter("priority > '4'").select("user_id", F.when(F.col("order_id") % 2 == 0, F.col("version")).alias("version"), "price", F.col("order_id").alias("seq"))
    rows, failed = profiles.versioned_upsert(old, new, ["user_id"], "version", ["price"], "seq")
    none = lambda t: F.lit(None).cast(t)
    lost = failed.groupBy("user_id").agg(F.count("*").alias("failed")).select("user_id", none("bigint").alias("version"), none("double").alias("price"), none("boolean").alias("is_latest"), "failed")
    return rows.select("user_id", "version", "price", "is_latest", none("bigint").alias("failed")).unionByName(lost)


@query(
    f"""WITH f AS (SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS cluster_ids FROM (SELECT user_id, event_type, min(event_id) AS first FROM {_EVENTS} GROUP BY 1, 2) GROUP BY 1)
    SELECT user_id, count(*) AS version, any_value(cluster_ids) AS cluster_ids, arg_max(event_type, event_id) AS last_cluster FROM events JOIN f USING (user_id) GROUP BY 1"""
)
def p2_profile_state(spark, sf):
    """Each event saves its user's profile for the cluster of its type: the version counts saves, clusters are listed once."""
    return profiles.save_state(T.read(spark, sf, "events").select("user_id", F.col("event_type").alias("cluster_id"), F.col("event_id").alias("seq")), ["user_id"])


@query("SELECT event_id FROM events WHERE event_type = 'purchase' AND round(value / 200, 2) >= 0.6 AND event_id % 10 <> 0")
def p4_value_gate(spark, sf):
    """A model's answers, as JSON, kept if they say high value with a confidence of 0.6 or more; answers that can't be read don't."""
    e = T.read(spark, sf, "events")
    told = F.to_json(F.struct((F.col("event_type") == "purchase").alias("is_high_value"), F.round(F.col("value") / 200, 2).alias("confidence")))
    answers = e.select("event_id", F.when(F.col("event_id") % 10 == 0, "no idea").otherwise(told).alias("answer"))
    return answers.filter(profiles.high_value(F.col("answer"))).select("event_id")


@query(
    """WITH c AS (SELECT o_custkey AS profile_id, o_orderstatus AS field, o_orderkey AS pos, 'S' || (o_orderkey % 5) AS value, 'n' || (o_orderkey % 2) AS note FROM orders), d AS (SELECT profile_id, field, pos, value, CASE WHEN pos % 3 = 0 THEN 'new' ELSE note END AS note, profile_id % 50 AS ev FROM c WHERE pos % 4 <> 1),
    m AS (SELECT d.profile_id, d.field, d.pos AS dpos, d.ev, c.pos, row_number() OVER (PARTITION BY d.profile_id, d.field, d.pos ORDER BY CASE WHEN d.note = c.note THEN 0 ELSE 1 END, c.pos) AS nth FROM d JOIN c ON d.profile_id = c.profile_id AND d.field = c.field AND d.value = c.value),
    e AS (SELECT profile_id, field, pos, strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderkey AS evidence FROM m JOIN orders ON o_orderkey = ev WHERE nth = 1)
    SELECT c.profile_id, c.field, c.pos, coalesce(any_value(evidence), 'old') AS evidences FROM c LEFT JOIN e USING (profile_id, field, pos) GROUP BY 1, 2, 3"""
)
def p7_merged_evidences(spark, sf):
    """Evidences of completed items go to the item that is equal but for them, else to the first with the same value. A customer's orders are
    its profile's items, every third completed item was changed, evidences are orders, and unknown ones go."""
    o, no = T.read(spark, sf, "orders"), F.col("o_orderkey")
    item = lambda note: F.create_map(F.lit("value"), F.concat(F.lit("S"), no % 5), F.lit("note"), note)
    note = F.concat(F.lit("n"), no % 2)
    key = [F.col("o_custkey").alias("profile_id"), F.col("o_orderstatus").alias("field"), no.alias("pos")]
    original = o.select(*key, item(note).alias("item"), F.array(F.lit("old")).alias("evidences"))
    completed = o.filter(no % 4 != 1).select(*key, item(F.when(no % 3 == 0, "new").otherwise(note)).alias("item"), F.array((F.col("o_custkey") % 50).cast("string")).alias("evidences"))
    dates = o.select(F.col("o_orderkey").cast("string").alias("evidence"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    merged = profiles.merge_item_evidences(original, completed, dates, ["profile_id", "field"])
    return merged.select("profile_id", "field", "pos", F.array_join("evidences", ",").alias("evidences"))


@query(
    f"""WITH b AS (SELECT conv_id % 10 AS batch, conv_id, CASE WHEN conv_id % 4 > 0 THEN 1704067200 + conv_id * 3600 - 60 END AS unit_at, min(at) AS first_at, arg_min(at, turn) AS said_at, CASE WHEN conv_id % 3 > 0 THEN 'g' || conv_id END AS grp FROM {_MESSAGES} GROUP BY conv_id)
    SELECT batch, conv_id, strftime(to_timestamp(coalesce(unit_at, said_at)) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date, arg_min(grp, CASE WHEN grp IS NOT NULL THEN conv_id END) OVER (PARTITION BY batch) AS group_id FROM b"""
)
def p13_unit_dates(spark, sf):
    """A unit's date is that of its own time, else of its first message; a batch's group is the first that is known."""
    first = T.messages(spark, sf).groupBy("conv_id").agg(F.min_by("at", "turn").alias("said_at"))
    c = F.col("conv_id")
    units = first.select((c % 10).alias("batch"), c.alias("unit_id"), F.when(c % 4 > 0, F.lit(1_704_067_200) + c * 3600 - 60).alias("unit_at"), "said_at", F.when(c % 3 > 0, F.concat(F.lit("g"), c)).alias("grp"))
    return profiles.unit_dates(units).select("batch", F.col("unit_id").alias("conv_id"), "date", "group_id")


_VOTED = "(SELECT l_orderkey, l_linenumber, l_shipmode AS category, (l_returnflag <> 'R')::INT + (l_linestatus = 'O')::INT + (l_tax < 0.05)::INT >= 2 AS ok FROM (SELECT *, 'c' || (l_linenumber % 3) AS l_shipmode FROM lineitem))"


@query(f"SELECT category, l_orderkey AS conversation, count(*) FILTER (NOT ok) AS wrong, count(*) AS n, string_agg(CASE WHEN NOT ok THEN l_linenumber::VARCHAR END, ',' ORDER BY l_linenumber) AS questions FROM {_VOTED} GROUP BY 1, 2 HAVING count(*) FILTER (NOT ok) > 0")
def e2_wrong_answers(spark, sf):
    """Questions that fewer than two of three judges call right, by category and conversation."""
    l = T.read(spark, sf, "lineitem")
    votes = (F.col("l_returnflag") != "R").cast("int") + (F.col("l_linestatus") == "O").cast("int") + (F.col("l_tax") < 0.05).cast("int")
    rows = l.select(F.concat(F.lit("c"), F.col("l_linenumber") % 3).alias("category"), F.col("l_orderkey").alias("conversation"), "l_linenumber", (votes >= 2).alias("ok"))
    missed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("l_linenumber"))))
    found = rows.groupBy("category", "conversation").agg(F.count(F.when(~F.col("ok"), 1)).alias("wrong"), F.count("*").alias("n"), F.array_join(F.transform(missed, lambda x: x.cast("string")), ",").alias("questions"))
    return found.filter("wrong > 0")
