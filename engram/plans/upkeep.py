"""Registered queries of evaluation sources, profile payloads and merges, conversation status and queues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engram import tables as T
from engram.operators import profiles
from engram.plans.lookups import _joined
from engram.plans.queries import _EVENTS, _EVIDENCE_SQL, _MESSAGES, _value_rows, query
from engram.sources import converters

# sources


@query(
    f"""SELECT CASE WHEN turn % 3 = 0 THEN 'q' || conv_id || '-' || turn ELSE conv_id || '_qa' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) END AS question_id, conv_id::VARCHAR AS conv_id, md5(content) AS question_md5,
    (turn % 4)::VARCHAR AS category, 0::BIGINT AS evidences FROM {_MESSAGES} WHERE sender = 'user'"""
)
def s4_qa_pairs(spark, sf):
    pair = F.struct(
        "turn", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("q"), "conv_id", F.lit("-"), "turn")).alias("question_id"), F.col("content").alias("question"),
        F.lit(None).cast("string").alias("answer"), (F.col("turn") % 4).alias("category"), F.lit(None).cast("array<string>").alias("evidence"),
    )
    nested = T.messages(spark, sf).filter("sender = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(pair)).alias("qa"))
    rows = converters.qa_pairs(nested)
    return rows.select("question_id", "conv_id", F.md5("question").alias("question_md5"), "category", F.size("evidence").cast("long").alias("evidences"))


@query(
    f"""WITH m AS (SELECT conv_id // 4 AS q, conv_id % 4 AS session, turn, sender, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS no FROM {_MESSAGES})
    SELECT 'h' || q AS question_id, 'D' || (dense_rank() OVER (PARTITION BY q ORDER BY session) - 1) || ':' || no AS dia_id, sender || '_h' || q AS speaker, session = 1 AS is_evidence, '2:0' || session || ' am on 5 March, 2024' AS session_time FROM m"""
)
def s5_haystack(spark, sf):
    """Four conversations are one haystack; the second holds the answer."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("sender").alias("role"), "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    s = T.messages(spark, sf).groupBy("conv_id").agg(said.alias("messages"))
    session = F.col("conv_id") % 4
    one = F.struct(session.alias("session"), F.concat(F.lit("2024/03/05 (Tue) 02:0"), session).alias("date"), "messages")
    rows = s.groupBy(F.concat(F.lit("h"), F.floor(F.col("conv_id") / 4)).alias("question_id")).agg(F.array_sort(F.collect_list(one)).alias("s"))
    rows = rows.select(
        "question_id", F.col("s.session").alias("haystack_session_ids"), F.col("s.date").alias("haystack_dates"), F.col("s.messages").alias("haystack_sessions"), F.array(F.lit(1).cast("long")).alias("answer_session_ids")
    )
    return converters.haystack(rows).select("question_id", "dia_id", "speaker", "is_evidence", "session_time")


@query(
    f"""WITH m AS (SELECT conv_id, turn, sender, content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS no FROM {_MESSAGES}), e AS (SELECT conv_id, unnest([1, 3]) AS end_index FROM m GROUP BY 1)
    SELECT conv_id AS context_id, end_index, 'D0:' || (row_number() OVER (PARTITION BY conv_id, end_index ORDER BY no) - 1) AS dia_id, CASE sender WHEN 'user' THEN 'User' ELSE 'Assistant' END AS speaker, md5(trim(content)) AS text_md5
    FROM (SELECT * FROM m JOIN e USING (conv_id) WHERE no <= end_index AND sender <> 'system')"""
)
def s6_persona(spark, sf):
    """Two questions end in each conversation."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("sender").alias("role"), F.concat(F.initcap("sender"), F.lit(": "), "content").alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    contexts = T.messages(spark, sf).groupBy(F.col("conv_id").alias("context_id")).agg(said.alias("messages"))
    asked = contexts.select(F.col("context_id").alias("shared_context_id"), F.explode(F.array(F.lit(1), F.lit(3))).alias("end_index_in_shared_context"))
    rows = converters.persona_dialogues(asked, contexts)
    return rows.select("context_id", "end_index", "dia_id", "speaker", F.md5("text").alias("text_md5"))


@query("SELECT vec_id % 7 AS conv_id, label::BIGINT AS cluster_id, 't' || label AS topic, vec_id AS unit_id FROM embeddings")
def s7_cluster_index(spark, sf):
    """Clusters of each conversation to JSON and back."""
    e = T.read(spark, sf, "embeddings").select((F.col("vec_id") % 7).alias("conv_id"), F.col("label").cast("long").alias("cluster_id"), F.col("vec_id").alias("unit_id"), F.col("vec_id").alias("at"))
    named = e.select("conv_id", "cluster_id").distinct().withColumn("topic", F.concat(F.lit("t"), "cluster_id"))
    return converters.index_from_json(converters.index_to_json(named, e)).select("conv_id", "cluster_id", "topic", "unit_id")


@query("SELECT min(doc_id) AS unit_id, source AS group_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL GROUP BY source, text")
def s14_re_export(spark, sf):
    """Index rows made anew, equal rows of a group once."""
    d = T.read(spark, sf, "documents").filter("text is not null").select("doc_id", F.col("source").alias("group_id"), F.md5("text").alias("text_md5"))
    return d.groupBy("group_id", "text_md5").agg(F.min("doc_id").alias("unit_id"))


# payloads and merges

_SHAPES = """CASE p_size % 5 WHEN 0 THEN '{"value":" V' || p_partkey || '","evidences":["e1","e2","e1"],"level":"high"}' WHEN 1 THEN '{"V' || p_partkey || '":["e1","e2"]}'
    WHEN 2 THEN '[{"value":"V' || p_partkey || '","evidences":["e1"],"level":"low"},{"value":"V' || p_partkey || '","evidences":"e2","level":"high"}]'
    WHEN 3 THEN '[{"V' || p_partkey || '":"unused","evidences":["e1","e2"],"level":"high"}]' ELSE '["V' || p_partkey || '"," "]' END"""


@query("SELECT p_partkey AS id, 'V' || p_partkey AS value, CASE WHEN p_size % 5 < 4 THEN 'e1,e2' ELSE '' END AS evidences, CASE WHEN p_size % 5 IN (0, 2, 3) THEN 'high' END AS level FROM part")
def p6_payloads(spark, sf):
    """Payloads in five shapes."""
    rows = T.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr(_SHAPES).alias("payload"))
    merged = profiles.merge_values(profiles.payload_rows(rows, "id", "payload"), ["id"])
    return merged.select("id", "value", F.array_join(F.array_compact("evidences"), ",").alias("evidences"), "level")


@query(
    """SELECT order_id, string_agg(flag || ':' || lines, ';' ORDER BY flag) AS kept FROM (SELECT l_orderkey AS order_id, l_returnflag AS flag, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS lines
    FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2) GROUP BY 1"""
)
def p8_pruned(spark, sf):
    """Entries without evidence go, then fields without entries, then profiles without fields."""
    entry = F.struct(F.col("l_linenumber").alias("value"), F.when(F.col("l_quantity") > 25, F.array("l_suppkey")).otherwise(F.array()).alias("evidences"))
    fields = T.read(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    whole = fields.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_returnflag").alias("field"), "entries"))).alias("fields"))
    whole = whole.withColumn("fields", profiles.pruned(F.col("fields"))).filter(F.size("fields") > 0)
    shown = F.transform("fields", lambda f: F.concat(f["field"], F.lit(":"), F.array_join(F.transform(f["entries"], lambda e: e["value"].cast("string")), ",")))
    return whole.select("order_id", F.array_join(shown, ";").alias("kept"))


@query("""SELECT l_orderkey AS order_id, '[' || string_agg('{"value":' || l_linenumber || ',"level":"' || l_returnflag || '"}', ',' ORDER BY l_linenumber, l_returnflag) || ']' AS compact FROM lineitem GROUP BY 1""")
def p9_without_evidences(spark, sf):
    entry = F.struct(F.col("l_linenumber").alias("value"), F.col("l_returnflag").alias("level"), F.array("l_suppkey").alias("evidences"))
    rows = T.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return rows.select("order_id", F.to_json(F.transform("entries", lambda e: e.dropFields("evidences"))).alias("compact"))


@query(
    f"""WITH n AS (SELECT event_type AS topic, user_id, event_id, at FROM {_EVENTS} WHERE value > 20), o AS (SELECT event_type AS topic, user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS pos FROM events WHERE event_id % 5 = 0),
    f AS (SELECT topic, user_id, event_id, 0 AS part, pos AS ord, (SELECT max(at) FROM n WHERE n.event_id = o.event_id) AS at FROM o UNION ALL SELECT topic, user_id, event_id, 1, at, at FROM n WHERE event_id NOT IN (SELECT event_id FROM o)),
    k AS (SELECT *, row_number() OVER (PARTITION BY topic, user_id ORDER BY part DESC, ord DESC, event_id::VARCHAR DESC) AS nth FROM f)
    SELECT topic, user_id, string_agg(event_id, ',' ORDER BY nth DESC) AS evidences, max(at) AS last_at FROM k WHERE nth <= 10 GROUP BY 1, 2"""
)
def p10_topic_evidences(spark, sf):
    """A topic's evidences: the old ones, then new ones by time, the last ten; when it was last active."""
    e = T.behaviors(spark, sf).select(F.col("event_type").alias("topic"), "user_id", F.col("event_id").alias("evidence"), "at", "value")
    pos = F.row_number().over(Window.partitionBy("user_id", "topic").orderBy("evidence"))
    old = e.filter("evidence % 5 = 0").withColumn("pos", pos)
    merged = profiles.merge_evidences(old, e.filter("value > 20"), ["topic", "user_id"], 10)
    return merged.select("topic", "user_id", F.array_join("evidences", ",").alias("evidences"), "last_at")


_ROLE = "CASE l_linenumber WHEN 1 THEN 'coordinator' WHEN 2 THEN 'opinion_leader' WHEN 3 THEN 'joker' ELSE 'decision_maker' END"


@query(
    f"""WITH r AS (SELECT l_suppkey AS user_id, {_ROLE} AS role, l_orderkey AS unit, l_linestatus = 'F' AS known, l_returnflag = 'R' AS strong FROM lineitem WHERE l_suppkey % 3 <> l_orderkey % 3),
    f AS (SELECT role, user_id, unit, min(CASE WHEN known THEN 0 ELSE 1 END) AS part FROM r WHERE role <> 'joker' GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY role, user_id ORDER BY part DESC, unit DESC) AS nth FROM f)
    SELECT role, user_id, any_value(confidence) AS confidence, md5(string_agg(unit::VARCHAR, ',' ORDER BY nth DESC)) AS evidences_md5 FROM k JOIN (SELECT role, user_id, CASE WHEN bool_or(strong) THEN 'strong' ELSE 'weak' END AS confidence FROM r GROUP BY 1, 2) USING (role, user_id) WHERE nth <= 50 GROUP BY 1, 2"""
)
def p11_roles(spark, sf):
    """History (lines of one status) and new findings (the others): known roles of participants, strong stays strong, old evidences and then
    new ones, the last fifty. A unit's participants are those suppliers whose number differs from its own by three's remainder."""
    l = T.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("user_id"), F.expr(_ROLE).alias("role"), F.col("l_orderkey").alias("unit"), (F.col("l_linestatus") == "F").alias("known"), (F.col("l_returnflag") == "R").alias("strong"))
    valid = l.filter(F.col("role").isin(profiles.ROLES) & (F.col("user_id") % 3 != F.col("unit") % 3))
    strong = F.when(F.max("strong"), "strong").otherwise("weak")
    sizes = valid.groupBy("role", "user_id").agg(strong.alias("confidence"))
    of = lambda known, at: valid.filter(F.col("known") == known).select("role", "user_id", F.col("unit").alias("evidence"), F.col("unit").alias(at))
    merged = profiles.merge_evidences(of(True, "pos"), of(False, "at"), ["role", "user_id"], 50)
    return merged.join(sizes, ["role", "user_id"]).select("role", "user_id", "confidence", F.md5(F.array_join("evidences", ",")).alias("evidences_md5"))


@query(f"WITH m AS (SELECT user_id, event_type, event_id, at, row_number() OVER (PARTITION BY user_id, event_type ORDER BY at DESC, event_id DESC) AS nth, count(*) OVER (PARTITION BY user_id, event_type) AS n, bool_or(value > 60) OVER (PARTITION BY user_id, event_type) AS watched FROM {_EVENTS}) SELECT user_id, event_type, event_id FROM m WHERE watched AND n >= 3 AND nth <= 5")
def p3_extraction_batch(spark, sf):
    """Of watched clusters of three or more, the newest five units; a valuable unit makes its cluster watched."""
    e, key = T.behaviors(spark, sf), ["user_id", "event_type"]
    due = e.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.col("value") > 60).alias("watched")).filter("watched and n >= 3").select(*key)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("at"), F.desc("event_id")))
    return e.withColumn("nth", nth).filter("nth <= 5").join(due, key, "left_semi").select("user_id", "event_type", "event_id")


_GROUPED = "(SELECT *, coalesce(max(important) FILTER (important) OVER (PARTITION BY user_id), false) AS some FROM (SELECT l_suppkey AS user_id, l_returnflag <> 'R' AND l_suppkey % 4 > 0 AS important, l_shipdate, l_partkey, l_orderkey, l_linenumber FROM lineitem))"


@query(
    _EVIDENCE_SQL.format(level="CASE WHEN l_linenumber > 4 THEN 'low' ELSE 'high' END", pick="arg_min(level, (CASE level WHEN 'high' THEN 0 ELSE 1 END) * 1000000000000 + seq)")
    .replace("l_suppkey AS user_id", "l.user_id").replace("FROM lineitem JOIN part", f"FROM {_GROUPED} l JOIN part").replace("AS level FROM " + _GROUPED + " l JOIN part ON l_partkey = p_partkey", "AS level FROM " + _GROUPED + " l JOIN part ON l_partkey = p_partkey WHERE l.important OR NOT l.some")
)
def a11_groups_merged(spark, sf):
    """Only important groups count; suppliers without any count with all."""
    level = F.when(F.col("l_linenumber") > 4, "low").otherwise("high")
    rows = _value_rows(spark, sf, level, "l_returnflag").withColumn("important", (F.col("l_returnflag") != "R") & (F.col("user_id") % 4 > 0))
    rows = rows.select("user_id", F.col("l_returnflag").alias("group_id"), "important", F.lit("hard_skills").alias("field"), "value", "level", "evidence", "seq")
    return profiles.merge_groups(rows, ["hard_skills"]).select("user_id", "value", F.array_join("evidences", ",").alias("evidences"), "level")


@query("SELECT l_suppkey AS user_id, coalesce(nullif(CASE WHEN l_partkey % 2 = 0 THEN p_brand ELSE '' END, ''), p_type) AS project, min(l_orderkey * 10 + l_linenumber) AS first, count(DISTINCT l_orderkey) AS subtasks FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def a12_projects(spark, sf):
    """Projects by id, else by name, with their distinct subtasks."""
    rows = _value_rows(spark, sf, F.lit(""), "l_partkey", "p_type")
    project = F.coalesce(F.nullif(F.when(F.col("l_partkey") % 2 == 0, F.col("value")).otherwise(""), F.lit("")), F.col("p_type"))
    return rows.groupBy("user_id", project.alias("project")).agg(F.min("seq").alias("first"), F.count_distinct("evidence").alias("subtasks"))


# status and queues


@query(f"SELECT user_id, min(at) AS first_at, max(at) FILTER (event_type = 'purchase') AS last_unit_at, coalesce(max(at) FILTER (event_type = 'purchase') * 1000 + 1, min(at) * 1000) AS new_start_ms FROM {_EVENTS} GROUP BY 1")
def k3_status(spark, sf):
    """A conversation's watermarks: after an extraction (here a purchase) new messages begin a millisecond later."""
    last = F.max(F.when(F.col("event_type") == "purchase", F.col("at")))
    return T.behaviors(spark, sf).groupBy("user_id").agg(F.min("at").alias("first_at"), last.alias("last_unit_at"), F.coalesce(last * 1000 + 1, F.min("at") * 1000).alias("new_start_ms"))


@query(f"SELECT event_id, user_id FROM (SELECT *, max(at) OVER (PARTITION BY user_id) AS newest FROM {_EVENTS}) WHERE at >= newest - 86400")
def k2_unexpired(spark, sf):
    """A key's buffered rows that are at most a day older than its newest."""
    newest = F.max("at").over(Window.partitionBy("user_id"))
    return T.behaviors(spark, sf).withColumn("newest", newest).filter("at >= newest - 86400").select("event_id", "user_id")


@query(
    f"""WITH d AS (SELECT user_id, event_type, at // 3600 AS hour, min(event_id) AS event_id, min(at) AS at FROM {_EVENTS} GROUP BY 1, 2, 3), c AS (SELECT * FROM d ORDER BY at, event_id LIMIT 1000)
    SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY at, event_id) AS place FROM c"""
)
def k6_group_queue(spark, sf):
    """Messages once each, the first thousand overall (the queue's cap), delivered by time within their group."""
    one = T.behaviors(spark, sf).groupBy("user_id", "event_type", F.floor(F.col("at") / 3600).alias("hour")).agg(F.min("event_id").alias("event_id"), F.min("at").alias("at"))
    kept = one.orderBy("at", "event_id").limit(1000)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("at", "event_id")).cast("long")
    return kept.select("user_id", "event_id", place.alias("place"))


@query(f"SELECT at // 3600 AS hour, count(*) AS total, count(*) < 12 OR count(DISTINCT user_id % 10) < 10 AS admitted FROM {_EVENTS} GROUP BY 1")
def k8_admission(spark, sf):
    """Each hour over ten queues: below the cap, or with an empty queue."""
    e = T.behaviors(spark, sf).groupBy(F.floor(F.col("at") / 3600).alias("hour"), (F.col("user_id") % 10).alias("queue")).agg(F.count("*").alias("n"))
    per = e.groupBy("hour").agg(F.sum("n").alias("total"), F.count("*").alias("filled"))
    return per.select("hour", "total", ((F.col("total") < 12) | (F.col("filled") < 10)).alias("admitted"))
