"""Registered queries of text analysis, annotation and question routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram import tables as T
from engram.functions import questions as Q
from engram.functions import text as X
from engram.plans.lookups import _joined
from engram.plans.queries import _UNITS, query

_COUNTS = {k: f"len(regexp_extract_all(narrative, '{p}'))" for k, (_, p) in X.TEXT_SCORES.items()}
_COUNTS["other"] = r"length(regexp_replace(narrative, '[一-鿿㐀-䶿A-Za-z0-9!-/:-@\[-`{-~\s]', '', 'g'))"


@query("SELECT unit_id, round(" + " + ".join(f"{_COUNTS[k]} * {w}::DOUBLE" for k, w in [*((k, w) for k, (w, _) in X.TEXT_SCORES.items()), ("other", 0.5)]) + f", 3) AS score FROM {_UNITS}")
def x3_text_score(spark, sf):
    return T.memunits(spark, sf).select("unit_id", F.round(X.text_score(F.col("narrative")), 3).alias("score"))


@query("SELECT unit_id, " + ", ".join(f"{e} AS {k}_n" for k, e in _COUNTS.items()) + f" FROM {_UNITS}")
def x5_text_classes(spark, sf):
    counts = X.class_counts(F.col("narrative"))
    return T.memunits(spark, sf).select("unit_id", *[c.cast("long").alias(f"{k}_n") for k, c in counts.items()])


@query(
    rf"""WITH t AS (SELECT unit_id, narrative, regexp_extract_all(narrative, '(?s)[A-Za-z]+|[0-9]+|\s+|.') AS t FROM {_UNITS}),
    p AS (SELECT *, list_filter(range(1, len(t) + 1), lambda i: regexp_full_match(t[i], '[A-Za-z]+|[0-9]+'))[21] AS p FROM t)
    SELECT unit_id, CASE WHEN p IS NULL OR p = len(t) THEN narrative ELSE regexp_replace(array_to_string(t[1:p], ''), '\s+$', '') || '...' END AS head FROM p"""
)
def x4_truncated(spark, sf):
    """The first 20 words and numbers; 21 are within the 5 % that a whole word may exceed."""
    weights = {"cjk": 1.0, "word": 1.0, "number": 1.0, "punctuation": 0.0, "whitespace": 0.0, "other": 0.0}
    return T.memunits(spark, sf).select("unit_id", X.truncated(F.col("narrative"), 20, weights).alias("head"))


@query(
    """SELECT o_orderkey AS id, o_orderpriority || ' due Tomorrow (' || strftime(d + 1, '%Y-%m-%d') || '), not last week (2024-01-01) but 上个月 (' || strftime(date_trunc('month', d) - INTERVAL 1 DAY, '%Y-%m-%d')
    || ') or next month (' || strftime(date_trunc('month', d) + INTERVAL 2 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') || ')' AS text FROM (SELECT *, o_orderdate::DATE AS d FROM orders)"""
)
def x11_relative_dates(spark, sf):
    text = F.concat("o_orderpriority", F.lit(" due Tomorrow, not last week (2024-01-01) but 上个月 or next month"))
    return T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), X.relative_dates(text, F.to_date("o_orderdate")).alias("text"))


@query("SELECT c_custkey AS id, '@' || c_name || '(user_id:' || c_custkey || ') saw @' || n_name || '(user_id:n' || n_nationkey || '), not ' || c_name AS text FROM customer JOIN nation ON c_nationkey = n_nationkey")
def x12_mentions(spark, sf):
    n = T.read(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = T.read(spark, sf, "customer").join(n, "c_nationkey")
    text = F.concat(F.lit("@"), "c_name", F.lit(" saw @"), "n_name", F.lit(", not "), "c_name")
    ref = lambda name, i: F.struct(F.col(name).alias("name"), i.alias("user_id"))
    refs = F.array(ref("c_name", F.col("c_custkey").cast("string")), ref("n_name", F.concat(F.lit("n"), "c_nationkey")))
    return c.select(F.col("c_custkey").alias("id"), X.mentions(text, refs).alias("text"))


@query(
    r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/pics/' || page_id || '.jpg' ELSE 'https://cdn.example.com/b.png' END AS image FROM pages"""
)
def x19_first_image(spark, sf):
    """The tables' pages have no images, so tags are put in: decorative and small ones, then a usable one."""
    skipped = F.lit('<img src="/static/LOGO.png"><img width="50" height="400" src="/a.jpg">')
    usable = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("<img alt='x' src='/pics/"), "page_id", F.lit(".jpg' width='100' height='100'>")))
    usable = usable.when(F.col("page_id") % 3 == 2, F.lit('<img width="20" src="https://cdn.example.com/b.png">')).otherwise("")
    return T.read(spark, sf, "pages").select("page_id", X.first_image(F.concat("html", skipped, usable), F.col("url")).alias("image"))


@query(
    """SELECT l_orderkey AS unit_id, string_agg(l_returnflag || l_linenumber, ' ' ORDER BY l_linenumber, l_returnflag) AS keyword_text,
    CASE WHEN l_orderkey % 2 = 0 THEN any_value(strftime(o_orderdate, '%Y-%m-%d')) || '：' ELSE '' END || string_agg(l_returnflag || l_linenumber, ' ' ORDER BY l_linenumber, l_returnflag) AS rerank_text
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey"""
)
def x20_fact_text(spark, sf):
    """Facts for keyword search, and with their time for reranking; odd units have no time."""
    l = T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit_id"), "l_linenumber", F.concat("l_returnflag", "l_linenumber").alias("fact"))
    facts = l.groupBy("unit_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "fact"))), lambda x: x["fact"]).alias("facts"))
    o = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("time"))
    return facts.join(o, "unit_id").select("unit_id", F.array_join("facts", " ").alias("keyword_text"), X.fact_text(F.col("time"), F.col("facts")).alias("rerank_text"))


_ASKED = {  # question of part k by its size: asked text, expected type
    0: ("How many times did A{} run", "counting"), 1: ("when did A{} go home", "event_temporal"), 2: ("What hobbies does A{} have", "event_activity"),
    3: ("What kinds of pots did A{} make", "event_aggregation"), 4: (" Who is A{}", "attribute_identity"), 5: ("What does A{} like", "attribute_preference"),
    6: ("Where is A{} from", "attribute_location"), 7: ("Would A{} likely move", "reasoning_hypothetical"), 8: ("How long ago was A{} born", "time_calculation"),
    9: ("What career path has A{} chosen", "general"), 10: ("So A{} is here", "general"), 11: ("What is A{}’s job", "attribute_identity"),
}
_STRATEGY = "CASE WHEN kind IN ('event_aggregation', 'reasoning_hypothetical', 'general') THEN 'gec_insert_after_hit' WHEN kind = 'event_activity' THEN 'gec_cluster_rerank' ELSE 'agentic_only' END"
_KINDS = "(SELECT p_partkey AS id, CASE p_size % 12 " + " ".join(f"WHEN {k} THEN '{t}'" for k, (_, t) in _ASKED.items()) + " END AS kind FROM part)"


def _kinds(spark, sf):
    p = T.read(spark, sf, "part")
    asked = F.create_map(*[F.lit(x) for k, (q, _) in _ASKED.items() for x in (k, q)])
    text = F.replace(asked[F.col("p_size") % 12], F.lit("{}"), F.col("p_partkey").cast("string"))
    return p.select(F.col("p_partkey").alias("id"), Q.classify(text).alias("k"))


@query(f"SELECT id, kind, {_STRATEGY} AS strategy FROM {_KINDS}")
def r23_question_types(spark, sf):
    return _kinds(spark, sf).select("id", F.col("k.type").alias("kind"), F.col("k.strategy").alias("strategy"))


@query(f"SELECT strategy, count(*) AS n FROM (SELECT CASE WHEN kind = 'counting' THEN 'gec_cluster_rerank' ELSE {_STRATEGY} END AS strategy FROM {_KINDS}) GROUP BY 1")
def r24_routing(spark, sf):
    """One type is overridden; the override of another names no strategy and is passed over."""
    overrides = {"counting": "gec_cluster_rerank", "general": "unknown"}
    return _kinds(spark, sf).groupBy(Q.route(F.col("k"), overrides).alias("strategy")).agg(F.count("*").alias("n"))


@query(f"SELECT conv_id, md5(string_agg('[' || conv_id || ':' || turn || '] ' || sender || ': ' || content, chr(10) ORDER BY turn, sender, content)) AS transcript_md5 FROM (SELECT conv_id, turn, role AS sender, coalesce(text, '') AS content FROM conversations) GROUP BY 1")
def p12_group_transcript(spark, sf):
    """Lines with the id of their unit."""
    line = F.concat(F.lit("["), "conv_id", F.lit(":"), "turn", F.lit("] "), "sender", F.lit(": "), "content")
    m = T.messages(spark, sf).withColumn("line", line)
    return m.groupBy("conv_id").agg(F.md5(_joined(F.struct("turn", "sender", "content", "line"), "line", "\n")).alias("transcript_md5"))
