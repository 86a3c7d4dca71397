"""Registered queries of model answers, page metadata, dates, codes, stems and event clusters from decisions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from engram import tables as T
from engram.functions import text as X
from engram.functions.stems import stem
from engram.operators import clusters, profiles, rank
from engram.plans.lookups import _joined
from engram.plans.queries import _EVENTS, _MESSAGES, _TOKENS, _UNITS, _units, query
from engram.streaming import state

# scalar functions


@query()
def x1_stemmed_terms(spark, sf):
    """Documents of each stem. Only distinct words are stemmed; tested against known stems and a plain count."""
    words = rank.term_counts(rank.postings(_units(spark, sf), "unit_id", "narrative", X.STOPWORDS))

    @F.pandas_udf("string")
    def stems(w: pd.Series) -> pd.Series:
        return w.map(stem)

    return words.select(stems("term").alias("stem"), "cf").groupBy("stem").agg(F.count("*").alias("words"), F.sum("cf").alias("cf"))


@query(f"SELECT event_id, at * 1000 AS ms FROM {_EVENTS}")
def x7_any_time(spark, sf):
    """Times as seconds, milliseconds, text with an offset and text of another time zone."""
    local = F.replace((F.convert_timezone(F.current_timezone(), F.lit("Asia/Shanghai"), F.col("ts").cast("timestamp_ntz"))).cast("string").substr(1, 19), F.lit(" "), F.lit("T"))
    kind, at = F.col("event_id") % 4, F.col("at")
    shown = F.when(kind == 0, at.cast("string")).when(kind == 1, (at * 1000).cast("string")).when(kind == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX")).otherwise(local)
    return T.behaviors(spark, sf).select("event_id", X.any_epoch_ms(shown, F.lit("Asia/Shanghai")).alias("ms"))


@query(
    """SELECT l_orderkey AS order_id, l_linenumber::BIGINT AS line, CASE WHEN l_linenumber % 5 <> 4 THEN strftime(d, '%Y-%m-%d') END AS starts,
    CASE l_linenumber % 5 WHEN 0 THEN strftime(d + l_linenumber, '%Y-%m-%d') WHEN 1 THEN strftime(s, '%Y-%m-%d') WHEN 2 THEN strftime(s, '%Y-%m-%d') WHEN 4 THEN strftime(s, '%Y-%m-%d') END AS ends,
    CASE l_linenumber % 5 WHEN 0 THEN l_linenumber WHEN 1 THEN date_diff('day', d, s) WHEN 2 THEN l_linenumber END::BIGINT AS days FROM (SELECT *, o_orderdate::DATE AS d, l_shipdate::DATE AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
)
def x10_spans(spark, sf):
    """Dates with stray characters; an end from a duration, a duration from an end, both given, neither, and no start."""
    o = T.read(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("a"))
    l = T.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("b")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.col("l_linenumber") % 5
    start = F.when(kind == 4, "2024/05/xx").otherwise(F.concat(F.lit("on "), "a", F.lit(".")))
    end = F.when(kind.isin(1, 2, 4), F.concat("b", F.lit(" (end)"))).when(kind == 0, "soon")
    found = X.span(start, end, F.when(kind.isin(0, 2), F.col("l_linenumber")))
    return l.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line"), found.alias("s")).select("order_id", "line", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"), F.col("s.days").cast("long").alias("days"))


@query(
    f"""WITH m AS (SELECT *, strftime(to_timestamp(at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS t FROM {_MESSAGES})
    SELECT conv_id, md5(coalesce(string_agg(CASE WHEN content <> '' THEN '[' || t || '] ' || sender || ': ' || content END, chr(10) ORDER BY turn), '')) AS timed_md5,
    md5(string_agg('[' || t || '][conversation_id:' || conv_id || '] ' || sender || '(user_id:u' || (turn % 3) || '): ' || content, chr(10) ORDER BY turn)) AS profile_md5,
    md5(string_agg('{{"timestamp":"' || t || '","speaker":"' || sender || '","chars":' || length(content) || '}}', chr(10) ORDER BY turn)) AS json_md5 FROM m GROUP BY 1"""
)
def x13_transcripts(spark, sf):
    """Three ways to write a conversation: with times, without empty messages; with ids of conversation and users; as JSON lines."""
    t = F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd HH:mm:ss")
    said = F.concat("sender", F.lit(": "), "content")
    timed = F.when(F.col("content") != "", F.concat(F.lit("["), "t", F.lit("] "), said))
    whom = F.concat(F.lit("["), "t", F.lit("][conversation_id:"), "conv_id", F.lit("] "), "sender", F.lit("(user_id:u"), F.col("turn") % 3, F.lit("): "), "content")
    as_json = F.to_json(F.struct(F.col("t").alias("timestamp"), F.col("sender").alias("speaker"), F.length("content").alias("chars")))
    m = T.messages(spark, sf).withColumn("t", t).select("conv_id", "turn", timed.alias("timed"), whom.alias("whom"), as_json.alias("js"))
    lines = lambda c: F.md5(F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("turn", c))), lambda x: x[c]), lambda x: x.isNotNull()), "\n"))
    return m.groupBy("conv_id").agg(lines("timed").alias("timed_md5"), lines("whom").alias("profile_md5"), lines("js").alias("json_md5"))


@query(
    """SELECT p_partkey AS id, CASE WHEN p_size % 6 IN (0, 1) THEN p_size % 4 = 0 ELSE TRUE END AS is_sufficient, CASE p_size % 6 WHEN 0 THEN p_name WHEN 1 THEN 'No reasoning provided' ELSE 'Failed to parse' END AS reasoning,
    CASE WHEN p_size % 6 = 0 THEN 'a,b' ELSE '' END AS missing, CASE WHEN p_size % 6 IN (0, 2, 3) THEN p_partkey END AS k FROM part"""
)
def x14_answers(spark, sf):
    """Judgements in answers of six kinds: with reasons around them, without defaults, in a block, in a marked block, broken, none."""
    size, name = F.col("p_size"), F.col("p_name")
    yes = F.when(size % 4 == 0, "true").otherwise("false")
    k = F.col("p_partkey").cast("string")
    answer = (
        F.when(size % 6 == 0, F.concat(F.lit('{"is_sufficient": '), yes, F.lit(', "reasoning": "'), name, F.lit('", "missing_information": ["a", "b"], "k": '), k, F.lit("}")))
        .when(size % 6 == 1, F.concat(F.lit('Well: {"is_sufficient": '), yes, F.lit("} is what I say.")))
        .when(size % 6 == 2, F.concat(F.lit('So\n```json\n{"k": '), k, F.lit("}\n```\nand ```more```")))
        .when(size % 6 == 3, F.concat(F.lit('So\n```text\n{"k": '), k, F.lit("}\n```")))
        .when(size % 6 == 4, '{"is_sufficient": tru')
        .otherwise("nothing to read")
    )
    s = X.sufficiency(answer)
    return T.read(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), s["is_sufficient"].alias("is_sufficient"), s["reasoning"].alias("reasoning"), F.array_join(s["missing"], ",").alias("missing"), F.get_json_object(X.fenced_json(answer), "$.k").cast("long").alias("k")
    )


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_id * 7919 END AS number FROM events")
def x17_codes_read(spark, sf):
    """Short codes read back; every third has a character that codes don't have."""
    number = F.col("event_id") * 7919
    code = X.short_code(number, digits=8)
    shown = F.when(F.col("event_id") % 3 > 0, code).otherwise(F.concat(code, F.lit("-")))
    return T.read(spark, sf, "events").select("event_id", X.unbase62(shown).alias("number"))


@query(
    r"""WITH p AS (SELECT page_id, url, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')) AS t, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin FROM pages)
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN nullif(CASE WHEN length(t) > 200 THEN t[1:200] || '...' ELSE t END, '') WHEN 1 THEN 'An Open Title ' || page_id WHEN 2 THEN 'tweet ' || page_id ELSE nullif(CASE WHEN length(t) > 200 THEN t[1:200] || '...' ELSE t END, '') END AS title,
    CASE page_id % 4 WHEN 1 THEN repeat('d', 500) || '...' WHEN 3 THEN 'meta words' END AS description, CASE page_id % 4 WHEN 1 THEN 'https://img.example.com/a.png' END AS image, CASE page_id % 4 WHEN 1 THEN 'Site' END AS site_name,
    CASE page_id % 4 WHEN 2 THEN origin || '/own.ico' ELSE origin || '/favicon.ico' END AS favicon FROM p"""
)
def x18_metadata(spark, sf):
    """Pages with Open Graph tags, Twitter tags, template variables and plain meta tags put in their heads."""
    n = F.col("page_id")
    og = F.concat(F.lit("<meta property='og:title' content='An  Open Title "), n, F.lit("'><meta content=\"" + "d" * 501 + "\" property=\"og:description\"><meta property='og:image' content='https://img.example.com/a.png'><meta property='og:site_name' content='Site'>"))
    twitter = F.concat(F.lit("<meta property='og:title' content='${title}'><meta name='twitter:title' content='tweet "), n, F.lit("'><meta name='twitter:image' content='/no/host.png'><link rel='shortcut icon' href='/own.ico'>"))
    plain = F.lit("<meta property='og:title' content='{{ page.title }}'><meta name='description' content=' meta words '>")
    more = F.when(n % 4 == 1, og).when(n % 4 == 2, twitter).when(n % 4 == 3, plain).otherwise("")
    found = X.page_metadata(F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), more)), F.col("url"))
    return T.read(spark, sf, "pages").select("page_id", found.alias("m")).select("page_id", "m.title", "m.description", "m.image", "m.site_name", "m.favicon")


@query("SELECT p_partkey AS id, array_to_string(list_transform(range(1, least(length(p_name), 20) + 1), lambda i: substr(lower(p_name), 1, i)), '|') AS grams, lower(trim(p_type || ' ')) AS keyword FROM part")
def x21_edge_grams(spark, sf):
    return T.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(X.edge_ngrams(F.col("p_name")), "|").alias("grams"), X.lower_keyword(F.concat("p_type", F.lit(" "))).alias("keyword"))


@query("SELECT doc_id, ((('0x' || substr(md5(doc_id::VARCHAR), 1, 16))::UBIGINT % 7 * 2 + ('0x' || substr(md5(doc_id::VARCHAR), 17, 16))::UBIGINT % 7) % 7)::BIGINT AS part FROM documents")  # 2 ** 64 % 7 is 2
def x22_route_whole(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", X.route_whole(F.col("doc_id").cast("string"), 7).alias("part"))


# clusters from decisions

_ANSWERS = [  # an answer by its size and what it decides: type and cluster or topic of each assignment; what it selects
    ('{"assignments": [{"type": "EXISTING", "cluster_id": "gec_002"}, {"type": "NEW", "new_topic": "trip"}]}', "EXISTING gec_002,NEW trip", "gec_002"),
    ('I think {"decision": "EXISTING", "cluster_id": "gec_001", "reason": "x"} is right', "EXISTING gec_001", "gec_001"),
    ('{"decision": "NEW"}', "NEW Unknown topic", ""),
    ("existing: gec_003 and gec_001, gec_003", "EXISTING gec_003,EXISTING gec_001,EXISTING gec_003", "gec_003,gec_001"),
    ('new one {"new_topic": "walk" and broken', "NEW walk", ""),
    ("cannot say", "NEW Unknown topic", ""),
    ('{"selected_clusters": ["gec_009", "gec_004"]}', "", "gec_009,gec_004"),
    ('So {"selected_clusters": ["gec_005"], "why": "gec_001"} it is', "", "gec_005"),
]


def _answers(spark, sf):
    told = F.array(*[F.lit(a) for a, _, _ in _ANSWERS])
    p = F.col("p_partkey")
    return T.read(spark, sf, "part").select((p % 20).alias("conv_id"), p.alias("unit_id"), p.alias("at"), F.element_at(told, (F.col("p_size") % len(_ANSWERS) + 1).cast("int")).alias("answer"))


def _by_size(n):
    return "CASE p_size % 8 " + " ".join(f"WHEN {k} THEN '{a[n]}'" for k, a in enumerate(_ANSWERS)) + " END"


@query(f"SELECT p_partkey AS unit_id, {_by_size(1)} AS assigned, {_by_size(2)} AS selected FROM part")
def c4_assignments(spark, sf):
    """Decisions as JSON, in JSON inside a text, in their older form, and read off a text; selections likewise."""
    shown = F.transform(X.assignments(F.col("answer")), lambda a: F.concat(a["type"], F.lit(" "), F.coalesce(a["cluster_id"], a["new_topic"])))
    return _answers(spark, sf).select("unit_id", F.array_join(shown, ",").alias("assigned"), F.array_join(X.selected_clusters(F.col("answer")), ",").alias("selected"))


@query()
def c3_event_index(spark, sf):
    """Event clusters of twenty conversations from the decisions of c4; tested against a plain loop."""
    return clusters.event_clusters(_answers(spark, sf).withColumn("assigned", X.assignments(F.col("answer"))))


@query(
    f"""WITH m AS (SELECT label, unit_id, strftime(to_timestamp(1704067200 + unit_id * 3600) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS at, summary FROM embeddings JOIN {_UNITS} ON vec_id = unit_id),
    n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY at DESC, summary DESC) AS nth FROM m)
    SELECT label::BIGINT AS cluster_id, md5('[' || label || '] t' || label || CASE WHEN label % 2 = 1 THEN ' (hits: ' || label || ')' ELSE '' END || chr(10) || 'Members: ' || count(*) || chr(10) || 'Time: ' ||
    CASE WHEN min(at)[1:10] = max(at)[1:10] THEN min(at)[1:10] ELSE min(at)[1:10] || ' to ' || max(at)[1:10] END || chr(10) || 'Recent content:' || chr(10) ||
    string_agg(CASE WHEN nth <= 3 THEN '  - ' || CASE WHEN length(summary) > 100 THEN summary[1:100] || '...' ELSE summary END END, chr(10) ORDER BY nth DESC)) AS preview_md5 FROM n GROUP BY label"""
)
def c6_previews(spark, sf):
    """What a model is shown of each cluster; odd clusters have hits."""
    e = T.read(spark, sf, "embeddings").select(F.col("label").cast("long").alias("cluster_id"), F.col("vec_id").alias("unit_id"))
    at = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("unit_id") * 3600), "yyyy-MM-dd HH:mm")
    rows = e.join(T.memunits(spark, sf).select("unit_id", "summary"), "unit_id")
    c = F.col("cluster_id")
    return clusters.previews(rows.select("cluster_id", F.concat(F.lit("t"), c).alias("topic"), at.alias("at"), "summary", F.when(c % 2 == 1, c).otherwise(0).alias("hits"))).select("cluster_id", F.md5("preview").alias("preview_md5"))


@query()
def p10_updated_topics(spark, sf):
    """Each user's topics, one for each type of event, after updates and new ones; tested against known results."""
    e = T.behaviors(spark, sf).select("user_id", "event_id", "event_type", "at", "value")
    kept = e.filter("event_type <> 'purchase'").groupBy(F.col("user_id").alias("group_id"), F.col("event_type").alias("topic_id")).agg(
        F.max("at").alias("last_at"), F.transform(F.slice(F.sort_array(F.collect_list("event_id"), False), 1, 3), lambda x: x.cast("string")).alias("evidences")
    )
    topics = kept.select("group_id", "topic_id", F.col("topic_id").alias("name"), F.when(F.col("topic_id") == "error", "implemented").otherwise("exploring").alias("status"), "last_at", "evidences")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    best = e.withColumn("seq", nth).filter("seq <= 4")
    ids = F.array(F.col("event_id").cast("string"))
    updates = best.select(F.col("user_id").alias("group_id"), "seq", F.when(F.col("event_type") == "purchase", "new").otherwise("update").alias("update_type"), F.col("event_type").alias("topic_id"), F.col("event_type").alias("name"), F.lit("exploring").alias("status"), ids.alias("evidences"))
    return profiles.updated_topics(topics, updates, e.select(F.col("user_id").alias("group_id"), F.col("event_id").cast("string").alias("unit_id"), "at"))


# streams, as batch twins

_BOUNDARY = "event_type = 'purchase' AND value > 50"


@query(
    f"""WITH b AS (SELECT *, coalesce(sum(({_BOUNDARY})::INT) OVER (PARTITION BY user_id ORDER BY at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM {_EVENTS})
    SELECT user_id, no::BIGINT AS no, count(*) AS n, arg_min(event_id, at * 10000000 + event_id) AS first_id, arg_max(event_id, at * 10000000 + event_id) AS last_id, bool_or({_BOUNDARY}) AS done FROM b GROUP BY 1, 2"""
)
def k1_decided_segments(spark, sf):
    """A user's buffer until a message that a boundary decision (here a purchase of more than 50) ends it with; the last may still wait."""
    return state.decided_segments(T.behaviors(spark, sf).withColumn("boundary", F.expr(_BOUNDARY)), "user_id", ["at", "event_id"], "event_id")


@query(
    f"""SELECT user_id, CASE WHEN max(at) FILTER (event_type = 'purchase') IS NULL THEN CASE WHEN count(*) = 1 THEN 'new' ELSE 'continuing' END WHEN max(at) FILTER (event_type = 'purchase') = max(at) THEN 'extracted' ELSE 'continuing' END AS phase,
    min(at) * 1000 AS old_start_ms, CASE WHEN max(at) FILTER (event_type = 'purchase') IS NULL THEN min(at) * 1000 ELSE max(at) FILTER (event_type = 'purchase') * 1000 + 1 END AS new_start_ms, max(at) * 1000 AS last_ms FROM {_EVENTS} GROUP BY 1"""
)
def k3_status_machine(spark, sf):
    """Each conversation's phase and watermarks: new after one message, continuing after more, extracted right after an extraction, which moves
    the start of what is new a millisecond past it."""
    return state.status(T.behaviors(spark, sf).withColumn("extracted", F.col("event_type") == "purchase"), "user_id")


@query(
    f"""SELECT event_id, user_id, at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at DESC, event_id DESC) AS nth, max(at) OVER (PARTITION BY user_id) AS newest, max(at) OVER () AS now FROM {_EVENTS})
    WHERE nth <= 100 AND now - newest <= 3600 * 24 AND at >= 1705276800 ORDER BY at DESC"""
)
def k4_history_range(spark, sf):
    """The last hundred of each key whose key was active within a day of the newest message at all, read from a time on, newest first."""
    return state.capped_history(T.behaviors(spark, sf), "user_id", 100, 86400, 1_705_276_800).select("event_id", "user_id", "at").orderBy(F.desc("at"))
