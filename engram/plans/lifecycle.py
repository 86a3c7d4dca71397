"""More registered queries: expansion, variants, cluster and profile upkeep, parsing, sliding rates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engram import tables as T
from engram.functions import text as X
from engram.operators import clusters, rank
from engram.plans.lookups import _joined
from engram.plans.queries import _BM25, _EVENTS, _FUSE, _MESSAGES, _USABLE, _VARIANTS, _VERSIONS, _inserted, _usable, _variant_lists, query, r6_knn

# retrieval


@query(_inserted("after") + " SELECT query_id, place, doc_id, score, hit_id FROM x")
def r18_insert_after_hits(spark, sf):
    """Hits with the co-members nearest in time put after each."""
    hits = r6_knn(spark, sf)
    members = T.read(spark, sf, "embeddings").select(F.col("label").alias("cluster_id"), F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("seq"))
    return clusters.insert_after_hits(hits, members)


@query(
    _BM25.replace("{field}", "narrative").replace("FROM benchmark)", f"FROM {_VARIANTS})")
    + ", l AS (SELECT query_id // 4 AS query_id, query_id % 4 AS list_no, doc_id, rank, score FROM hits WHERE rank <= 50), "
    + _FUSE
)
def r14_multi_query(spark, sf):
    """All variants of all questions in one job; the lists of a question are fused by reciprocal rank, a single list stays as it is."""
    return rank.fused(_variant_lists(spark, sf), 20).withColumn("rank", F.col("rank").cast("long"))


@query(
    """WITH b AS (SELECT doc_id, coalesce(source, '') AS text, [upper(coalesce(source, '')), ' ' || lang || ' query' || chr(10), 'four', 'What of ' || doc_id || '?', repeat('x', (doc_id % 400)::INT), 'the last one'] AS q, doc_id % 4 AS kind FROM documents),
    v AS (SELECT doc_id, text, CASE WHEN kind < 3 THEN list_slice(list_filter(q, lambda s: length(s) BETWEEN 5 AND 300 AND lower(trim(s, ' ' || chr(10))) <> lower(text)), 1, 3) END AS v FROM b)
    SELECT doc_id, CASE WHEN len(v) > 0 THEN array_to_string(list_transform(v, lambda s: trim(s, ' ' || chr(10))), '|') ELSE text END AS variants FROM v"""
)
def x15_answers(spark, sf):
    """Variants out of JSON answers, some of which are cut off: a source's name is the question."""
    d = T.read(spark, sf, "documents").select("doc_id", "lang", F.coalesce("source", F.lit("")).alias("text"))
    said = F.array(F.upper("text"), F.concat(F.lit(" "), "lang", F.lit(" query\n")), F.lit("four"), F.concat(F.lit("What of "), "doc_id", F.lit("?")), F.repeat(F.lit("x"), (F.col("doc_id") % 400).cast("int")), F.lit("the last one"))
    answer = F.concat(F.lit("Here they are: "), F.to_json(F.struct(said.alias("queries"), F.lit("why").alias("reasoning"))))
    cut = F.when(F.col("doc_id") % 4 == 3, F.substring(answer, 1, 40)).otherwise(answer)
    return d.select("doc_id", F.array_join(X.query_variants(cut, F.col("text")), "|").alias("variants"))


@query(f"SELECT item_id, CASE WHEN len(v) = 0 THEN text ELSE array_to_string(v, '|') END AS variants FROM (SELECT item_id, text, {_USABLE} AS v FROM (SELECT item_id, coalesce(text, '') AS text FROM benchmark))")
def x15_variants(spark, sf):
    """At most three usable variants of a question, or the question itself."""
    b = T.read(spark, sf, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("v", _usable(F.col("text")))
    return b.select("item_id", F.when(F.size("v") == 0, F.col("text")).otherwise(F.array_join("v", "|")).alias("variants"))


# clusters


@query("SELECT label::BIGINT AS label, grp, 'gec_' || lpad((row_number() OVER (PARTITION BY grp ORDER BY first))::VARCHAR, 3, '0') AS cluster_id, n FROM (SELECT vec_id % 7 AS grp, label, min(vec_id) AS first, count(*) AS n FROM embeddings GROUP BY 1, 2)")
def c3_event_clusters(spark, sf):
    """Clusters of each group, named in the order of their first members."""
    c = T.read(spark, sf, "embeddings").groupBy((F.col("vec_id") % 7).alias("grp"), F.col("label").cast("long").alias("label")).agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    no = F.row_number().over(Window.partitionBy("grp").orderBy("first"))
    return c.select("label", "grp", F.concat(F.lit("gec_"), F.lpad(no.cast("string"), 3, "0")).alias("cluster_id"), "n")


_DECISION = "CASE p_size % 3 WHEN 0 THEN 'use gec_' || lpad(p_size::VARCHAR, 3, '0') || ' and gec_001' WHEN 1 THEN '{\"decision\": \"gec_002\"}' ELSE 'a new one' END"


@query(f"SELECT id, coalesce(nullif(array_to_string(regexp_extract_all(answer, 'gec_[0-9]+'), ','), ''), 'NEW') AS decision FROM (SELECT p_partkey AS id, {_DECISION} AS answer FROM part)")
def c4_decisions(spark, sf):
    answer = F.expr(_DECISION.replace("p_size::VARCHAR", "cast(p_size as string)"))
    return T.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.decisions(answer).alias("decision"))


@query("SELECT label::BIGINT AS cluster_id, min(vec_id) AS first_id, max(vec_id) AS last_id, count(*) AS n FROM embeddings GROUP BY 1")
def w10_cluster_span(spark, sf):
    return T.read(spark, sf, "embeddings").groupBy(F.col("label").cast("long").alias("cluster_id")).agg(F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"), F.count("*").alias("n"))


@query(f"SELECT user_id, start, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS next_start FROM (SELECT user_id, at // 86400 AS day, min(at) AS start FROM {_EVENTS} GROUP BY 1, 2)")
def w9_next_session(spark, sf):
    s = T.behaviors(spark, sf).groupBy("user_id", F.floor(F.col("at") / 86400).alias("day")).agg(F.min("at").alias("start"))
    return s.select("user_id", "start", F.lead("start").over(Window.partitionBy("user_id").orderBy("start")).alias("next_start"))


# profiles and evaluation




@query("SELECT l_orderkey AS unit_id, l_linenumber::BIGINT AS line, strftime(o_orderdate, '%Y-%m-%d') || '|' || l_orderkey AS evidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%'")
def p5_evidence_format(spark, sf):
    """date|unit of each evidence; those of unknown units go."""
    o = T.read(spark, sf, "orders").filter("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("unit_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    l = T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").cast("long").alias("line"))
    return l.join(o, "unit_id").select("unit_id", "line", F.concat_ws("|", "day", "unit_id").alias("evidence"))



@query(f"SELECT user_id, version, order_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY version DESC, order_id DESC) AS nth FROM {_VERSIONS}) WHERE nth <= 3")
def p14_history(spark, sf):
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("version"), F.desc("order_id")))
    return T.profile_versions(spark, sf).withColumn("nth", nth).filter("nth <= 3").select("user_id", "version", "order_id")



# parsing


@query("SELECT event_id, epoch_us(date_trunc('minute', ts)) // 1000000 AS at FROM events")
def x9_session_time(spark, sf):
    """Times written like 6:07 pm on 13 January, 2023, read back."""
    shown = F.lower(F.date_format("ts", "h:mm a")), F.date_format("ts", "d MMMM, yyyy")
    return T.behaviors(spark, sf).select("event_id", X.session_time(F.concat_ws(" on ", *shown)).alias("at"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 > 0 THEN json_extract_string(props, '$.k') END, 'none') AS k FROM events")
def x14_json_in_text(spark, sf):
    """The object within a model's answer; a default where there is none."""
    e = T.read(spark, sf, "events")
    answer = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("Sure:\n"), F.col("props"), F.lit("\nDone."))).otherwise("no object here")
    return e.select("event_id", F.coalesce(F.get_json_object(X.json_in(answer), "$.k"), F.lit("none")).alias("k"))


@query(
    r"""SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<meta[^>]*property="og:title"[^>]*content="([^"]*)"', 1)), ''), nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '')) AS title,
    nullif(regexp_extract(url, '^https?://([^/?#]+)', 1), '') AS host FROM pages"""
)
def x18_page_metadata(spark, sf):
    """Open Graph title, else the page's title; the host."""
    part = lambda c, p: F.nullif(F.trim(F.regexp_extract(c, p, 1)), F.lit(""))
    title = F.coalesce(part("html", r'<meta[^>]*property="og:title"[^>]*content="([^"]*)"'), part("html", r"(?is)<title[^>]*>(.*?)</title>"))
    return T.read(spark, sf, "pages").select("page_id", title.alias("title"), part("url", r"^https?://([^/?#]+)").alias("host"))


# streams, as batch twins


@query(f"SELECT event_id, user_id FROM (SELECT event_id, user_id, at, max(at) OVER (PARTITION BY user_id) AS newest FROM {_EVENTS}) WHERE at > newest - 172800")
def k5_recent_of_key(spark, sf):
    newest = F.max("at").over(Window.partitionBy("user_id"))
    return T.behaviors(spark, sf).withColumn("newest", newest).filter("at > newest - 172800").select("event_id", "user_id")


@query(
    f"""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY at RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS last_minute,
    count(*) OVER (PARTITION BY user_id ORDER BY at RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS last_hour FROM {_EVENTS}"""
)
def k7_throughput(spark, sf):
    w = Window.partitionBy("user_id").orderBy("at")
    count = lambda s: F.count("*").over(w.rangeBetween(1 - s, 0))
    return T.behaviors(spark, sf).select("event_id", count(60).alias("last_minute"), count(3600).alias("last_hour"))
