"""Registered queries of scopes, lookups by type and the retrieval modes built on the rankers."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram import tables as T
from engram.shared import written
from engram.operators import clusters, inverted, matching, profiles, rank
from engram.plans.queries import SQL, _BM25, _EVENTS, _KNN, _POSTS, _ROUNDS, _TOKENS, _inserted, _UNITS, _index, _units, _VECTORS, _VERSIONS, _queries, _variant_lists, _vector_queries, query, r6_knn

# filters

_SCOPED = """(SELECT l_orderkey AS id, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_suppkey::VARCHAR END AS user_id, l_returnflag AS group_id, [l_suppkey::VARCHAR, (l_partkey % 20)::VARCHAR] AS participants FROM lineitem)"""


@query(
    f"""SELECT 'personal' AS scope, id FROM {_SCOPED} WHERE user_id = '7' UNION ALL SELECT 'group', id FROM {_SCOPED} WHERE group_id = 'A' AND user_id = '' AND list_contains(participants, '7')
    UNION ALL SELECT 'all', id FROM {_SCOPED} WHERE group_id = 'A' AND list_contains(participants, '7')"""
)
def f12_scopes(spark, sf):
    user = F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.col("l_suppkey").cast("string"))
    people = F.array(F.col("l_suppkey").cast("string"), (F.col("l_partkey") % 20).cast("string"))
    rows = T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), user.alias("user_id"), F.col("l_returnflag").alias("group_id"), people.alias("participants"))
    kinds = ("personal", "group", "all")
    hit = F.array_compact(F.array(*[F.when(matching.scope(k, "episode", "7", "A"), F.lit(k)) for k in kinds]))
    return rows.select(F.explode(hit).alias("scope"), "id")  # one scan for all scopes


@query("SELECT c_custkey AS user_id, c_name AS name, '{\"segment\":\"' || c_mktsegment || '\",\"nation\":' || c_nationkey || '}' AS base FROM customer")
def f20_projection(spark, sf):
    base = F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")))
    return T.read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), base.alias("base"))


@query(
    """WITH r AS (SELECT 'order' AS type, o_custkey AS user_id, o_orderkey AS id, o_orderpriority AS content FROM orders UNION ALL SELECT 'event', user_id, event_id, event_type FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY type, user_id ORDER BY id DESC) AS nth, count(*) OVER (PARTITION BY type, user_id) AS total FROM r)
    SELECT type, user_id, id, content, total >= 5 AS has_more FROM n WHERE nth <= 5"""
)
def f21_fetch_by_type(spark, sf):
    """The newest five rows of each user and type in one shape; has_more: the limit was reached."""
    o = T.read(spark, sf, "orders").select(F.lit("order").alias("type"), F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("content"))
    e = T.read(spark, sf, "events").select(F.lit("event").alias("type"), "user_id", F.col("event_id").alias("id"), F.col("event_type").alias("content"))
    rows = o.unionByName(e)
    sizes = rows.groupBy("type", "user_id").agg((F.count("*") >= 5).alias("has_more"))
    newest = rank.top(rows.withColumn("key", F.concat_ws("|", "type", "user_id")), 5, "id", "key", "content")
    return newest.join(sizes, ["type", "user_id"]).select("type", "user_id", "id", "content", "has_more")


@query("SELECT 'unit' AS via, doc_id AS id FROM documents WHERE doc_id = 12 UNION ALL SELECT 'parent', l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)")
def f23_lookups(spark, sf):
    """By unit id, and children by their parents' ids."""
    unit = T.read(spark, sf, "documents").filter("doc_id = 12").select(F.lit("unit").alias("via"), F.col("doc_id").alias("id"))
    parents = T.read(spark, sf, "orders").filter("o_custkey = 7").select(F.col("o_orderkey").alias("l_orderkey"))
    children = T.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(parents, "l_orderkey", "left_semi")
    return unit.unionByName(children.select(F.lit("parent").alias("via"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")))


@query("SELECT doc_id AS id, source AS group_id FROM documents WHERE lang = 'en' ORDER BY source, doc_id LIMIT 15 OFFSET 5")
def f24_by_scene_paged(spark, sf):
    return T.read(spark, sf, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"), F.col("source").alias("group_id")).orderBy("group_id", "id").offset(5).limit(15)


@query(f"SELECT event_id, at FROM {_EVENTS} WHERE user_id = 8 AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25' ORDER BY at DESC, event_id LIMIT 40")
def f25_filter_only(spark, sf):
    when = (F.col("ts") >= F.lit("2024-01-03").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-25").cast("timestamp"))
    return T.behaviors(spark, sf).filter((F.col("user_id") == 8) & when).select("event_id", "at").orderBy(F.desc("at"), "event_id").limit(40)


@query("SELECT vec_id AS id FROM embeddings WHERE CASE label % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'g' || label END <> ''")
def f26_named_groups(spark, sf):
    name = F.when(F.col("label") % 3 == 1, "").when(F.col("label") % 3 == 2, F.concat(F.lit("g"), "label"))
    return T.read(spark, sf, "embeddings").withColumn("name", name).filter("name is not null and name <> ''").select(F.col("vec_id").alias("id"))


_IDS = "CASE c_custkey % 3 WHEN 0 THEN 'Supplier#' || lpad(c_custkey::VARCHAR, 9, '0') WHEN 1 THEN lpad(c_custkey::VARCHAR, 9, '0') ELSE 'see Supplier#' || lpad(c_custkey::VARCHAR, 9, '0') || '!' END"


@query(
    f"""WITH p AS (SELECT evidence_id, s_name AS unit_id, CASE WHEN evidence_id = s_name THEN 'equal' ELSE 'contained' END AS how FROM (SELECT {_IDS} AS evidence_id FROM customer) JOIN supplier ON contains(evidence_id, s_name) OR contains(s_name, evidence_id))
    SELECT evidence_id, unit_id, how FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY how DESC, unit_id) AS nth FROM p) WHERE nth = 1"""
)
def j4_contained_ids(spark, sf):
    ids = T.read(spark, sf, "customer").select(F.expr(_IDS.replace("::VARCHAR", "").replace("lpad(c_custkey", "lpad(cast(c_custkey as string)")).alias("evidence_id"))
    return matching.containing(ids, T.read(spark, sf, "supplier").select(F.col("s_name").alias("unit_id")))


@query(f"WITH h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS nth FROM ({_KNN})) SELECT query_id, doc_id, score, rank FROM (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h JOIN embeddings ON vec_id = doc_id WHERE nth <= 100 AND label > 3) WHERE rank <= 5")
def t2_over_fetch(spark, sf):
    """max(10 k, 100) candidates, then the filter, then k."""
    k = 5
    hits = rank.knn(_vector_queries(spark, sf), T.vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "vector"), max(10 * k, 100)).drop("rank")
    kept = T.read(spark, sf, "embeddings").filter("label > 3").select(F.col("vec_id").alias("doc_id"))
    return rank.top(hits.join(kept, "doc_id", "left_semi"), k).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


# rankers

_BOOSTED = (
    f"WITH toks AS (SELECT unit_id, lang, {_TOKENS.format('narrative')} AS t FROM {_UNITS}), {_POSTS}, stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),"
    + " terms AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM posts GROUP BY 1), stats),"
    + f" words AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS.format('coalesce(text, chr(32))')}) AS term FROM benchmark),"
    + """ weighed AS (SELECT *, len(regexp_extract_all(term, '[a-z]+')) * 1.5::DOUBLE + length(regexp_replace(term, '[a-z]', '', 'g')) * 0.5::DOUBLE AS w FROM words),
    q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, term) AS nth FROM weighed) WHERE nth <= 10),
    scored AS (SELECT query_id, doc_id, round(sum(w * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN terms USING (term) JOIN posts USING (term) JOIN toks ON unit_id = doc_id, stats WHERE {where} GROUP BY 1, 2)
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 20"""
)


@query(_BOOSTED.replace("{where}", "true"))
def r2_boosted_terms(spark, sf):
    return inverted.boosted(_index(spark, sf), _queries(spark, sf), 20).withColumn("rank", F.col("rank").cast("long"))


@query(_BOOSTED.replace("{where}", "lang IN ('en', 'de')"))
def r7_filtered_keywords(spark, sf):
    """Keyword search over filtered rows."""
    some = T.memunits(spark, sf).filter(F.col("lang").isin("en", "de")).select(F.col("unit_id").alias("doc_id"))
    return inverted.boosted(_index(spark, sf), _queries(spark, sf), 20, some).withColumn("rank", F.col("rank").cast("long"))


@query(_BOOSTED.replace("{where}", "lang = 'fr'"))
def f15_pinned_type(spark, sf):
    """The same search with its type pinned."""
    some = T.memunits(spark, sf).filter("lang = 'fr'").select(F.col("unit_id").alias("doc_id"))
    return inverted.boosted(_index(spark, sf), _queries(spark, sf), 20, some).withColumn("rank", F.col("rank").cast("long"))


_SUBJECT_QUERIES = f"FROM (SELECT unit_id AS item_id, narrative AS text FROM {_UNITS} WHERE unit_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0)))"


@query(
    "WITH b AS ("
    + _BM25.replace("{field}", "narrative").replace("FROM benchmark)", _SUBJECT_QUERIES)
    + f""" SELECT query_id, doc_id, score, rank FROM hits WHERE rank <= 50), e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_KNN})) WHERE rank <= 50),
    f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM b UNION ALL SELECT query_id, doc_id, rank FROM e) GROUP BY 1, 2)
    SELECT 'bm25' AS mode, query_id, doc_id, score, rank FROM b WHERE rank <= 10 UNION ALL SELECT 'embedding', query_id, doc_id, score, rank FROM e WHERE rank <= 10
    UNION ALL SELECT * FROM (SELECT 'rrf', query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10"""
)
def r12_modes(spark, sf):
    """Every mode in one row shape."""
    v, u = T.vectors(spark, sf), _units(spark, sf)
    asked = u.join(v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("unit_id")), "unit_id", "left_semi").select(F.col("unit_id").alias("query_id"), F.col("narrative").alias("text"))
    words = written(inverted.bm25(_index(spark, sf), asked, 50))
    near = written(rank.knn(_vector_queries(spark, sf), v.select(F.col("vec_id").alias("doc_id"), "vector"), 50))
    lists = words.withColumn("list_no", F.lit(0)).unionByName(near.withColumn("list_no", F.lit(1)))
    modes = {"bm25": words.filter("rank <= 10"), "embedding": near.filter("rank <= 10"), "rrf": rank.top(rank.rrf(lists), 10)}
    parts = [df.select(F.lit(m).alias("mode"), "query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank")) for m, df in modes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT user_id, version, order_id FROM (SELECT *, max(version) OVER (PARTITION BY user_id) AS newest FROM {_VERSIONS}) WHERE version = newest AND user_id IN (7, 14, 35, 70)")
def r13_profile_lookup(spark, sf):
    rows = T.profile_versions(spark, sf).filter(F.col("user_id").isin(7, 14, 35, 70))
    return profiles.latest(rows, ["user_id"], "version").filter("is_latest").select("user_id", "version", "order_id")


@query(
    _ROUNDS
    + """, m AS (SELECT query_id, doc_id, 'round1' AS origin, rank FROM a WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, 'round2', rank FROM b WHERE NOT EXISTS (SELECT 1 FROM a x WHERE x.rank <= 20 AND x.query_id = b.query_id AND x.doc_id = b.doc_id)),
    c AS (SELECT *, CASE WHEN (doc_id + query_id) % 3 = 0 THEN NULL ELSE doc_id * 7 % 101 END AS rs FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY origin, rank) AS place FROM m WHERE query_id % 2 = 1) WHERE place <= 40),
    d AS (SELECT *, avg(CASE WHEN rs IS NULL THEN 0.0 ELSE 1.0 END) OVER (PARTITION BY query_id) >= 0.3 AS ok FROM c)
    SELECT query_id, doc_id, rank AS place, 1 AS rounds FROM a WHERE rank <= 20 AND query_id % 2 = 0 UNION ALL
    SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN ok THEN -rs END NULLS LAST, place) AS place, 2 AS rounds FROM d) WHERE place <= 20"""
)
def r17_two_rounds(spark, sf):
    """What a judge and a reranker would say comes from formulas over the ids."""
    q = _queries(spark, sf)
    first, second = written(inverted.bm25(_index(spark, sf), q, 20)), written(rank.in_turn(_variant_lists(spark, sf)))  # each is used several times
    sufficient = q.select("query_id", (F.col("query_id") % 2 == 0).alias("is_sufficient"))
    d, both = F.col("doc_id"), first.select("query_id", "doc_id").union(second.select("query_id", "doc_id")).distinct()
    scores = both.filter((d + F.col("query_id")) % 3 != 0).withColumn("rerank_score", (d * 7 % 101).cast("double"))
    return rank.two_rounds(first, second, sufficient, scores)


# expansion


def _members(spark, sf):
    return T.read(spark, sf, "embeddings").select(F.col("label").cast("long").alias("cluster_id"), F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("seq"))


@query(_inserted("end") + " SELECT query_id, place, doc_id, score, hit_id FROM x")
def r19_append_to_end(spark, sf):
    """Co-members after all hits."""
    return clusters.insert_after_hits(r6_knn(spark, sf), _members(spark, sf), place="end")


@query(_inserted("score") + " SELECT query_id, place, doc_id, score, hit_id FROM x")
def r20_merge_by_score(spark, sf):
    """Hits and co-members by score."""
    return clusters.insert_after_hits(r6_knn(spark, sf), _members(spark, sf), place="score")


@query(
    f"""WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_KNN})) WHERE rank <= 20),
    c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, f, label) AS pos FROM (SELECT query_id, label, count(*) AS n, min(rank) AS f FROM h JOIN embeddings ON vec_id = doc_id GROUP BY 1, 2)) WHERE pos <= 3),
    m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, doc_id) AS place FROM (SELECT query_id, pos, label, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id, label ORDER BY vec_id) AS nth FROM c JOIN embeddings USING (label)) WHERE nth <= 15) WHERE place <= 30),
    o AS (SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth, (SELECT count(*) FROM m WHERE m.query_id = h.query_id) AS had FROM h WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.query_id = h.query_id AND m.doc_id = h.doc_id)) WHERE nth <= least(10, 40 - had))
    SELECT query_id, place, doc_id, round(1 - 0.1 * (pos - 1), 6)::DOUBLE AS score, label::BIGINT AS cluster_id FROM m UNION ALL SELECT query_id, had + nth, doc_id, round(score * 0.8::DOUBLE, 6), NULL FROM o"""
)
def r21_rerank_by_cluster(spark, sf):
    found = clusters.rerank_by_cluster(r6_knn(spark, sf), _members(spark, sf))
    return found.select("query_id", "place", "doc_id", F.round("score", 6).alias("score"), "cluster_id")


@query(
    f"""WITH y AS ({_inserted("after")} SELECT query_id, place, doc_id, score FROM x), z AS ({SQL["r21_rerank_by_cluster"]}), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_KNN})) WHERE rank <= 20)
    SELECT query_id, rank AS place, doc_id, round(score, 6) AS score, 'agentic_only' AS strategy FROM h WHERE query_id // 20 % 3 = 0 UNION ALL SELECT query_id, place, doc_id, round(score, 6), 'gec_insert_after_hit' FROM y WHERE query_id // 20 % 3 = 1
    UNION ALL SELECT query_id, place, doc_id, score, 'gec_cluster_rerank' FROM z WHERE query_id // 20 % 3 = 2"""
)
def d3_strategies(spark, sf):
    """Each query's hits as the strategy that its id stands for orders them; also tested against the strategies one by one."""
    hits = r6_knn(spark, sf)
    named = F.element_at(F.array(*map(F.lit, clusters.STRATEGIES)), (F.col("query_id") / 20 % 3 + 1).cast("int"))
    routed = _vector_queries(spark, sf).select("query_id", named.alias("strategy"))
    return clusters.by_strategy(hits, _members(spark, sf), routed).withColumn("score", F.round("score", 6))


# vectors of the units of a cluster


@query(f"SELECT label::BIGINT AS cluster_id, '[' || string_agg('{{\"unit\":' || vec_id || ',\"dim\":' || len(vector) || '}}', ',' ORDER BY vec_id) || ']' AS assignments FROM {_VECTORS} GROUP BY 1")
def c2_assignments(spark, sf):
    """Each cluster's assignments as one JSON text, ready to be written by cluster."""
    one = F.struct(F.col("vec_id").alias("unit"), F.size("vector").alias("dim"))
    return T.vectors(spark, sf).groupBy(F.col("label").cast("long").alias("cluster_id")).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("assignments"))
