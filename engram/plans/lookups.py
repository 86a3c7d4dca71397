"""More registered queries: lookups, rounds of retrieval, context, caps, scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engram import tables as T
from engram.functions import text as X
from engram.operators import inverted, profiles, rank
from engram.plans.queries import _BM25, _COS, _EVENTS, _KNN, _MESSAGES, _TOKENS, _UNITS, _units, _ROUNDS, _VECTORS, _index, _VERSIONS, _queries, _variant_lists, _vector_queries, query, r1_bm25, r6_knn

_HITS = f"h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_KNN})) WHERE rank <= 20)"


def _joined(ordered, value, sep=","):
    """The values of a group as one string, in the order of the struct's first fields."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(ordered)), lambda x: x[value].cast("string")), sep)


# filters


@query(f"SELECT unit_id, list_has_any(t, ['the', 'la', 'der']) AS any_word, list_has_all(t, ['the', 'of']) AS all_words FROM (SELECT unit_id, {_TOKENS.format('narrative')} AS t FROM {_UNITS})")
def f6_keywords(spark, sf):
    u = T.memunits(spark, sf).select("unit_id", X.tokens(F.col("narrative")).alias("t"))
    asked = lambda *w: F.array(*map(F.lit, w))
    return u.select("unit_id", F.arrays_overlap("t", asked("the", "la", "der")).alias("any_word"), (F.size(F.array_except(asked("the", "of"), F.col("t"))) == 0).alias("all_words"))


@query("SELECT p_type AS kind, count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) GROUP BY 1")
def f10_entities_by_type(spark, sf):
    ids = T.read(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return T.read(spark, sf, "part").join(ids, "p_partkey", "left_semi").groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("n"))


@query(f"SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT k.* FROM ({_KNN}) k JOIN embeddings e ON e.vec_id = k.doc_id WHERE e.label IN (1, 2, 3) AND k.doc_id >= 50)) WHERE rank <= 10")
def f13_vector_prefilter(spark, sf):
    """The filter runs before the scores, at the scan."""
    some = T.vectors(spark, sf).filter("label in (1, 2, 3) and vec_id >= 50").select(F.col("vec_id").alias("doc_id"), "vector")
    return rank.knn(_vector_queries(spark, sf), some, 10).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT event_id, user_id FROM events WHERE (event_type IN ('click', 'view') OR event_type IS NULL) AND user_id BETWEEN 5 AND 25 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def f14_text_prefilter(spark, sf):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    kind = F.col("event_type").isin("click", "view") | F.col("event_type").isNull()
    when = (F.col("ts") >= ts("2024-01-05")) & (F.col("ts") < ts("2024-01-20"))
    return T.read(spark, sf, "events").filter(kind & F.col("user_id").between(5, 25) & when).select("event_id", "user_id")


@query("SELECT l_orderkey AS order_id, coalesce(string_agg(CASE WHEN l_returnflag = 'R' THEN l_linenumber::VARCHAR END, ',' ORDER BY l_linenumber), '') AS returned, count(*) AS n FROM lineitem GROUP BY 1")
def f22_nested_filter(spark, sf):
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    rows = T.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(lines.alias("lines"))
    returned = F.transform(F.filter("lines", lambda x: x["l_returnflag"] == "R"), lambda x: x["l_linenumber"].cast("string"))
    return rows.select("order_id", F.array_join(returned, ",").alias("returned"), F.size("lines").cast("long").alias("n"))


@query(f"SELECT user_id, version, order_id FROM (SELECT *, max(version) OVER (PARTITION BY user_id) AS newest FROM {_VERSIONS} WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) WHERE version = newest")
def f27_latest_of_many(spark, sf):
    keys = T.read(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    rows = T.profile_versions(spark, sf).join(keys, "user_id", "left_semi")
    return profiles.latest(rows, ["user_id"], "version").filter("is_latest").select("user_id", "version", "order_id")


# joins and rounds of retrieval


@query("SELECT l.doc_id, l.quality::BIGINT AS quality, d.source FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def j2_children_with_parent(spark, sf):
    parents = T.read(spark, sf, "documents").select("doc_id", "source")
    return T.read(spark, sf, "labels").join(parents, "doc_id").select("doc_id", F.col("quality").cast("long").alias("quality"), "source")


@query(
    _ROUNDS
    + """, m AS (SELECT query_id, doc_id, 'round1' AS origin, rank FROM a WHERE rank <= 20 UNION ALL
    SELECT query_id, doc_id, 'round2', rank FROM b WHERE NOT EXISTS (SELECT 1 FROM a x WHERE x.rank <= 20 AND x.query_id = b.query_id AND x.doc_id = b.doc_id))
    SELECT query_id, doc_id, origin, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY origin, rank) AS place FROM m) WHERE place <= 40"""
)
def j5_second_round(spark, sf):
    """The first round's best 20, then what only the variants' lists in turn have, 40 at most; origin names the round."""
    return rank.merge_rounds(inverted.bm25(_index(spark, sf), _queries(spark, sf), 20), rank.in_turn(_variant_lists(spark, sf)), 40)


@query(_ROUNDS + " SELECT query_id, doc_id, rank FROM b WHERE NOT EXISTS (SELECT 1 FROM a x WHERE x.rank <= 20 AND x.query_id = b.query_id AND x.doc_id = b.doc_id)")
def u1_variant_hits(spark, sf):
    """The lists of a question's variants one after another, each document once, without the first round's hits."""
    first = inverted.bm25(_index(spark, sf), _queries(spark, sf), 20).select("query_id", "doc_id")
    return rank.in_turn(_variant_lists(spark, sf)).join(first, ["query_id", "doc_id"], "left_anti").withColumn("rank", F.col("rank").cast("long"))


@query(_BM25.replace("{field}", "narrative") + f" SELECT query_id, string_agg(substr(narrative, 1, 500), chr(10) ORDER BY rank) AS context FROM hits JOIN {_UNITS} u ON doc_id = unit_id WHERE rank <= 5 GROUP BY 1")
def r25_context(spark, sf):
    """The best five texts of each question, cut at 500 characters, in order."""
    heads = T.memunits(spark, sf).select(F.col("unit_id").alias("doc_id"), F.substring("narrative", 1, 500).alias("head"))
    hits = r1_bm25(spark, sf).filter("rank <= 5").join(heads, "doc_id")
    return hits.groupBy("query_id").agg(_joined(F.struct("rank", "head"), "head", "\n").alias("context"))


@query(
    _BM25.replace("{field}", "narrative")
    + """ SELECT h.query_id, h.doc_id, p.term, p.tf, round(q.w * t.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / avgdl)), 6) AS part
    FROM hits h JOIN q ON q.query_id = h.query_id JOIN terms t ON t.term = q.term JOIN posts p ON p.term = q.term AND p.doc_id = h.doc_id, stats WHERE h.rank <= 5"""
)
def r8_explain(spark, sf):
    """What each term adds to the score of a question's best five."""
    return inverted.explain(_index(spark, sf), _queries(spark, sf), 5)


@query(
    f"""WITH f AS (SELECT *, CASE WHEN lang = 'en' THEN list_filter(string_split(narrative, chr(10)), lambda s: trim(s) <> '') END AS facts FROM {_UNITS})
    SELECT unit_id, md5(CASE WHEN len(facts) > 0 THEN array_to_string(facts, ' ') ELSE concat_ws(' ', subject, subject, subject, summary, summary, narrative) END) AS text_md5 FROM f"""
)
def r3_weighted_text(spark, sf):
    """English units have facts, their lines; the others' fields are weighted."""
    lines = F.when(F.col("lang") == "en", F.filter(F.split("narrative", "\n", -1), lambda s: F.trim(s) != ""))
    return T.memunits(spark, sf).select("unit_id", F.md5(X.searchable(lines, F.col("subject"), F.col("summary"), F.col("narrative"))).alias("text_md5"))


@query(
    """WITH v AS (SELECT event_id, user_id, CASE WHEN user_id % 2 = 0 THEN value / 1000 ELSE value END AS x FROM events), w AS (SELECT *, max(x) OVER (PARTITION BY user_id) AS hi, min(x) OVER (PARTITION BY user_id) AS lo FROM v)
    SELECT event_id, round(CASE WHEN hi < 1 THEN 1 / (1 + exp(-x)) WHEN hi = lo THEN 0.5 ELSE (x - lo) / (hi - lo) END, 6) AS score FROM w"""
)
def r16_normalised(spark, sf):
    v = T.read(spark, sf, "events").select("event_id", "user_id", F.when(F.col("user_id") % 2 == 0, F.col("value") / 1000).otherwise(F.col("value")).alias("x"))
    return rank.normalised(v, "user_id", "x").select("event_id", F.round("x", 6).alias("score"))


@query(f"SELECT query_id, doc_id, score, rank FROM (SELECT k.*, row_number() OVER (PARTITION BY k.query_id ORDER BY k.score DESC, k.doc_id) AS rank FROM ({_KNN}) k JOIN embeddings a ON a.vec_id = k.query_id JOIN embeddings b ON b.vec_id = k.doc_id WHERE a.label = b.label AND k.doc_id <> k.query_id AND k.score >= 0.2) WHERE rank <= 10")
def r22_members_by_score(spark, sf):
    """Co-members of each hit with a least score, best first."""
    v = T.vectors(spark, sf)
    hits = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("vector").alias("qvector"))
    found = rank.knn_within(hits, v.withColumnRenamed("vec_id", "doc_id"), "label", 11, least=0.2)  # a hit may be its own best
    return rank.top(found.filter("doc_id <> query_id").drop("rank"), 10).withColumn("rank", F.col("rank").cast("long"))


# aggregations



_PROFILE = "(SELECT o_custkey AS k, round(max(o_totalprice), 2) AS price, list(DISTINCT o_orderpriority) AS items FROM orders WHERE o_orderstatus = '{}' GROUP BY 1)"


@query(
    f"""SELECT coalesce(a.k, b.k) AS user_id, coalesce(b.price, a.price) AS price, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.items, []), coalesce(b.items, [])))), ',') AS items
    FROM {_PROFILE.format('F')} a FULL JOIN {_PROFILE.format('O')} b ON a.k = b.k"""
)
def a13_merge_profiles(spark, sf):
    o = T.read(spark, sf, "orders").withColumnRenamed("o_custkey", "user_id")
    of = lambda s: o.filter(F.col("o_orderstatus") == s).groupBy("user_id").agg(F.round(F.max("o_totalprice"), 2).alias("price"), F.collect_set("o_orderpriority").alias("items"))
    merged = profiles.merge_pair(of("F"), of("O"), ["user_id"], ["price"], ["items"])
    return merged.select("user_id", "price", F.array_join(F.array_sort("items"), ",").alias("items"))


@query(
    f"""WITH {_HITS}, l AS (SELECT label, count(*) - 1 AS truth FROM embeddings GROUP BY 1), f AS (SELECT h.query_id, any_value(a.label) AS label, count(*) FILTER (a.label = b.label) AS found
    FROM h JOIN embeddings a ON a.vec_id = h.query_id JOIN embeddings b ON b.vec_id = h.doc_id WHERE h.doc_id <> h.query_id GROUP BY 1)
    SELECT query_id, found, found > 0 AS hit, CASE WHEN truth > 0 THEN round(found / truth, 6) END AS coverage FROM f JOIN l USING (label)"""
)
def a16_retrieval_quality(spark, sf):
    """Of each query's hits, those of its own cluster: their number, whether there are any, their share of the cluster."""
    e = T.read(spark, sf, "embeddings").select("vec_id", "label")
    truth = e.groupBy("label").agg((F.count("*") - 1).alias("truth"))
    hits = r6_knn(spark, sf).filter("doc_id <> query_id").select("query_id", "doc_id")
    hits = hits.join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id").join(e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("other")), "doc_id")
    found = hits.groupBy("query_id", "label").agg(F.count(F.when(F.col("label") == F.col("other"), 1)).alias("found"))
    return found.join(truth, "label").select("query_id", "found", (F.col("found") > 0).alias("hit"), F.when(F.col("truth") > 0, F.round(F.col("found") / F.col("truth"), 6)).alias("coverage"))


@query("SELECT user_id, count(DISTINCT event_type) AS scored, count(DISTINCT CASE WHEN value > 50 THEN event_type END) AS reranked FROM events GROUP BY 1")
def a19_traversal(spark, sf):
    kind = F.col("event_type")
    return T.read(spark, sf, "events").groupBy("user_id").agg(F.countDistinct(kind).alias("scored"), F.countDistinct(F.when(F.col("value") > 50, kind)).alias("reranked"))


@query(f"WITH {_HITS} SELECT query_id, label::BIGINT AS group_id, max(score) AS best, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS docs FROM h JOIN embeddings ON vec_id = doc_id GROUP BY 1, 2")
def a21_hits_by_group(spark, sf):
    groups = T.read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("group_id"))
    return r6_knn(spark, sf).join(groups, "doc_id").groupBy("query_id", "group_id").agg(F.max("score").alias("best"), _joined(F.struct("rank", "doc_id"), "doc_id").alias("docs"))


# windows, order, sets


@query(
    """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS nth FROM
    (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS own, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE own <= 3) WHERE nth <= least(10, n * 3 // 10)"""
)
def w6_caps_and_budget(spark, sf):
    """At most three of each kind, and of each user at most ten and three tenths of the rows."""
    e = T.read(spark, sf, "events").select("user_id", "event_type", "event_id")
    sizes = e.groupBy("user_id").agg(F.least(F.lit(10), F.floor(F.count("*") * 3 / 10)).alias("budget"))
    own = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    few = e.withColumn("own", own).filter("own <= 3")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_type", "event_id"))
    return few.withColumn("nth", nth).filter("nth <= 10").join(sizes, "user_id").filter("nth <= budget").select("user_id", "event_type", "event_id")


@query("SELECT label::BIGINT AS cluster_id, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS members FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS nth FROM embeddings) WHERE nth <= 3 GROUP BY 1")
def w7_last_members(spark, sf):
    nth = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("vec_id")))
    last = T.read(spark, sf, "embeddings").select("label", "vec_id").withColumn("nth", nth).filter("nth <= 3")
    return last.groupBy(F.col("label").cast("long").alias("cluster_id")).agg(_joined(F.struct("vec_id"), "vec_id").alias("members"))


@query("SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2)")
def w11_first_occurrence(spark, sf):
    first = T.read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))


@query(f"SELECT event_id, at FROM {_EVENTS} ORDER BY at DESC, event_id LIMIT 20 OFFSET 40")
def t3_page(spark, sf):
    return T.behaviors(spark, sf).select("event_id", "at").orderBy(F.desc("at"), "event_id").offset(40).limit(20)


@query("SELECT c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment = 'BUILDING' DESC, c_name, c_custkey) AS place FROM customer")
def t4_multi_key_order(spark, sf):
    order = Window.partitionBy("c_nationkey").orderBy(F.desc(F.col("c_mktsegment") == "BUILDING"), "c_name", "c_custkey")
    return T.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.row_number().over(order).cast("long").alias("place"))


@query("SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS newest FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events) WHERE nth <= 50 GROUP BY 1")
def t6_newest_kept(spark, sf):
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    kept = T.read(spark, sf, "events").select("user_id", "event_id").withColumn("nth", nth).filter("nth <= 50")
    return kept.groupBy("user_id").agg(_joined(F.struct("event_id"), "event_id").alias("newest"))


@query("SELECT query_id, doc_id FROM (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) AS nth FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE nth <= 5")
def u3_related_units(spark, sf):
    """Each unit's first five co-members. Only a cluster's first six members can be among them, so only those are joined."""
    e = T.read(spark, sf, "embeddings").select("label", "vec_id")
    first = e.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).filter("nth <= 6")
    pairs = e.select("label", F.col("vec_id").alias("query_id")).join(first.select("label", F.col("vec_id").alias("doc_id")), "label").filter("query_id <> doc_id")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))
    return pairs.withColumn("nth", nth).filter("nth <= 5").select("query_id", "doc_id")


# evaluation and scalar functions

_ANSWER = """CASE l_linenumber % 7 WHEN 0 THEN 'So (' || l_returnflag || ') it is, not b)' WHEN 1 THEN lower(l_returnflag) || ') yes' WHEN 2 THEN l_returnflag || '. yes' WHEN 3 THEN ' ' || l_returnflag || ' '
    WHEN 4 THEN 'The   answer is ' || l_returnflag WHEN 5 THEN 'I say ' || l_returnflag ELSE 'none at all' END"""
#: Read off the forms above: the lone letters n and r are no choices, and neither is I, the first lone letter of the sixth.
_CHOICE = "CASE WHEN l_linenumber % 7 IN (0, 1, 2) OR (l_linenumber % 7 IN (3, 4) AND l_returnflag = 'A') THEN '(' || lower(l_returnflag) || ')' END"


@query(f"SELECT l_linestatus AS category, {_CHOICE} AS choice, count(*) AS n, count(*) FILTER ({_CHOICE} = '(a)') AS correct FROM lineitem GROUP BY 1, 2")
def e1_exact_match(spark, sf):
    """Choices written in seven ways against the gold choice (a)."""
    r = T.read(spark, sf, "lineitem").select(F.col("l_linestatus").alias("category"), X.choice(F.expr(_ANSWER)).alias("choice"))
    return r.groupBy("category", "choice").agg(F.count("*").alias("n"), F.count(F.when(F.col("choice") == "(a)", 1)).alias("correct"))


@query(f"SELECT unit_id, array_to_string(list_filter({_TOKENS.format('narrative')}, lambda w: NOT list_contains({X.STOPWORDS!r}, w)), ' ') AS words FROM {_UNITS}")
def x2_without_stopwords(spark, sf):
    return T.memunits(spark, sf).select("unit_id", F.array_join(X.tokens(F.col("narrative"), X.STOPWORDS), " ").alias("words"))


@query("SELECT event_id, CASE WHEN x >= 1000000000000 THEN x ELSE x * 1000 END AS ms FROM (SELECT event_id, epoch_us(ts) // 1000000 * CASE WHEN event_id % 2 = 0 THEN 1 ELSE 1000 END AS x FROM events)")
def x7_epoch(spark, sf):
    x = F.col("at") * F.when(F.col("event_id") % 2 == 0, 1).otherwise(1000)
    return T.behaviors(spark, sf).select("event_id", X.epoch_ms(x).alias("ms"))


@query("SELECT l_orderkey AS order_id, l_linenumber::BIGINT AS line, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS days, strftime(o_orderdate::DATE + 30, '%Y-%m-%d') AS ends FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def x10_durations(spark, sf):
    l = T.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = T.read(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).cast("long")
    ends = F.date_format(F.date_add(F.to_date("o_orderdate"), 30), "yyyy-MM-dd")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line"), days.alias("days"), ends.alias("ends"))


@query(f"SELECT conv_id, count(*) AS n, md5(string_agg(sender || ': ' || content, chr(10) ORDER BY turn, sender, content)) AS transcript_md5 FROM {_MESSAGES} GROUP BY 1")
def x13_transcript(spark, sf):
    m = T.messages(spark, sf).withColumn("line", F.concat_ws(": ", "sender", "content"))
    return m.groupBy("conv_id").agg(F.count("*").alias("n"), F.md5(_joined(F.struct("turn", "sender", "content", "line"), "line", "\n")).alias("transcript_md5"))


@query(f"SELECT event_id, regexp_replace(array_to_string(list_transform(range(7, -1, -1), lambda i: substr('{X.BASE62}', (event_id * 7919 // pow(62, i)::BIGINT % 62 + 1)::BIGINT, 1)), ''), '^0+(.)', '\\1') AS code FROM events")
def x17_short_code(spark, sf):
    return T.read(spark, sf, "events").select("event_id", X.base62(F.col("event_id") * 7919, 8).alias("code"))


@query(f"SELECT unit_id, array_to_string(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), '|') AS shingles FROM (SELECT unit_id, {_TOKENS.format('narrative')} AS t FROM {_UNITS})")
def x21_shingles(spark, sf):
    return T.memunits(spark, sf).select("unit_id", F.array_join(X.shingles(X.tokens(F.col("narrative"))), "|").alias("shingles"))


@query(f"WITH v AS {_VECTORS} SELECT a.vec_id AS a, b.vec_id AS b, round({_COS.format('a.vector', 'b.vector')}, 6) AS score FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def r4_cosine(spark, sf):
    """Each vector with the one after it."""
    v = T.vectors(spark, sf).select("vec_id", "vector")
    after = v.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("vector").alias("w"))
    return v.join(after, F.col("vec_id") == F.col("a")).select("a", "b", F.round(rank.cosine(F.col("vector"), F.col("w")), 6).alias("score"))
