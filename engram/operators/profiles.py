"""Value-evidence merges and versioned profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.shared import written

#: Level labels by rank, English and Chinese; other labels rank 0.
LEVELS = {
    1: ["低级", "low", "basic", "beginner", "初级", "familiar", "weak"],
    2: ["中级", "medium", "intermediate"],
    3: ["高级", "high", "advanced", "strong", "专家", "expert"],
}
_BLANKS = " \t\n\r\x0b\x0c"


def level_rank(level: Column) -> Column:
    """The rank of a label, whatever its case and the blanks around it."""
    name = F.lower(F.btrim(level, F.lit(_BLANKS)))
    rank = F.lit(0)
    for no, labels in LEVELS.items():
        rank = F.when(name.isin(labels), no).otherwise(rank)
    return rank


def merge_values(rows: DataFrame, keys: list[str], keep: str = "last", n: int | None = None, part_rows: int = 500_000) -> DataFrame:
    """rows: keys, value, level, evidence, seq (of any type that has an order). One row per trimmed value: evidences distinct in first-seen
    order; the last non-empty level, or with keep="highest" the highest, trimmed, of which the earliest stays: an empty level counts
    less than an unknown one, and the level is empty where all are. n: how many rows there are, if that is known; both aggregates sort
    part_rows of them in a task, however many there are."""
    # the first key alone, as another may be a constant, which Spark leaves out of the groups and then shuffles once more
    parts = max(1, -(-(rows.count() if n is None else n) // part_rows))
    value = F.trim("value")
    rows = rows.filter(value != "").withColumn("value", value)
    filled = F.coalesce(F.col("level"), F.lit("")) != ""
    if keep == "highest":
        best, of = F.min, F.when(filled, F.struct((-level_rank(F.col("level"))).alias("r"), "seq", "level"))
    else:
        best, of = F.max, F.when(filled, F.struct("seq", "level"))
    # evidence by evidence first, so that a value with many copies of one evidence keeps one; the level is folded on the way
    first = rows.repartition(parts, keys[0], "value", "evidence").groupBy(*keys, "value", "evidence").agg(F.min("seq").alias("seq"), best(of).alias("best"))
    evidences = F.transform(F.array_sort(F.collect_list(F.struct("seq", "evidence"))), lambda x: x["evidence"])
    lists = first.repartition(parts, keys[0], "value").groupBy(*keys, "value").agg(evidences.alias("evidences"), best("best").alias("best"))
    level = F.col("best")["level"] if keep != "highest" else F.coalesce(F.btrim(F.col("best")["level"], F.lit(_BLANKS)), F.lit(""))
    return lists.select(*keys, "value", "evidences", level.alias("level"))


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Adds is_latest: the row has the largest version of its key."""
    return rows.withColumn("is_latest", F.col(version) == F.max(version).over(Window.partitionBy(*keys)))


def as_of(rows: DataFrame, keys: list[str], version: str, first: int, last: int, tie: str) -> DataFrame:
    """The latest version within the closed range, of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc(tie))
    return rows.filter(F.col(version).between(first, last)).withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same keys; the rest of both stays."""
    a, b = old.alias("a"), new.withColumn("given", F.lit(True)).alias("b")
    joined = a.join(b, keys, "full")
    return joined.select(*keys, *[F.when(F.col("b.given"), F.col(f"b.{v}")).otherwise(F.col(f"a.{v}")).alias(v) for v in values])


def versioned_upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str, values: list[str], seq: str) -> tuple[DataFrame, DataFrame]:
    """Rows after the updates ``new``, with is_latest, and the updates that fail. An update with a version changes or makes that one; one
    without changes the latest version there was, and fails where there is none. Of updates to one version the last by seq counts."""
    top = old.groupBy(*keys).agg(F.max(version).alias("top"))
    aimed = new.join(top, keys, "left").withColumn(version, F.coalesce(version, "top")).drop("top")
    last = aimed.filter(F.col(version).isNotNull()).groupBy(*keys, version).agg(*[F.max_by(v, seq).alias(v) for v in values])
    return latest(upsert(old, last, [*keys, version], values), keys, version), aimed.filter(F.col(version).isNull())


def save_state(saves: DataFrame, keys: list[str]) -> DataFrame:
    """saves: keys, cluster_id, seq. The state after all saves: version (their number), cluster_ids (each once, as they came,
    comma-joined), last_cluster."""
    first = saves.groupBy(*keys, "cluster_id").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("first", "cluster_id"))), lambda x: x["cluster_id"])
    return first.groupBy(*keys).agg(F.sum("n").alias("version"), F.array_join(ids, ",").alias("cluster_ids"), F.max_by("cluster_id", "last").alias("last_cluster"))


def high_value(answer: Column, least: float = 0.6) -> Column:
    """Whether a model's JSON answer says high value with enough confidence; answers that can't be read don't."""
    told = F.from_json(answer, "is_high_value boolean, confidence double")
    return F.coalesce(told["is_high_value"] & (told["confidence"] >= least), F.lit(False))


def importance(messages: DataFrame, group: str) -> DataFrame:
    """messages: group, user_id, refs (array of user ids). group, user_id, chat_count, at_count, total (the group's messages),
    important: by both counts, the share of the messages, or the references."""
    m = messages.select(group, "user_id", "refs")
    facts = m.select(group, F.explode(F.concat(F.array(F.struct("user_id", F.lit(1).alias("speak"))), F.transform("refs", lambda r: F.struct(r.alias("user_id"), F.lit(0).alias("speak"))))).alias("f"))
    counts = facts.groupBy(group, "f.user_id").agg(F.sum("f.speak").alias("chat_count"), F.sum(1 - F.col("f.speak")).alias("at_count"))
    rows = counts.join(m.groupBy(group).agg(F.count("*").alias("total")), group)
    return rows.withColumn("important", F.expr("chat_count + at_count >= 5 or chat_count / total > 0.1 or at_count >= 2"))


def appended(old: DataFrame, new: DataFrame, keys: list[str], most: int) -> DataFrame:
    """old, new: keys, evidence, pos. The old evidences, then the new ones, the first ``most``: keys, evidences."""
    rows = old.select(*keys, "evidence", F.lit(0).alias("part"), "pos").unionByName(new.select(*keys, "evidence", F.lit(1).alias("part"), "pos"))
    kept = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("part", "pos"))).filter(F.col("nth") <= most)
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "evidence"))), lambda x: x["evidence"]).alias("evidences"))


def merge_item_evidences(original: DataFrame, completed: DataFrame, dates: DataFrame, keys: list[str]) -> DataFrame:
    """original, completed: keys (the path of a list), pos, item (map of text to text, without evidences), evidences; dates: evidence, date,
    the known ones. Original items with the evidences, as date|id, of the last completed item that matches them and has known ones.

    A completed item matches the first item that is equal but for evidences, else the first that agrees in the first of these
    fields in which any does."""
    # fixed values: the fields, in the order they are tried
    fields = ["value", "skill", "project_id", "project_name", "user_id", "name", "title"]
    whole = F.to_json(F.array_sort(F.map_entries("item")))
    trimmed = lambda f: F.nullif(F.trim(F.try_element_at("item", F.lit(f))), F.lit(""))
    names = F.array(F.struct(F.lit(0).alias("no"), F.when(F.size("item") > 0, whole).alias("name")), *[F.struct(F.lit(i).alias("no"), trimmed(f).alias("name")) for i, f in enumerate(fields, 1)])
    named = lambda rows: rows.select(*keys, "pos", F.explode(names).alias("n")).select(*keys, "pos", "n.no", "n.name").filter("name is not null")
    first = named(original).groupBy(*keys, "no", "name").agg(F.min("pos").alias("target"))
    matched = named(completed).join(first, [*keys, "no", "name"]).groupBy(*keys, "pos").agg(F.min_by("target", "no").alias("target"))
    found = completed.join(matched, [*keys, "pos"]).select(*keys, "pos", "target", F.posexplode("evidences").alias("place", "e"))
    id_of = F.trim(F.regexp_replace("e", r"^\d{4}-\d{2}-\d{2}\|", ""))
    known = found.withColumn("evidence", id_of).join(dates, "evidence").select(*keys, "pos", "target", "place", F.concat_ws("|", "date", "evidence").alias("shown"))
    lists = known.groupBy(*keys, "target", "pos").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "shown"))), lambda x: x["shown"])).alias("formatted"))
    last = lists.groupBy(*keys, F.col("target").alias("pos")).agg(F.max_by("formatted", "pos").alias("formatted"))
    return original.join(last, [*keys, "pos"], "left").select(*keys, "pos", "item", F.coalesce("formatted", "evidences").alias("evidences"))


def evicted(now: Column, inactive: int = 30 * 86400) -> Column:
    """An aggregate over topics (topic_id, status, last_at): the one to go. Implemented ones that were inactive for so many seconds come
    first, then the one longest inactive."""
    old = (F.col("status") == "implemented") & (F.coalesce("last_at", now) < now - inactive)
    return F.min_by("topic_id", F.struct(~F.coalesce(old, F.lit(False)), F.coalesce("last_at", F.lit(-(1 << 62))), "topic_id"))


def updated_topics(topics: DataFrame, updates: DataFrame, units: DataFrame, most: int = 5, most_evidences: int = 10, inactive: int = 30 * 86400) -> DataFrame:
    """topics: group_id, topic_id, name, status, last_at, evidences; updates: group_id, seq, update_type (update, new), topic_id, name,
    status, evidences; units: group_id, unit_id, at, the known ones. The topics of each group after its updates, last active first:
    group_id, place, topic_id (new_<seq> for new ones), name, status, last_at, evidences.

    An update of a known topic merges its known evidences, the last ``most_evidences``; others are passed over. A new topic takes
    the place of the one that ``evicted`` would name where there are ``most``. A topic was last active at its latest known evidence, else
    at the group's latest unit. Updates follow one another, so a group, with its units' times for the evidences named, is folded in one task."""
    named = updates.select("group_id", "seq", F.explode("evidences").alias("unit_id"))
    old = topics.select("group_id", F.explode("evidences").alias("unit_id"))
    wanted = named.select("group_id", "unit_id").unionByName(old).distinct().join(units, ["group_id", "unit_id"]).groupBy("group_id").agg(F.map_from_entries(F.collect_list(F.struct("unit_id", "at"))).alias("known"))
    newest = units.groupBy("group_id").agg(F.max("at").alias("newest"))
    of = lambda rows, name, *columns: rows.groupBy("group_id").agg(F.collect_list(F.struct(*columns)).alias(name))
    held = of(topics, "topics", "topic_id", "name", "status", "last_at", "evidences")
    told = of(updates, "updates", "seq", F.coalesce("update_type", F.lit("new")).alias("update_type"), "topic_id", "name", "status", "evidences")
    same = F.col("group_id").eqNullSafe(F.col("g"))
    groups = held.join(told.withColumnRenamed("group_id", "g"), same, "full").select(F.coalesce("group_id", "g").alias("group_id"), "topics", "updates")
    groups = groups.join(wanted, "group_id", "left").join(newest, "group_id", "left")

    def fold(topics, updates, known, now):
        known = known or {}
        active = lambda ids: max((known[i] for i in ids if i in known), default=now)
        held = {t["topic_id"]: (t["name"], t["status"], t["last_at"], list(t["evidences"] or [])) for t in topics or []}
        old = lambda t: t[1] == "implemented" and now is not None and (now if t[2] is None else t[2]) < now - inactive
        for u in sorted(updates or [], key=lambda u: u["seq"]):
            told = [e for e in u["evidences"] or [] if e in known]
            if u["update_type"] == "update":
                if u["topic_id"] in held:
                    before = held[u["topic_id"]][3]
                    merged = (before + sorted((e for e in dict.fromkeys(told) if e not in before), key=known.get))[-most_evidences:]
                    held[u["topic_id"]] = (u["name"], u["status"], active(merged), merged)
                continue
            if len(held) >= most:
                del held[min(held, key=lambda i: (not old(held[i]), -(1 << 62) if held[i][2] is None else held[i][2], i))]
            held[f"new_{u['seq']}"] = (u["name"], u["status"], active(told), told)
        out = sorted(((i, *t) for i, t in held.items()), key=lambda t: (t[3] is None, -(t[3] or 0), t[0]))
        return [(place, *t) for place, t in enumerate(out, 1)]

    # a group is one row, so that a fold costs no more than its updates
    folded = F.udf(fold, "array<struct<place:bigint,topic_id:string,name:string,status:string,last_at:bigint,evidences:array<string>>>")
    return groups.select("group_id", F.inline(folded("topics", "updates", "known", "newest")))


def unit_dates(units: DataFrame) -> DataFrame:
    """units: batch, unit_id, unit_at, said_at (epoch seconds), grp. batch, unit_id, date (UTC) of the unit's own time, else of its first
    message, and group_id, the first of the batch that is known."""
    one = units.groupBy("batch", "unit_id").agg(F.min(F.coalesce("unit_at", "said_at")).alias("at"), F.min("grp").alias("grp"))
    group = one.groupBy("batch").agg(F.min_by("grp", F.when(F.col("grp").isNotNull(), F.col("unit_id"))).alias("group_id"))
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("at") / 86400).cast("int")), "yyyy-MM-dd")
    return one.join(group, "batch").select("batch", "unit_id", day.alias("date"), "group_id")


def judge_accuracy(questions: DataFrame) -> DataFrame:
    """questions: category, judgments (map of run to boolean). scope (all, or a category), runs, mean and population deviation of the
    runs' accuracies."""
    each = questions.select("category", F.explode("judgments").alias("run", "ok")).groupBy("category", "run").agg(F.sum(F.col("ok").cast("int")).alias("right"), F.count("*").alias("n"))
    of = lambda scope: each.groupBy(scope.alias("scope"), "run").agg((F.sum("right") / F.sum("n")).alias("x"))
    runs = of(F.col("category")).unionByName(of(F.lit("all")))
    return runs.groupBy("scope").agg(F.count("*").alias("runs"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"))


def majority_roll_up(questions: DataFrame, least: int = 2) -> DataFrame:
    """questions: conv_id, category, judgments (map of run to boolean). conv_id and category (null: all), n, correct (questions that at
    least ``least`` runs call right), accuracy; over all, by conversation and by category."""
    right = F.size(F.filter(F.map_values("judgments"), lambda ok: F.coalesce(ok, F.lit(False)))) >= least
    rows = questions.select("conv_id", F.coalesce(F.col("category").cast("string"), F.lit("unknown")).alias("category"), F.coalesce(right, F.lit(False)).cast("int").alias("ok"))
    return rows.groupingSets([[], ["conv_id"], ["category"]], "conv_id", "category").agg(F.count("*").alias("n"), F.sum("ok").alias("correct"), F.avg("ok").alias("accuracy"))


def role_evidences(history: DataFrame, new: DataFrame, units: DataFrame, most: int = 50) -> DataFrame:
    """history: role, user_id, evidence, pos, confidence; new: role, user_id, evidence, confidence; units: evidence, user_id (who takes part),
    at. For the known roles and users that new findings name: confidence, strong once either says so, and evidences: those of history as
    they were, then the new ones in which the user takes part, by time, none twice, the last ``most``."""
    known = lambda rows: rows.filter(F.col("role").isin(ROLES) & (F.coalesce(F.col("user_id").cast("string"), F.lit("")) != ""))
    keys = ["role", "user_id"]
    named, old = known(new), known(history)
    strong = F.max(F.coalesce(F.col("confidence") == "strong", F.lit(False)))
    said = named.groupBy(*keys).agg(strong.alias("now"))
    before = old.groupBy(*keys).agg(strong.alias("was"))
    valid = named.join(units, ["evidence", "user_id"]).select(*keys, "evidence", "at")
    merged = merge_evidences(old.join(said.select(*keys), keys, "left_semi").select(*keys, "evidence", "pos"), valid, keys, most)
    both = said.join(before, keys, "left").join(merged, keys, "left")
    confidence = F.when(F.col("now") | F.coalesce("was", F.lit(False)), "strong").otherwise("weak")
    return both.select(*keys, confidence.alias("confidence"), F.coalesce("evidences", F.array().cast("array<string>")).alias("evidences"))


def merge_pair(old: DataFrame, new: DataFrame, keys: list[str], scalars: list[str], lists: list[str]) -> DataFrame:
    """One profile of each key: scalars of new win unless null, lists are joined without repeats."""
    joined = old.alias("a").join(new.alias("b"), keys, "full")
    each = [F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in scalars]
    given = lambda x: F.coalesce(F.col(x), F.array())
    return joined.select(*keys, *each, *[F.array_union(given(f"a.{c}"), given(f"b.{c}")).alias(c) for c in lists])


def payload_rows(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """Loose JSON payloads as rows: key, seq (the places of entry, value and evidence), value, evidence (null: none), level. Shapes: an object with value, evidences and level; an
    object of values and their evidences; a list of either, where a list entry's own evidences hold for all its values; a list of texts; a
    text. The names evidences and level in an object are no values."""
    text = F.trim(payload)
    entries = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))
    each = rows.select(key, F.posexplode(entries).alias("no", "e"), text.startswith("[").alias("listed"))
    is_object = F.trim("e").startswith("{")
    fields = F.from_json(F.when(is_object, F.col("e")), "map<string,string>")
    get = lambda n: F.try_element_at(F.col("fields"), F.lit(n))
    named = F.filter(F.map_keys("fields"), lambda k: ~k.isin("evidences", "level"))
    values = (
        F.when(F.col("fields").isNull(), F.array(F.struct(F.col("e").alias("value"), F.lit(None).cast("string").alias("found"))))
        .when(get("value").isNotNull(), F.array(F.struct(get("value").alias("value"), get("evidences").alias("found"))))
        .otherwise(F.transform(named, lambda k: F.struct(k.alias("value"), F.when(F.col("listed") & get("evidences").isNotNull(), get("evidences")).otherwise(F.col("fields")[k]).alias("found"))))
    )
    each = each.withColumn("fields", fields)
    each = each.select(key, "no", get("level").alias("level"), F.posexplode(values).alias("nth", "v"))
    found = F.trim("v.found")
    lists = F.when(found.startswith("["), F.from_json(found, "array<string>")).when(found != "", F.array(found))
    each = each.select(key, "no", "nth", "level", F.trim("v.value").alias("value"), F.posexplode_outer(lists).alias("place", "evidence"))
    seq = F.struct("no", "nth", F.coalesce("place", F.lit(0)).alias("place"))
    return each.filter("value <> ''").select(key, seq.alias("seq"), "value", "evidence", "level")


def pruned(fields: Column) -> Column:
    """An array of struct field, entries (array of struct with evidences) without entries that have no evidence and empty fields."""
    kept = F.transform(fields, lambda f: f.withField("entries", F.filter(f["entries"], lambda e: F.size(F.coalesce(e["evidences"], F.array())) > 0)))
    return F.filter(kept, lambda f: F.size(f["entries"]) > 0)


def merge_evidences(old: DataFrame, new: DataFrame, keys: list[str], most: int) -> DataFrame:
    """old: keys, evidence, pos; new: keys, evidence, at. Old evidences in their order, then new ones in order of time, none twice, the
    last ``most``. keys, evidences (array), last_at (the latest time of a kept new one)."""
    evidence = F.col("evidence").cast("string").alias("evidence")
    none = F.lit(None).cast("long")
    rows = old.select(*keys, evidence, F.lit(0).alias("part"), F.col("pos").cast("long").alias("ord"), none.alias("at"))
    rows = rows.unionByName(new.select(*keys, evidence, F.lit(1).alias("part"), F.col("at").cast("long").alias("ord"), F.col("at").cast("long").alias("at")))
    one = rows.groupBy(*keys, "evidence").agg(F.min(F.struct("part", "ord")).alias("first"), F.max("at").alias("at"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("first"), F.desc("evidence")))
    kept = one.withColumn("nth", nth).filter(F.col("nth") <= most)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("nth", "evidence")), False), lambda x: x["evidence"])
    return kept.groupBy(*keys).agg(ordered.alias("evidences"), F.max("at").alias("last_at"))


#: The roles that a group profile knows.
ROLES = ["decision_maker", "opinion_leader", "topic_initiator", "execution_promoter", "core_contributor", "coordinator", "info_summarizer"]


def merge_groups(rows: DataFrame, level_fields: list[str]) -> DataFrame:
    """One profile of each user from those of their groups. rows: user_id, group_id, important (null counts as true), field, value,
    level, evidence, seq. Only important groups count, all where none is; fields with levels keep the highest, others the last."""
    important = F.coalesce("important", F.lit(True))
    some = written(rows.groupBy("user_id").agg(F.max(important).alias("some"), F.count("*").alias("n")))
    n = some.agg(F.sum("n")).first()[0] or 0
    used = rows.join(some.select("user_id", "some"), "user_id").filter(important | ~F.col("some"))
    of = lambda cond, keep: merge_values(used.filter(cond), ["user_id", "field"], keep, n)
    levelled = F.col("field").isin(level_fields)
    return of(levelled, "highest").unionByName(of(~levelled, "last"))


def merge_group_info(rows: DataFrame) -> DataFrame:
    """rows: user_id, group_id, seq, name, reasoning. user_id, the last known name, group_ids as they come, comma-joined, and all
    reasonings that aren't empty, joined by $."""
    groups = rows.groupBy("user_id", "group_id").agg(F.min("seq").alias("first")).groupBy("user_id")
    ids = groups.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "group_id"))), lambda x: x["group_id"].cast("string")), ",").alias("group_ids"))
    told = F.array_sort(F.collect_list(F.when(F.coalesce("reasoning", F.lit("")) != "", F.struct("seq", "reasoning"))))
    info = rows.groupBy("user_id").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("seq"))).alias("name"), F.array_join(F.transform(told, lambda x: x["reasoning"]), "$").alias("reasoning"))
    return info.join(ids, "user_id").select("user_id", "name", "group_ids", "reasoning")


def merge_projects(rows: DataFrame) -> DataFrame:
    """rows: user_id, project_id, project_name, field, value, level, evidence, seq, entry_date. Projects are one by their id, else by their
    name; each field's values are merged, the first entry date that isn't empty is the project's. Where rows with one seq tell different
    dates or levels, those of the least place (struct of a number and a name that tell rows apart; optional) count, else the least date
    and the greatest level."""
    place = F.col("place") if "place" in rows.columns else F.struct(F.lit(0).alias("no"), F.lit("").alias("name"))
    rows = rows.withColumn("project", F.coalesce(F.nullif("project_id", F.lit("")), "project_name")).withColumn("place", place)
    date = F.min(F.when(F.coalesce("entry_date", F.lit("")) != "", F.struct("seq", "place", "entry_date")))
    dates = rows.groupBy("user_id", "project").agg(F.coalesce(date["entry_date"], F.lit("")).alias("entry_date"))
    last = rows.withColumn("seq", F.struct("seq", (-F.col("place.no")).alias("no"), "place.name"))  # of the greatest the least place
    return merge_values(last, ["user_id", "project", "field"]).join(dates, ["user_id", "project"])
