"""Evaluation sets in their file shapes to rows: QA pairs, haystack dialogues, persona files; cluster indexes as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def qa_pairs(dialogues: DataFrame) -> DataFrame:
    """dialogues: conv_id, qa (array of struct question_id, question, answer, category, evidence). One row a pair; an id is
    made where none is given; categories become strings."""
    rows = dialogues.select(F.col("conv_id").cast("string").alias("conv_id"), F.posexplode("qa").alias("no", "p"))
    made = F.concat("conv_id", F.lit("_qa"), "no")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c.split(".")[1])
    return rows.select(
        F.coalesce(F.nullif("p.question_id", F.lit("")), made).alias("question_id"), "conv_id", text("p.question"), text("p.answer"),
        F.col("p.category").cast("string").alias("category"), F.coalesce("p.evidence", F.array().cast("array<string>")).alias("evidence"),
    )


def dialogue_time(stamp: Column) -> Column:
    """2023/05/20 (Sat) 02:21 as 2:21 am on 20 May, 2023."""
    at = F.try_to_timestamp(F.regexp_replace(stamp, r" \([A-Za-z]+\)", ""), F.lit("yyyy/MM/dd HH:mm"))
    return F.concat(F.lower(F.date_format(at, "h:mm a")), F.lit(" on "), F.date_format(at, "d MMMM, yyyy"))


def haystack(rows: DataFrame) -> DataFrame:
    """rows: question_id, haystack_session_ids, haystack_dates, haystack_sessions (array of arrays of struct role, content),
    answer_session_ids. One row a message: question_id, session, session_time, dia_id (D<session>:<message>), speaker, text,
    is_evidence (its session has the answer)."""
    sessions = F.arrays_zip(F.col("haystack_session_ids").alias("id"), F.col("haystack_dates").alias("date"), F.col("haystack_sessions").alias("messages"))
    each = rows.select("question_id", "answer_session_ids", F.posexplode(sessions).alias("session", "s"))
    said = each.select("*", F.posexplode("s.messages").alias("no", "m"))
    return said.select(
        "question_id", "session", dialogue_time(F.col("s.date")).alias("session_time"), F.concat(F.lit("D"), "session", F.lit(":"), "no").alias("dia_id"),
        F.concat("m.role", F.lit("_"), "question_id").alias("speaker"), F.col("m.content").alias("text"), F.array_contains("answer_session_ids", F.col("s.id")).alias("is_evidence"),
    )


def options(shown: Column) -> Column:
    """Map of choice to text, from a printed list like ['(a) one', "(b) two"]."""
    items = F.regexp_extract_all(shown, F.lit(r"""(?s)['"](\([a-z]\)(?:[^'"\\]|\\.|(?<=\w)'(?=\w))*)['"]"""), F.lit(1))
    return F.map_from_entries(F.transform(items, lambda x: F.struct(F.substring(x, 1, 3), F.trim(F.regexp_replace(x, r"(?s)^\([a-z]\)\s*", "")))))


def persona_dialogues(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """questions: shared_context_id, end_index_in_shared_context; contexts: context_id, messages (array of struct role, content).
    One row a message of each context prefix that a question ends at: context_id, end_index, dia_id, speaker, text. System messages
    only give the persona's name; User: and Assistant: at line starts go. Unknown contexts go."""
    ends = questions.select(F.col("shared_context_id").alias("context_id"), F.col("end_index_in_shared_context").cast("int").alias("end_index")).distinct()
    rows = ends.join(contexts, "context_id").withColumn("prefix", F.slice("messages", 1, F.col("end_index") + 1))
    first = F.try_element_at("prefix", F.lit(1))
    name = F.when(first["role"] == "system", F.nullif(F.trim(F.regexp_extract(first["content"], r"Name:\s*([^\n]+)", 1)), F.lit("")))
    rows = rows.select("context_id", "end_index", F.coalesce(name, F.lit("User")).alias("persona"), F.posexplode(F.filter("prefix", lambda m: m["role"] != "system")).alias("no", "m"))
    speaker = F.when(F.col("m.role") == "user", F.col("persona")).otherwise("Assistant")
    text = F.trim(F.regexp_replace("m.content", r"(?m)^(User|Assistant):\s*", ""))
    return rows.select("context_id", "end_index", F.concat(F.lit("D0:"), "no").alias("dia_id"), speaker.alias("speaker"), text.alias("text"))


def read_persona(spark: SparkSession, questions_csv: str, contexts_jsonl: str) -> tuple[DataFrame, DataFrame]:
    """The two files: questions, and contexts of which each line maps ids to messages."""
    questions = spark.read.csv(questions_csv, header=True, multiLine=True, escape='"')
    lines = spark.read.text(contexts_jsonl).select(F.explode(F.from_json("value", "map<string,array<struct<role:string,content:string>>>")).alias("context_id", "messages"))
    return questions, lines


def index_to_json(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """clusters: conv_id, cluster_id, topic; members: conv_id, cluster_id, unit_id, at. One JSON text for each conversation."""
    lists = members.groupBy("conv_id", "cluster_id").agg(F.array_sort(F.collect_list(F.struct("at", "unit_id"))).alias("members"))
    one = F.struct("cluster_id", "topic", "members")
    whole = clusters.join(lists, ["conv_id", "cluster_id"], "left").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("clusters"))
    return whole.select("conv_id", F.to_json(F.struct("clusters")).alias("index"))


def index_from_json(rows: DataFrame) -> DataFrame:
    """The members of such texts: conv_id, cluster_id, topic, at, unit_id."""
    kind = "struct<clusters:array<struct<cluster_id:bigint,topic:string,members:array<struct<at:bigint,unit_id:bigint>>>>>"
    each = rows.select("conv_id", F.explode(F.from_json("index", kind)["clusters"]).alias("c"))
    return each.select("conv_id", "c.cluster_id", "c.topic", F.explode("c.members").alias("m")).select("conv_id", "cluster_id", "topic", "m.at", "m.unit_id")
