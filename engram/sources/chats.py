"""Chat files to message rows: group chats, session-keyed dialogues, single messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.text import collapsed, instant, session_time

_META = "struct<group_id:string,name:string,scene:string,default_timezone:string,user_details:map<string,struct<full_name:string,role:string>>>"
_MESSAGE = "struct<message_id:string,create_time:string,sender:string,sender_name:string,content:string,refer_list:array<string>>"
_SAID = "array<struct<speaker:string,text:string,dia_id:string,img_url:string,blip_caption:string>>"


def group_chat(files: DataFrame, chat: str = "chat") -> DataFrame:
    """files: the JSON text of a group chat. One row a message: group_id, group_name, scene, place, message_id, sender, full_name, content,
    refs (ids), at, current_at (epoch seconds).

    A missing name is looked up in user_details, else it is the id; references are ids or messages with an id; times without an
    offset are in the chat's time zone, UTC if it names none; current_at is the last message's time. Chats without messages
    or meta data give no rows."""
    c = F.from_json(chat, f"struct<conversation_meta:{_META},conversation_list:array<{_MESSAGE}>>")
    rows = files.select(c.alias("c")).filter("c.conversation_meta is not null and size(c.conversation_list) > 0")
    rows = rows.select(F.col("c.conversation_meta").alias("meta"), F.try_element_at("c.conversation_list", F.lit(-1))["create_time"].alias("ends"), F.posexplode("c.conversation_list").alias("place", "m"))
    zone = F.coalesce(F.nullif("meta.default_timezone", F.lit("")), F.lit("UTC"))
    known = F.try_element_at("meta.user_details", F.col("m.sender"))["full_name"]
    id_of = lambda r: F.when(F.ltrim(r).startswith("{"), F.get_json_object(r, "$.message_id")).otherwise(r)
    refs = F.filter(F.transform(F.coalesce("m.refer_list", F.array().cast("array<string>")), id_of), lambda r: F.coalesce(r, F.lit("")) != "")
    return rows.select(
        "meta.group_id", F.col("meta.name").alias("group_name"), "meta.scene", "place", "m.message_id", "m.sender",
        F.coalesce(F.nullif("m.sender_name", F.lit("")), known, F.col("m.sender")).alias("full_name"), F.coalesce("m.content", F.lit("")).alias("content"), refs.alias("refs"),
        instant(F.col("m.create_time"), zone).alias("at"), instant(F.col("ends"), zone).alias("current_at"),
    )


def checked_messages(rows: DataFrame, required: list[str]) -> DataFrame:
    """Adds reason: the first required field that is null or blank, null for valid rows, whose required texts are collapsed."""
    text = lambda c: F.coalesce(collapsed(F.col(c).cast("string")), F.lit(""))
    reason = F.coalesce(*[F.when(text(c) == "", F.lit(c)) for c in required])
    rows = rows.withColumn("reason", reason)
    for f in rows.schema:
        if f.name in required and f.dataType.simpleString() == "string":
            rows = rows.withColumn(f.name, F.when(F.col("reason").isNull(), text(f.name)).otherwise(F.col(f.name)))
    return rows


def dialogue_messages(dialogues: DataFrame, interval: float = 30.0, fake_start: int = 1_704_067_200) -> DataFrame:
    """dialogues: conv_id, conversation (JSON text with session_N and session_N_date_time keys). One row a message: conv_id, session,
    no (from 0), speaker_id, speaker, content, dia_id, at (epoch seconds), is_fake.

    Sessions are in order of their number. One without a readable time starts fake_start plus as many hours as sessions come before it.
    Messages are ``interval`` apart, or so that they fill nine tenths of the time to the next session if that is less. A shared
    image is told in front of the text."""
    keys = F.from_json("conversation", "map<string,string>")
    pairs = dialogues.select("conv_id", keys.alias("c")).select("conv_id", "c", F.explode(F.map_keys("c")).alias("session")).filter(F.col("session").rlike(r"^session_\d+$"))
    sessions = pairs.select(
        "conv_id", "session", F.regexp_extract("session", r"(\d+)", 1).cast("int").alias("n"),
        session_time(F.try_element_at("c", F.concat("session", F.lit("_date_time")))).alias("told"), F.from_json(F.try_element_at("c", F.col("session")), _SAID).alias("said"),
    )
    order = Window.partitionBy("conv_id").orderBy("n")
    sessions = sessions.withColumn("start", F.coalesce("told", F.lit(fake_start) + (F.row_number().over(order) - 1) * 3600))
    room = F.lead("start").over(order) - F.col("start")
    steps = F.size("said") - 1
    step = F.when((room > 0) & (steps * interval > room * 0.9), room * 0.9 / F.nullif(steps, F.lit(0))).otherwise(F.lit(interval))
    rows = sessions.withColumn("step", step).select("conv_id", "session", "start", "step", F.col("told").isNull().alias("is_fake"), F.posexplode("said").alias("no", "m"))
    image = F.concat(F.lit("["), F.col("m.speaker"), F.lit(" shared an image: "), F.coalesce("m.blip_caption", F.lit("an image")), F.lit("] "))
    return rows.select(
        "conv_id", "session", "no", F.concat(F.replace(F.lower("m.speaker"), F.lit(" "), F.lit("_")), F.lit("_"), F.col("conv_id").cast("string")).alias("speaker_id"), F.col("m.speaker").alias("speaker"),
        F.concat(F.when(F.coalesce("m.img_url", F.lit("")) != "", image).otherwise(""), "m.text").alias("content"), "m.dia_id", (F.col("start") + F.col("no") * F.col("step")).alias("at"), "is_fake",
    )


def history_and_new(rows: DataFrame, batch: str, order: list[Column], ratio: float = 0.8) -> DataFrame:
    """Adds part: the first ``ratio`` of a batch, rounded down, is history, the rest new; the last row is new in any case."""
    w = Window.partitionBy(batch)
    n, no = F.count("*").over(w), F.row_number().over(w.orderBy(*order))
    return rows.withColumn("part", F.when(no <= F.least(F.floor(F.lit(ratio) * n), n - 1), "history").otherwise("new"))
