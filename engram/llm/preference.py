"""Preference formatting, with DataFrame operations only.

The chosen and the rejected conversation of a pair are aligned turn by turn. The longest common turn prefix is rendered once,
as the prompt; what follows on either side is its completion, of which only the assistant's turns count in the loss.
Rows stay turns: a pair of any length is never gathered into one value, nor sorted in one task. Its turns are numbered in ranges, the
first turn that differs is a minimum, and offsets are sums of blocks of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.operators.ordered import ranked, running_sum

from .common import written


def _numbered(turns: DataFrame, pair: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns with a place from 0; ties of the turn number are ordered by role and text, null turns come last."""
    rows = turns.select(F.col(pair).alias("pair_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"role_head": F.left("role", F.lit(64)), "head": F.left("text", F.lit(256)), "th": F.xxhash64("text")})
    order = [F.col("turn").asc_nulls_last(), "role_head", "head", "th"]  # long texts are told apart by their hash
    return ranked(rows.filter("pair_id is not null"), ["pair_id"], order).select("pair_id", (F.col("nth") - 1).cast("long").alias("place"), "role", "text")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def preference_segments(
    chosen: DataFrame, rejected: DataFrame, pair: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """One row per rendered turn: pair_id, part (prompt, chosen, rejected), place, role, segment, in_loss, start, end, usable.

    place counts the turns of the conversation from 0. start and end are character offsets in the part, so segments in
    order of place are the part, without gaps. in_loss: the mask, true for the assistant's turns of a completion, never in
    the prompt. usable: both completions have a turn in the loss and they differ.
    Null roles render as "unknown", null texts as empty, null turn numbers come last, rows without a pair are not part of
    any conversation and give none; a pair that has only one side has an empty prompt. Pairs without a difference are all
    prompt. Repeated turns are turns. Empty tables give no rows; other columns are not read.
    """
    a = _numbered(chosen, pair, turn, role, text)
    b = _numbered(rejected, pair, turn, role, text)
    both = a.withColumnsRenamed({"role": "c_role", "text": "c_text"}).join(b.withColumnsRenamed({"role": "r_role", "text": "r_text"}), ["pair_id", "place"], "full")
    same = F.col("c_role").eqNullSafe(F.col("r_role")) & F.col("c_text").eqNullSafe(F.col("r_text"))
    both = written(both.withColumn("same", same))
    # tables between aggregation and join: the join can then split a long pair
    ends = written(both.filter(~F.col("same")).groupBy(F.col("pair_id").alias("p")).agg(F.min("place").alias("first")))
    aligned = both.join(ends, F.col("pair_id") == F.col("p"), "left").withColumn("shared", F.col("first").isNull() | (F.col("place") < F.col("first"))).drop("p")
    side = lambda part, p, when: F.when(when & F.col(f"{p}_role").isNotNull(), F.struct(F.lit(part).alias("part"), F.col(f"{p}_role").alias("role"), F.col(f"{p}_text").alias("text")))
    parts = F.array_compact(F.array(side("prompt", "c", F.col("shared")), side("chosen", "c", ~F.col("shared")), side("rejected", "r", ~F.col("shared"))))
    rows = aligned.select("pair_id", "place", F.explode(parts).alias("s")).select(
        "pair_id", "s.part", "place", "s.role", render(F.col("s.role"), F.col("s.text")).alias("segment"), ((F.col("s.role") == loss_role) & (F.col("s.part") != "prompt")).alias("in_loss")
    )
    rows = written(running_sum(rows.withColumn("length", F.length("segment").cast("long")), ["pair_id", "part"], "place", "length", "end"))
    trained = rows.groupBy(F.col("pair_id").alias("p")).agg(
        (F.max(F.when((F.col("part") == "chosen") & F.col("in_loss"), 1).otherwise(0)) + F.max(F.when((F.col("part") == "rejected") & F.col("in_loss"), 1).otherwise(0)) == 2).alias("usable")
    )
    return rows.join(written(trained), F.col("pair_id") == F.col("p")).select("pair_id", "part", "place", "role", "segment", "in_loss", (F.col("end") - F.length("segment")).alias("start"), "end", "usable")


def cut_answers(conversations: DataFrame) -> DataFrame:
    """The rejected side for conversations that have only one: each conversation, its last assistant turn cut off at half."""
    last = conversations.filter("role = 'assistant'").groupBy(F.col("conv_id").alias("c")).agg(F.max("turn").alias("last"))
    last = written(last)
    at_last = (F.col("role") == "assistant") & (F.col("turn") == F.col("last"))
    half = F.expr("substring(text, 1, cast(floor(length(text) / 2) as int))")
    return conversations.join(last, F.col("conv_id") == F.col("c"), "left").select("conv_id", "turn", "role", F.when(at_last, half).otherwise(F.col("text")).alias("text"))
