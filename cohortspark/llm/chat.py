"""Chat formatting after cumulative-snapshot collapse.

A chat log often holds the same conversation many times, each snapshot longer
than the one before. Every turn gets the rolling hash of the conversation up to
it; the ends of conversations whose hash is the hash of a prefix inside a longer
one go by an anti join, so only maximal conversations are rendered. Of equal
conversations the one with the smallest id stays.

Defined results: rows without conversation id or turn number belong to no
conversation and are left out; a null role is ``unknown``, a null text is empty;
turns with the same number are put in order of role and text, so a repeated row
is a repeated turn; very long texts stay whole; an empty table gives an empty result;
columns that are not named are never read, so extra ones cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Opens and closes a turn when rendered.
OPEN, CLOSE = "<|{role}|>\n", "\n<|end|>\n"


def turn_prefixes(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns as ``conv_id, pos, n_turns, role, text, h1, h2``: 128 bits of rolling hash over the turns so far.

    The hash of a turn depends on its position, so their exclusive or depends on the order of turns.
    """
    turns = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.withColumn("pos", F.row_number().over(in_order).cast("long")).withColumn("n_turns", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    turn_hash = {h: F.xxhash64(F.lit(seed), "pos", "role", "text") for h, seed in (("h1", 17), ("h2", 91))}
    return placed.select("conv_id", "pos", "n_turns", "role", "text", *(F.bit_xor(x).over(so_far).alias(h) for h, x in turn_hash.items()))


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies`` of the conversations that no longer one starts with."""
    state = ["pos", "h1", "h2"]
    ends = prefixes.where(F.col("pos") == F.col("n_turns")).groupBy(*state).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inside = prefixes.where(F.col("pos") < F.col("n_turns")).select(*state).distinct()
    return ends.join(inside, state, "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_copies")


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, n_turns, n_copies, rendered``, one row for each maximal conversation."""
    prefixes = turn_prefixes(conversations, conv_col, turn_col, role_col, text_col)
    kept = maximal_conversations(prefixes)
    before, after = OPEN.split("{role}")
    shown = F.concat(F.lit(before), "role", F.lit(after), "text", F.lit(CLOSE))
    turns = prefixes.select("conv_id", F.struct("pos", shown.alias("shown")).alias("t"))
    rendered = turns.join(kept.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["shown"]), "").alias("rendered"))
    return kept.join(rendered, "conv_id").select("conv_id", "n_turns", "n_copies", "rendered")
