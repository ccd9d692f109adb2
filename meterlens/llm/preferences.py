"""Preference pairs of conversations as one prompt and two masked completions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

TURN = "struct<role:string,text:string>"


def conversation_turns(
    turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, turns): one row per conversation with its turns in order, as the example that it is to become.

    Equal rows count once; turns with the same number follow each other by role and text. Rows without a conversation
    or turn number belong to no place in a conversation and are left out. Null roles and texts stay null.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).alias("text")
    )
    placed = turns.where(F.col(id_col).isNotNull() & F.col(turn_col).isNotNull())
    rows = placed.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_set(turn)).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).cast(f"array<{TURN}>").alias("turns"))


def reply_pairs(conversations: DataFrame, *, role: str = "assistant") -> DataFrame:
    """(pair_id, chosen, rejected) from conversations: up to the last reply, against the same with that reply replaced.

    The replacement is the conversation's first reply; where there is only one, the empty text. Conversations without
    a reply have nothing to prefer and give no pair.
    """
    turns = F.col("turns")
    places = F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: F.element_at(turns, i)["role"] == role)
    found = conversations.where(F.size("turns") > 0).select("conv_id", "turns", places.alias("places")).where(F.size("places") > 0)
    first, last = F.element_at("places", 1), F.element_at("places", -1)
    other = F.when(first < last, F.element_at(turns, first)["text"]).otherwise(F.lit(""))
    before = F.slice(turns, F.lit(1), last - 1)
    instead = F.array(F.struct(F.lit(role).alias("role"), other.alias("text"))).cast(f"array<{TURN}>")
    return found.select(
        F.col("conv_id").alias("pair_id"),
        F.slice(turns, F.lit(1), last).alias("chosen"),
        F.concat(before, instead).alias("rejected"),
    )


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit("<|end|>\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _mask(turns: Column, role: str) -> Column:
    """Runs `flag:characters` of the rendered turns in order; flag 1 marks what is learned: replies, not their heads."""
    learned = lambda t: F.when(t["role"] == role, F.lit("1:")).otherwise(F.lit("0:"))
    runs = lambda t: F.array(
        F.concat(F.lit("0:"), F.length(_head(t)).cast("string")), F.concat(learned(t), F.length(_body(t)).cast("string"))
    )
    return F.array_join(F.flatten(F.transform(turns, runs)), ",")


def format_preferences(pairs: DataFrame, *, id_col: str = "pair_id", role: str = "assistant") -> DataFrame:
    """pair_id, common_turns, prompt, chosen, rejected, chosen_mask, rejected_mask of pairs of turn lists.

    The longest common prefix of both lists (role and text equal, nulls alike) is rendered once as the prompt; what is
    left of either is its completion, empty where one is a prefix of the other. A null list counts as empty, a null
    role or text is rendered as empty. Masks are run lengths, so they grow with the turns and not with the texts.
    """
    none = F.array().cast(f"array<{TURN}>")
    both = pairs.select(
        F.col(id_col).alias("pair_id"),
        F.coalesce(F.col("chosen").cast(f"array<{TURN}>"), none).alias("c"),
        F.coalesce(F.col("rejected").cast(f"array<{TURN}>"), none).alias("r"),
    )
    differs = F.array_position(F.zip_with("c", "r", lambda a, b: a.eqNullSafe(b)), F.lit(False))
    cut = both.withColumn("n", F.when(differs > 0, differs - 1).otherwise(F.size("c")).cast("int"))
    rest = lambda side: F.slice(F.col(side), F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    return cut.select(
        "pair_id",
        F.col("n").cast("long").alias("common_turns"),
        _rendered(F.slice("c", 1, F.col("n"))).alias("prompt"),
        _rendered(rest("c")).alias("chosen"),
        _rendered(rest("r")).alias("rejected"),
        _mask(rest("c"), role).alias("chosen_mask"),
        _mask(rest("r"), role).alias("rejected_mask"),
    )
