"""Preference formatting, in DataFrame operations alone.

The longest common prefix of turns of a chosen and a rejected conversation is the prompt, rendered once. What follows on
either side is rendered as a completion, with a mask: the places of what a model should learn, the texts of assistant
turns with their end marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.llm.shared import let

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role: string, text: string>>"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) from rows of conv_id, turn, role and text, in order of turn, then role and text.

    Rows without conv_id or turn belong to no conversation. Repeated rows are repeated turns. A null role is ``unknown``,
    a null text empty.
    """
    rows = turns.where("conv_id is not null and turn is not null")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("x"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x")).select("conv_id", F.transform("x", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _parted(text: Column) -> Column:
    """Marks inside a text are broken up, so that no turn can end itself or open another."""
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), _parted(turn["role"]), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(_parted(turn["text"]), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def _mask(turns: Column) -> Column:
    """Runs [first, past) of characters to learn, in the rendered turns."""
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<first: bigint, past: bigint>>").alias("runs"))

    def step(done: Column, t: Column) -> Column:
        first = done["at"] + F.length(_head(t))
        past = first + F.length(_body(t))
        run = F.struct(first.cast("long").alias("first"), past.cast("long").alias("past"))
        return F.struct((past + 1).cast("long").alias("at"), F.when(t["role"] == "assistant", F.array_append(done["runs"], run)).otherwise(done["runs"]).alias("runs"))

    return F.aggregate(turns, none, step, lambda done: done["runs"])


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading turns are equal."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return let(same, lambda s: F.when(F.array_position(s, False) == 0, F.size(s)).otherwise(F.array_position(s, False) - 1)).cast("int")


def preference_format(pairs: DataFrame) -> DataFrame:
    """Two rows, ``chosen`` and ``rejected``, for each row of pair_id, chosen and rejected (arrays of role and text).

    Columns: pair_id, side, n_common (turns of the prompt), prompt, completion, mask (array of [first, past) characters of
    the completion), tie (both sides are equal, and both completions empty). A null array is an empty conversation; one
    side may be a prefix of the other, and then has an empty completion. Repeated pairs are repeated.
    """
    side = lambda c: F.coalesce(F.col(c).cast(TURNS), F.array().cast(TURNS))
    rows = pairs.select("pair_id", side("chosen").alias("chosen"), side("rejected").alias("rejected")).withColumn("n_common", common_prefix(F.col("chosen"), F.col("rejected")))
    # The prompt is rendered before the two sides part; both rows carry the same text.
    rows = rows.select(
        "pair_id", "n_common", render(F.slice("chosen", F.lit(1), F.col("n_common"))).alias("prompt"), F.col("chosen").eqNullSafe(F.col("rejected")).alias("tie"),
        *[F.slice(F.col(s), F.col("n_common") + 1, F.size(s)).alias(s) for s in ("chosen", "rejected")],
    )
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("rest")) for s in ("chosen", "rejected")])
    rows = rows.select("pair_id", "n_common", "prompt", "tie", F.explode(sides).alias("x"))
    return rows.select("pair_id", "x.side", "n_common", "prompt", render(F.col("x.rest")).alias("completion"), _mask(F.col("x.rest")).alias("mask"), "tie")
