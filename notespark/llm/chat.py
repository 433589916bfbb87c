"""Chat formatting: keep the longest of cumulative snapshots, then render."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notespark.session import cut_lineage

TURNS_PER_PART = 256
# Part of turns without a number, which are before all others.
UNNUMBERED = -(2**63)
# Marks of the chat template.
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>"


def _turns(logged: DataFrame, per_part: int) -> DataFrame:
    """conv (a key that is never null), conv_id, part, turn, role, text, digest."""
    role = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    text = F.coalesce(F.col("text"), F.lit(""))
    turn = F.col("turn").cast("long")
    digest = F.sha2(F.concat(role, F.lit("\n"), text).cast("binary"), 256)
    conv = F.coalesce(F.concat(F.lit("id:"), F.col("conv_id").cast("string")), F.concat(F.lit("row:"), digest))
    part = F.coalesce(F.floor(turn / F.lit(per_part)).cast("long"), F.lit(UNNUMBERED))
    return logged.select(
        conv.alias("conv"), F.col("conv_id"), part.alias("part"), turn.alias("turn"), role.alias("role"), text.alias("text"), digest.alias("digest")
    )


def _before(window) -> object:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def prefix_hashes(logged: DataFrame, per_part: int = TURNS_PER_PART) -> DataFrame:
    """conv, conv_id, pos, a, b and a1, b1: the 128-bit hash of the first pos turns, and that of the turn alone.

    The hash of a prefix is the XOR of the hashes of its turns, each taken with its place, so it can be summed up part
    by part: turns are ordered within a part of `per_part` turn numbers, and parts start from what came before.
    """
    rows = _turns(logged, per_part).select("conv", "conv_id", "part", "turn", "digest").distinct()
    cell, parts = Window.partitionBy("conv", "part"), Window.partitionBy("conv").orderBy("part")
    starts = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("conv", "part", _zero(F.sum("n").over(_before(parts))).alias("start"))
    placed = rows.withColumn("rank", F.row_number().over(cell.orderBy("turn", "digest"))).join(starts, ["conv", "part"])
    pos = (F.col("start") + F.col("rank")).alias("pos")
    placed = placed.select("conv", "conv_id", "part", pos, "digest").withColumns(
        {"a1": F.xxhash64("pos", "digest"), "b1": F.xxhash64("digest", F.lit("second"), "pos")}
    )
    sums = placed.groupBy("conv", "part").agg(F.bit_xor("a1").alias("a"), F.bit_xor("b1").alias("b"))
    sums = sums.select(
        "conv", "part", *[_zero(F.bit_xor(c).over(_before(parts))).alias(f"{c}0") for c in ("a", "b")]
    )
    upto = cell.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(sums, ["conv", "part"]).select(
        "conv",
        "conv_id",
        "pos",
        *[F.col(f"{c}0").bitwiseXOR(F.bit_xor(f"{c}1").over(upto)).alias(c) for c in ("a", "b")],
        "a1",
        "b1",
    )


def maximal(logged: DataFrame, per_part: int = TURNS_PER_PART) -> DataFrame:
    """conv, copies, n_turns of the conversations that no other one continues; of equal ones the smallest conv_id stays."""
    hashed = cut_lineage(prefix_hashes(logged, per_part))  # a few numbers a turn, read twice
    last = hashed.groupBy("conv").agg(
        F.min("conv_id").alias("conv_id"), F.max(F.struct("pos", "a", "b")).alias("end")
    )
    whole = last.groupBy(F.col("end.pos").alias("pos"), F.col("end.a").alias("a"), F.col("end.b").alias("b")).agg(
        F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "conv")).alias("first"), F.count(F.lit(1)).alias("copies")
    )
    longer = (
        hashed.where("pos > 1")
        .select((F.col("pos") - 1).alias("pos"), F.col("a").bitwiseXOR(F.col("a1")).alias("a"), F.col("b").bitwiseXOR(F.col("b1")).alias("b"))
        .distinct()
    )
    return whole.join(longer, ["pos", "a", "b"], "left_anti").select(
        F.col("first.conv").alias("conv"), "copies", F.col("pos").alias("n_turns")
    )


def format_chats(logged: DataFrame, per_part: int = TURNS_PER_PART) -> DataFrame:
    """conv_id, part, n_turns, copies, chat: every maximal conversation, rendered in parts of `per_part` turn numbers.

    Turns go by turn number, then by a digest of role and text. A turn logged twice counts once. Null role: "unknown"; null text:
    empty; null turn number: before the others, in a part of their own, which is null; a row without conv_id is a conversation of its own, equal ones
    being one. A mark of the template within a text is broken by a blank, so that no text can open a turn. Empty table:
    no rows. Other columns are not read.
    """

    def render(t: Column) -> Column:
        text = F.replace(t["text"], F.lit("<|im_"), F.lit("<| im_"))
        return F.concat(F.lit(TURN_START), t["role"], F.lit("\n"), text, F.lit(TURN_END + "\n"))

    turns = _turns(logged, per_part).join(maximal(logged, per_part), "conv").groupBy("conv", "part").agg(
        F.min("conv_id").alias("conv_id"),
        F.max("n_turns").alias("n_turns"),
        F.max("copies").alias("copies"),
        F.array_sort(F.collect_set(F.struct(F.coalesce("turn", F.lit(UNNUMBERED)).alias("turn"), "digest", "role", "text"))).alias("turns"),
    )

    return turns.select(
        "conv_id", F.nullif("part", F.lit(UNNUMBERED)).alias("part"), "n_turns", "copies", F.array_join(F.transform("turns", render), "").alias("chat")
    )
