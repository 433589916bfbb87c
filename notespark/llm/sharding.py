"""Sharding of records by rendezvous hashing over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notespark.llm.common import text_or_empty, uniform_bits

ROWS_PER_BLOCK = 1000
COPIES_PER_RUN = 4096


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """Shard of a key: the largest -weight / ln(u), u being uniform in (0, 1) from key, shard and seed.

    A shard's scores don't depend on the other shards, so a shard more takes keys only into itself, and a shard's
    share is its weight's share. A null key counts as an empty text. Equal scores: the later shard.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    name = F.coalesce(key.cast("string"), F.lit(""))
    scores = [
        F.struct(
            (F.lit(-float(w)) / F.ln((uniform_bits(F.concat(name, F.lit(f"/{i}/{seed}"))) + F.lit(0.5)) / F.lit(2.0**52))).alias("score"),
            F.lit(i).alias("shard"),
        )
        for i, w in enumerate(weights)
    ]
    return F.array_max(F.array(*scores))["shard"] if len(scores) > 1 else F.lit(0)


def assign(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * 16,
    added_weight: float | None = 1.0,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 0,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    Only the key and the number and weights of the shards decide the shard; `grown_shard` is the shard after one more
    of `added_weight` (null without). Slots of a shard run from 0 without gaps, in the order of a hash of key and text.
    A shard is cut into blocks of that hash, of about `rows_per_block` rows: rows are ranked within a block and start
    after the blocks before, so no task holds a shard. Equal rows (key, size and text) are counted before the shuffle
    and numbered in a row, so neither a key nor a text with a third of all rows gathers in one task.

    Null text: size 1 and the checksum of nothing; null key: shards as an empty text does; repeated rows: a slot each;
    empty table: no rows; other columns are not read.
    """
    value = text_or_empty(text)
    same = (
        docs.select(
            F.col(key).alias("key"),
            (F.octet_length(value) + 1).cast("long").alias("size"),
            F.crc32(value.cast("binary")).alias("text_crc32"),
        )
        .groupBy("key", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    name = F.coalesce(F.col("key").cast("string"), F.lit(""))
    order = uniform_bits(F.concat_ws("/", name, F.col("text_crc32"), F.col("size"), F.lit(f"slot{seed}")))
    grown = rendezvous(F.col("key"), [*weights, added_weight], seed) if added_weight else F.lit(None).cast("int")
    placed = same.withColumns({"shard": rendezvous(F.col("key"), weights, seed), "grown_shard": grown, "h": order})
    rows = docs.select(F.count(F.lit(1))).scalar()
    blocks = F.greatest(F.ceil(rows / F.lit(len(weights) * rows_per_block)), F.lit(1))
    placed = placed.withColumn("block", F.floor(F.col("h") * blocks.cast("double") / F.lit(2.0**52)))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "block")
        .agg(F.sum("n").alias("rows"))
        .select("shard", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    )
    within = (
        Window.partitionBy("shard", "block").orderBy("h", "key", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = placed.withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["shard", "block"])
    runs = ranked.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES_PER_RUN).cast("long"))))
    ends = F.least(F.col("n"), F.col("run") + COPIES_PER_RUN) - 1
    return runs.withColumn("copy", F.explode(F.sequence("run", ends))).select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("first") + F.col("copy")).alias("slot"),
        "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * 16, key: str = "doc_id", seed: int = 0) -> None:
    """Write whole records, one folder per shard."""
    docs.withColumn("shard", rendezvous(F.col(key), weights, seed)).write.partitionBy("shard").parquet(path)
