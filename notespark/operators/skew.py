"""Joins and bounded top lists that stay balanced when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notespark.session import cut_lineage

MAX_HOT_KEYS = 1000


def lookup(
    facts: DataFrame,
    dims: DataFrame,
    keys: list[str],
    spread_by: list[str],
    how: str = "inner",
    max_hot: int = MAX_HOT_KEYS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Attach at most one ``dims`` row per key to ``facts``, whatever the key distribution.

    Without ``counts`` this is a plain join, whose large partitions (also that of null keys in a left join) adaptive
    execution splits; no job runs while the plan is built.

    With ``counts`` (keys, ``_n``; read twice, so hand in something materialised) hot keys are salted beforehand: a key
    that owns more than ``1/max_hot`` of the facts. There cannot be more than ``max_hot`` of them, so the list (key,
    number of salts) that is broadcast has a size bound that does not depend on the data. Facts of a hot key spread
    over salts by a hash of ``spread_by`` (columns that differ within a key); its one dims row is repeated per salt. In
    sum at most ``2 * max_hot`` rows are added to ``dims`` and no join task holds more than about ``1/max_hot`` of the
    facts for one key.
    """
    if counts is None:
        return facts.join(dims, keys, how)
    total = counts.agg(F.sum("_n")).scalar()
    hot = cut_lineage(
        counts.where(F.col("_n") * max_hot > total).select(
            *keys, F.ceil(F.col("_n") * max_hot / total).cast("int").alias("_salts")
        )
    )
    if hot.isEmpty():
        return facts.join(dims, keys, how)
    salted_facts = (
        facts.join(F.broadcast(hot), keys, "left")
        .withColumn(
            "_salt",
            F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("_salts")), F.lit(0)).cast("int"),
        )
        .drop("_salts")
    )
    salted_dims = (
        dims.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    return salted_facts.join(salted_dims, [*keys, "_salt"], how).drop("_salt")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each key.

    Spark cuts every map task's share of a key to ``n`` rows before the shuffle (WindowGroupLimit), so a hot
    key sends ``n`` rows per task and never its whole group.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
