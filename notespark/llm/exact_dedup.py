"""Exact duplicates by combining within tasks, then within salted digest groups, then over all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notespark.llm.common import text_or_empty

HOT_SHARE = 1000
SALTS = 64
COPIES_PER_RUN = 4096


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, salts: int = SALTS
) -> DataFrame:
    """Digest, text, largest key and number of rows of every different text.

    Each stage groups by digest and full text, so equal digests of different texts stay apart. The first stage combines
    within a task before anything is shuffled. Digests of more than one row in `HOT_SHARE` (at most that many, so their
    list is broadcast) are dealt over salts, whose winners are combined once more; the text of all others is shuffled once.
    """
    value = text_or_empty(text)
    rows = docs.select(F.col(key).alias("key"), value.alias("text"), digest(value).alias("digest"))
    counts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    most = F.greatest(docs.select(F.count(F.lit(1)) / F.lit(HOT_SHARE)).scalar(), F.lit(100))
    hot = counts.where(F.col("n") > most).select("digest", F.lit(True).alias("hot"))
    salted = rows.join(F.broadcast(hot), "digest", "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("key"), F.lit(salts))).otherwise(F.lit(-1))
    )
    part = salted.groupBy("digest", "salt", "text").agg(F.max("key").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    combined = (
        part.where("salt >= 0")
        .groupBy("digest", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    return part.where("salt < 0").select("digest", "text", "keep_id", "group_size").unionByName(combined)


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Of equal texts the row of the largest key stays. Texts are compared in full while groups form; a row then finds its
    group by SHA-256, so texts are not shuffled again. Were two different texts to share a SHA-256, the query would stop
    with an error rather than merge them.

    Null text counts as empty; null keys lose against any other, and stay null where a group has no other. Of repeated
    rows with the same key and text one is kept. Empty table: no rows. Other columns are not read.
    """
    one_text = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("different texts share a SHA-256"))).otherwise(F.sum("group_size"))
    by_digest = (
        groups(docs, key, text, sha256, salts)
        .groupBy("digest")
        .agg(F.max("keep_id").alias("keep_id"), one_text.cast("long").alias("group_size"))
    )
    members = (
        docs.select(F.col(key).alias("key"), sha256(text_or_empty(text)).alias("digest"))
        .groupBy("key", "digest")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    starts = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(COPIES_PER_RUN).cast("long")))
    # By number: runs that are dealt by number are not put together again for their small size.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = members.join(by_digest, "digest").withColumn("run", starts).repartition(tasks, "digest", "key", "run")
    copies = F.explode(F.sequence("run", F.least(F.col("n"), F.col("run") + (COPIES_PER_RUN - 1))))
    return runs.withColumn("copy", copies).select(
        F.col("key").alias(key),
        "keep_id",
        "group_size",
        (F.col("key").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
