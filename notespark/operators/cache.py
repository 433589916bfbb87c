"""Result cache as a table ``(key, value, ts, ttl_ms)``: lookup, upsert, invalidation, replay, pending work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notespark.operators.skew import lookup
from notespark.session import cut_lineage


def age_us(ts: Column, now: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", ts, now)


def is_live(ts: Column, ttl_ms: Column, now: Column) -> Column:
    """An entry exactly as old as its time to live is still live. The entry's own ttl counts."""
    return age_us(ts, now) <= ttl_ms * 1000


def upsert(cache: DataFrame, entries: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Last write per key wins; ties on ``ts`` are settled by further ``order`` columns both sides carry.

    ``max`` on a struct combines on the map side, so a key that is written all the time shuffles one row per task.
    """
    columns = ["key", *order, *[c for c in entries.columns if c != "key" and c not in order]]
    rows = cache.select(columns).unionByName(entries.select(columns))
    latest = F.max(F.struct(*order, *[c for c in columns if c != "key" and c not in order]))
    return rows.groupBy("key").agg(latest.alias("_e")).select("key", "_e.*")


def latest_sets(log: DataFrame) -> DataFrame:
    """Cache table that results from an operation log."""
    sets = log.where(F.col("op") == "set").select("key", "ts", "event_id", "ttl_ms", "value")
    return upsert(sets.limit(0), sets, order=("ts", "event_id"))


def purge(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(is_live(F.col("ts"), F.col("ttl_ms"), now))


def invalidate(cache: DataFrame, pattern: str) -> DataFrame:
    """Drop every key in which the pattern is found."""
    return cache.where(~F.col("key").rlike(pattern))


def clear(cache: DataFrame) -> DataFrame:
    return cache.where(F.lit(False))


def stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("size"))


def keys(cache: DataFrame) -> DataFrame:
    return cache.select("key")


def look_up(
    requests: DataFrame, cache: DataFrame, now: Column, spread_by: list[str], enabled: bool = True
) -> DataFrame:
    """Every request with ``status`` hit, expired or miss and the value of a hit.

    Many requests may carry one key (copies of a note); adaptive execution splits such a join.
    """
    if not enabled:
        return requests.withColumn("status", F.lit("miss")).withColumn("value", F.lit(None).cast("string"))
    entries = cache.select("key", "value", is_live(F.col("ts"), F.col("ttl_ms"), now).alias("_live"))
    return (
        lookup(requests, entries, ["key"], spread_by, how="left")
        .withColumn(
            "status", F.when(F.col("_live"), "hit").when(F.col("_live").isNull(), "miss").otherwise("expired")
        )
        .withColumn("value", F.when(F.col("_live"), F.col("value")))
        .drop("_live")
    )


def pending(requests: DataFrame, cache: DataFrame, now: Column, order: str = "path", enabled: bool = True) -> DataFrame:
    """One row per key that no live entry answers; of equal requests the first in ``order`` stands for all.

    The rows are reduced to one per key (on the map side first) before the anti-join, so both of its sides
    have unique keys.
    """
    rest = [c for c in requests.columns if c not in ("key", order)]
    unique = (
        requests.groupBy("key").agg(F.min(F.struct(order, *rest)).alias("_r")).select("key", "_r.*")
    )
    if not enabled:
        return unique
    return unique.join(purge(cache, now).select("key"), "key", "left_anti")


def reply_table(cache: DataFrame, now: Column, new: DataFrame | None = None) -> DataFrame:
    """``(key, raw_reply)``: what live entries and newly arrived replies answer; a new reply goes before an old entry.

    The one form in which findings, themes, links and rewrites read their answers, so a cached value and a fresh reply
    are read alike. Several new replies to a key: the least one counts.
    """
    live = purge(cache, now).select("key", F.col("value").alias("raw_reply"))
    if new is None:
        return live
    fresh = new.groupBy("key").agg(F.min("raw_reply").alias("raw_reply"))
    return live.join(fresh.select("key"), "key", "left_anti").unionByName(fresh)


def replay(log: DataFrame) -> DataFrame:
    """Outcome of every ``get`` in an operation log: hit, expired or miss against the last ``set`` before it.

    An as-of lookup in two levels, because one key may own a large share of the log, even of an hour of it: the log is
    range-partitioned by key and time, so that such a key covers many partitions (checkpointed, for range bounds are
    sampled). Within a partition a running window finds the last set of a key; the last set of each key and partition,
    one row each, is then carried on to later partitions. No task sees a key's whole history.
    """
    entry = F.struct("ts", "ttl_ms", "value")
    columns = ["event_id", "ts", "key", "op", "ttl_ms", "value"]
    ranged = cut_lineage(log.select(columns).repartitionByRange("key", "ts", "event_id"))
    at = ranged.withColumn("_bucket", F.spark_partition_id()).withColumn("_set", F.when(F.col("op") == "set", entry))
    inside = (
        Window.partitionBy("key", "_bucket")
        .orderBy("ts", "event_id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = at.withColumn("_local", F.last("_set", ignorenulls=True).over(inside)).where(F.col("op") == "get")
    last_of_bucket = at.groupBy("key", "_bucket").agg(
        F.max(F.when(F.col("op") == "set", F.struct("ts", "event_id", "ttl_ms", "value"))).alias("_last")
    )
    across = (
        Window.partitionBy("key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = last_of_bucket.select(
        "key", "_bucket", F.last("_last", ignorenulls=True).over(across).alias("_carry")
    )
    found = local.join(carried, ["key", "_bucket"], "left").withColumn(
        "_hit",
        F.coalesce(
            "_local",
            F.when(
                F.col("_carry").isNotNull(),
                F.struct(
                    F.col("_carry.ts").alias("ts"),
                    F.col("_carry.ttl_ms").alias("ttl_ms"),
                    F.col("_carry.value").alias("value"),
                ),
            ),
        ),
    )
    live = is_live(F.col("_hit.ts"), F.col("_hit.ttl_ms"), F.col("ts"))
    return found.select(
        "event_id",
        "key",
        F.when(F.col("_hit").isNull(), "miss").when(live, "hit").otherwise("expired").alias("status"),
        F.when(live, F.col("_hit.value")).alias("value"),
    )


def to_store(cache: DataFrame) -> DataFrame:
    """Cache rows as ``(key, entry)`` with the entry as JSON text."""
    ts_ms = F.floor(age_us(F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) / 1000).cast("long")
    entry = F.to_json(F.struct("value", ts_ms.alias("timestamp"), F.col("ttl_ms").alias("ttl")))
    return cache.select("key", entry.alias("entry"))


def entry_fields(entry: Column) -> Column:
    return F.from_json(entry, "value string, timestamp bigint, ttl bigint")


def from_store(stored: DataFrame) -> DataFrame:
    """Back to cache rows; entries that cannot be read are dropped instead of failing the load."""
    e = entry_fields(F.col("entry"))
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return (
        stored.select("key", e.alias("e"))
        .where(F.col("e.timestamp").isNotNull() & F.col("e.ttl").isNotNull())
        .select(
            "key",
            F.col("e.value").alias("value"),
            F.timestamp_add("MILLISECOND", F.col("e.timestamp"), epoch).alias("ts"),
            F.col("e.ttl").alias("ttl_ms"),
        )
    )
