"""Cache store on disk that can be saved again and again.

A store is a Parquet table bucketed by key. Every save appends files of its own rows only, one for each bucket it touches;
reading merges them, the last write of a key winning. Rows of a key are always in one bucket, so merging and looking up
move no row of the store. ``compact`` rewrites the buckets that have gathered several files.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notespark import params
from notespark.operators import cache as cache_ops
from notespark.operators.cache import entry_fields, from_store, to_store

BUCKETS = 64
_COLUMNS = "key string, entry string, save bigint"
_BUCKET_OF_FILE = re.compile(r"_(\d+)(?:\.c\d+)?\.")


def _name(target: str) -> str:
    return "notespark_cache_" + hashlib.md5(target.rstrip("/").encode()).hexdigest()


def _table(spark: SparkSession, target: str, buckets: int) -> DataFrame:
    """The store's rows as they lie on disk. A store that is not there yet has none."""
    name = _name(target)
    if not spark.catalog.tableExists(name):
        place = target.replace("'", "\\'")
        spark.sql(
            f"create table {name} ({_COLUMNS}) using parquet clustered by (key) into {int(buckets)} buckets location '{place}'"
        )
    spark.catalog.refreshTable(name)
    return spark.table(name)


def _append(rows: DataFrame, target: str, buckets: int) -> None:
    """Rows as new files. Dealt by key like the store, so each bucket gets one file of them."""
    rows.select("key", "entry", "save").repartition(buckets, "key").write.insertInto(_name(target))


def save(cache: DataFrame, target: str, buckets: int = BUCKETS) -> None:
    """Add the entries ``(key, value, ts, ttl_ms)`` of a cache; entries of other keys stay. Nothing else is rewritten.

    Of several entries to a key the newest is saved.
    ``buckets`` must be the same for every save of a store. Saves to one store come one after the other: their order tells
    which of equally old entries is the last.
    """
    spark = cache.sparkSession
    last = _table(spark, target, buckets).agg(F.max("save")).first()[0] or 0
    rows = cache.select("key", "value", "ts", "ttl_ms")
    one = cache_ops.upsert(rows.limit(0), rows)
    _append(to_store(one).withColumn("save", F.lit(last + 1).cast("long")), target, buckets)


def remove(keys: DataFrame, target: str, buckets: int = BUCKETS) -> None:
    """Forget keys: a save of empty entries, which no older entry outlives."""
    spark = keys.sparkSession
    last = _table(spark, target, buckets).agg(F.max("save")).first()[0] or 0
    gone = keys.select("key").distinct().withColumn("entry", F.lit(None).cast("string"))
    _append(gone.withColumn("save", F.lit(last + 1).cast("long")), target, buckets)


def invalidate(spark: SparkSession, target: str, pattern: str, buckets: int = BUCKETS) -> None:
    """Forget every key in which the pattern is found."""
    remove(_table(spark, target, buckets).select("key").where(F.col("key").rlike(pattern)), target, buckets)


def _merged(stored: DataFrame) -> DataFrame:
    """One row for each key: the newest entry since the key was last forgotten; of equally old ones the last saved.

    Entries that can't be read count for nothing. The windows need no exchange, for the store is bucketed by key; a key has
    a row for each of its saves since the last compaction.
    """
    e, of_key = entry_fields(F.col("entry")), Window.partitionBy("key")
    told = stored.select("key", "entry", "save", e["timestamp"].alias("_ts"), e["ttl"].alias("_ttl"))
    seen = told.withColumn("_gone", F.max(F.when(F.col("entry").isNull(), F.col("save"))).over(of_key))
    alive = seen.where(
        F.col("_ts").isNotNull() & F.col("_ttl").isNotNull() & (F.col("_gone").isNull() | (F.col("save") > F.col("_gone")))
    )
    newest = F.row_number().over(of_key.orderBy(F.desc("_ts"), F.desc("save"), F.desc("entry")))
    ranked = alive.withColumn("_place", newest).withColumn("save", F.max("save").over(of_key))
    return ranked.where("_place = 1").select("key", "entry", "save")


def load(spark: SparkSession, source: str, buckets: int = BUCKETS) -> DataFrame:
    """The cache as it is after all saves; a store that is not there loads as empty, unreadable entries are dropped."""
    return from_store(_merged(_table(spark, source, buckets)).select("key", "entry"))


def look_up(
    requests: DataFrame, source: str, now: Column, spread_by: list[str], buckets: int = BUCKETS, enabled: bool = True
) -> DataFrame:
    """``cache.look_up`` against the store: requests are dealt over the buckets, rows of the store stay where they are."""
    return cache_ops.look_up(requests, load(requests.sparkSession, source, buckets), now, spread_by, enabled)


def add_replies(new: DataFrame, target: str, now: Column, ttl_ms: int = params.CACHE_TTL_MS, buckets: int = BUCKETS) -> None:
    """Save newly arrived replies ``(key, raw_reply)`` as of now; of several to a key the least one counts."""
    entries = new.groupBy("key").agg(F.min("raw_reply").alias("value"))
    save(entries.select("key", now.alias("ts"), F.lit(ttl_ms).cast("long").alias("ttl_ms"), "value"), target, buckets)


def _files(spark: SparkSession, target: str) -> dict[int, list[str]]:
    """Data files of each bucket."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[int, list[str]] = {}
    for status in folder.listStatus(path) if folder.exists(path) else ():
        found = _BUCKET_OF_FILE.search(status.getPath().getName())
        if found and not status.getPath().getName().startswith(("_", ".")):
            out.setdefault(int(found[1]), []).append(status.getPath().toString())
    return out


def compact(spark: SparkSession, target: str, now: Column | None = None, buckets: int = BUCKETS, files: int = 1) -> list[int]:
    """Merge the buckets that have more than ``files`` files into one file each, and return their numbers.

    Forgotten keys go for good, and entries that have expired by ``now``. The merged rows are written before the old files
    are removed; stopped in between, a store holds both and reads the same.
    """
    _table(spark, target, buckets)
    touched = {b: names for b, names in _files(spark, target).items() if len(names) > files}
    if not touched:
        return []
    old = [name for names in touched.values() for name in names]
    kept = _merged(spark.read.schema(_COLUMNS).parquet(*old))
    if now is not None:
        alive = from_store(kept.select("key", "entry"))
        kept = kept.join(cache_ops.purge(alive, now).select("key"), "key", "left_semi")
    _append(kept, target, buckets)
    for name in old:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    spark.catalog.refreshTable(_name(target))
    return sorted(touched)
