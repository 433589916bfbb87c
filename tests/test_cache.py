import datetime as dt
import random

from pyspark.sql import functions as F

from notespark.operators import cache
from notespark.sources import cache_store
from notespark.streaming import reply_feed

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "key string, value string, ts timestamp_ntz, ttl_ms bigint"


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


def now(ms):
    return F.lit(at(ms)).cast("timestamp_ntz")


def test_entry_of_exactly_its_ttl_is_live(spark):
    entries = spark.createDataFrame([("a", "1", T0, 1000)], SCHEMA)
    assert cache.purge(entries, now(1000)).count() == 1
    assert cache.purge(entries, now(1001)).count() == 0


def test_look_up(spark):
    entries = spark.createDataFrame([("a", "1", T0, 1000), ("b", "2", T0, 10)], SCHEMA)
    asked = spark.createDataFrame([(i, k) for i, k in enumerate(["a"] * 50 + ["b", "c"])], "id int, key string")
    got = {r.id: (r.status, r.value) for r in cache.look_up(asked, entries, now(500), ["id"]).collect()}
    assert len(got) == 52
    assert all(got[i] == ("hit", "1") for i in range(50))
    assert got[50] == ("expired", None) and got[51] == ("miss", None)
    off = cache.look_up(asked, entries, now(500), ["id"], enabled=False)
    assert {r.status for r in off.collect()} == {"miss"}


def test_upsert_last_write_wins(spark):
    old = spark.createDataFrame([("a", "1", at(5), 9), ("b", "1", at(5), 9)], SCHEMA)
    new = spark.createDataFrame([("a", "2", at(6), 9), ("b", "0", at(4), 9), ("c", "3", at(1), 9)], SCHEMA)
    assert {r.key: r.value for r in cache.upsert(old, new).collect()} == {"a": "2", "b": "1", "c": "3"}


def test_invalidate_tests_the_whole_key(spark):
    entries = spark.createDataFrame([(k, "v", T0, 1) for k in ("spell:en:1", "spell:de:1", "smart-link:a:b")], SCHEMA)
    assert {r.key for r in cache.invalidate(entries, "^spell:").collect()} == {"smart-link:a:b"}
    assert cache.clear(entries).count() == 0
    assert cache.stats(entries).first().size == 3


def test_pending_one_row_per_key(spark):
    entries = spark.createDataFrame([("a", "1", T0, 1000), ("b", "1", T0, 1)], SCHEMA)
    asked = spark.createDataFrame([("p2", "b"), ("p1", "b"), ("p3", "a"), ("p4", "c")], "path string, key string")
    assert {(r.key, r.path) for r in cache.pending(asked, entries, now(500)).collect()} == {("b", "p1"), ("c", "p4")}
    assert cache.pending(asked, entries, now(500), enabled=False).count() == 3


def test_replay_against_plain_walk_with_a_hot_key(spark):
    rng = random.Random(3)
    log = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"k{rng.randint(0, 40)}"
        op = "get" if rng.random() < 0.6 else "set"
        log.append((i, at(rng.randint(0, 48 * 3600) * 1000), key, op, rng.choice([60_000, 3_600_000, 86_400_000]), f"v{i}"))
    last, expected = {}, {}
    for event_id, ts, key, op, ttl, value in sorted(log, key=lambda e: (e[1], e[0])):
        if op == "set":
            last[key] = (ts, ttl, value)
        elif key not in last:
            expected[event_id] = ("miss", None)
        else:
            s, t, v = last[key]
            live = ts - s <= dt.timedelta(milliseconds=t)
            expected[event_id] = ("hit", v) if live else ("expired", None)
    df = spark.createDataFrame(log, "event_id int, ts timestamp_ntz, key string, op string, ttl_ms bigint, value string")
    got = {r.event_id: (r.status, r.value) for r in cache.replay(df).collect()}
    assert got == expected


def test_a_key_that_is_hot_within_an_hour_is_spread(spark):
    log = [(i, at(i), "hot" if i % 10 else f"k{i % 7}", "set" if i % 50 == 3 else "get", 3_600_000, f"v{i}") for i in range(4000)]
    df = spark.createDataFrame(log, "event_id int, ts timestamp_ntz, key string, op string, ttl_ms bigint, value string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r.event_id: r.value for r in cache.replay(df).collect()}
    last = {}
    for i, _, key, op, _, value in log:
        if op == "set":
            last[key] = value
        else:
            assert got[i] == last.get(key)
    whole = "spark.sql.adaptive.coalescePartitions.enabled"  # small partitions stay apart, as large ones would
    spark.conf.set(whole, "false")
    parts = df.repartitionByRange("key", "ts", "event_id").groupBy(F.spark_partition_id().alias("p")).count()
    assert parts.agg(F.max("count")).first()[0] < 0.6 * len(log)
    spark.conf.set(whole, "true")


def test_store_round_trip_drops_unreadable_entries(spark, tmp_path):
    entries = spark.createDataFrame([("a", '{"x": "\\n é"}', at(1234), 99), ("b", None, at(5), 1)], SCHEMA)
    cache_store.save(entries, str(tmp_path / "store"))
    back = cache_store.load(spark, str(tmp_path / "store"))
    assert {(r.key, r.value, r.ts, r.ttl_ms) for r in back.collect()} == {("a", '{"x": "\\n é"}', at(1234), 99), ("b", None, at(5), 1)}
    assert cache_store.load(spark, str(tmp_path / "nothing")).count() == 0
    bad = spark.createDataFrame([("a", "{"), ("b", "[1]"), ("c", None)], "key string, entry string")
    assert cache.from_store(bad).count() == 0


def store_rows(spark, target, **options):
    return {(r.key, r.value, r.ts, r.ttl_ms) for r in cache_store.load(spark, target, **options).collect()}


def stored_files(target):
    return {f.name for f in target.iterdir() if f.name.endswith(".parquet")}


def test_store_is_saved_again_and_again(spark, tmp_path):
    target = str(tmp_path / "store")
    old = spark.createDataFrame([(f"k{i}", f"old{i}", at(i), 1000) for i in range(50)], SCHEMA)
    new = spark.createDataFrame(
        [(f"k{i}", f"new{i}", at(100 + i), 1000) for i in range(0, 70, 2)] + [("k1", "late", at(0), 1), ("k3", "same", at(3), 2)], SCHEMA
    )
    cache_store.save(old, target, buckets=4)
    before = stored_files(tmp_path / "store")
    cache_store.save(new, target, buckets=4)
    want = {(r.key, r.value, r.ts, r.ttl_ms) for r in cache.upsert(old, new).collect()} - {("k3", "old3", at(3), 1000)}
    assert store_rows(spark, target, buckets=4) == want | {("k3", "same", at(3), 2)}
    assert before < stored_files(tmp_path / "store")  # nothing was rewritten
    cache_store.remove(spark.createDataFrame([("k2",), ("k5",), ("none",)], "key string"), target, buckets=4)
    cache_store.invalidate(spark, target, "^k1[0-9]$", buckets=4)
    kept = {r for r in want | {("k3", "same", at(3), 2)} if r[0] not in ("k2", "k5") and not (len(r[0]) == 3 and r[0][1] == "1")}
    assert store_rows(spark, target, buckets=4) == kept
    cache_store.save(spark.createDataFrame([("k5", "again", at(1), 5)], SCHEMA), target, buckets=4)
    assert store_rows(spark, target, buckets=4) == kept | {("k5", "again", at(1), 5)}


def test_compaction_rewrites_touched_buckets_only(spark, tmp_path):
    target, folder = str(tmp_path / "store"), tmp_path / "store"
    cache_store.save(spark.createDataFrame([(f"k{i}", "a", at(i), 1000) for i in range(200)], SCHEMA), target, buckets=8)
    whole = stored_files(folder)
    assert len(whole) == 8 and cache_store.compact(spark, target, buckets=8) == []
    cache_store.save(spark.createDataFrame([("k7", "b", at(500), 1000)], SCHEMA), target, buckets=8)
    rows = store_rows(spark, target, buckets=8)
    (touched,) = cache_store.compact(spark, target, buckets=8)
    assert store_rows(spark, target, buckets=8) == rows and ("k7", "b", at(500), 1000) in rows
    left = stored_files(folder)
    assert len(left) == 8 and len(whole & left) == 7
    cache_store.save(spark.createDataFrame([(f"k{i}", "c", at(400), 10) for i in range(200)], SCHEMA), target, buckets=8)
    now = F.lit(at(501)).cast("timestamp_ntz")
    assert len(cache_store.compact(spark, target, now, buckets=8)) == 8
    assert store_rows(spark, target, buckets=8) == {("k7", "b", at(500), 1000)}


def test_store_is_not_shuffled_for_a_look_up(spark, tmp_path):
    target = str(tmp_path / "store")
    cache_store.save(spark.createDataFrame([(f"k{i}", "a", at(i), 1000) for i in range(300)], SCHEMA), target, buckets=8)
    cache_store.save(spark.createDataFrame([(f"k{i}", "b", at(400), 1000) for i in range(9)], SCHEMA), target, buckets=8)
    asked = spark.range(500).select(F.col("id").alias("request_id"), F.concat(F.lit("k"), "id").alias("key"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = cache_store.look_up(asked, target, F.lit(at(401)).cast("timestamp_ntz"), ["request_id"], buckets=8)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1  # of the requests
        values = {r.request_id: (r.status, r.value) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert values[3] == ("hit", "b") and values[20] == ("hit", "a") and values[400] == ("miss", None)


def test_reply_feed_keeps_the_last_readable_reply(spark, tmp_path):
    replies, log, progress = (str(tmp_path / d) for d in ("replies", "log", "progress"))

    def arrive(rows):
        spark.createDataFrame(rows, reply_feed.REPLY_SCHEMA).coalesce(1).write.mode("append").parquet(replies)
        reply_feed.start(spark, replies, log, progress, available_now=True).awaitTermination(120)

    good = '{"corrections":[{"original":"teh","suggested":"the","line":1,"confidence":0.9}]}'
    arrive([("a", "{}", at(1)), ("b", "cut {", at(1))])
    arrive([("a", good, at(2)), ("a", "cut {", at(3))])
    rows = {r.key: r for r in reply_feed.current(spark, log).collect()}
    assert set(rows) == {"a"}
    assert rows["a"].ts == at(2) and '"suggested":"the"' in rows["a"].value
