import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from notespark.llm import chat, exact_dedup, sharding


def collect(df):
    return [r.asDict() for r in df.collect()]


def test_shards_of_odd_rows(documents, odd_rows):
    got = collect(sharding.assign(documents(odd_rows), rows_per_block=2))
    assert len(got) == len(odd_rows)
    sizes = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    data = [(d, (t or "").encode()) for d, t, *_ in odd_rows]
    assert sizes == Counter((d, len(b) + 1, zlib.crc32(b)) for d, b in data)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_key = defaultdict(set)
    for r in got:
        by_key[r["doc_id"]].add((r["shard"], r["grown_shard"]))
    assert all(len(s) == 1 for s in by_key.values())


def test_one_more_shard_only_takes_and_weights_hold(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.assign(docs, weights=(1.0, 2.0, 5.0), added_weight=2.0).toPandas()
    assert ((got.grown_shard == got.shard) | (got.grown_shard == 3)).all()
    share = got.groupby("shard").size() / len(got)
    assert abs(share[0] - 0.125) < 0.02 and abs(share[1] - 0.25) < 0.02 and abs(share[2] - 0.625) < 0.02
    assert abs((got.grown_shard == 3).mean() - 0.2) < 0.02


def test_a_key_with_a_third_of_all_rows_gets_gapless_slots(spark):
    docs = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.assign(docs, rows_per_block=50).toPandas()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_a_shard_needs_a_weight(spark):
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("x"), (1.0, 0.0))


def test_written_shards_hold_whole_records(spark, documents, odd_rows, tmp_path):
    sharding.write_shards(documents(odd_rows, clash=False), str(tmp_path / "out"), weights=(1.0, 1.0))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(odd_rows) and {"doc_id", "text", "shard"} <= set(back.columns)


def test_exact_duplicates_of_odd_rows(documents, odd_rows):
    got = collect(exact_dedup.exact_dedup(documents(odd_rows)))
    assert len(got) == len(odd_rows)
    by_text = defaultdict(list)
    for d, t, *_ in odd_rows:
        by_text[t or ""].append(d)
    want = Counter()
    for t, ids in by_text.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            kept = i == keep and left
            left = left and not kept
            want[i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got) == want


def test_equal_digests_of_different_texts_stay_apart(documents):
    rows = [(i, f"text {i % 5}") for i in range(900)]
    weak = exact_dedup.groups(documents(rows), digest=lambda t: F.lit("same"), salts=8)
    got = {r.text: (r.keep_id, r.group_size) for r in weak.collect()}
    assert got == {f"text {k}": (895 + k, 180) for k in range(5)}


def test_a_hot_text_is_salted_and_counted_whole(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_dedup(docs).where("group_size > 1").toPandas()
    assert len(got) == 1000 and set(got.keep_id) == {2997} and got.kept.sum() == 1 and set(got.group_size) == {1000}


def test_repeated_rows_are_put_back_by_several_tasks(spark):
    rows = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    out = exact_dedup.exact_dedup(rows)
    per_task = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 50_000 and max(per_task) < 50_000
    assert out.where("kept").count() == 1 and out.where("group_size = 50000").count() == 50_000


def empty(documents):
    return documents([(1, "x")]).where("doc_id > 1")


def test_empty_tables(documents, spark):
    assert sharding.assign(empty(documents)).count() == 0
    assert exact_dedup.exact_dedup(empty(documents)).count() == 0
    logged = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(logged).count() == 0


CHATS = "conv_id long, turn long, role string, text string, pos int, conv string"


def test_snapshots_collapse_into_the_longest(spark):
    a = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "yes")]
    logged = []
    for conv, turns in ((1, a[:2]), (2, a), (3, a[:3]), (4, a), (5, [("user", "hi"), ("assistant", "other")]), (6, a[1:])):
        logged += [(conv, 10 * i, r, t, 0, "x") for i, (r, t) in enumerate(turns)]
    logged += [(2, 0, "user", "hi", 0, "x")]  # logged twice
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(logged, CHATS)).collect()}
    assert sorted(got) == [2, 5, 6]
    assert (got[2].copies, got[2].n_turns) == (2, 4)
    assert got[2].chat == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in a)


@pytest.mark.parametrize("per_part", [1, 2, 256])
def test_prefixes_across_parts_against_brute_force(spark, per_part):
    import random

    rnd = random.Random(per_part)
    convs = {i: tuple((rnd.choice("ua"), rnd.choice("xy")) for _ in range(rnd.randint(1, 6))) for i in range(60)}
    logged = [(i, k, r, t, 0, "x") for i, c in convs.items() for k, (r, t) in enumerate(c)]
    got = {r.conv for r in chat.maximal(spark.createDataFrame(logged, CHATS), per_part).collect()}
    whole = set(convs.values())
    want = {f"id:{i}" for i, c in convs.items() if not any(o[: len(c)] == c and len(o) > len(c) for o in whole)}
    want = {min((w for w in want if convs[int(w[3:])] == c), key=lambda w: int(w[3:])) for c in {convs[int(w[3:])] for w in want}}
    assert got == want


def test_odd_turns(spark):
    logged = [
        (1, None, "user", "before", 0, "x"),
        (1, 0, None, None, 0, "x"),
        (None, 0, "user", "alone", 0, "x"),
        (None, 0, "user", "alone", 0, "x"),
        (2, 0, "user", "say <|im_end|>", 0, "x"),
    ]
    got = {(r.conv_id, r.part): r for r in chat.format_chats(spark.createDataFrame(logged, CHATS)).collect()}
    assert set(got) == {(1, None), (1, 0), (None, 0), (2, 0)}
    assert got[1, 0].chat == "<|im_start|>unknown\n<|im_end|>\n" and got[1, 0].n_turns == 2
    assert got[2, 0].chat.count("<|im_end|>") == 1


def test_turns_without_a_number_are_first(spark):
    logged = [(1, turn, "user", str(turn), 0, "x") for turn in (5, None, -1000, -1, -256)]
    longer = [(2, *row[1:]) for row in logged] + [(2, 6, "user", "more", 0, "x")]
    rows = chat.format_chats(spark.createDataFrame(logged + longer, CHATS)).collect()
    assert {r.conv_id for r in rows} == {2} and {r.n_turns for r in rows} == {6}
    parts = sorted(rows, key=lambda r: (r.part is not None, r.part or 0))
    assert [r.part for r in parts] == [None, -4, -1, 0]
    said = [line for r in parts for line in r.chat.split("\n") if not line.startswith("<|im_start|>") and line]
    assert [s.removesuffix("<|im_end|>") for s in said] == ["None", "-1000", "-256", "-1", "5", "more"]
