import pytest
from pyspark.sql import functions as F

from notespark.operators import themes
from notespark.operators.skew import first_per_key, lookup


def hot_facts(spark, n=3000):
    return spark.range(n).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("key")
    )


def counted(facts):
    return facts.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))


def test_lookup_is_a_plain_join(spark):
    facts = hot_facts(spark)
    dims = facts.select("key").distinct().where("key <> 'k1'").withColumn("v", F.concat(F.lit("v-"), "key"))
    for how in ("inner", "left"):
        plain = {tuple(r) for r in facts.join(dims, "key", how).select("id", "key", "v").collect()}
        for max_hot, counts in ((2, counted(facts)), (10, counted(facts)), (1000, counted(facts)), (10, None)):
            got = [tuple(r) for r in lookup(facts, dims, ["key"], ["id"], how, max_hot=max_hot, counts=counts).select("id", "key", "v").collect()]
            assert len(got) == len(plain) and set(got) == plain


def test_hot_key_is_spread_over_salts(spark):
    facts, dims = hot_facts(spark), spark.createDataFrame([("hot", 1)], "key string, v int")
    joined = lookup(facts, dims, ["key"], ["id"], max_hot=30, counts=counted(facts))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan
    assert joined.count() == 1000


def test_no_hot_key_no_salts(spark):
    facts = spark.range(5000).select("id", F.col("id").alias("key"))
    joined = lookup(facts, facts.select("key", F.lit(1).alias("v")), ["key"], ["id"], max_hot=100, counts=counted(facts))
    assert "_salt" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count() == 5000


def test_without_counts_no_job_runs_while_the_plan_is_built(spark):
    facts = hot_facts(spark)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lookup", "lookup")
    lookup(facts, facts.select("key").distinct(), ["key"], ["id"], "left")
    assert not tracker.getJobIdsForGroup("lookup")
    spark.sparkContext.setJobGroup("other", "other")


def test_first_per_key_cuts_before_the_shuffle(spark):
    top = first_per_key(hot_facts(spark), ["key"], [F.desc("id")], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted(r.id for r in top.where("key = 'hot'").collect()) == [2994, 2997]


@pytest.fixture
def no_coalescing(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_numbering_follows_path_order_over_partitions(spark, no_coalescing):
    files = spark.range(2500).select(
        F.format_string("f%04d.md", (F.col("id") * 7919) % 2500).alias("path"), F.col("id").cast("string").alias("basename")
    )
    numbered = themes.numbered(files)
    assert numbered.select(F.spark_partition_id()).distinct().count() > 1
    rows = numbered.collect()
    assert [r.path for r in sorted(rows, key=lambda r: r.position)] == sorted(r.path for r in rows)
    assert sorted(r.position for r in rows) == list(range(2500))
    chunks = themes.name_chunks(themes.chunk_members(files, 100)).collect()
    assert len(chunks) == 25 and all(c.n_names == 100 for c in chunks)
