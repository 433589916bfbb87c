"""What the plans must look like over a stored notes table."""

import re

import pytest
from pyspark.sql import functions as F

from notespark.operators import cache, inventory, links, sections, spelling, strategies, themes


@pytest.fixture(scope="module")
def notes(spark, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("stored") / "notes")
    spark.range(200).select(
        F.format_string("f%d/n%04d.md", F.col("id") % 7, "id").alias("path"),
        F.format_string("n%04d", "id").alias("basename"),
        F.when(F.col("id") % 5 == 0, "pdf").otherwise("md").alias("extension"),
        F.lit("en").alias("lang"),
        F.concat(F.lit("# title\nsome words here , and word"), F.col("id").cast("string")).alias("content"),
    ).write.parquet(target)
    return spark.read.parquet(target)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(df):
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<([^>]*)>", plan(df))]


def exchanges(df):
    return len(re.findall(r"Exchange (?:hash|range|SinglePartition|RoundRobin)", plan(df)))


def test_names_only_queries_never_read_content(notes):
    assert read_columns(inventory.breakdown(notes)) == [{"extension"}]
    assert read_columns(inventory.summary(notes)) == [{"extension"}]
    assert read_columns(inventory.markdown(notes).select("path")) == [{"path", "extension"}]
    assert read_columns(inventory.markdown(notes).select("path", "basename").repartitionByRange("path"))[0] == {
        "path", "basename", "extension",
    }


def test_extension_filter_is_pushed_down(notes):
    assert "EqualTo(extension,md)" in plan(inventory.markdown(notes))


def test_row_local_operators_do_not_shuffle(notes):
    md = inventory.markdown(notes)
    for df in (
        sections.progress(sections.full_sections(md)),
        sections.fixed_line_offset(sections.fixed_sections(md)),
        strategies.check_incremental(md, strategies.from_lint),
        strategies.auto_verdict(md, strategies.from_lint),
        spelling.note_words(md),
    ):
        assert exchanges(df) == 0


def test_texts_are_processed_once(notes):
    for df in (spelling.note_words(notes), sections.full_sections(notes), sections.fixed_sections(notes)):
        assert not re.search(r"- (\*\(\d+\) )?Filter ", plan(df))


def test_lexicon_is_one_shuffle_with_partial_aggregation(notes):
    lex = spelling.lexicon(notes)
    assert exchanges(lex) == 1
    assert plan(lex).count("partial_sum") >= 1


def test_replies_join_without_section_text(spark, notes):
    replies = spark.createDataFrame([("k", "{}")], "key string, raw_reply string")
    checker = strategies.from_replies(replies, lambda s: F.sha2("section", 256))
    shuffled = plan(strategies.check_full(notes, checker))
    below_exchange = re.findall(r"Exchange hashpartitioning\(key.*?\n.*?Project \[([^\]]*)\]", shuffled)
    assert below_exchange and not any(re.search(r"(^|, )section#\d+(,|$)", p) for p in below_exchange)


def test_top_lists_use_bounded_operators(notes):
    scored = notes.select("path", F.length("content").alias("relevance"))
    assert "TakeOrderedAndProject" in plan(links.best(scored))
    members = notes.select("path", (F.length("path") % 3).alias("chunk_no"), "basename")
    assert "WindowGroupLimit" in plan(themes.chunk_themes(members, top=10))


def test_no_cross_joins(notes, spark):
    vectors = spark.createDataFrame([(0, [1.0], 0)], "vec_id bigint, embedding array<float>, label int")
    weights = links.term_weights(notes)
    for df in (
        links.vector_links(vectors, F.lit(0)),
        links.anchor_links(notes, F.lit("f1/n0001.md"), weights=weights),
        links.describe_partners(links.theme_partners(links.note_themes(weights)), notes),
        spelling.candidates(spelling.lexicon(notes), notes),
    ):
        assert "CartesianProduct" not in plan(df) and "NestedLoopJoin" not in plan(df)


def test_cache_upsert_combines_on_the_map_side(spark):
    entries = spark.createDataFrame([("a", "1", 1)], "key string, value string, ts int")
    assert "partial_max" in plan(cache.upsert(entries, entries))
