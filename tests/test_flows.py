import json

from pyspark.sql import functions as F

from notespark.operators import inventory, requests, themes
from notespark.plans import flows


def vault(spark, n=30):
    return spark.range(n).select(
        F.format_string("f/n%03d.md", "id").alias("path"),
        F.format_string("topic-n%03d", "id").alias("basename"),
        F.lit("md").alias("extension"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("content"),
    )


def test_model_links_end_to_end(spark):
    notes = vault(spark)
    anchor = F.lit("f/n000.md")
    candidates = inventory.link_candidates(notes, anchor, "all")
    asked = requests.link_requests(notes.where(F.col("path") == anchor), candidates)
    body = json.loads(asked.where("path = 'f/n007.md'").first().body)
    assert body["messages"][1]["content"] == (
        "Compare these files:\n\nFile A (topic-n000):\ntext 0\n\nFile B (topic-n007):\ntext 7"
    )
    assert (body["max_tokens"], body["temperature"]) == (1500, 0.2)
    number = F.regexp_extract("path", "n(\\d+)", 1).cast("int")
    replies = asked.where(number != 5).select(
        "key", F.format_string('{"shouldLink": true, "relevance": %.2f}', number / 30).alias("raw_reply")
    )
    best = flows.links_from_replies(asked, replies, candidates).collect()
    assert [r.path for r in best] == [f"f/n{i:03d}.md" for i in range(29, 9, -1)]
    assert best[0].content_preview == "text 29" and best[0].common_themes == []


def test_model_themes_end_to_end(spark):
    chunks = themes.name_chunks(themes.chunk_members(vault(spark), 10))
    asked = requests.theme_requests(chunks)
    replies = asked.select("key", F.when(F.col("chunk_no") == 1, '["b", "a"]').when(F.col("chunk_no") == 2, '["a", "B"]').otherwise("none").alias("raw_reply"))
    got = flows.themes_from_replies(asked, replies).orderBy("chunk_no", "pos").collect()
    assert [(r.theme, r.chunk_no, r.pos) for r in got] == [("b", 1, 0), ("a", 1, 1), ("B", 2, 1)]


def test_analyze_vault(spark):
    summary, breakdown, found = flows.analyze_vault(vault(spark))
    assert tuple(summary.first()) == (30, 30)
    assert [tuple(r) for r in breakdown.collect()] == [("md", 30)]
    assert sorted(r.theme for r in found.collect()) == ["n", "topic"]


def test_copies_are_one_request(spark):
    from notespark.operators import cache
    from notespark.sources import derived

    notes = vault(spark, 90).withColumn("content", F.when(F.col("path") < "f/n030.md", "same").otherwise(F.col("content")))
    asked = notes.select("path", derived.section_key(F.col("content")).alias("key"))
    none = spark.createDataFrame([], "key string, value string, ts timestamp_ntz, ttl_ms bigint")
    open_work = cache.pending(asked, none, F.lit("2024-01-01").cast("timestamp_ntz"))
    assert open_work.count() == 61
    assert open_work.agg(F.min("path")).first()[0] == "f/n000.md"


def test_cached_rewrite_reads_cache_and_new_replies(spark):
    now = F.lit("2024-01-02").cast("timestamp_ntz")
    notes = spark.createDataFrame(
        [(f"{n}.md", n, "md", f"# {n}\n" + f"text of {n} " * 10) for n in "abcd"] + [("z.pdf", "z", "pdf", "other")],
        "path string, basename string, extension string, content string",
    )
    md = notes.where("extension = 'md'").withColumnRenamed("content", "section").withColumn("section_no", F.lit(0))
    keys = {r.path: r.key for r in requests.rewrite_requests(md, "enhance").collect()}
    entries = [(keys["a.md"], "# old a", "2024-01-01 12:00:00", 86_400_000), (keys["b.md"], "# expired", "2024-01-01 12:00:00", 1000), (keys["c.md"], "# old c", "2024-01-01 12:00:00", 86_400_000)]
    cached = spark.createDataFrame(entries, "key string, value string, ts string, ttl_ms bigint").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    new = spark.createDataFrame([(keys["c.md"], "# new c"), (keys["c.md"], "# newer c"), ("none", "x")], "key string, raw_reply string")
    got = {r.path: r.content for r in flows.rewrite_cached(notes, "enhance", cached, now, new).collect()}
    kept = {r.path: r.content for r in notes.collect()}
    assert got == {"a-enhanced.md": "# old a", "b-enhanced.md": kept["b.md"], "c-enhanced.md": "# new c", "d-enhanced.md": kept["d.md"]}
    stored = {r.key: r.value for r in flows.store(cached, new, now).collect()}
    assert stored[keys["c.md"]] == "# new c" and stored[keys["b.md"]] == "# expired" and len(stored) == 4


def test_findings_go_back_into_the_note(spark):
    from notespark.operators import sections, strategies

    now = F.lit("2024-01-02").cast("timestamp_ntz")
    notes = vault(spark, 3).withColumn("content", F.lit("teh cat , teh dog"))
    key = flows.check_keys(notes).first().key
    reply = '{"corrections":[{"original":"teh","suggested":"the","line":1,"confidence":0.9}]}'
    none = spark.createDataFrame([], "key string, value string, ts timestamp_ntz, ttl_ms bigint")
    new = spark.createDataFrame([(key, reply)], "key string, raw_reply string")
    assert flows.pending_checks(notes, none, now).count() == 1
    found = flows.check_cached(notes, none, now, new).collect()
    assert len(found) == 3 and {r.what for r in found} == {"teh"}
    cut = sections.full_sections(notes)
    checked = strategies.from_lint(cut)
    assert {r.content for r in flows.apply_findings(notes, checked).collect()} == {"teh cat, teh dog"}


def test_limits_can_be_lifted(spark):
    long = spark.createDataFrame([("a.md", 0, "x" * 7000)], "path string, section_no int, section string")
    for chars, sent in ((5000, 5000), (None, 7000)):
        r = requests.check_requests(long, chars=chars).first()
        assert json.loads(r.body)["messages"][1]["content"] == "Check: " + "x" * sent and r.truncated == (sent < 7000)


def spoken_vault(spark):
    lang = F.get(F.array(*map(F.lit, ("en", "fr", "de"))), (F.col("id") % 3).cast("int"))
    notes = spark.range(30).select(
        F.format_string("f/n%03d.md", "id").alias("path"), F.format_string("n%03d", "id").alias("basename"), F.lit("md").alias("extension"),
        F.concat(F.lit("same teh text "), (F.col("id") % 5).cast("string")).alias("content"), lang.alias("lang"), "id",
    )
    return notes.withColumn("variant", F.when(F.col("id") % 2 == 0, "standard").otherwise("superprompt"))


NOW = "2024-02-01"
NO_CACHE = "key string, value string, ts timestamp_ntz, ttl_ms bigint"


def test_each_request_is_answered_under_its_own_key(spark):
    notes, now = spoken_vault(spark), F.lit(NOW).cast("timestamp_ntz")
    asked = {"language": F.col("lang"), "variant": F.col("variant"), "model": "other"}
    none = spark.createDataFrame([], NO_CACHE)
    keys = flows.check_keys(notes, **asked)
    assert keys.select("key").distinct().count() == 30  # 3 languages, 2 variants, 5 texts
    json_reply = '{"corrections":[{"original":"teh","suggested":"the","line":1,"confidence":0.9}]}'
    new = keys.select("key", F.lit(json_reply).alias("raw_reply")).distinct()
    for mode in ("full", "incremental", "auto", F.lit("full")):
        found = flows.check_cached(notes, none, now, new, mode, **asked)
        assert {r.path for r in found.collect()} == {r.path for r in notes.collect()}
    assert flows.check_cached(notes, none, now, new, language=F.col("lang")).count() == 0  # another variant and model
    cached = flows.store(none, new, now)
    assert flows.pending_checks(notes, cached, now, **asked).count() == 0
    assert flows.pending_checks(notes, cached, now).count() == 5


def test_rewrites_in_other_languages_are_found_again(spark):
    notes, now = spoken_vault(spark), F.lit(NOW).cast("timestamp_ntz")
    from notespark.operators import sections

    cut = sections.rewrite_sections(notes, keep=("lang",))
    asked = requests.rewrite_requests(cut, "correct", F.col("lang"), "other")
    text = "A corrected text that is long enough to be accepted, in any language."
    new = asked.select("key", F.lit(text).alias("raw_reply")).distinct()
    none = spark.createDataFrame([], NO_CACHE)
    got = flows.rewrite_cached(notes, "correct", none, now, new, F.col("lang"), "other")
    assert {r.content for r in got.collect()} == {text}
    assert text not in {r.content for r in flows.rewrite_cached(notes, "correct", none, now, new).collect()}


def test_cached_links(spark):
    notes, now = vault(spark), F.lit(NOW).cast("timestamp_ntz")
    anchor, candidates = notes.where("path = 'f/n000.md'"), notes.where("path <> 'f/n000.md'")
    asked = requests.link_requests(anchor, candidates)
    number = F.regexp_extract("path", "n(\\d+)", 1).cast("int")
    reply = F.format_string('{"shouldLink": true, "relevance": %.2f}', number / 30)
    cached = asked.where(number < 25).select(
        "key", reply.alias("value"), F.when(number < 20, now).otherwise(F.timestamp_add("DAY", F.lit(-9), now)).alias("ts"), F.lit(1000).cast("bigint").alias("ttl_ms")
    )
    new = asked.where(number == 27).select("key", reply.alias("raw_reply"))
    found = flows.links_cached(anchor, candidates, cached, now, new).collect()
    assert [r.path for r in found] == ["f/n027.md"] + [f"f/n{i:03d}.md" for i in range(19, 9, -1)]


def test_templates_from_a_table(spark):
    import pytest

    notes = spoken_vault(spark)
    rows = [("*", "standard", "all {language}"), ("fr", "standard", "fr own"), ("*", "superprompt", "sup {language}")]
    templates = spark.createDataFrame(rows, "language string, variant string, template string")
    asked = flows.check_keys(notes, language=F.col("lang"), variant=F.col("variant"), templates=templates).collect()
    system = {r.path: json.loads(r.body)["messages"][0]["content"] for r in asked}
    want = lambda i, lang: f"sup {lang}" if i % 2 else "fr own" if lang == "fr" else f"all {lang}"
    assert system == {f"f/n{i:03d}.md": want(i, ("en", "fr", "de")[i % 3]) for i in range(30)}
    with pytest.raises(Exception, match="no template: en superprompt|no template: fr superprompt|no template: de superprompt"):
        flows.check_keys(notes, language=F.col("lang"), variant=F.col("variant"), templates=templates.where("variant = 'standard'")).collect()


def test_mixed_modes_are_each_mode_by_itself(spark):
    import pytest

    from notespark.operators import strategies

    body = F.concat_ws("\n", F.lit("# head , x"), F.repeat(F.lit("line , with comma\n## more\n\n\n"), F.col("id").cast("int") * 20), F.lit("end , x"))
    mode = F.get(F.array(F.lit("full"), F.lit("incremental"), F.lit("auto"), F.lit(None)), (F.col("id") % 4).cast("int"))
    notes = spark.range(24).select(F.format_string("n%02d.md", "id").alias("path"), body.alias("content"), "id", mode.alias("mode"))
    got = sorted(tuple(r) for r in strategies.check_mixed(notes, F.col("mode"), strategies.from_lint).collect())
    want = []
    for name in strategies.CHECKS:
        want += [(*r, name) for r in strategies.check(name, notes.where(F.col("mode") == name), strategies.from_lint).collect()]
    assert got == sorted(want) and len({r[-1] for r in got}) == 3
    with pytest.raises(Exception, match="unknown check mode: none"):
        strategies.check_mixed(notes, F.lit("none"), strategies.from_lint).collect()
    plan = strategies.check_mixed(notes, F.col("mode"), strategies.from_lint)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1
