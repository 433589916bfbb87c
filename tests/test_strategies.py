import json

import pytest
from pyspark.sql import functions as F

from notespark.operators import sections, strategies
from notespark.plans import flows
from notespark.sources import notes as source

TEXT = "intro\n# A\naa\n## B\nbb\n### C\ncc\n# D\ndd"


def notes(spark, content, path="f/n.md"):
    return spark.createDataFrame(
        [(path, "n", "md", content)], "path string, basename string, extension string, content string"
    )


def key(text):
    return F.sha2(text, 256)


def reply_table(spark, by_section):
    rows = spark.createDataFrame(list(by_section.items()), "section string, raw_reply string")
    return rows.select(key(F.col("section")).alias("key"), "raw_reply")


def reply(line):
    return json.dumps({"corrections": [{"original": "x", "suggested": "y", "line": line, "confidence": 0.9}]})


def test_failed_section_does_not_move_the_offset(spark):
    n = notes(spark, TEXT)
    table = reply_table(
        spark, {"intro\n\n# A\naa": reply(4), "## B\nbb\n### C\ncc": "broken {", "# D\ndd": reply(1)}
    )
    checker = strategies.from_replies(table, lambda s: key(F.col("section")))
    got = {r.section_no: (r.line, r.line_exact) for r in strategies.check_full(n, checker, size=12).collect()}
    # section 0: blank line added by packing; section 2: only the four lines of section 0 count
    assert got == {0: (4, 3), 2: (5, 8)}


def test_missing_reply_is_a_failed_section(spark):
    checker = strategies.from_replies(reply_table(spark, {"zz": reply(1)}), lambda s: key(F.col("section")))
    assert strategies.check_full(notes(spark, TEXT), checker).count() == 0


def test_fixed_width_lines_are_one_too_high(spark):
    n = notes(spark, "a , b\nc\nd , e")
    got = [(r.section_no, r.line, r.line_exact) for r in strategies.check_incremental(n, strategies.from_lint, 8).collect()]
    assert sorted(got) == [(0, 2, 1), (1, 4, 3)]
    assert strategies.check_incremental(n, strategies.from_lint, 8, only_section=0).count() == 1


@pytest.mark.parametrize("content, n, dense", [("", 0, False), ("x" * 1000, 0, False), ("a , b\n" * 10, 10, True)])
def test_auto_verdict(spark, content, n, dense):
    v = strategies.auto_verdict(notes(spark, content), strategies.from_lint)
    row = v.first()
    assert (row.n_findings, row.suggest_full) == (n, dense)
    assert strategies.switch_suggestions(v).count() == int(dense)
    assert strategies.switch_suggestions(v, "full", "auto").count() == 0


def test_density_of_empty_text(value):
    from notespark.operators.findings import is_dense

    dense = is_dense(F.col("n"), F.col("c"), 3)
    assert value(dense, n=0, c=0) is False
    assert value(dense, n=1, c=0) is True
    assert value(dense, n=3, c=1000) is True
    assert value(dense, n=2, c=1000) is False


def test_estimates_and_modes(spark, value):
    assert [value(strategies.estimated_requests("full", F.lit(n))) for n in (0, 1, 4000, 4001)] == [0, 1, 1, 2]
    assert value(strategies.estimated_requests("auto", F.lit(9999))) == 1
    with pytest.raises(ValueError):
        strategies.check("other", None, None)
    assert {(r.mode, r.can_switch_to) for r in strategies.modes(spark).collect()} == {
        ("full", "incremental"), ("incremental", "full"), ("auto", "full"),
    }


def test_progress(spark):
    cut = sections.progress(sections.full_sections(notes(spark, TEXT), 12))
    assert sorted(r.progress for r in cut.collect()) == [33, 67, 100]


def test_rewrite_keeps_sections_without_a_usable_reply(spark):
    long = "# A\n" + "a" * 9000 + "\n# B\n" + "b" * 9000 + "\n# C\n"
    replies = spark.createDataFrame(
        [("f/n.md", 0, "<think>x</think>" + "A" * 60), ("f/n.md", 1, "short")], "path string, section_no int, raw_reply string"
    )
    row = flows.rewrite(notes(spark, long), replies, "correct").first()
    assert row.path == "f/n-corrected.md"
    assert row.content == "A" * 60 + "\n\n# B\n" + "b" * 9000 + "\n\n# C"
    row = flows.rewrite(notes(spark, long), replies, "enhance").first()
    assert row.path == "f/n-enhanced.md" and row.content == long.replace("\n# ", "\n\n# ")


def test_short_note_is_one_section(spark):
    assert sections.rewrite_sections(notes(spark, TEXT)).count() == 1
    assert sections.rewrite_sections(notes(spark, "\n# " + "a" * 16000)).count() == 1
    assert sections.rewrite_sections(notes(spark, "  \n# " + "a" * 16000), trimmed=False).count() == 1


def test_folder_scan_and_sinks(spark, tmp_path):
    vault = tmp_path / "My vault"
    (vault / "sub").mkdir(parents=True)
    texts = {"a.b.md": "# A\nx , y\n", "Open Note.md": "o", "100%25 #1.md": "p", "sub/é+ö.md": "[[Open Note]]"}
    for name, text in texts.items():
        (vault / name).write_text(text)
    (vault / "sub" / "noext").write_text("z")
    (vault / "sub" / "p.PDF").write_bytes(b"12345")
    scanned = source.scan_folder(spark, str(vault))
    files = {r.basename: (r.extension, r.n_bytes) for r in scanned.collect()}
    assert files == {"a.b": ("md", 10), "Open Note": ("md", 1), "100%25 #1": ("md", 1), "é+ö": ("md", 13), "noext": ("", 1), "p": ("PDF", 5)}
    read = source.read_folder(spark, str(vault))
    assert {r.path.split("My vault/")[1]: r.content for r in read.collect()} == texts
    assert read.join(scanned, "path").count() == 4
    everything = source.read_folder(spark, str(vault), "*")
    fixed = flows.fix_notes(everything)
    source.write_snapshot(source.snapshot(everything, fixed), str(tmp_path / "out"))
    back = {r.basename: (r.extension, r.content) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert back["a.b"] == ("md", "# A\nx, y\n") and back["p"] == ("PDF", "12345") and len(back) == 6
    with pytest.raises(Exception, match="(?i)exist"):
        source.write_new(fixed, str(tmp_path / "out"))


def test_new_notes_must_be_new(spark, tmp_path):
    old = spark.createDataFrame([("a.md", "x")], "path string, content string")
    new = spark.createDataFrame([("a.md", "y"), ("b.md", "y")], "path string, content string")
    with pytest.raises(Exception, match="note exists: a.md"):
        source.write_new(new, str(tmp_path / "one"), existing=old)
    source.write_new(new.where("path = 'b.md'"), str(tmp_path / "two"), existing=old)
    with pytest.raises(ValueError, match="two notes for a.md"):
        source.write_new(old.unionByName(old), str(tmp_path / "three"))


def test_a_manifest_is_a_source(spark):
    manifest = spark.createDataFrame([("v/My Note.md", "text", 4), ("v/x", None, 0)], "path string, content string, n_bytes long")
    got = {r.path: (r.basename, r.extension, r.content) for r in source.from_manifest(manifest).collect()}
    assert got == {"v/My Note.md": ("My Note", "md", "text"), "v/x": ("x", "", None)}
