import os

import pytest
from pyspark.sql import functions as F

from notespark.operators import inventory
from notespark.sources import notes


@pytest.fixture
def folder(tmp_path):
    for i in range(60):
        place = tmp_path / "vault" / f"a{i % 4}" / (f"b{i % 3}" if i % 2 else ".") / ("deep/er" if i % 5 == 0 else ".")
        place.mkdir(parents=True, exist_ok=True)
        (place / f"n{i}.{['md', 'MD', 'txt'][i % 3]}").write_text(f"text {i} é\n" * (i % 4), encoding="utf-8")
    (tmp_path / "vault" / "top.md").write_bytes(b"\xff top")
    (tmp_path / "vault" / "_hidden").mkdir()
    (tmp_path / "vault" / "_hidden" / "no.md").write_text("no")
    (tmp_path / "vault" / ".trash.md").write_text("no")
    (tmp_path / "vault" / "empty").mkdir()
    return str(tmp_path / "vault")


@pytest.mark.parametrize("levels", [0, 1, 2, 9])
def test_tree_is_what_the_folder_holds(spark, folder, levels):
    def rows(df):
        return sorted((r.path, r.basename, r.extension, r.n_bytes, r.modified) for r in df.collect())

    # Spark's reader of binary files passes over empty ones; the tree has them.
    want, got = rows(notes.scan_folder(spark, folder)), rows(notes.scan_tree(spark, folder, levels))
    assert len(got) == 61 and [r for r in got if r[3]] == want and len(want) == 46
    assert rows(notes.scan_tree(spark, f"file://{folder}/", levels)) == got
    texts = {r.path: r.content for r in notes.read_folder(spark, folder).where("basename <> 'top'").collect()}
    read = {r.path: r.content for r in notes.read_tree(spark, folder, levels).where("basename <> 'top'").collect()}
    assert len(read) == 20 and {p: t for p, t in read.items() if t} == texts
    (top,) = notes.read_tree(spark, folder, levels).where("basename = 'top'").collect()
    assert top.content == "� top"


def test_tree_is_listed_by_several_tasks(spark, folder):
    per_task = notes.scan_tree(spark, folder, 2).groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 4 and max(r["count"] for r in per_task) < 30


def test_no_files(spark, tmp_path):
    assert notes.scan_tree(spark, str(tmp_path)).count() == 0


def files_of(target):
    return {os.path.relpath(os.path.join(d, f), target) for d, _, names in os.walk(target) for f in names if f.endswith(".parquet")}


def test_one_changed_note_rewrites_one_part(spark, tmp_path):
    target = str(tmp_path / "vault")
    vault = spark.range(300).select(F.format_string("f/%03d.md", "id").alias("path"), F.concat(F.lit("text "), "id").alias("content"), "id")
    notes.write_snapshot(vault, target, 8)
    before = files_of(target)
    assert len(before) == 8 and notes.read_snapshot(spark, target).count() == 300
    change = spark.createDataFrame([("f/007.md", "new")], "path string, content string")
    (part,) = notes.update_snapshot(change, target, 8)
    after = files_of(target)
    assert len(before & after) == 7 and {f.split("/")[0] for f in after - before} == {f"part={part}"}
    rows = {r.path: (r.content, r.id) for r in notes.read_snapshot(spark, target).collect()}
    assert rows == {f"f/{i:03d}.md": ("new" if i == 7 else f"text {i}", i) for i in range(300)}
    assert notes.update_snapshot(change.limit(0), target, 8) == []
    with pytest.raises(ValueError, match="no such note: f/none.md"):
        notes.update_snapshot(change.withColumn("path", F.lit("f/none.md")), target, 8)
    assert files_of(target) == after


def test_new_notes_must_be_new(spark, tmp_path):
    new = spark.createDataFrame([("a.md", "x"), ("b.md", "y")], "path string, content string")
    notes.write_new(new, str(tmp_path / "ok"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "ok")).collect()} == {("a.md", "x"), ("b.md", "y")}
    for bad, existing in ((new.union(new.limit(1)), None), (new, new.limit(1))):
        with pytest.raises(Exception, match="two notes for|note exists"):
            notes.write_new(bad, str(tmp_path / "bad"), existing)


def test_exclusions_from_a_table(spark):
    files = spark.createDataFrame([("a", "PDF"), ("b", "md"), ("c", None), ("d", ""), ("e", "Txt")], "path string, extension string")
    listed = spark.createDataFrame([("pdf",), ("pdf",), ("TXT",), (None,), ("",)], "extension string")
    flags = {r.path: r.excluded for r in inventory.flag_excluded_by_table(files, listed).collect()}
    assert flags == {"a": True, "b": False, "c": False, "d": True, "e": False}
    assert {r.path for r in inventory.included_by_table(files, listed).collect()} == {"b", "c", "e"}
