from pyspark.sql import functions as F

from notespark.operators import inventory

FILES = [("a/x.md", "x", "md"), ("a/y.MD", "y", "MD"), ("b/z.PDF", "z", "PDF"), ("b/w.txt", "w", "txt"), ("c/v.md", "v", "md")]


def files(spark):
    return spark.createDataFrame(FILES, "path string, basename string, extension string")


def test_exclusion_list_keeps_case_and_empties(value):
    assert value(inventory.parse_exclusions("pdf, PDF ,")) == ["pdf", "PDF", ""]


def test_upper_case_entry_never_matches(spark):
    def flags(setting):
        flagged = inventory.flag_excluded(files(spark), inventory.parse_exclusions(setting))
        return {r.path for r in flagged.where("excluded").collect()}

    assert flags("pdf") == {"b/z.PDF"}
    assert flags("PDF") == set()


def test_counts(spark):
    f = files(spark)
    by_ext = {r.extension: r.n for r in inventory.breakdown(f).collect()}
    assert by_ext == {"md": 3, "pdf": 1, "txt": 1}
    assert sum(by_ext.values()) == len(FILES)
    assert tuple(inventory.summary(f).first()) == (4, 2)


def test_candidates(spark):
    f = files(spark)
    assert [r.path for r in inventory.link_candidates(f, F.lit("a/x.md")).collect()] == ["c/v.md"]
    many = spark.range(50).select(
        F.format_string("n%03d.md", "id").alias("path"), F.lit("b").alias("basename"), F.lit("md").alias("extension")
    )
    assert inventory.link_candidates(many, F.lit("n003.md")).count() == 20
    assert inventory.link_candidates(many, F.lit("n003.md"), "all").count() == 49
