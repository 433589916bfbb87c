"""Note scans and sinks.

A note is ``(path, basename, extension, content)``. File metadata and content are separate reads: everything
that works on names never touches the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notespark.functions.text import derived_path
from notespark.session import cut_lineage
from notespark.sources.folder_source import FORMAT, FolderSource

SNAPSHOT_PARTS = 256
_NAME = r"([^/]*?)(?:\.([^./]*))?$"


def _split_path(files: DataFrame) -> DataFrame:
    return files.withColumn("basename", F.regexp_extract("path", _NAME, 1)).withColumn(
        "extension", F.regexp_extract("path", _NAME, 2)
    )


def _files(spark: SparkSession, folder: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below a folder that isn't empty: ``path, basename, extension, n_bytes, modified``; no content is read.

    The driver lists the files. For very many small notes use ``scan_tree``, or keep a manifest table and ``from_manifest``.
    """
    return _split_path(
        _files(spark, folder, None).select("path", F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"))
    )


def read_folder(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """Notes below a folder with their whole text, under the same paths as ``scan_folder`` gives."""
    return _split_path(_files(spark, folder, glob).select("path", F.decode("content", "UTF-8").alias("content")))


def _walk(spark: SparkSession, folder: str, levels: int, suffix: str, content: bool) -> DataFrame:
    spark.dataSource.register(FolderSource)
    reader = spark.read.format(FORMAT).option("levels", levels).option("suffix", suffix)
    return reader.option("content", str(content).lower()).load(folder)


def scan_tree(spark: SparkSession, folder: str, levels: int = 2) -> DataFrame:
    """What ``scan_folder`` gives, and empty files too, listed by tasks: the driver looks at directories of the upper
    ``levels`` only."""
    return _split_path(_walk(spark, folder, levels, "", False))


def read_tree(spark: SparkSession, folder: str, levels: int = 2, suffix: str = ".md") -> DataFrame:
    """What ``read_folder`` gives, listed and read by tasks; bytes that are no UTF-8 become marks."""
    return _split_path(_walk(spark, folder, levels, suffix, True).select("path", "content"))


def from_manifest(manifest: DataFrame) -> DataFrame:
    """Notes from a table with ``path`` and any other columns (``content``, sizes, dates): no folder is listed."""
    return _split_path(manifest.drop("basename", "extension"))


def derived_notes(texts: DataFrame, suffix: str) -> DataFrame:
    """Rewritten notes under their new path; ``texts`` has ``path, basename, content`` of markdown notes."""
    return texts.select(
        derived_path(F.col("path"), F.col("basename"), suffix).alias("path"), "content"
    )


def write_new(notes: DataFrame, target: str, existing: DataFrame | None = None) -> None:
    """Write notes that must be new: fails when the target exists, or when a path is in ``existing`` or comes twice.

    Paths that come twice are looked for first, over the paths alone; ``existing`` is checked by the write job itself.
    """
    checked = notes
    if existing is not None:
        known = existing.select("path").distinct().withColumn("_known", F.lit(True))
        taken = F.when(F.col("_known"), F.raise_error(F.concat(F.lit("note exists: "), F.col("path"))))
        checked = notes.join(known, "path", "left").withColumn("path", F.coalesce(taken.cast("string"), F.col("path"))).drop("_known")
    twice = notes.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two notes for {twice[0].path}")
    checked.write.mode("errorifexists").parquet(target)


def snapshot(notes: DataFrame, changed: DataFrame) -> DataFrame:
    """All files of a vault, with the content of the changed notes ``(path, content)`` replaced."""
    new = changed.select("path", F.col("content").alias("_new"), F.lit(True).alias("_changed"))
    content = F.when(F.col("_changed"), F.col("_new")).otherwise(F.col("content"))
    return notes.join(new, "path", "left").withColumn("content", content).drop("_new", "_changed")


def write_snapshot(notes: DataFrame, target: str, parts: int = SNAPSHOT_PARTS) -> None:
    """All notes of a vault as a new snapshot, dealt over ``parts`` folders by path; the source stays as it is.

    A number of parts suits a vault as long as a part fits a task; all updates of a snapshot name the same number.
    """
    placed = notes.withColumn("part", _part(parts)).repartition("part")
    placed.write.partitionBy("part").mode("errorifexists").parquet(target)


def read_snapshot(spark: SparkSession, source: str) -> DataFrame:
    return spark.read.parquet(source).drop("part")


def update_snapshot(changed: DataFrame, target: str, parts: int = SNAPSHOT_PARTS) -> list[int]:
    """Replace the content of the changed notes ``(path, content)`` in a written snapshot; returns the parts rewritten.

    Only the parts that have a changed note are read and rewritten, each as a whole when the job ends, so readers see the
    old or the new state of a part. Paths that the vault doesn't have are an error: new notes go through ``write_new``.
    """
    spark = changed.sparkSession
    changed = cut_lineage(changed.select("path", "content"))  # read for the parts and for the texts
    touched = sorted(r[0] for r in changed.select(_part(parts).alias("part")).distinct().collect())  # ``parts`` at most
    if not touched:
        return []
    stored = spark.read.parquet(target)
    columns = [c for c in stored.columns if c != "part"]
    old = stored.where(F.col("part").isin(touched))
    known = old.select("path", F.lit(True).alias("_known"))
    strangers = changed.join(known, "path", "left").where(F.col("_known").isNull()).limit(1).collect()
    if strangers:
        raise ValueError(f"no such note: {strangers[0].path}")
    new = snapshot(old, changed).select(*columns, "part").repartition("part")
    new.write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(target)
    return touched


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int")
