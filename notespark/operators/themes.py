"""Names in chunks of a fixed count, their themes, and the union of themes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notespark import params
from notespark.functions.text import words
from notespark.operators.skew import first_per_key
from notespark.session import cut_lineage


_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number inside the partition below


def numbered(files: DataFrame) -> DataFrame:
    """``(path, basename, position)`` with the position in path order over the whole corpus.

    Runs one job: names are range-partitioned, sorted inside their partition and checkpointed, so that counting
    a partition and numbering inside it see the same rows (range bounds are sampled and might differ between
    two evaluations). A position is the row's number inside its partition plus the sizes of the partitions
    before; those are summed over one row per partition, and no task sorts the corpus.
    """
    names = files.select("path", "basename").repartitionByRange("path").sortWithinPartitions("path")
    row_id = F.monotonically_increasing_id()
    ranged = cut_lineage(names).withColumn("_id", row_id).withColumn("_part", F.shiftright("_id", _ROW_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    row = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return ranged.join(F.broadcast(offsets), "_part").select(  # one row per partition
        "path", "basename", (F.col("_offset") + row).alias("position")
    )


def chunk_members(files: DataFrame, size: int = params.NAMES_PER_CHUNK) -> DataFrame:
    return numbered(files).withColumn("chunk_no", F.floor(F.col("position") / size).cast("long"))


def name_chunks(members: DataFrame) -> DataFrame:
    """One row per chunk: its names in order, a line each. A chunk has a fixed number of names."""
    in_order = F.array_sort(F.collect_list(F.struct("position", "basename")))
    return members.groupBy("chunk_no").agg(
        F.count(F.lit(1)).alias("n_names"),
        F.array_join(F.transform(in_order, lambda n: n["basename"]), "\n").alias("names"),
    )


def chunk_themes(
    members: DataFrame, min_names: int = 2, top: int | None = params.THEMES_PER_CHUNK, min_chars: int = params.MIN_TERM_CHARS
) -> DataFrame:
    """Words that occur in at least ``min_names`` names of a chunk, most frequent first; at most ``top``, if given.

    Substitute for a model's themes, by the same input: file names only.
    """
    counted = (
        members.select(
            "chunk_no",
            F.explode(
                F.array_distinct(F.filter(words(F.col("basename")), lambda w: F.length(w) >= min_chars))
            ).alias("theme"),
        )
        .groupBy("chunk_no", "theme")
        .agg(F.count(F.lit(1)).alias("n_names"))
        .where(F.col("n_names") >= min_names)
    )
    order = [F.desc("n_names"), F.asc("theme")]
    if top is None:
        return counted.withColumn("pos", F.row_number().over(Window.partitionBy("chunk_no").orderBy(*order)))
    return first_per_key(counted, ["chunk_no"], order, top, "pos")


def union(themes: DataFrame) -> DataFrame:
    """Distinct themes, case-sensitive, with the place they were seen first (``chunk_no``, ``pos``)."""
    return (
        themes.groupBy("theme")
        .agg(F.min(F.struct("chunk_no", "pos")).alias("_first"))
        .select("theme", "_first.*")
    )
