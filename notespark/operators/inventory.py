"""File inventory: exclusion, splits, counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notespark import params
from notespark.functions.text import trim


def parse_exclusions(setting: str | Column) -> Column:
    """Comma list to array: entries trimmed, empty entries and letter case kept."""
    text = F.lit(setting) if isinstance(setting, str) else setting
    return F.transform(F.split(text, ",", -1), trim)


def is_excluded(extension: Column, excluded: Iterable[str] | Column = params.EXCLUDED_EXTENSIONS) -> Column:
    """Only the file's side is lower-cased, so an upper-case list entry never matches."""
    if isinstance(excluded, Column):
        return F.array_contains(excluded, F.lower(extension))
    return F.lower(extension).isin(*excluded)


def flag_excluded(files: DataFrame, excluded=params.EXCLUDED_EXTENSIONS) -> DataFrame:
    return files.withColumn("excluded", is_excluded(F.col("extension"), excluded))


def flag_excluded_by_table(files: DataFrame, exclusions: DataFrame) -> DataFrame:
    """``flag_excluded`` with a list of any length as a table ``(extension)``, its entries taken as they are.

    Files are many and extensions few: the different ones are looked up once each, and whether that small result is
    broadcast is left to the engine, by its bytes.
    """
    listed = exclusions.select(F.col("extension").alias("_own")).where("_own is not null").distinct().withColumn("excluded", F.lit(True))
    own = files.select(F.lower("extension").alias("_own")).distinct()
    known = own.join(listed, "_own", "left_semi").withColumn("excluded", F.lit(True))
    flagged = files.withColumn("_own", F.lower("extension")).join(known, "_own", "left")
    return flagged.select(*files.columns, F.coalesce("excluded", F.lit(False)).alias("excluded"))


def included(files: DataFrame, excluded=params.EXCLUDED_EXTENSIONS) -> DataFrame:
    return files.where(~is_excluded(F.col("extension"), excluded))


def included_by_table(files: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Files whose extension is in no row of the table ``(extension)``: an anti-join on the lower-cased extension."""
    listed = exclusions.select(F.col("extension").alias("_own")).where("_own is not null").distinct()
    return files.withColumn("_own", F.lower("extension")).join(listed, "_own", "left_anti").drop("_own")


def markdown(files: DataFrame, excluded=params.EXCLUDED_EXTENSIONS) -> DataFrame:
    """Included files whose extension is exactly ``md``; ``MD`` is included but not markdown."""
    return included(files, excluded).where(F.col("extension") == "md")


def breakdown(files: DataFrame) -> DataFrame:
    """Files per lower-cased extension, excluded ones too."""
    return files.groupBy(F.lower("extension").alias("extension")).agg(F.count(F.lit(1)).alias("n"))


def summary(files: DataFrame, excluded=params.EXCLUDED_EXTENSIONS) -> DataFrame:
    """One row; ``total_files`` counts included files only."""
    kept = ~is_excluded(F.col("extension"), excluded)
    return files.agg(
        F.count_if(kept).alias("total_files"),
        F.count_if(kept & (F.col("extension") == "md")).alias("markdown_files"),
    )


def link_candidates(
    files: DataFrame,
    anchor_path: Column,
    mode: str = "current",
    excluded=params.EXCLUDED_EXTENSIONS,
    limit: int = params.CURRENT_MODE_CANDIDATES,
) -> DataFrame:
    """Markdown files other than the anchor; mode ``current`` keeps the first ``limit`` in path order."""
    others = markdown(files, excluded).where(F.col("path") != anchor_path)
    if mode == "all":
        return others
    if mode != "current":
        raise ValueError(f"unknown mode: {mode}")
    return others.orderBy("path").limit(limit)
