"""Notes to sections and back; line numbers re-based from section to note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notespark import params
from notespark.functions import markdown as md
from notespark.functions.text import line_count, trim


def header_pieces(notes: DataFrame) -> DataFrame:
    return notes.select("path", F.posexplode(md.header_pieces(F.col("content"))).alias("piece_no", "piece"))


def _inline(notes: DataFrame, cut: Column, keep: tuple[str, ...]) -> DataFrame:
    """Sections as rows, with what later steps need of the text, so that the text itself can be dropped early.

    The generator gets the expression itself: over a named column the optimizer would add a filter on the
    column's size and cut every note again for it.
    """
    return notes.select("path", *keep, F.inline(cut)).withColumn("n_lines", line_count(F.col("section")))


def full_sections(notes: DataFrame, size: int = params.FULL_CHUNK_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Packed header sections of every note."""
    return _inline(notes, md.pack_sections(F.col("content"), size), keep)


def fixed_sections(
    notes: DataFrame, size: int = params.FIXED_SECTION_CHARS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Fixed-width sections; ``newlines_before`` counts the line ends in front of each."""
    return _inline(notes, md.fixed_sections(F.col("content"), size), keep)


def sample_section(notes: DataFrame, size: int = params.SAMPLE_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    return notes.select(
        "path",
        *keep,
        F.lit(0).alias("section_no"),
        F.substring("content", 1, size).alias("section"),
        (F.length("content") <= size).alias("whole_note"),
    )


def sections_by_mode(
    notes: DataFrame, mode: Column, full_size: int, fixed_size: int, sample_size: int, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Sections as the mode of each note cuts them; ``_mode``, ``line_map`` and ``newlines_before`` tell how."""
    text, no_map = F.col("content"), F.array().cast("array<struct<packed:int,exact:int>>")

    def section(no: Column, part: Column, line_map: Column, before: Column) -> Column:
        return F.struct(
            no.alias("section_no"), part.alias("section"), line_map.alias("line_map"), before.alias("newlines_before")
        )

    full = F.transform(md.pack_sections(text, full_size), lambda s: section(s["section_no"], s["section"], s["line_map"], F.lit(0)))
    fixed = F.transform(md.fixed_sections(text, fixed_size), lambda s: section(s["section_no"], s["section"], no_map, s["newlines_before"]))
    sample = F.array(section(F.lit(0), F.substring(text, 1, sample_size), no_map, F.lit(0)))
    unknown = F.raise_error(F.concat(F.lit("unknown check mode: "), F.col("_mode")))
    cut = (
        F.when(F.col("_mode") == "full", full)
        .when(F.col("_mode") == "incremental", fixed)
        .when(F.col("_mode") == "auto", sample)
        .when(F.col("_mode").isNotNull(), unknown)
    )
    return _inline(notes.withColumn("_mode", mode), cut, keep)


def progress(sections: DataFrame) -> DataFrame:
    """Share of a note done after each section, in whole percent, half up."""
    done, total = F.col("section_no") + 1, F.col("n_sections")
    return sections.withColumn("progress", F.floor((200 * done + total) / (2 * total)).cast("long"))


def full_line_offset(sections: DataFrame, ok: Column) -> DataFrame:
    """Lines of the earlier sections that were checked successfully; a failed one does not count.

    The window holds the sections of one note, so its size is bounded by the note itself.
    """
    w = Window.partitionBy("path").orderBy("section_no").rowsBetween(Window.unboundedPreceding, -1)
    counted = F.when(ok, F.col("n_lines")).otherwise(0)
    return sections.withColumn("line_offset", F.coalesce(F.sum(counted).over(w), F.lit(0)))


def fixed_line_offset(sections: DataFrame) -> DataFrame:
    """Offset as reported to users: it starts at 1, so lines come out one too high (``line_exact`` does not)."""
    return sections.withColumn("line_offset", F.col("newlines_before") + 1)


def rewrite_sections(
    notes: DataFrame,
    trimmed: bool = True,
    split_above: int = params.REWRITE_SPLIT_CHARS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Pieces sent for rewriting: long notes by header with blank pieces dropped, others whole.

    ``trimmed`` is the rule for corrections; enhancement leaves the pieces as they are.
    """
    return notes.select("path", *keep, F.posexplode(rewrite_parts(trimmed, split_above)).alias("section_no", "section"))


def rewrite_parts(trimmed: bool = True, split_above: int = params.REWRITE_SPLIT_CHARS) -> Column:
    """The same pieces as one array of a note's row."""
    pieces = md.header_pieces(F.col("content"))
    if trimmed:
        pieces = F.transform(pieces, trim)
    long = F.filter(pieces, lambda p: F.length(trim(p)) > 0)
    return F.when(F.length("content") > split_above, long).otherwise(F.array("content"))


def join_sections(sections: DataFrame, text: str = "section") -> DataFrame:
    """Sections of a note back to one text, in order, separated by an empty line."""
    ordered = F.array_sort(F.collect_list(F.struct("section_no", F.col(text).alias("t"))))
    return sections.groupBy("path").agg(
        F.array_join(F.transform(ordered, lambda s: s["t"]), "\n\n").alias("content")
    )
