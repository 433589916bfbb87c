"""Check modes: how a note is cut, how findings' lines are re-based, what a check costs.

A checker is a function ``sections -> sections`` that adds ``parse_ok``, ``corrections`` and ``issues``;
``from_replies`` reads a reply table, ``from_lint`` needs no model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notespark import params
from notespark.functions.markdown import exact_line, lint
from notespark.operators import findings, replies, requests, sections

Checker = Callable[[DataFrame], DataFrame]
_NO_CORRECTIONS = "array<struct<original:string,suggested:string,line:bigint,confidence:double,context:string>>"


def from_lint(cut: DataFrame) -> DataFrame:
    return (
        cut.withColumn("parse_ok", F.lit(True))
        .withColumn("corrections", F.array().cast(_NO_CORRECTIONS))
        .withColumn("issues", lint(F.col("section")))
        .drop("section")
    )


def from_replies(reply_table: DataFrame, key: Callable[[DataFrame], Column]) -> Checker:
    """Checker over a reply table; a section without a readable reply counts as failed.

    Only the key of a section meets the replies: its text is dropped before the join and not shuffled.
    """

    def check(cut: DataFrame) -> DataFrame:
        keyed = cut.withColumn("key", key(cut)).drop("section")
        answered = requests.attach_replies(keyed, reply_table, ["path", "section_no"])
        return replies.parse_findings(answered).withColumn("parse_ok", F.coalesce("parse_ok", F.lit(False)))

    return check


def _explode(checked: DataFrame, line_exact: Callable[[Column], Column], *more: Column) -> DataFrame:
    def rows(kind: str, column: str, title: str) -> Column:
        listed = F.coalesce(F.when(F.col("parse_ok"), F.col(column)), F.array())
        return F.transform(
            listed,
            lambda f, i: F.struct(
                F.lit(kind).alias("kind"),
                i.cast("long").alias("pos"),
                f[title].alias("what"),
                f["line"].cast("long").alias("line"),
            ),
        )

    line = F.col("f.line")
    both = F.concat(rows("correction", "corrections", "original"), rows("issue", "issues", "issue"))
    return checked.withColumn("f", F.explode(both)).select(
        "path",
        F.col("section_no").cast("long").alias("section_no"),
        "f.kind",
        "f.pos",
        "f.what",
        (line + F.col("line_offset")).cast("long").alias("line"),
        line_exact(line).cast("long").alias("line_exact"),
        *more,
    )


def check_full(
    notes: DataFrame, checker: Checker, size: int = params.FULL_CHUNK_CHARS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """All packed sections. ``line`` follows the offset rule, ``line_exact`` the place in the note.

    ``keep`` names columns of the notes that the checker needs, the language of a request's key, say.
    """
    checked = checker(sections.full_sections(notes, size, keep))
    based = sections.full_line_offset(checked, F.col("parse_ok"))
    return _explode(based, lambda line: exact_line(line, F.col("line_map")))


def check_incremental(
    notes: DataFrame,
    checker: Checker,
    size: int = params.FIXED_SECTION_CHARS,
    only_section: int | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Fixed-width sections; ``only_section=0`` is what an interactive first check looks at."""
    if only_section == 0:  # the first characters, without cutting the rest
        cut = sections.sample_section(notes, size, keep).withColumn("newlines_before", F.lit(0))
    else:
        cut = sections.fixed_sections(notes, size, keep)
        if only_section is not None:
            cut = cut.where(F.col("section_no") == only_section)
    based = sections.fixed_line_offset(checker(cut))
    return _explode(based, lambda line: line + F.col("newlines_before"))


def check_auto(
    notes: DataFrame, checker: Checker, size: int = params.SAMPLE_CHARS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The first characters only; whether a full check is advised is told by ``auto_verdict``."""
    based = checker(sections.sample_section(notes, size, keep)).withColumn("line_offset", F.lit(0))
    return _explode(based, lambda line: line)


CHECKS = {"full": check_full, "incremental": check_incremental, "auto": check_auto}


def check(mode: str, notes: DataFrame, checker: Checker, **options) -> DataFrame:
    if mode not in CHECKS:
        raise ValueError(f"unknown check mode: {mode}")
    return CHECKS[mode](notes, checker, **options)


def check_mixed(
    notes: DataFrame,
    mode: Column,
    checker: Checker,
    full_size: int = params.FULL_CHUNK_CHARS,
    fixed_size: int = params.FIXED_SECTION_CHARS,
    sample_size: int = params.SAMPLE_CHARS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Every note in its own mode: the findings of ``check`` for each, with the column ``mode``, in one plan.

    Texts are read once and cut by the mode of their row; replies are joined once. A note without a mode is left out, an
    unknown mode is an error.
    """
    cut = sections.sections_by_mode(notes, mode, full_size, fixed_size, sample_size, ("_mode", *keep))
    is_full, is_fixed = F.col("_mode") == "full", F.col("_mode") == "incremental"
    based = sections.full_line_offset(checker(cut), F.col("parse_ok")).withColumn(
        "line_offset",
        F.when(is_full, F.col("line_offset")).when(is_fixed, F.col("newlines_before") + 1).otherwise(0),
    )

    def place(line: Column) -> Column:
        return F.when(is_full, exact_line(line, F.col("line_map"))).otherwise(line + F.col("newlines_before"))

    return _explode(based, place, F.col("_mode").alias("mode"))


def auto_verdict(
    notes: DataFrame,
    checker: Checker,
    threshold: float = params.AUTO_THRESHOLD,
    size: int = params.SAMPLE_CHARS,
) -> DataFrame:
    """Error density of the sample and the advice that follows from it."""
    sample = sections.sample_section(notes, size).withColumn("sample_chars", F.length("section"))
    checked = checker(sample).where("parse_ok")
    n = (F.size("corrections") + F.size("issues")).cast("long")
    chars = F.col("sample_chars")
    dense = findings.is_dense(n, chars, threshold)
    density = findings.density(n, chars)
    # Fixed value: the text that users see.
    reason = F.format_string(
        f"Found %d errors in first %dk characters (%.1f errors/k). Threshold is {threshold} errors/k.",
        n,
        F.floor(chars / 1000.0 + 0.5).cast("long"),
        density,
    )
    return checked.select(
        "path",
        n.alias("n_findings"),
        F.round(density, 4).alias("density"),
        dense.alias("suggest_full"),
        F.when(dense, reason).alias("reason"),
        "whole_note",
    )


def estimated_requests(mode: str, n_chars: Column, chars: int = params.ESTIMATE_CHARS) -> Column:
    """A full check is estimated with a fixed section size whatever the setting; the others are one request."""
    if mode not in CHECKS:
        raise ValueError(f"unknown check mode: {mode}")
    return F.ceil(n_chars / float(chars)) if mode == "full" else F.lit(1).cast("long")


# Mode, mode it may switch to, whether it works section by section.
MODES = (("full", "incremental", False), ("incremental", "full", True), ("auto", "full", False))


def modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODES, "mode string, can_switch_to string, incremental boolean")


def switch_suggestions(verdicts: DataFrame, mode: str = "auto", to: str = "full") -> DataFrame:
    """Advice to switch, only where the mode table allows that switch."""
    legal = modes(verdicts.sparkSession).where((F.col("mode") == mode) & (F.col("can_switch_to") == to))
    return (
        verdicts.where("suggest_full")
        .withColumn("mode", F.lit(mode))
        .join(F.broadcast(legal), "mode")  # three rows at most
        .select("path", "mode", F.col("can_switch_to").alias("suggested_mode"), "reason")
    )
