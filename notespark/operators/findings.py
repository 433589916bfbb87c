"""Findings of notes: merge over sections, counts, density, application to the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notespark import params
from notespark.functions import text as t


def fixable(issues: Column) -> Column:
    """Issues that can be applied: fixable with both texts given (placeholders do not count)."""
    return F.filter(
        issues,
        lambda i: F.coalesce(i["fixable"], F.lit(False))
        & F.coalesce(~i["originalText"].isin("", params.NO_ORIGINAL), F.lit(False))
        & F.coalesce(~i["suggestedText"].isin("", params.NO_SUGGESTED), F.lit(False)),
    )


def merge(sections: DataFrame) -> DataFrame:
    """Findings of all sections of a note in section order."""

    def flat(column: str) -> Column:
        in_order = F.array_sort(F.collect_list(F.struct("section_no", F.col(column).alias("f"))))
        return F.flatten(F.transform(in_order, lambda s: F.coalesce(s["f"], F.array())))

    return sections.groupBy("path").agg(
        flat("corrections").alias("corrections"), flat("issues").alias("issues")
    )


def counts(findings: DataFrame) -> DataFrame:
    n_c, n_i = F.size("corrections"), F.size("issues")
    return findings.select(
        "path",
        n_c.cast("long").alias("n_corrections"),
        n_i.cast("long").alias("n_issues"),
        F.size(F.filter("issues", lambda i: i["fixable"])).cast("long").alias("n_fixable"),
        (n_c + n_i == 0).alias("clean"),
    )


def density(n_findings: Column, n_chars: Column) -> Column:
    """Findings per 1000 characters, null for an empty text."""
    return F.try_divide(n_findings.cast("double"), n_chars / F.lit(1000.0))


def is_dense(n_findings: Column, n_chars: Column, threshold: float = params.AUTO_THRESHOLD) -> Column:
    """An empty text is dense as soon as it has any finding."""
    return F.coalesce(density(n_findings, n_chars) >= threshold, n_findings > 0)


def apply_one(content: Column, original: Column, suggested: Column) -> Column:
    return t.replace_all(content, original, suggested)


def apply_corrections(content: Column, corrections: Column) -> Column:
    return t.apply_pairs(content, corrections, "original", "suggested")


def apply_fixes(content: Column, issues: Column) -> Column:
    return t.apply_pairs(content, fixable(issues), "originalText", "suggestedText")
