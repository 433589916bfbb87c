"""The four things a note collection is asked: what is in it, what links, what is wrong, what a rewrite looks like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notespark import params
from notespark.functions.markdown import lint, safe_fix
from notespark.functions.text import native_spell_key
from notespark.operators import cache, findings, inventory, links, replies, requests, sections, strategies, themes
from notespark.sources.notes import derived_notes


def analyze_vault(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, breakdown, themes with the place first seen). Only names are read."""
    members = themes.chunk_members(inventory.markdown(files))
    found = themes.union(themes.chunk_themes(members))
    return inventory.summary(files), inventory.breakdown(files), found


def smart_links(notes: DataFrame, anchor_path: Column, mode: str = "current") -> DataFrame:
    """Best partners of one note among the first 20 others (``current``) or all others (``all``)."""
    # The path itself: as a subquery it would be looked for again by every scan.
    anchor_path = F.lit(notes.sparkSession.range(1).select(anchor_path).first()[0]).cast("string")
    candidates = None if mode == "all" else inventory.link_candidates(notes, anchor_path, mode)
    return links.anchor_links(inventory.markdown(notes), anchor_path, candidates)


def links_from_replies(asked: DataFrame, reply_table: DataFrame, candidates: DataFrame) -> DataFrame:
    """Best partners of one note as a model judged them.

    ``asked`` is what ``requests.link_requests`` returned, ``reply_table`` has ``(key, raw_reply)``. Pairs that
    were refused, not answered or not readable give no row.
    """
    about = candidates.select("path", "basename", F.substring("content", 1, params.PREVIEW_CHARS).alias("preview"))
    answered = requests.attach_replies(asked.select("path", "key"), reply_table, ["path"])
    return links.best(replies.parse_links(answered.join(about, "path")).drop("key"))


def themes_from_replies(asked: DataFrame, reply_table: DataFrame) -> DataFrame:
    """Union of the themes a model gave for chunks of names; ``asked`` comes from ``requests.theme_requests``."""
    answered = requests.attach_replies(asked.select("chunk_no", "key"), reply_table, ["chunk_no"])
    listed = replies.parse_themes(answered).select(
        "chunk_no", F.posexplode(F.coalesce("themes", F.array())).alias("pos", "theme")
    )
    return themes.union(listed)


def theme_partners(notes: DataFrame) -> DataFrame:
    """The 20 notes with most themes in common with each markdown note."""
    md = inventory.markdown(notes)
    return links.describe_partners(links.theme_partners(links.themes_of(md)), md)


def check_notes(notes: DataFrame, mode: str, checker: strategies.Checker = strategies.from_lint, **options) -> DataFrame:
    return strategies.check(mode, inventory.markdown(notes), checker, **options)


def fix_notes(notes: DataFrame) -> DataFrame:
    """Markdown notes with the safe formatting fixes, ``(path, content)``; ``snapshot`` puts them back in the vault."""
    return inventory.markdown(notes).select("path", safe_fix(F.col("content")).alias("content"))


def apply_lint(notes: DataFrame) -> DataFrame:
    """Every fixable lint finding applied to the whole text, in order, protected spans not spared."""
    return inventory.markdown(notes).select(
        "path", findings.apply_fixes(F.col("content"), lint(F.col("content"))).alias("content")
    )


def apply_findings(notes: DataFrame, checked: DataFrame) -> DataFrame:
    """The notes of checked sections with all their corrections and fixes applied, in section order: ``(path, content)``.

    ``checked`` is what a checker returned; failed sections and notes without findings change nothing and give no row.
    Findings are gathered per note before they meet the texts, which are joined once.
    """
    merged = findings.merge(checked.where("parse_ok"))
    found = merged.where((F.size("corrections") > 0) | (F.size("issues") > 0))
    corrected = findings.apply_corrections(F.col("content"), F.col("corrections"))
    return notes.join(found, "path").select("path", findings.apply_fixes(corrected, F.col("issues")).alias("content"))


def _asked(notes: DataFrame, language: Column | None, variant: str | Column) -> DataFrame:
    """Notes with the language and prompt variant of their requests, so that keys are built alike on both sides."""
    lang = F.lit(params.LANGUAGE) if language is None else language
    return notes.withColumn("_language", lang).withColumn("_variant", F.lit(variant) if isinstance(variant, str) else variant)


_KEPT = ("_language", "_variant")


def check_keys(
    notes: DataFrame,
    size: int = params.FULL_CHUNK_CHARS,
    language: Column | None = None,
    variant: str | Column = params.PROMPT_VARIANT,
    model: str = params.CHECK_MODEL,
    templates: DataFrame | None = None,
) -> DataFrame:
    """Request rows ``(path, section_no, key, truncated, body)`` of a full check; language and variant may be columns."""
    cut = sections.full_sections(_asked(inventory.markdown(notes), language, variant), size, _KEPT)
    return requests.check_requests(cut, F.col("_language"), F.col("_variant"), model, templates=templates)


def pending_checks(notes: DataFrame, cached: DataFrame, now: Column, **asked) -> DataFrame:
    """Requests of a full check that no live entry answers, one per key; ``asked`` as in ``check_keys``."""
    return cache.pending(check_keys(notes, **asked), cached, now)


def check_cached(
    notes: DataFrame,
    cached: DataFrame,
    now: Column,
    new: DataFrame | None = None,
    mode: str | Column = "full",
    language: Column | None = None,
    variant: str | Column = params.PROMPT_VARIANT,
    model: str = params.CHECK_MODEL,
) -> DataFrame:
    """Findings from what is cached and what has newly arrived, by the key of ``requests.check_requests`` for the same
    language, variant and model. ``mode`` may be a column: each note is then checked in its own mode."""
    key = lambda cut: native_spell_key(F.col("_language"), F.col("section"), F.col("_variant"), model)
    checker = strategies.from_replies(cache.reply_table(cached, now, new), key)
    md = _asked(inventory.markdown(notes), language, variant)
    if isinstance(mode, Column):
        return strategies.check_mixed(md, mode, checker, keep=_KEPT)
    return strategies.check(mode, md, checker, keep=_KEPT)


def links_cached(
    anchor: DataFrame,
    candidates: DataFrame,
    cached: DataFrame,
    now: Column,
    new: DataFrame | None = None,
    model: str = params.LINK_MODEL,
) -> DataFrame:
    """Best partners of one note from cached and newly arrived judgements."""
    asked = requests.link_requests(anchor, candidates, model)
    return links_from_replies(asked, cache.reply_table(cached, now, new), candidates)


def themes_cached(chunks: DataFrame, cached: DataFrame, now: Column, new: DataFrame | None = None) -> DataFrame:
    """Union of the themes from cached and newly arrived replies on chunks of names."""
    return themes_from_replies(requests.theme_requests(chunks), cache.reply_table(cached, now, new))


def rewrite_cached(
    notes: DataFrame,
    kind: str,
    cached: DataFrame,
    now: Column,
    new: DataFrame | None = None,
    language: Column | None = None,
    model: str | None = None,
) -> DataFrame:
    """Corrected or enhanced notes from cached and newly arrived replies, by the key of ``requests.rewrite_requests`` for the
    same language and model."""
    return rewrite(notes, cache.reply_table(cached, now, new), kind, language, model)


def store(cached: DataFrame, new: DataFrame, now: Column, ttl_ms: int = params.CACHE_TTL_MS) -> DataFrame:
    """The cache with newly arrived replies ``(key, raw_reply)`` added as of now."""
    entries = new.groupBy("key").agg(F.min("raw_reply").alias("value"))
    entries = entries.select("key", now.alias("ts"), F.lit(ttl_ms).cast("long").alias("ttl_ms"), "value")
    return cache.upsert(cached.select("key", "ts", "ttl_ms", "value"), entries)


def rewrite(
    notes: DataFrame, reply_table: DataFrame, kind: str, language: Column | None = None, model: str | None = None
) -> DataFrame:
    """Corrected or enhanced notes under their derived path; sections without a usable reply stay as they were.

    ``reply_table`` has ``(key, raw_reply)``, keys being those of ``requests.rewrite_requests`` for the same language and
    model, or ``(path, section_no, raw_reply)``. Replies are gathered per note, and each text is joined once, cut, replaced and put
    together in its row. Of several replies to a section the least one counts.
    """
    accept, suffix = {
        "correct": (replies.accept_corrected, "corrected"),
        "enhance": (replies.accept_enhanced, "enhanced"),
    }[kind]
    md = inventory.markdown(notes)
    parts = sections.rewrite_parts(trimmed=kind == "correct")
    answered = reply_table
    if "key" in reply_table.columns:
        keys = F.transform(parts, lambda s: requests.rewrite_key(kind, s, language, model))
        asked = md.select("path", F.posexplode(keys).alias("section_no", "key"))
        answered = requests.attach_replies(asked, reply_table, ["path", "section_no"])
    one = answered.where(F.col("raw_reply").isNotNull()).groupBy("path", F.col("section_no").cast("int").alias("section_no"))
    by_note = (
        one.agg(F.min("raw_reply").alias("raw_reply"))
        .groupBy("path")
        .agg(F.map_from_entries(F.collect_list(F.struct("section_no", "raw_reply"))).alias("_replies"))
    )
    replaced = F.transform(
        F.col("_parts"), lambda s, i: F.coalesce(accept(F.try_element_at("_replies", i), s), s)
    )
    whole = md.join(by_note, "path", "left").withColumn("_parts", parts)
    whole = whole.withColumn("content", F.array_join(F.when(F.col("_replies").isNull(), F.col("_parts")).otherwise(replaced), "\n\n"))
    return derived_notes(whole, suffix)


def estimate(notes: DataFrame, mode: str) -> DataFrame:
    """Number of requests a check of each markdown note is expected to take."""
    return inventory.markdown(notes).select(
        "path", strategies.estimated_requests(mode, F.length("content")).alias("n_requests")
    )
