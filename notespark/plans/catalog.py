"""One named query per operator, over the whole derived views of a table folder."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notespark.functions import markdown as md
from notespark.functions import text as t
from notespark.operators import (
    cache,
    findings,
    inventory,
    link_index,
    links,
    replies,
    requests,
    sections,
    spelling,
    strategies,
    themes,
    vector_index,
)
from notespark.plans import flows
from notespark.session import ensure_checkpoint_dir
from notespark.sources import cache_store as store
from notespark.sources import derived
from notespark.sources.notes import derived_notes, read_snapshot, update_snapshot, write_snapshot

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CACHE_NOW = "2024-01-31 00:00:00"
CACHED_NOW = "2024-02-01 00:00:00"
SNAPSHOT_PARTS = 16
PENDING_NOW = "2024-01-02 06:00:00"
EXCLUSION_SETTING = "pdf, PNG ,Txt, md5,"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _now(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _long(c: str) -> Column:
    return F.col(c).cast("long").alias(c)


def _listed(column: str) -> Column:
    """A list, empty for null. Over a bare column the optimizer would filter on its size and parse twice."""
    return F.coalesce(F.col(column), F.array())


def _md_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.markdown(derived.notes(spark, sf_dir))


def _anchor_path(files: DataFrame) -> Column:
    """The open note of the examples: the markdown file of the lowest document."""
    return inventory.markdown(files).agg(F.min_by("path", "doc_id")).scalar()


def _near_path(files: DataFrame) -> Column:
    """An open note for mode ``current``: one that bears the longest name, but for its number,
    of one of the first 20 notes."""
    md = inventory.markdown(files).withColumn("_stem", F.regexp_replace("basename", "[0-9]+$", ""))
    first = md.orderBy("path").limit(20).select("_stem", F.col("path").alias("_first"))
    named_alike = md.join(first.select("_stem").distinct(), "_stem", "left_semi")
    others = named_alike.join(first, F.col("path") == F.col("_first"), "left_anti")
    return F.coalesce(others.agg(F.min_by("path", F.struct(-F.length("_stem"), "doc_id"))).scalar(), _anchor_path(files))


# --- inventory ---------------------------------------------------------------------------------------------


@query
def vault_scan(spark, sf_dir):
    return derived.files(spark, sf_dir).select("path", "basename", "extension")


@query
def note_text(spark, sf_dir):
    return _md_notes(spark, sf_dir).select("path", "content", F.length("content").cast("long").alias("n_chars"))


@query
def exclusion_flags(spark, sf_dir):
    return inventory.flag_excluded(derived.files(spark, sf_dir)).select("path", "extension", "excluded")


@query
def exclusion_setting(spark, sf_dir):
    flagged = inventory.flag_excluded(
        derived.files(spark, sf_dir), inventory.parse_exclusions(EXCLUSION_SETTING)
    )
    return flagged.select("path", "extension", "excluded")


def _long_exclusion_list(spark, sf_dir) -> DataFrame:
    """A list of many thousand entries: the words of part names, the keys of customers, and two extensions in use."""
    names = derived.table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("extension"))
    customers = derived.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("extension"))
    used = derived.files(spark, sf_dir).where(F.col("extension").isin("txt", "PNG")).select(F.lower("extension").alias("extension"))
    return names.union(customers).union(used)


@query
def exclusion_table(spark, sf_dir):
    return inventory.flag_excluded_by_table(derived.files(spark, sf_dir), _long_exclusion_list(spark, sf_dir)).select(
        "path", "extension", "excluded"
    )


@query
def included_by_table(spark, sf_dir):
    return inventory.included_by_table(derived.files(spark, sf_dir), _long_exclusion_list(spark, sf_dir)).select("path", "extension")


@query
def md_candidates(spark, sf_dir):
    return inventory.markdown(derived.files(spark, sf_dir)).select("path", "basename")


@query
def anchor_candidates(spark, sf_dir):
    files = derived.files(spark, sf_dir)
    return inventory.link_candidates(files, _anchor_path(files)).select("path", "basename")


@query
def request_texts(spark, sf_dir):
    return _md_notes(spark, sf_dir).select(
        "path",
        F.substring("content", 1, 5000).alias("check_text"),
        F.substring("content", 1, 3000).alias("compare_text"),
        F.substring("content", 1, 200).alias("preview"),
        (F.length("content") > 5000).alias("truncated"),
    )


@query
def vault_breakdown(spark, sf_dir):
    return inventory.breakdown(derived.files(spark, sf_dir))


@query
def vault_summary(spark, sf_dir):
    return inventory.summary(derived.files(spark, sf_dir))


@query
def vault_analysis(spark, sf_dir):
    """The whole analysis as one row: counts, and numbers of file types and of themes."""
    summary, breakdown, found = flows.analyze_vault(derived.files(spark, sf_dir))
    number = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return summary.select("*", number(breakdown).alias("n_file_types"), number(found).alias("n_themes"))


# --- names and themes --------------------------------------------------------------------------------------


def _members(spark, sf_dir):
    return themes.chunk_members(inventory.markdown(derived.files(spark, sf_dir)))


@query
def name_chunks(spark, sf_dir):
    return themes.name_chunks(_members(spark, sf_dir))


@query
def vault_themes(spark, sf_dir):
    return themes.chunk_themes(_members(spark, sf_dir)).select("chunk_no", _long("pos"), "theme", "n_names")


@query
def parsed_themes(spark, sf_dir):
    raw = derived.theme_replies(themes.name_chunks(_members(spark, sf_dir)))
    return replies.parse_themes(raw).select("chunk_no", F.posexplode(_listed("themes")).alias("pos", "theme")).select(
        "chunk_no", _long("pos"), "theme"
    )


@query
def parsed_themes_compat(spark, sf_dir):
    raw = derived.theme_replies(themes.name_chunks(_members(spark, sf_dir)))
    return replies.parse_themes(raw, compat=True).select(
        "chunk_no", F.size("themes").cast("long").alias("n_themes")
    )


@query
def theme_union(spark, sf_dir):
    return themes.union(parsed_themes(spark, sf_dir)).select("theme", "chunk_no", "pos")


# --- sections ----------------------------------------------------------------------------------------------


@query
def header_pieces(spark, sf_dir):
    return sections.header_pieces(_md_notes(spark, sf_dir)).select("path", _long("piece_no"), "piece")


@query
def header_pack(spark, sf_dir):
    return sections.full_sections(_md_notes(spark, sf_dir)).select("path", _long("section_no"), "section")


@query
def fixed_sections(spark, sf_dir):
    return sections.fixed_line_offset(sections.fixed_sections(_md_notes(spark, sf_dir))).select(
        "path", _long("section_no"), "section", _long("line_offset")
    )


@query
def sample_sections(spark, sf_dir):
    return sections.sample_section(_md_notes(spark, sf_dir)).select("path", "section", "whole_note")


@query
def rewrite_sections(spark, sf_dir):
    notes = _md_notes(spark, sf_dir)
    return (
        sections.rewrite_sections(notes, trimmed=True)
        .withColumn("kind", F.lit("correct"))
        .unionByName(sections.rewrite_sections(notes, trimmed=False).withColumn("kind", F.lit("enhance")))
        .select("kind", "path", _long("section_no"), "section")
    )


@query
def section_progress(spark, sf_dir):
    return sections.progress(sections.full_sections(_md_notes(spark, sf_dir))).select(
        "path", _long("section_no"), "progress"
    )


def _reply_checker(cut: DataFrame) -> strategies.Checker:
    return strategies.from_replies(derived.section_replies(cut), lambda s: derived.section_key(F.col("section")))


@query
def check_full_replies(spark, sf_dir):
    notes = _md_notes(spark, sf_dir)
    return strategies.check("full", notes, _reply_checker(sections.full_sections(notes)))


@query
def check_incremental_replies(spark, sf_dir):
    notes = _md_notes(spark, sf_dir)
    return strategies.check("incremental", notes, _reply_checker(sections.fixed_sections(notes)))


@query
def check_incremental_first(spark, sf_dir):
    notes = _md_notes(spark, sf_dir)
    return strategies.check(
        "incremental", notes, _reply_checker(sections.fixed_sections(notes)), only_section=0
    )


@query
def check_auto_replies(spark, sf_dir):
    notes = _md_notes(spark, sf_dir)
    return strategies.check("auto", notes, _reply_checker(sections.sample_section(notes)))


@query
def check_full_lint(spark, sf_dir):
    return strategies.check("full", _md_notes(spark, sf_dir), strategies.from_lint)


@query
def auto_verdicts(spark, sf_dir):
    return strategies.auto_verdict(_md_notes(spark, sf_dir), strategies.from_lint)


@query
def mode_suggestions(spark, sf_dir):
    return strategies.switch_suggestions(auto_verdicts(spark, sf_dir))


@query
def request_estimate(spark, sf_dir):
    notes = _md_notes(spark, sf_dir)
    return notes.select(
        "path",
        *[
            strategies.estimated_requests(mode, F.length("content")).cast("long").alias(f"n_{mode}")
            for mode in strategies.CHECKS
        ],
    )


# --- text functions ----------------------------------------------------------------------------------------


@query
def text_hashes(spark, sf_dir):
    return derived.notes(spark, sf_dir).select("path", t.text_hash(F.col("content")).alias("hash"))


@query
def compat_cache_keys(spark, sf_dir):
    files = derived.files(spark, sf_dir)
    anchor = _anchor_path(files)
    chunk_no = themes.chunk_members(inventory.markdown(files)).select("path", "chunk_no")
    return (
        _md_notes(spark, sf_dir)
        .join(chunk_no, "path")
        .select(
            "path",
            t.spell_key(F.col("lang"), F.col("content"), "standard").alias("spell_key"),
            t.link_key(anchor, F.col("path")).alias("link_key"),
            t.theme_chunk_key(F.col("chunk_no")).alias("theme_key"),
        )
    )


def _parsed_replies(spark, sf_dir):
    """Notes with the parsed reply of their document."""
    parsed = replies.parse_findings(derived.model_replies(spark, sf_dir)).select(
        "doc_id", "parse_ok", "corrections", "issues"
    )
    return derived.notes(spark, sf_dir).join(parsed, "doc_id").where("parse_ok")


@query
def apply_single(spark, sf_dir):
    return _parsed_replies(spark, sf_dir).select(
        "path",
        F.posexplode(_listed("corrections")).alias("pos", "c"),
        "content",
    ).select(
        "path", _long("pos"), findings.apply_one(F.col("content"), F.col("c.original"), F.col("c.suggested")).alias("content")
    )


@query
def apply_corrections(spark, sf_dir):
    return _parsed_replies(spark, sf_dir).select(
        "path", findings.apply_corrections(F.col("content"), F.col("corrections")).alias("content")
    )


@query
def apply_fixes(spark, sf_dir):
    return _parsed_replies(spark, sf_dir).select(
        "path", findings.apply_fixes(F.col("content"), F.col("issues")).alias("content")
    )


@query
def highlighted_lines(spark, sf_dir):
    """Each correction shown in the line that it names; a line that the note doesn't have is null."""
    lines = F.split("content", "\n", -1)
    return (
        _parsed_replies(spark, sf_dir)
        .select("path", lines.alias("lines"), F.explode(_listed("corrections")).alias("c"))
        .select(
            "path",
            t.highlight(F.get("lines", (F.col("c.line") - 1).cast("int")), F.col("c.original")).alias("marked"),
            t.percent(F.col("c.confidence")).alias("confidence_percent"),
        )
    )


@query
def file_sizes(spark, sf_dir):
    return derived.notes(spark, sf_dir).select("path", t.file_size(F.octet_length("content")).alias("size"))


@query
def entry_ages(spark, sf_dir):
    ms = F.floor(cache.age_us(F.col("ts"), _now("2024-02-01 00:00:00")) / 1000).cast("long")
    return derived.cache_log(spark, sf_dir).select("event_id", t.duration(ms).alias("age"))


@query
def derived_paths(spark, sf_dir):
    return inventory.markdown(derived.files(spark, sf_dir)).select(
        "path",
        t.derived_path(F.col("path"), F.col("basename"), "corrected").alias("corrected_path"),
        t.derived_path(F.col("path"), F.col("basename"), "enhanced").alias("enhanced_path"),
        t.wiki_link(F.col("path")).alias("link_text"),
    )


@query
def trimmed_notes(spark, sf_dir):
    return derived.notes(spark, sf_dir).select(
        "path", t.trim(F.concat(F.lit("  \n﻿"), "content", F.lit(" \t\n"))).alias("content")
    )


# --- requests ----------------------------------------------------------------------------------------------


@query
def check_requests(spark, sf_dir):
    cut = sections.full_sections(_md_notes(spark, sf_dir), keep=("lang",))
    return requests.check_requests(cut, F.col("lang")).select("path", _long("section_no"), "key", "truncated", "body")


def check_templates(spark: SparkSession) -> DataFrame:
    """The prompt variants as a table, with wording of their own for two languages."""
    rows = [("*", name, text) for name, text in requests.CHECK_TEMPLATES.items()]
    rows += [("*", "short", "Spelling of {language}: JSON only."), ("de", "short", "Nur JSON."), ("fr", "standard", "JSON seulement ({language}).")]
    return spark.createDataFrame(rows, "language string, variant string, template string")


@query
def template_requests(spark, sf_dir):
    """Requests of three prompt variants in one run, worded by a table of templates."""
    variant = F.get(F.array(*map(F.lit, ("standard", "superprompt", "short"))), (F.col("doc_id") % 3).cast("int"))
    asked = flows.check_keys(_md_notes(spark, sf_dir), language=F.col("lang"), variant=variant, templates=check_templates(spark))
    return asked.select("path", _long("section_no"), "key", "body")


@query
def theme_requests(spark, sf_dir):
    return requests.theme_requests(themes.name_chunks(_members(spark, sf_dir)))


@query
def link_requests(spark, sf_dir):
    notes = derived.notes(spark, sf_dir)
    anchor_path = _anchor_path(derived.files(spark, sf_dir))
    candidates = inventory.link_candidates(notes, anchor_path, "all")
    return requests.link_requests(notes.where(F.col("path") == anchor_path), candidates)


@query
def rewrite_requests(spark, sf_dir):
    notes = _md_notes(spark, sf_dir)
    parts = [
        requests.rewrite_requests(
            sections.rewrite_sections(notes, trimmed=kind == "correct", keep=("lang",)), kind, F.col("lang")
        )
        for kind in ("correct", "enhance")
    ]
    return parts[0].unionByName(parts[1]).select("path", _long("section_no"), "key", "body")


# --- replies -----------------------------------------------------------------------------------------------


@query
def cleaned_replies(spark, sf_dir):
    text = replies.strip_reasoning(F.col("raw_reply"))
    return derived.model_replies(spark, sf_dir).select(
        "request_key",
        text.alias("without_reasoning"),
        replies.strip_fences(F.col("raw_reply")).alias("unfenced"),
        replies.strip_fences(F.col("raw_reply"), compat=True).alias("fences_dropped"),
        replies.widest_object(text).alias("object"),
    )


@query
def parsed_corrections(spark, sf_dir):
    return (
        replies.parse_findings(derived.model_replies(spark, sf_dir))
        .select("request_key", F.posexplode(_listed("corrections")).alias("pos", "c"))
        .select("request_key", _long("pos"), "c.*")
    )


@query
def parsed_issues(spark, sf_dir):
    return (
        replies.parse_findings(derived.model_replies(spark, sf_dir))
        .select("request_key", F.posexplode(_listed("issues")).alias("pos", "i"))
        .select(
            "request_key",
            _long("pos"),
            "i.issue",
            "i.line",
            "i.suggestion",
            "i.fixable",
            F.col("i.originalText").alias("original_text"),
            F.col("i.suggestedText").alias("suggested_text"),
        )
    )


@query
def reply_status(spark, sf_dir):
    return replies.parse_findings(derived.model_replies(spark, sf_dir)).select("request_key", "parse_ok")


def _link_suggestions(spark, sf_dir):
    target = derived.notes(spark, sf_dir).select(
        (F.col("doc_id") + 1).alias("doc_id"), "path", "basename", F.substring("content", 1, 200).alias("preview")
    )
    return replies.parse_links(derived.link_replies(spark, sf_dir).join(target, "doc_id"))


@query
def parsed_links(spark, sf_dir):
    return _link_suggestions(spark, sf_dir).select(
        "request_key",
        "path",
        "title",
        "relevance",
        t.percent(F.col("relevance")).alias("relevance_percent"),
        "connection_type",
        "reasoning",
        F.array_join("common_themes", ", ").alias("common_themes"),
        "content_preview",
    )


@query
def best_reply_links(spark, sf_dir):
    return links.best(_link_suggestions(spark, sf_dir)).select("path", "title", "relevance", "connection_type")


@query
def fixable_issues(spark, sf_dir):
    return (
        replies.parse_findings(derived.model_replies(spark, sf_dir))
        .select("request_key", F.explode(findings.fixable(F.col("issues"))).alias("i"))
        .select("request_key", F.col("i.originalText").alias("original_text"), F.col("i.suggestedText").alias("suggested_text"))
    )


@query
def kept_corrections(spark, sf_dir):
    return parsed_corrections(spark, sf_dir).where(
        spelling.keep(F.col("original"), F.col("suggested"), F.col("confidence"))
    ).select("request_key", "original", "suggested", "confidence")


@query
def findings_counts(spark, sf_dir):
    notes = _md_notes(spark, sf_dir)
    cut = sections.full_sections(notes)
    checked = _reply_checker(cut)(cut)
    return findings.counts(findings.merge(checked))


@query
def findings_merged(spark, sf_dir):
    notes = _md_notes(spark, sf_dir)
    merged = findings.merge(strategies.from_lint(sections.full_sections(notes)))
    return merged.select("path", F.posexplode(_listed("issues")).alias("pos", "i")).select(
        "path", _long("pos"), "i.rule", F.col("i.line").alias("section_line")
    )


@query
def corrected_notes(spark, sf_dir):
    notes = derived.notes(spark, sf_dir)
    raw = derived.rewrite_replies(sections.rewrite_sections(inventory.markdown(notes), trimmed=True))
    return flows.rewrite(notes, raw, "correct")


@query
def enhanced_notes(spark, sf_dir):
    notes = derived.notes(spark, sf_dir)
    raw = derived.rewrite_replies(sections.rewrite_sections(inventory.markdown(notes), trimmed=False))
    return flows.rewrite(notes, raw, "enhance")


@query
def applied_findings(spark, sf_dir):
    """All findings of all sections, back in the note."""
    notes = _md_notes(spark, sf_dir)
    cut = sections.full_sections(notes)
    return flows.apply_findings(notes, _reply_checker(cut)(cut))


# --- cached flows: a third of the answers is cached, a third has expired, a third arrives now --------------


def _aged_checks(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    cut = sections.full_sections(notes, keep=("lang",))
    return derived.aged(derived.section_replies(cut, F.col("lang")), _now(CACHED_NOW))


@query
def check_full_cached(spark, sf_dir):
    notes = _md_notes(spark, sf_dir)
    cached, new = _aged_checks(notes)
    return flows.check_cached(notes, cached, _now(CACHED_NOW), new, language=F.col("lang"))


@query
def pending_checks(spark, sf_dir):
    notes = _md_notes(spark, sf_dir)
    open_work = flows.pending_checks(notes, _aged_checks(notes)[0], _now(CACHED_NOW), language=F.col("lang"))
    return open_work.select("key", "path")


def _mode_of_note() -> Column:
    return F.get(F.array(*map(F.lit, strategies.CHECKS)), (F.col("doc_id") % 3).cast("int"))


@query
def check_mixed(spark, sf_dir):
    """Each note in its own mode, with lint findings."""
    return strategies.check_mixed(_md_notes(spark, sf_dir), _mode_of_note(), strategies.from_lint)


@query
def corrected_cached(spark, sf_dir):
    notes = derived.notes(spark, sf_dir)
    cut = sections.rewrite_sections(inventory.markdown(notes), trimmed=True, keep=("lang",))
    key = requests.rewrite_key("correct", F.col("section"), F.col("lang")).alias("key")
    answers = derived.rewrite_replies(cut, key, (F.length("section") % 3).alias("third")).groupBy("key")
    answers = answers.agg(F.min("raw_reply").alias("raw_reply"), F.min("third").alias("third"))
    cached, new = derived.aged(answers, _now(CACHED_NOW))
    return flows.rewrite_cached(notes, "correct", cached, _now(CACHED_NOW), new, F.col("lang"))


@query
def links_cached(spark, sf_dir):
    """Best partners of one note from judgements that are cached, expired or new."""
    notes = derived.notes(spark, sf_dir)
    anchor_path = _anchor_path(derived.files(spark, sf_dir))
    anchor, candidates = notes.where(F.col("path") == anchor_path), inventory.link_candidates(notes, anchor_path, "all")
    third = (derived.path_code(F.col("path")) % 3).alias("third")
    asked = requests.link_requests(anchor, candidates)
    cached, new = derived.aged(asked.select("key", derived.link_judgement(F.col("path")).alias("raw_reply"), third), _now(CACHED_NOW))
    return flows.links_cached(anchor, candidates, cached, _now(CACHED_NOW), new).select("path", "title", "relevance", "connection_type")


@query
def themes_cached(spark, sf_dir):
    chunks = themes.name_chunks(_members(spark, sf_dir))
    answers = derived.theme_replies(chunks).join(requests.theme_requests(chunks).select("chunk_no", "key"), "chunk_no")
    cached, new = derived.aged(answers.withColumn("third", F.col("chunk_no") % 3), _now(CACHED_NOW))
    found = flows.themes_cached(chunks, cached, _now(CACHED_NOW), new)
    return found.select("theme", "chunk_no", _long("pos"))


# --- cache -------------------------------------------------------------------------------------------------


def _cache(spark, sf_dir):
    return cache.latest_sets(derived.cache_log(spark, sf_dir))


@query
def cache_lookup(spark, sf_dir):
    asked = derived.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.concat(F.lit("spell:en:"), F.col("o_custkey").cast("string"), F.lit(":standard")).alias("key"),
    )
    return cache.look_up(asked, _cache(spark, sf_dir), _now(CACHE_NOW), ["request_id"]).select(
        "request_id", "key", "status", "value"
    )


@query
def cache_replay(spark, sf_dir):
    return cache.replay(derived.cache_log(spark, sf_dir))


@query
def cache_upsert(spark, sf_dir):
    sets = derived.cache_log(spark, sf_dir).where("op = 'set'").select("key", "ts", "event_id", "ttl_ms", "value")
    old = cache.upsert(sets.limit(0), sets.where(F.col("ts") < _now("2024-01-15")), ("ts", "event_id"))
    return cache.upsert(old, sets.where(F.col("ts") >= _now("2024-01-15")), ("ts", "event_id")).select(
        "key", "event_id", "ttl_ms", "value"
    )


@query
def cache_invalidate(spark, sf_dir):
    return cache.invalidate(_cache(spark, sf_dir), "^spell:en:1[0-9]*:").select("key", "value")


@query
def cache_purge(spark, sf_dir):
    return cache.purge(_cache(spark, sf_dir), _now(CACHE_NOW)).select("key", "value")


@query
def cache_stats(spark, sf_dir):
    return cache.stats(_cache(spark, sf_dir))


@query
def cache_key_list(spark, sf_dir):
    return cache.keys(_cache(spark, sf_dir))


@query
def cache_store(spark, sf_dir):
    return cache.to_store(_cache(spark, sf_dir))


@query
def cache_reload(spark, sf_dir):
    log = derived.cache_log(spark, sf_dir).select(F.col("event_id").cast("string").alias("key"), "ts", "ttl_ms", "value")
    props = derived.table(spark, sf_dir, "events").select(
        F.concat(F.lit("bad"), F.col("event_id").cast("string")).alias("key"), F.col("props").alias("entry")
    )
    return cache.from_store(cache.to_store(log).unionByName(props)).select("key", "value", "ttl_ms")


def _saved_store(spark, sf_dir) -> str:
    """A store of a cache log in the shared checkpoint folder, saved twice and compacted in between."""
    ensure_checkpoint_dir(spark)
    target = f"{spark.sparkContext.getCheckpointDir()}/cache-{uuid4().hex}"
    sets = derived.cache_log(spark, sf_dir).where("op = 'set'")
    # The store keeps milliseconds; the number of the event tells which of several within one is the last.
    whole = F.date_trunc("millisecond", "ts").cast("timestamp_ntz")
    entries = cache.upsert(sets.limit(0).select("key", "ts", "event_id", "ttl_ms", "value"), sets.select("key", "ts", "event_id", "ttl_ms", "value"), ("ts", "event_id"))
    early, late = sets.where(F.col("ts") < _now("2024-01-15")), entries.where(F.col("ts") >= _now("2024-01-15"))
    early = cache.upsert(early.limit(0).select("key", "ts", "event_id", "ttl_ms", "value"), early.select("key", "ts", "event_id", "ttl_ms", "value"), ("ts", "event_id"))
    store.save(early.withColumn("ts", whole), target)
    store.save(late.withColumn("ts", whole), target)
    store.compact(spark, target)
    return target


@query
def cache_saved_twice(spark, sf_dir):
    """A store after two saves and a compaction, read again."""
    return store.load(spark, _saved_store(spark, sf_dir)).select("key", "value", "ttl_ms")


@query
def cache_store_lookup(spark, sf_dir):
    """``cache_lookup`` against the store on disk."""
    asked = derived.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.concat(F.lit("spell:en:"), F.col("o_custkey").cast("string"), F.lit(":standard")).alias("key"),
    )
    found = store.look_up(asked, _saved_store(spark, sf_dir), _now(CACHE_NOW), ["request_id"])
    return found.select("request_id", "key", "status", "value")


@query
def pending_requests(spark, sf_dir):
    notes = _md_notes(spark, sf_dir).select("path", derived.section_key(F.col("content")).alias("key"))
    return cache.pending(notes, derived.reply_cache(spark, sf_dir), _now(PENDING_NOW))


# --- deterministic judgements ------------------------------------------------------------------------------


@query
def protected_mask(spark, sf_dir):
    pages = derived.table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").alias("content"))
    notes = derived.notes(spark, sf_dir).select("path", "content")
    return notes.unionByName(pages).select("path", md.mask(F.col("content")).alias("masked"))


@query
def lexicon(spark, sf_dir):
    return spelling.lexicon(_md_notes(spark, sf_dir)).select("lang", "word", "n", "n_notes", "several")


@query
def suspect_words(spark, sf_dir):
    return spelling.suspects(spelling.lexicon(_md_notes(spark, sf_dir))).select("lang", "word")


@query
def spell_candidates(spark, sf_dir):
    notes = _md_notes(spark, sf_dir)
    return spelling.candidates(spelling.lexicon(notes), notes)


@query
def spell_candidates_two(spark, sf_dir):
    notes = _md_notes(spark, sf_dir)
    return spelling.candidates_within_two(spelling.lexicon(notes), notes)


@query
def spell_contexts(spark, sf_dir):
    notes = _md_notes(spark, sf_dir)
    found = spell_candidates(spark, sf_dir)
    return spelling.with_context(found, notes)


@query
def lint_findings(spark, sf_dir):
    return (
        _md_notes(spark, sf_dir)
        .select("path", F.inline(md.lint(F.col("content"))))
        .select("path", "line", "rule", "fixable")
    )


@query
def safe_fixes(spark, sf_dir):
    return flows.fix_notes(derived.notes(spark, sf_dir))


@query
def lint_applied(spark, sf_dir):
    return flows.apply_lint(derived.notes(spark, sf_dir))


@query
def smart_links_current(spark, sf_dir):
    notes = derived.notes(spark, sf_dir)
    return flows.smart_links(notes, _near_path(derived.files(spark, sf_dir)), "current")


@query
def smart_links_anchor(spark, sf_dir):
    notes = derived.notes(spark, sf_dir)
    return flows.smart_links(notes, _anchor_path(derived.files(spark, sf_dir)), "all")


@query
def anchor_relevance(spark, sf_dir):
    notes, anchor = _md_notes(spark, sf_dir), _anchor_path(derived.files(spark, sf_dir))
    return links.anchor_relevance(links.term_weights(notes), anchor)


@query
def smart_links_many(spark, sf_dir):
    """Best partners of every fiftieth note among all notes."""
    return link_index.many_links(_md_notes(spark, sf_dir), F.col("doc_id") % 50 == 0)


@query
def note_themes(spark, sf_dir):
    return links.themes_of(_md_notes(spark, sf_dir)).select("path", _long("pos"), "theme")


@query
def theme_partners(spark, sf_dir):
    return flows.theme_partners(derived.notes(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query
def embedding_links(spark, sf_dir):
    vectors = derived.table(spark, sf_dir, "embeddings")
    anchor = vectors.agg(F.min("vec_id")).scalar()
    return links.vector_links(vectors, anchor).select("vec_id", _long("label"), "similarity")


@query
def vector_links_many(spark, sf_dir):
    """The 20 nearest vectors of every fiftieth one, through the cell index over all."""
    return vector_index.nearest(derived.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def snapshot_updated(spark, sf_dir):
    """A written vault whose every two hundredth note was fixed in place, read again."""
    ensure_checkpoint_dir(spark)
    target = f"{spark.sparkContext.getCheckpointDir()}/vault-{uuid4().hex}"
    vault = derived.notes(spark, sf_dir).select("doc_id", "path", "content")
    write_snapshot(vault, target, SNAPSHOT_PARTS)
    chosen = read_snapshot(spark, target).where((F.col("doc_id") % 200 == 0) & F.endswith("path", F.lit(".md")))
    update_snapshot(chosen.select("path", md.safe_fix(F.col("content")).alias("content")), target, SNAPSHOT_PARTS)
    return read_snapshot(spark, target).select("path", "content")
