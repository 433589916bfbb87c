"""Model replies (raw text) to typed rows. All of it is per-row and malformed input never fails the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notespark import params
from notespark.functions.text import default_to, let, trim

_LINK = (
    "shouldLink string, relevance string, connectionType string, reasoning string, "
    "commonThemes array<string>, contentPreview string"
)
_FALSY = ("", "0", "false")


def strip_reasoning(reply: Column) -> Column:
    """What follows the last ``</think>``. A lazy regular expression would rescan a long reply from every position."""
    return F.substring_index(reply, "</think>", -1)


def strip_fences(reply: Column, compat: bool = False) -> Column:
    """``compat`` deletes fenced blocks with their content; otherwise only the fence marks go."""
    if compat:
        return F.regexp_replace(reply, r"(?s)```.*?```", "")
    return F.regexp_replace(reply, r"(?s)```[A-Za-z]*\n?(.*?)```", "$1")


def widest_object(reply: Column) -> Column:
    return F.regexp_extract(reply, r"(?s)\{.*\}", 0)


def widest_array(reply: Column) -> Column:
    return F.regexp_extract(reply, r"(?s)\[.*\]", 0)


def _truthy(text: Column) -> Column:
    return F.coalesce(~text.isin(*_FALSY), F.lit(False))


def _field(value: Column, name: str, kind: str = "string") -> Column:
    """A field of a variant; null where it is missing or of another kind, whatever its neighbours are."""
    return F.try_variant_get(value, f"$.{name}", kind)


def _listable(reply: Column, name: str) -> Column:
    """A list, or nothing at all: any other value is a malformed reply."""
    kind = F.schema_of_variant(_field(reply, name, "variant"))
    return kind.isNull() | (kind == "VOID") | F.startswith(kind, F.lit("ARRAY")) | _field(reply, name).isin(*_FALSY)


def _number(text: Column) -> Column:
    return text.try_cast("double")


def _findings(obj: Column) -> Column:
    """The reply is parsed once; lists are read element by element, so a malformed one doesn't void the others."""

    def read(reply: Column) -> Column:
        ok = reply.isNotNull() & (F.schema_of_variant(reply) != "VOID")
        ok = ok & _listable(reply, "corrections") & _listable(reply, "formattingIssues")
        lists = [_field(reply, name, "array<variant>").alias(name) for name in ("corrections", "formattingIssues")]
        return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.struct(*lists).alias("f"))

    return let(F.try_parse_json(obj), read)


def _kept_corrections(raw: Column) -> Column:
    return F.filter(
        F.transform(
            raw,
            lambda c: F.struct(
                _field(c, "original").alias("original"),
                _field(c, "suggested").alias("suggested"),
                _number(_field(c, "line")).cast("long").alias("line"),
                _number(_field(c, "confidence")).alias("confidence"),
                default_to(_field(c, "context"), F.lit(params.NO_CONTEXT)).alias("context"),
            ),
        ),
        lambda c: F.coalesce((c["original"] != "") & (c["suggested"] != ""), F.lit(False)),
    )


def _kept_issues(raw: Column) -> Column:
    return F.filter(
        F.transform(
            raw,
            lambda i: F.struct(
                _field(i, "issue").alias("issue"),
                _number(_field(i, "line")).cast("long").alias("line"),
                _field(i, "suggestion").alias("suggestion"),
                _truthy(_field(i, "fixable")).alias("fixable"),
                default_to(_field(i, "originalText"), F.lit(params.NO_ORIGINAL)).alias("originalText"),
                default_to(_field(i, "suggestedText"), F.lit(params.NO_SUGGESTED)).alias("suggestedText"),
            ),
        ),
        lambda i: F.coalesce(i["issue"] != "", F.lit(False)),
    )


def parse_findings(replies: DataFrame, raw: str = "raw_reply") -> DataFrame:
    """Add ``parse_ok``, ``corrections`` and ``issues``.

    A missing list is empty, missing texts get their placeholders, corrections need both texts and issues
    need a title. An unreadable reply gives ``parse_ok = false`` and null lists.
    """
    parsed = let(
        strip_reasoning(F.col(raw)), lambda text: let(default_to(widest_object(text), text), _findings)
    )
    ok, f = F.col("_p.ok"), F.col("_p.f")
    return (
        replies.withColumn("_p", parsed)
        .withColumn("parse_ok", F.coalesce(ok, F.lit(False)))
        .withColumn("corrections", F.when(ok, F.coalesce(_kept_corrections(f["corrections"]), F.array())))
        .withColumn("issues", F.when(ok, F.coalesce(_kept_issues(f["formattingIssues"]), F.array())))
        .drop("_p")
    )


def parse_themes(replies: DataFrame, raw: str = "raw_reply", compat: bool = False) -> DataFrame:
    """Add ``themes``: the widest ``[...]`` read as a list of text; nothing readable is an empty list."""
    arr = widest_array(strip_fences(F.col(raw), compat))
    return replies.withColumn("themes", F.coalesce(F.from_json(arr, "array<string>"), F.array().cast("array<string>")))


def parse_links(
    replies: DataFrame,
    raw: str = "raw_reply",
    min_relevance: float = params.MIN_RELEVANCE,
    compat: bool = False,
) -> DataFrame:
    """Replies on (anchor, target) pairs to suggestions; a refusal or unreadable reply gives no row.

    Needs the target's ``basename``, ``path`` and ``preview``.
    """
    obj = widest_object(strip_reasoning(strip_fences(F.col(raw), compat)))
    link = replies.withColumn("_l", F.from_json(obj, _LINK))
    return (
        link.withColumn("relevance", _number(F.col("_l.relevance")))
        .where(_truthy(F.col("_l.shouldLink")) & (F.col("relevance") > min_relevance))
        .withColumn("title", F.col("basename"))
        .withColumn("connection_type", F.col("_l.connectionType"))
        .withColumn("reasoning", F.col("_l.reasoning"))
        .withColumn("common_themes", F.coalesce("_l.commonThemes", F.array().cast("array<string>")))
        .withColumn("content_preview", default_to(F.col("_l.contentPreview"), F.col("preview")))
        .drop("_l", "preview", "basename", raw)
    )


def accept_corrected(raw: Column, original: Column, more_than: int = params.MIN_ACCEPTED_CORRECTION_CHARS) -> Column:
    """Corrected text counts only when more than ``more_than`` characters remain after cleaning."""
    clean = trim(strip_fences(strip_reasoning(trim(raw)), compat=True))
    return F.when(F.length(clean) > more_than, clean).otherwise(original)


def accept_enhanced(raw: Column, original: Column) -> Column:
    """Enhanced text counts only when it starts with a heading mark; it is not trimmed again."""
    clean = strip_fences(strip_reasoning(trim(raw)), compat=True)
    return F.when(F.startswith(clean, F.lit("#")), clean).otherwise(original)
