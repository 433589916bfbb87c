"""Request rows for an external batch-inference job; replies come back as a table joined on ``request_key``.

The instruction texts are this package's own short wording of the reply contract that ``replies`` reads.
Pass ``template`` to send others; ``{language}`` is filled in per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notespark import params
from notespark.functions.text import first_chars, native_spell_key
from notespark.operators.skew import lookup

# The shape and names of replies, and the connection types.
_FINDINGS_SHAPE = (
    '{"corrections":[{"original":"","suggested":"","line":1,"confidence":0.0,"context":""}],'
    '"formattingIssues":[{"issue":"","line":1,"suggestion":"","fixable":true,"originalText":"","suggestedText":""}]}'
)
CHECK_TEMPLATES = {
    "standard": (
        "Check the {language} text for spelling and formatting errors. Leave names, terms, links and code alone. "
        "Count lines from 1. Answer with JSON only, empty lists if nothing is wrong: " + _FINDINGS_SHAPE
    ),
    "superprompt": (
        "Check the {language} text line by line. Report an error only with confidence of 0.75 or more; skip names "
        "written with a capital, terms that occur more than once, links, URLs, block ids and code. "
        "Answer with JSON only: " + _FINDINGS_SHAPE
    ),
}
ARABIC_CLAUSE = " Never add, drop or change Arabic vowel marks."
THEME_TEMPLATE = "Name the themes of these note titles. Answer with a JSON array of short texts only."
# Reply names and connection types in it are fixed values too.
LINK_TEMPLATE = (
    "Should the two notes be linked? Answer with JSON only: "
    '{"shouldLink":true,"relevance":0.0,"connectionType":"conceptual|sequential|complementary|reference",'
    '"reasoning":"","commonThemes":[""],"contentPreview":""}'
)
CORRECT_TEMPLATE = (
    "Correct spelling and grammar of the {language} markdown. Change nothing else; keep links, code, math, tables, "
    "front matter and line breaks. Answer with the text only."
)
ENHANCE_TEMPLATE = (
    "Improve clarity and structure of the {language} markdown without changing facts, links or code. "
    "Answer with the markdown only, starting with its heading."
)
# The user part of each request.
CHECK_USER = "Check: "
THEME_USER = "Analyze these files and identify themes:\n"
CORRECT_USER = (
    "Apply ONLY spelling and formatting corrections to this content (keep everything else exactly the same):\n\n"
)
ENHANCE_USER = "Enhance this content:\n\n"
LINK_FILE_A = "Compare these files:\n\nFile A ("
LINK_FILE_B = "\n\nFile B ("
LINK_TEXT = "):\n"


def _system(template: str | Column, language: Column | None = None) -> Column:
    template = F.lit(template) if isinstance(template, str) else template
    if language is None:
        return template
    text = F.replace(template, F.lit("{language}"), language)
    return F.concat(text, F.when(language == "ar", ARABIC_CLAUSE).otherwise(""))


def body(
    kind: str, model: str, system: Column, user: Column, limits: dict[str, tuple[int, float]] = params.REQUEST_LIMITS
) -> Column:
    """Request body as JSON text; ``limits`` has (max_tokens, temperature) by kind."""
    max_tokens, temperature = limits[kind]
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            F.array(message("system", system), message("user", user)).alias("messages"),
            F.lit(max_tokens).alias("max_tokens"),
            F.lit(temperature).alias("temperature"),
        )
    )


def check_requests(
    sections: DataFrame,
    language: Column | None = None,
    variant: str | Column = params.PROMPT_VARIANT,
    model: str = params.CHECK_MODEL,
    template: str | None = None,
    chars: int | None = params.CHECK_CHARS,
    limits: dict[str, tuple[int, float]] = params.REQUEST_LIMITS,
    templates: DataFrame | None = None,
) -> DataFrame:
    """One request per section: only its first ``chars`` characters are sent (None: all); ``truncated`` says when that cuts.

    The key hashes the whole section and names the model. ``templates`` is a table ``(language, variant, template)``, one row
    for each pair; language ``*`` stands for all that have no row of their own. Each section then gets the template of its
    own language and variant, and one that has none is an error.
    """
    lang = F.lit(params.LANGUAGE) if language is None else language
    user = F.concat(F.lit(CHECK_USER), first_chars(F.col("section"), chars))
    if templates is not None:
        sections = _with_templates(sections, lang, F.lit(variant) if isinstance(variant, str) else variant, templates)
        lang, variant, system = F.col("_language"), F.col("_variant"), F.col("_template")
    elif template is not None:
        system = F.lit(template)
    elif isinstance(variant, str):
        system = F.lit(CHECK_TEMPLATES[variant])
    else:
        missing = F.raise_error(F.concat(F.lit("no template: "), variant)).cast("string")
        system = F.coalesce(*[F.when(variant == name, F.lit(text)) for name, text in CHECK_TEMPLATES.items()], missing)
    return sections.select(
        "path",
        "section_no",
        native_spell_key(lang, F.col("section"), variant, model).alias("key"),
        (F.lit(False) if chars is None else F.length("section") > chars).alias("truncated"),
        body("check", model, _system(system, lang), user, limits).alias("body"),
    )


def _with_templates(sections: DataFrame, language: Column, variant: Column, templates: DataFrame) -> DataFrame:
    """Sections with ``_template``. How the table is joined is left to the engine, by its bytes."""
    own = templates.where("language <> '*'").select(
        F.col("language").alias("_language"), F.col("variant").alias("_variant"), F.col("template").alias("_own")
    )
    general = templates.where("language = '*'").select(F.col("variant").alias("_variant"), F.col("template").alias("_general"))
    keyed = sections.withColumn("_language", language).withColumn("_variant", variant)
    missing = F.raise_error(F.concat_ws(" ", F.lit("no template:"), "_language", "_variant")).cast("string")
    return (
        keyed.join(own, ["_language", "_variant"], "left")
        .join(general, "_variant", "left")
        .withColumn("_template", F.coalesce("_own", "_general", missing))
    )


def theme_requests(chunks: DataFrame, model: str = params.THEME_MODEL, template: str = THEME_TEMPLATE) -> DataFrame:
    """One request per chunk of file names; the native key hashes the names, not the position."""
    return chunks.select(
        "chunk_no",
        F.concat_ws(":", F.lit("themes"), F.lit(model), F.sha2("names", 256)).alias("key"),
        body("themes", model, _system(template), F.concat(F.lit(THEME_USER), F.col("names"))).alias("body"),
    )


def link_requests(
    anchor: DataFrame,
    candidates: DataFrame,
    model: str = params.LINK_MODEL,
    template: str = LINK_TEMPLATE,
    chars: int | None = params.COMPARE_CHARS,
    limits: dict[str, tuple[int, float]] = params.REQUEST_LIMITS,
) -> DataFrame:
    """One request per (anchor, candidate): the first ``chars`` characters of both (None: all).

    The anchor is one row; it enters the plan as one scalar subquery, so there is no join.
    """
    text = first_chars(F.col("content"), chars).alias("text")
    a = anchor.select(F.struct("path", "basename", text, F.sha2("content", 256).alias("sha"))).scalar()
    user = F.concat(
        F.lit(LINK_FILE_A), a["basename"], F.lit(LINK_TEXT), a["text"],
        F.lit(LINK_FILE_B), F.col("basename"), F.lit(LINK_TEXT), text,
    )
    key = F.concat_ws(
        ":", F.lit("smart-link"), F.lit(model), a["sha"], F.sha2("content", 256), a["path"], F.col("path")
    )
    return candidates.select("path", key.alias("key"), body("link", model, _system(template), user, limits).alias("body"))


def rewrite_key(kind: str, section: Column, language: Column | None = None, model: str | None = None) -> Column:
    model = model or {"correct": params.CHECK_MODEL, "enhance": params.ENHANCE_MODEL}[kind]
    lang = F.lit(params.LANGUAGE) if language is None else language
    return F.concat_ws(":", F.lit(kind), lang, F.lit(model), F.sha2(section, 256))


def rewrite_requests(
    sections: DataFrame, kind: str, language: Column | None = None, model: str | None = None, template: str | None = None
) -> DataFrame:
    """``kind`` is ``correct`` or ``enhance``; whole sections are sent."""
    own = {
        "correct": (params.CHECK_MODEL, CORRECT_TEMPLATE, CORRECT_USER),
        "enhance": (params.ENHANCE_MODEL, ENHANCE_TEMPLATE, ENHANCE_USER),
    }
    default_model, default_template, user = own[kind]
    model = model or default_model
    lang = F.lit(params.LANGUAGE) if language is None else language
    return sections.select(
        "path",
        "section_no",
        rewrite_key(kind, F.col("section"), lang, model).alias("key"),
        body(
            kind, model, _system(template or default_template, lang), F.concat(F.lit(user), F.col("section"))
        ).alias("body"),
    )


def attach_replies(requests: DataFrame, replies: DataFrame, spread_by: list[str]) -> DataFrame:
    """Left join on ``key``; replies are unique per key, requests need not be (copied sections share one)."""
    return lookup(requests, replies.select("key", "raw_reply"), ["key"], spread_by, how="left")
