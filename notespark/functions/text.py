"""Scalar text functions.

Lengths and positions are code points. They agree with UTF-16 units for every character of the Basic
Multilingual Plane; only ``text_hash`` goes further and hashes the surrogate pair of anything above it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters an ECMAScript ``trim`` removes.
SCRIPT_SPACE = (
    "\t\n\x0b\x0c\r   "
    "           "
    "    　﻿"
)
# Letters plus the Arabic vowel marks, which belong to the word they sit on.
WORD = r"[\p{L}\x{064B}-\x{0652}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` (keeps costly expressions from repeating)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(text: Column) -> Column:
    """Strip all Unicode white space including line ends; SQL ``trim`` alone strips blanks only."""
    return F.btrim(text, F.lit(SCRIPT_SPACE))


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_count(text: Column) -> Column:
    return newlines(text) + 1


def default_to(value: Column, default: Column) -> Column:
    """Null and empty text both fall back."""
    return F.coalesce(F.nullif(value, F.lit("")), default)


def text_hash(text: Column) -> Column:
    """32-bit polynomial hash (base 31) of the UTF-16 units, absolute value in base 36.

    Kept for keys of existing caches. It collides and is folded character by character, so new keys use
    ``content_key`` instead.
    """

    def step(h: Column, ch: Column) -> Column:
        return (h * 31 + F.ascii(ch)).bitwiseAND(F.lit(0xFFFFFFFF))

    def step_with_surrogates(h: Column, ch: Column) -> Column:
        c = F.ascii(ch).cast("long")
        high = F.shiftright(c - 0x10000, 10) + 0xD800
        low = (c - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00
        return (
            F.when(c > 0xFFFF, (h * 31 + high) * 31 + low).otherwise(h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF))
        )

    def signed_abs(h: Column) -> Column:
        return F.when(h >= 0x80000000, F.lit(0x100000000) - h).otherwise(h)

    chars, zero = F.split(text, ""), F.lit(0).cast("long")
    folded = F.when(
        text.rlike(r"[\x{10000}-\x{10FFFF}]"), F.aggregate(chars, zero, step_with_surrogates, signed_abs)
    ).otherwise(F.aggregate(chars, zero, step, signed_abs))
    return F.lower(F.conv(folded.cast("string"), 10, 36))


def content_key(text: Column) -> Column:
    """Collision-safe content hash for native cache keys."""
    return F.sha2(text, 256)


# The prefixes of the cache keys below.


def spell_key(language: Column, text: Column, variant: str) -> Column:
    return F.concat_ws(":", F.lit("spell"), language, text_hash(text), F.lit(variant))


def native_spell_key(language: Column, text: Column, variant: str | Column, model: str) -> Column:
    variant = F.lit(variant) if isinstance(variant, str) else variant
    return F.concat_ws(":", F.lit("spell"), language, F.lit(model), variant, content_key(text))


def link_key(anchor_path: Column, path: Column) -> Column:
    return F.concat_ws(":", F.lit("smart-link"), anchor_path, path)


def theme_chunk_key(chunk_no: Column) -> Column:
    return F.concat(F.lit("vault-analysis-chunk-"), chunk_no.cast("string"))


def replace_all(text: Column, original: Column, suggested: Column) -> Column:
    """Literal, case-sensitive; ``$`` in the replacement stays as written. Empty ``original`` changes nothing."""
    return F.replace(text, original, suggested)


def apply_pairs(text: Column, pairs: Column, original: str, suggested: str) -> Column:
    """Fold an ordered array of replacements over the text; later ones see what earlier ones produced."""
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p[original], p[suggested]))


def quote_literal(text: Column) -> Column:
    """Escape a literal for use inside a regular expression."""
    return F.regexp_replace(text, r"([\\.*+?^${}()|\[\]])", r"\\$1")


def highlight(context: Column, original: Column) -> Column:
    # Fixed value: the tag around an error.
    marked = F.regexp_replace(
        context,
        F.concat(F.lit("(?iu)("), quote_literal(original), F.lit(")")),
        F.lit('<mark class="error-highlight">$1</mark>'),
    )
    return F.when(F.length(original) > 0, marked).otherwise(context)


def first_chars(text: Column, n: int | None) -> Column:
    """The first ``n`` characters, or the whole text if ``n`` is None."""
    return text if n is None else F.substring(text, 1, n)


def percent(ratio: Column) -> Column:
    return F.floor(ratio * 100 + 0.5).cast("long")


def file_size(n_bytes: Column) -> Column:
    """Base 1024, at most two decimals, no trailing zeros; units stop at GB."""
    n = n_bytes.cast("long")

    def shown(unit_bytes: int, unit: str) -> Column:
        hundredths = F.floor((n * 200 + unit_bytes) / F.lit(2 * unit_bytes))
        return let(
            hundredths,
            lambda h: F.concat(
                F.floor(h / 100).cast("string"),
                F.when(h % 100 == 0, "")
                .when(h % 10 == 0, F.concat(F.lit("."), F.floor(h % 100 / 10).cast("string")))
                .otherwise(F.concat(F.lit("."), F.lpad((h % 100).cast("string"), 2, "0"))),
                F.lit(" " + unit),
            ),
        )

    return (
        F.when(n == 0, "0 Bytes")
        .when(n < 1024, shown(1, "Bytes"))
        .when(n < 1024**2, shown(1024, "KB"))
        .when(n < 1024**3, shown(1024**2, "MB"))
        .otherwise(shown(1024**3, "GB"))
    )


def duration(ms: Column) -> Column:
    seconds = F.floor(ms / 1000).cast("long")
    minutes = F.floor(seconds / 60).cast("long")
    hours = F.floor(minutes / 60).cast("long")
    return (
        F.when(hours > 0, F.format_string("%dh %dm", hours, minutes % 60))
        .when(minutes > 0, F.format_string("%dm %ds", minutes, seconds % 60))
        .otherwise(F.format_string("%ds", seconds))
    )


def derived_path(path: Column, basename: Column, suffix: str) -> Column:
    """``folder/name.md`` to ``folder/name-<suffix>.md``."""
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(basename) - 3)
    return F.concat(folder, basename, F.lit(f"-{suffix}.md"))


def wiki_link(path: Column) -> Column:
    return F.concat(F.lit("[["), path, F.lit("]]"))


def words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def run_lengths(items: Column) -> Column:
    """Array of comparable values to ``array<struct<item, n>>``, sorted by item, inside the row.

    Counting inside the row keeps the shuffle that follows at one record per distinct word of a note.
    """

    def counted(s: Column) -> Column:
        starts = F.filter(
            F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda p, k: F.struct(
                    F.get(s, p).alias("item"),
                    (F.coalesce(F.get(st, k + 1), F.size(s)) - p).cast("long").alias("n"),
                ),
            ),
        )

    return let(F.sort_array(items), counted)
