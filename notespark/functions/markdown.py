"""Protected spans, header pieces, packing, fixed-width cuts and lint rules, all inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notespark.functions.text import SCRIPT_SPACE, let, newlines, trim

# Syntax no check may touch. Ordered: at one position the first alternative that matches wins.
FRONT_MATTER = r"\A---\n[\s\S]*?\n---"
FENCE = r"```[\s\S]*?```"
INLINE_CODE = r"`[^`\n]+`"
MATH_BLOCK = r"\$\$[\s\S]*?\$\$"
MATH_INLINE = r"\$[^$\s][^$\n]*\$"
WIKI_LINK = r"!?\[\[[^\]\n]*\]\]"
FOOTNOTE = r"\[\^[^\]\n]+\]:?"
TABLE_ROW = r"(?:\A|\n)\|[^\n]*"
HTML_TAG = r"</?[A-Za-z][^>\n]*>"
BLOCK_ID = r"\s\^[A-Za-z0-9-]+"
URL = r"https?://[^\s)>\]]+"

PROTECTED_BUT_URL = "|".join(
    (FRONT_MATTER, FENCE, INLINE_CODE, MATH_BLOCK, MATH_INLINE, WIKI_LINK, FOOTNOTE, TABLE_ROW, HTML_TAG, BLOCK_ID)
)
PROTECTED = PROTECTED_BUT_URL + "|" + URL

# Every alternative starts with one of these; testing them first skips most positions at once.
_STARTS = r"(?=[`$<\[]|!\[|http|\n\||\s\^|\A[|-])"

HEADER_BREAK = r"\n(?=##? )"


def _rebuild(text: Column, pattern: str, free, kept) -> Column:
    """Text with ``free`` applied between protected spans and ``kept`` to the spans.

    Most texts have no span at all; they are searched once and not split.
    """
    quick = f"{_STARTS}(?:{pattern})"

    def build(spans: Column) -> Column:
        pairs = F.zip_with(
            F.split(text, quick, -1), spans, lambda a, b: F.concat(free(a), kept(F.coalesce(b, F.lit(""))))
        )
        return F.when(F.size(spans) == 0, free(text)).otherwise(F.array_join(pairs, ""))

    return let(F.regexp_extract_all(text, F.lit(quick), F.lit(0)), build)


def mask(text: Column, pattern: str = PROTECTED, fill: str = " ") -> Column:
    """Overwrite protected spans with ``fill``; line ends stay, so lengths and line numbers do not move."""
    return _rebuild(text, pattern, lambda a: a, lambda b: F.regexp_replace(b, r"[^\n]", fill))


def edit_unprotected(text: Column, edit, pattern: str = PROTECTED) -> Column:
    """Apply ``edit`` to the stretches between protected spans only."""
    return _rebuild(text, pattern, edit, lambda b: b)


def safe_fix(text: Column) -> Column:
    """Comma spacing and surplus blank lines; code and other protected spans stay as they are."""
    return edit_unprotected(
        text, lambda part: F.regexp_replace(F.regexp_replace(part, " +,", ","), r"\n{3,}", "\n\n")
    )


def header_pieces(text: Column) -> Column:
    """Cut before every line that starts with one or two ``#`` and a blank."""
    return F.split(text, HEADER_BREAK, -1)


def pack_sections(text: Column, size: int) -> Column:
    """Greedy packing of header pieces into sections of at most ``size`` characters.

    Pieces join with an empty line, a piece longer than ``size`` stays whole, and a text no longer than
    ``size`` is one untrimmed section. Each section carries ``line_map``: for every piece the line it starts
    on inside the section (``packed``) and inside the note (``exact``).
    """

    def starts_of(pieces: Column) -> Column:
        def step(acc: Column, piece: Column) -> Column:
            n = F.length(piece)
            flush = (acc["cur"] > 0) & (acc["cur"] + n > size)
            return F.struct(
                F.when(flush | (acc["cur"] == 0), n).otherwise(acc["cur"] + 2 + n).alias("cur"),
                F.when(flush | (acc["i"] == 0), F.concat(acc["starts"], F.array(acc["i"])))
                .otherwise(acc["starts"])
                .alias("starts"),
                (acc["i"] + 1).alias("i"),
            )

        zero = F.struct(
            F.lit(0).alias("cur"), F.array().cast("array<int>").alias("starts"), F.lit(0).alias("i")
        )
        return F.aggregate(pieces, zero, step, lambda acc: acc["starts"])

    def running_lines(pieces: Column) -> Column:
        """First line of each piece in the note."""
        zero = F.struct(F.array().cast("array<int>").alias("at"), F.lit(1).alias("next"))
        return F.aggregate(
            pieces,
            zero,
            lambda acc, piece: F.struct(
                F.concat(acc["at"], F.array(acc["next"])).alias("at"),
                (acc["next"] + newlines(piece) + 1).alias("next"),
            ),
            lambda acc: acc["at"],
        )

    def build(pieces: Column) -> Column:
        return let(
            F.struct(starts_of(pieces).alias("starts"), running_lines(pieces).alias("at")),
            lambda b: F.transform(b["starts"], lambda s, k: one(pieces, b, s, k)),
        )

    def one(pieces: Column, b: Column, s: Column, k: Column) -> Column:
        until = F.coalesce(F.get(b["starts"], k + 1), F.size(pieces))
        joined = F.array_join(F.slice(pieces, s + 1, until - s), "\n\n")

        def finish(j: Column) -> Column:
            cut_lines = newlines(j) - newlines(F.ltrim(j, F.lit(SCRIPT_SPACE)))
            first = F.get(b["at"], s)
            return F.struct(
                k.alias("section_no"),
                F.size(b["starts"]).alias("n_sections"),
                trim(j).alias("section"),
                # each earlier piece of the section adds the one blank line it is joined with
                F.transform(
                    F.slice(b["at"], s + 1, until - s),
                    lambda at, i: F.struct((at - first + i + 1 - cut_lines).alias("packed"), at.alias("exact")),
                ).alias("line_map"),
            )

        return let(joined, finish)

    whole = F.array(
        F.struct(
            F.lit(0).alias("section_no"),
            F.lit(1).alias("n_sections"),
            text.alias("section"),
            F.array(F.struct(F.lit(1).alias("packed"), F.lit(1).alias("exact"))).alias("line_map"),
        )
    )
    return F.when(F.length(text) <= size, whole).otherwise(let(header_pieces(text), build))


def exact_line(line: Column, line_map: Column) -> Column:
    """Line in the note for a line of a packed section."""
    return F.aggregate(
        line_map,
        line.cast("long"),
        lambda acc, m: F.when(m["packed"] <= line, m["exact"] + line - m["packed"]).otherwise(acc).cast("long"),
    )


def fixed_sections(text: Column, size: int) -> Column:
    """Cuts of ``size`` characters with the number of line ends before each; an empty text has none.

    One regular-expression pass: repeated ``substr`` would walk the text from its start for every cut.
    """

    def step(acc: Column, section: Column) -> Column:
        return F.struct(
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        F.size(acc["out"]).alias("section_no"),
                        section.alias("section"),
                        acc["seen"].alias("newlines_before"),
                    )
                ),
            ).alias("out"),
            (acc["seen"] + newlines(section)).alias("seen"),
        )

    zero = F.struct(
        F.array().cast("array<struct<section_no:int,section:string,newlines_before:int>>").alias("out"),
        F.lit(0).alias("seen"),
    )
    cuts = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0))

    def with_total(acc: Column) -> Column:
        return F.transform(acc["out"], lambda s: s.withField("n_sections", F.size(acc["out"])))

    return F.aggregate(cuts, zero, step, with_total)


_LINT_FILL = "\x01"


def lint(text: Column) -> Column:
    """Formatting findings of one text as ``array<struct<line, rule, issue, suggestion, fixable, originalText, suggestedText>>``.

    Rules: blank before a comma, runs of blank lines, heading level that skips a step, bare URL, code fence
    without a language, list markers of two kinds.
    """

    def finding(line, rule, issue, suggestion, original="", suggested=""):
        return F.struct(
            line.cast("long").alias("line"),
            F.lit(rule).alias("rule"),
            F.lit(issue).alias("issue"),
            F.lit(suggestion).alias("suggestion"),
            F.lit(bool(original)).alias("fixable"),
            F.lit(original).alias("originalText"),
            F.lit(suggested).alias("suggestedText"),
        )

    def rules(v: Column) -> Column:
        raw, m = v["raw"], v["masked"]
        lines = F.transform(m, lambda t, i: F.struct((i + 1).alias("line"), t.alias("t")))

        def blank(t: Column) -> Column:
            return F.coalesce(F.btrim(t, F.lit(" \t")) == "", F.lit(False))

        comma = F.transform(
            F.filter(lines, lambda x: x["t"].rlike("[^ ] +,")),
            lambda x: finding(x["line"], "comma_space", "space before comma", "drop the space", " ,", ","),
        )
        runs = F.transform(
            F.filter(
                lines,
                lambda x: blank(x["t"])
                & blank(F.get(m, x["line"]))
                & ~F.when(x["line"] > 1, blank(F.get(m, x["line"] - 2))).otherwise(F.lit(False)),
            ),
            lambda x: finding(x["line"], "blank_run", "several blank lines", "keep one", "\n\n\n", "\n\n"),
        )
        heads = F.filter(
            F.transform(
                lines,
                lambda x: F.struct(
                    x["line"].alias("line"),
                    F.length(F.regexp_extract(x["t"], "^(#{1,6}) ", 1)).alias("level"),
                ),
            ),
            lambda h: h["level"] > 0,
        )
        jumps = let(
            heads,
            lambda hs: F.transform(
                F.filter(
                    F.transform(
                        hs,
                        lambda h, i: F.struct(
                            h["line"].alias("line"),
                            F.when(i > 0, h["level"] - F.get(hs, i - 1)["level"]).otherwise(0).alias("step"),
                        ),
                    ),
                    lambda h: h["step"] > 1,
                ),
                lambda h: finding(h["line"], "heading_jump", "heading level skipped", "use the next level"),
            ),
        )
        urls = F.transform(
            F.filter(lines, lambda x: x["t"].rlike(r"(^|[^(<\[])https?://")),
            lambda x: finding(x["line"], "bare_url", "bare URL", "make it a link"),
        )
        fences = F.filter(
            F.transform(raw, lambda t, i: F.struct((i + 1).alias("line"), t.alias("t"))),
            lambda x: F.startswith(x["t"], F.lit("```")),
        )
        open_fences = F.transform(
            F.filter(
                F.transform(
                    fences, lambda x, i: F.struct(x["line"].alias("line"), x["t"].alias("t"), i.alias("i"))
                ),
                lambda x: (x["i"] % 2 == 0) & (F.btrim(x["t"], F.lit(" \t")) == "```"),
            ),
            lambda x: finding(x["line"], "fence_language", "code fence without a language", "name the language"),
        )
        bullets = F.filter(
            F.transform(
                lines,
                lambda x: F.struct(
                    x["line"].alias("line"), F.regexp_extract(x["t"], r"^[ \t]*([-*]) ", 1).alias("mark")
                ),
            ),
            lambda x: x["mark"] != "",
        )
        mixed = let(
            bullets,
            lambda bs: F.transform(
                F.filter(bs, lambda x: x["mark"] != F.get(bs, F.lit(0))["mark"]),
                lambda x: finding(x["line"], "mixed_bullets", "mixed list markers", "use one marker"),
            ),
        )
        return F.array_sort(F.concat(comma, runs, jumps, urls, open_fences, mixed))

    return let(
        F.struct(
            F.split(text, "\n", -1).alias("raw"),
            F.split(mask(text, PROTECTED_BUT_URL, _LINT_FILL), "\n", -1).alias("masked"),
        ),
        rules,
    )
