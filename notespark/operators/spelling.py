"""Corpus lexicon and spelling candidates.

Substitute for a model's judgement: a word seen once in the whole corpus of its language is suspected when
the lexicon holds an established word at edit distance one. Values are not what a model would answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notespark import params
from notespark.functions.markdown import PROTECTED, mask
from notespark.functions.text import WORD, let
from notespark.session import cut_lineage

MARK = r"[\x{064B}-\x{0652}]"
_MARK_RANGE = ("\u064b", "\u0652")
NO_MARK = r"[^\x{064B}-\x{0652}]+"
# Share of the established words, the most frequent ones, that are asked first for words at distance two.
FIRST_SHARE = 0.1
_ARABIC = r"[\x{0600}-\x{06FF}]"


def _note_words(content: Column) -> Column:
    """``array<struct<word, n, line, cap>>`` of one note: times used, line and capitals of the first use.

    Counted inside the row: a note is not split over tasks, so grouping its words needs no shuffle, and what
    is shuffled later is one record per distinct word.
    """

    def tokens_of(line: Column, i: Column) -> Column:
        def tokens(found: Column) -> Column:
            return F.zip_with(
                found,
                F.transform(found, F.lower),
                lambda w, low: F.struct(
                    low.alias("word"), (i + 1).alias("line"), (low != w).cast("int").alias("cap")
                ),
            )

        return let(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)), tokens)

    def runs(s: Column) -> Column:
        first_of_word = F.filter(
            F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: (i == 0) | (F.get(s, i)["word"] != F.get(s, i - 1)["word"]),
        )
        return let(first_of_word, lambda st: F.transform(st, lambda p, k: run(F.get(s, p), st, p, k, F.size(s))))

    def run(token: Column, st: Column, p: Column, k: Column, size: Column) -> Column:
        return F.struct(
            token["word"].alias("word"),
            (F.coalesce(F.get(st, k + 1), size) - p).cast("long").alias("n"),
            token["line"].alias("line"),
            token["cap"].alias("cap"),
        )

    lines = F.split(mask(content, PROTECTED), "\n", -1)
    return let(F.sort_array(F.flatten(F.transform(lines, tokens_of))), runs)


def _text_id(content: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text: fixed width, so aggregates that carry them stay hash aggregates."""
    return F.xxhash64(content).alias("text_a"), F.xxhash64(F.lit("text"), content).alias("text_b")


def note_words(notes: DataFrame) -> DataFrame:
    """One row per note and distinct word."""
    identified = notes.select("lang", "content", *_text_id(F.col("content")))
    return identified.select("lang", "text_a", "text_b", F.inline(_note_words(F.col("content"))))


def lexicon(notes: DataFrame) -> DataFrame:
    """Per language and word: count ``n``, number of notes ``n_notes``, whether ``several`` different texts have it,
    and ``most``, its largest count in a note.

    Copies of a note are one text. ``line``, ``cap``, ``text_a`` and ``text_b`` tell the place of a word of one text
    and mean nothing for others. One shuffle of numbers and words, combined on the map side, so a word of every note
    sends one row per task.
    """
    ids = ("text_a", "text_b")
    return (
        note_words(notes)
        .groupBy("lang", "word")
        .agg(
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("n_notes"),
            F.max("n").alias("most"),
            *[F.max(c).alias(c) for c in ("line", "cap", *ids)],
            *[F.min(c).alias(f"_{c}") for c in ids],
        )
        .withColumn("several", (F.col("text_a") != F.col("_text_a")) | (F.col("text_b") != F.col("_text_b")))
        .drop("_text_a", "_text_b")
    )


def suspects(lex: DataFrame, min_confidence: float = params.MIN_CONFIDENCE) -> DataFrame:
    """Words used once in one text, so neither a term that repeats nor, without capitals, a name.

    At distance one the confidence is ``1 - 1/length``, so the confidence gate can cut here already.
    """
    return lex.where(
        ~F.col("several") & (F.col("most") == 1) & (F.col("cap") == 0) & (1 - 1 / F.length("word") >= min_confidence)
    )


def established(lex: DataFrame) -> DataFrame:
    return lex.where("several")


def _edits(words: DataFrame, whole: str, keys) -> DataFrame:
    """One row per word and key: the word itself under ``whole`` and ``keys(hole, shorter, is_mark)`` per position.

    Positions are exploded first, so the keys are built by generated code and not inside array lambdas.
    """
    word, i = F.col("word"), F.col("_i")
    ch = F.substring(word, i, F.lit(1))
    before, after = F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))
    at = keys(F.concat(before, F.lit("*"), after), F.concat(before, after), ch.between(*_MARK_RANGE))
    return (
        words.withColumn("_i", F.explode(F.sequence(F.lit(0), F.length(word))))
        .withColumn("key", F.explode(F.when(i == 0, F.array(F.concat(F.lit(whole), word))).otherwise(F.array(*at))))
        .where(F.col("key").isNotNull())
        .drop("_i")
    )


def _established_keys(hole: Column, shorter: Column, is_mark: Column) -> tuple[Column, ...]:
    return (
        F.concat(F.when(is_mark, "m:").otherwise("s:"), hole),
        F.when(~is_mark, F.concat(F.lit("i:"), shorter)),
    )


def _suspect_keys(hole: Column, shorter: Column, is_mark: Column) -> tuple[Column, ...]:
    return (
        F.concat(F.lit("s:"), hole),
        F.when(~is_mark, F.concat(F.lit("d:"), shorter)),
        F.when(~is_mark & F.col("word").rlike(_ARABIC), F.concat(F.lit("m:"), hole)),
    )


def candidates(lex: DataFrame, notes: DataFrame, min_confidence: float = params.MIN_CONFIDENCE) -> DataFrame:
    """Best established word at edit distance one for every suspect; more frequent first, then by spelling.

    Every note that has the suspect's text gets the finding; ``notes`` gives back their paths, by the text's hash.

    Keys describe one edit exactly, so nothing has to be compared afterwards: a word with a hole at one
    position meets words that differ in that letter (``s:``), a suspect with a letter removed meets the
    established word itself (``d:``), a suspect as it is meets an established word with a letter removed
    (``i:``). Each key therefore keeps its one best established word, and a suspect of n letters looks at no more than
    3n+1 keys. Pairs are never listed, and work is linear in the lexicon. Established words are numbered from best to
    worst, so the best one of a key is a minimum of numbers, taken by hash aggregates.

    Arabic vowel marks are never the edit: an established word's holes are labelled by what they cover, marks
    are not removed on either side, and only letters of a suspect may meet a hole over a mark (``m:``).

    Runs jobs: the lexicon, small next to the texts, is checkpointed because both sides read it, and so is the
    numbering, for range bounds are sampled.
    """
    lex = cut_lineage(lex)
    return _at_distance_one(lex, _numbered(lex), notes, min_confidence)


def _numbered(lex: DataFrame) -> DataFrame:
    """Established words, numbered from best to worst."""
    order = [F.desc("n"), F.asc("word"), F.asc("lang")]
    ranked = established(lex).select("lang", "n", "word").repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(ranked).withColumn("number", F.monotonically_increasing_id())


def _at_distance_one(lex: DataFrame, known: DataFrame, notes: DataFrame, min_confidence: float) -> DataFrame:
    by_key = (
        _edits(known.select("lang", "number", "word"), "d:", _established_keys)
        .groupBy("lang", "key")
        .agg(F.min("number").alias("number"))
    )
    place = ("line", "text_a", "text_b")
    asked = _edits(suspects(lex, min_confidence).select("lang", "word", *place), "i:", _suspect_keys)
    found = (
        asked.join(by_key, ["lang", "key"])
        .groupBy("lang", "word")
        .agg(F.min("number").alias("number"), *[F.max(c).alias(c) for c in place])
    )
    best = known.select("number", F.col("word").alias("suggested"), F.col("n").alias("frequency"))
    paths = notes.select("lang", "path", *_text_id(F.col("content")))
    return found.join(best, "number").join(paths, ["lang", "text_a", "text_b"]).select(
        "lang",
        F.col("word").alias("original"),
        "suggested",
        "frequency",
        F.round(1 - 1 / F.length("word"), 4).alias("confidence"),
        "path",
        F.col("line").cast("long").alias("line"),
    )


def _shortened(words: DataFrame, name: str) -> DataFrame:
    """``(key, name)``: a row per word and way of leaving out none, one or two of its letters, the key being 64 bits of the
    language and what is left. Only numbers, so the many rows are short."""
    word, i, j, n = F.col("word"), F.col("_i"), F.col("_j"), F.length("word")
    part = lambda first, last: F.substring(word, first, last - first + 1)
    left = (
        F.when(j == 0, word)
        .when(i == 0, F.concat(part(F.lit(1), j - 1), part(j + 1, n)))
        .otherwise(F.concat(part(F.lit(1), i - 1), part(i + 1, j - 1), part(j + 1, n)))
    )
    second = F.when(i == 0, F.sequence(F.lit(0), n)).when(i < n, F.sequence(i + 1, n))
    ways = words.withColumn("_i", F.explode(F.sequence(F.lit(0), n))).withColumn("_j", F.explode(second))
    return ways.select(F.xxhash64("lang", left).alias("key"), name)


def _best_within_two(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``(asked, number)``: the best established word at distance one or two of each asked word ``(lang, word, asked)``.

    Two words at distance two or less have a form in common that leaves out at most two letters of each. Words that meet
    by their keys are compared, each pair once; vowel marks must be the same in both, so an edit is never one of marks.
    """
    marks = lambda c: F.regexp_replace(c, NO_MARK, "")
    met = _shortened(asked, "asked").join(_shortened(known, "number").hint("merge"), "key").select("asked", "number").distinct()
    theirs = known.select("number", F.col("lang").alias("_lang"), F.col("word").alias("_known"))
    alike = F.levenshtein("word", "_known", 2).between(1, 2) & (marks(F.col("word")) == marks(F.col("_known")))
    return (
        met.join(asked, "asked")
        .join(theirs, "number")
        .where((F.col("lang") == F.col("_lang")) & alike)
        .groupBy("asked")
        .agg(F.min("number").alias("number"))
    )


def candidates_within_two(
    lex: DataFrame, notes: DataFrame, min_confidence: float = params.MIN_CONFIDENCE, first_share: float = FIRST_SHARE
) -> DataFrame:
    """``candidates``, and for suspects that have none the best established word at distance two, with ``distance``.

    The confidence is ``1 - distance/length``, so at distance two the gate leaves words of eight letters or more. Best is
    the more frequent, then the spelling. The index of shortened forms is dealt over tasks by its keys. It is asked twice:
    first only for the most frequent ``first_share`` of established words; a suspect that finds one there needs no other,
    for those after it are less frequent, and just the rest goes on to the long lists of rare words. Pairs that share no
    form are not compared, and none at distance two is lost.

    Runs jobs: lexicon, numbered established words, the candidates at distance one, the words left and both answers are
    checkpointed, so nothing is worked out twice and no plan holds more than one of these steps.
    """
    lex = cut_lineage(lex)
    known = _numbered(lex)
    near = cut_lineage(_at_distance_one(lex, known, notes, min_confidence)).withColumn("distance", F.lit(1).cast("long"))
    place = ("line", "text_a", "text_b")
    gate = 1 - 2 / F.length("word") >= min_confidence
    done = near.select("lang", F.col("original").alias("word"))
    left = suspects(lex, min_confidence).where(gate).join(done, ["lang", "word"], "left_anti").select("lang", "word", *place)
    left = cut_lineage(left.withColumn("asked", F.monotonically_increasing_id()))
    bound = (known.approxQuantile("number", [first_share], 0.01) or [0.0])[0]
    # A word at distance two has at most two letters less or more.
    shortest, longest = left.agg(F.min(F.length("word")), F.max(F.length("word"))).first()
    near_long = known.where(F.length("word").between((shortest or 0) - 2, (longest or 0) + 2))
    asked = left.select("lang", "word", "asked")
    early = cut_lineage(_best_within_two(asked, near_long.where(F.col("number") <= bound)))
    late = cut_lineage(
        _best_within_two(asked.join(early, "asked", "left_anti"), near_long.where(F.col("number") > bound))
    )
    best = known.select("number", F.col("word").alias("suggested"), F.col("n").alias("frequency"))
    paths = notes.select("lang", "path", *_text_id(F.col("content")))
    two = (
        early.unionByName(late)
        .join(best, "number")
        .join(left, "asked")
        .join(paths, ["lang", "text_a", "text_b"])
        .select(
            "lang",
            F.col("word").alias("original"),
            "suggested",
            "frequency",
            F.round(1 - 2 / F.length("word"), 4).alias("confidence"),
            "path",
            F.col("line").cast("long").alias("line"),
            F.lit(2).cast("long").alias("distance"),
        )
    )
    return near.unionByName(two)


def keep(original: Column, suggested: Column, confidence: Column, min_confidence: float = params.MIN_CONFIDENCE) -> Column:
    """Gate for corrections from any source: sure enough, a real change, and more than a change of marks."""
    bare = lambda c: F.regexp_replace(c, MARK, "")
    return (confidence >= min_confidence) & (original != suggested) & (bare(original) != bare(suggested))


def with_context(found: DataFrame, notes: DataFrame) -> DataFrame:
    """Add the full line a finding is on. Shuffles the notes' text once; leave it out where not needed."""
    text = notes.select("path", F.split("content", "\n", -1).alias("_lines"))
    return found.join(text, "path").select(
        "*", F.get("_lines", (F.col("line") - 1).cast("int")).alias("context")
    ).drop("_lines")
