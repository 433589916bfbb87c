import random

import pytest
from pyspark.sql import functions as F

from notespark.operators import spelling

LEXICON = "lang string, word string, n bigint, n_notes bigint, path string, line int, cap int"


def as_tables(spark, rows):
    """Lexicon, and notes with the path that words were seen in, which here stands for the text too."""
    df = spark.createDataFrame(rows, LEXICON).withColumns(dict(zip(("text_a", "text_b"), spelling._text_id(F.col("path")))))
    lex = df.withColumns({"several": F.col("n_notes") > 1, "most": F.col("n")}).drop("path")
    return lex, df.select("lang", "path", F.col("path").alias("content")).distinct()


def candidates(spark, rows):
    return spelling.candidates(*as_tables(spark, rows)).collect()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_candidates_against_all_pairs(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(3, 7))) for _ in range(900)}
    lex = []
    for w in sorted(words):
        known = rng.random() < 0.5
        lex.append((rng.choice(["en", "de"]), w, rng.randint(2, 9) if known else 1, 2 if known else 1, f"p{len(lex)}", len(lex), 0))
    expected = {}
    for i, (lang, w, _, notes, *_) in enumerate(lex):
        if notes == 1 and len(w) >= 4:
            near = [(-n, k) for kl, k, n, kn, *_ in lex if kl == lang and kn >= 2 and distance(w, k) == 1]
            if near:
                expected[lang, w] = (min(near)[1], f"p{i}", i)
    got = candidates(spark, lex)
    assert {(r.lang, r.original): (r.suggested, r.path, r.line) for r in got} == expected
    assert all(r.confidence == round(1 - 1 / len(r.original), 4) for r in got)


def test_candidates_within_two_against_all_pairs(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdé") for _ in range(rng.randint(6, 11))) for _ in range(40)]

    def changed(w):
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice("abcdé") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdé") + w[i + 1 :]])
        return w

    words = sorted({changed(rng.choice(stems)) for _ in range(700)} - {""})
    lex = []
    for w in words:
        known = rng.random() < 0.4
        lex.append((rng.choice(["en", "de"]), w, rng.randint(2, 5) if known else 1, 2 if known else 1, f"p{len(lex)}", len(lex), 0))
    expected = {}
    for i, (lang, w, _, notes, *_) in enumerate(lex):
        if notes == 1 and len(w) >= 4:
            most = 2 if len(w) >= 8 else 1
            near = [(d, -n, k) for kl, k, n, kn, *_ in lex if kl == lang and kn >= 2 and (d := distance(w, k)) <= most]
            if near:
                d, _, k = min(near)
                expected[lang, w] = (k, d, round(1 - d / len(w), 4), f"p{i}", i)
    assert sum(x[1] == 2 for x in expected.values()) > 20
    table, notes = as_tables(spark, lex)
    for share in (0.1, 0.9):
        got = spelling.candidates_within_two(table, notes, first_share=share).collect()
        assert {(r.lang, r.original): (r.suggested, r.distance, r.confidence, r.path, r.line) for r in got} == expected
    assert spelling.candidates_within_two(table.limit(0), notes).count() == 0


def test_marks_are_no_edits_at_distance_two(spark):
    rows = [("ar", "كتابكتاب" + FATHA, 1, 1, "p", 1, 0)]
    rows += [("ar", k, 5, 2, "p", 1, 0) for k in ("كتابكتا", "كتابكتنن" + FATHA)]
    got = spelling.candidates_within_two(*as_tables(spark, rows)).collect()
    assert [(r.suggested, r.distance) for r in got] == [("كتابكتنن" + FATHA, 2)]


FATHA, KASRA = "َ", "ِ"


@pytest.mark.parametrize(
    "suspect, known, expected",
    [
        ("كتاب" + FATHA, ["كتاب"], None),  # mark too many
        ("كتاب", ["كتاب" + FATHA], None),  # mark too few
        ("كتاب" + FATHA, ["كتاب" + KASRA], None),  # other mark
        ("كتاب" + FATHA, ["كتاب", "كتان" + FATHA], "كتان" + FATHA),  # letter differs
        ("كتاب", ["كتا" + FATHA], "كتا" + FATHA),  # letter against mark
    ],
)
def test_marks_alone_are_never_corrected(spark, suspect, known, expected):
    rows = [("ar", suspect, 1, 1, "p", 1, 0)] + [("ar", k, 5, 2, "p", 1, 0) for k in known]
    got = candidates(spark, rows)
    assert [r.suggested for r in got] == ([expected] if expected else [])


def test_lexicon_counts_and_first_use(spark):
    notes = spark.createDataFrame(
        [("en", "b.md", "The cat\nthe `code` cat"), ("en", "a.md", "x\nCat sat [[Link]]"), ("de", "c.md", "cat")],
        "lang string, path string, content string",
    )
    lex = spelling.lexicon(notes)
    assert {(r.lang, r.word): (r.n, r.n_notes) for r in lex.collect()} == {
        ("en", "the"): (2, 1), ("en", "cat"): (3, 2), ("en", "x"): (1, 1), ("en", "sat"): (1, 1), ("de", "cat"): (1, 1),
    }
    assert "SortAggregate" not in lex._jdf.queryExecution().executedPlan().toString()
    assert {(r.word, r.line, r.cap) for r in lex.where("lang = 'en' and n_notes = 1").collect()} == {
        ("the", 1, 1), ("x", 1, 0), ("sat", 2, 0),
    }
    assert [r.word for r in spelling.suspects(spelling.lexicon(notes), 0.5).where("lang = 'en'").collect()] == ["sat"]


@pytest.mark.parametrize(
    "original, suggested, confidence, kept",
    [("teh", "the", 0.75, True), ("teh", "the", 0.74, False), ("a", "a", 0.9, False), ("ب" + FATHA, "ب", 0.9, False)],
)
def test_gate(value, original, suggested, confidence, kept):
    keep = spelling.keep(F.col("o"), F.col("s"), F.col("c"))
    assert value(keep, o=original, s=suggested, c=confidence) is kept


def test_a_copy_does_not_establish_a_word(spark):
    body = "the garden gate\nis gardin green"
    rows = [("en", "a.md", body), ("en", "copy.md", body), ("en", "b.md", "a garden"), ("en", "c.md", "the gardin gardin")]
    notes = spark.createDataFrame(rows[:3], "lang string, path string, content string")
    got = spelling.candidates(spelling.lexicon(notes), notes).collect()
    assert {(r.original, r.suggested, r.path, r.line) for r in got} == {("gardin", "garden", p, 2) for p in ("a.md", "copy.md")}
    notes = spark.createDataFrame(rows, "lang string, path string, content string")
    assert spelling.candidates(spelling.lexicon(notes), notes).count() == 0


def test_no_step_of_distance_two_is_left_in_the_plan(spark):
    """Candidates at distance one used to be worked out twice and with them the whole index, in the plan of the result."""
    rows = [("en", "garden", 5, 2, "p", 1, 0), ("en", "garding", 1, 1, "p", 1, 0), ("en", "gardingxx", 1, 1, "p", 1, 0)]
    plan = spelling.candidates_within_two(*as_tables(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "levenshtein" not in plan


def test_forms_of_distance_two_hold_numbers_only(spark):
    words = spark.createDataFrame([("en", "abc", 7)], "lang string, word string, number long")
    forms = spelling._shortened(words, "number")
    assert [(f.name, f.dataType.simpleString()) for f in forms.schema] == [("key", "bigint"), ("number", "bigint")]
    assert forms.distinct().count() == 7  # abc, three of two letters, three of one
    other = spelling._shortened(words.withColumn("lang", F.lit("de")), "number")
    assert forms.join(other, "key").count() == 0
