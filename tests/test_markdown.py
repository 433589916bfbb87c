import random
import re

import pytest
from pyspark.sql import functions as F

from notespark.functions import markdown as md

TEXT = "intro\n# A\naa\n## B\nbb\n### C\ncc\n# D\ndd"


def test_header_pieces(value):
    assert value(md.header_pieces(F.col("c")), c=TEXT) == ["intro", "# A\naa", "## B\nbb\n### C\ncc", "# D\ndd"]
    assert value(md.header_pieces(F.col("c")), c="a\n### b") == ["a\n### b"]
    assert value(md.header_pieces(F.col("c")), c="") == [""]


def pack(text, size):
    """Plain restatement of the packing rule."""
    if len(text) <= size:
        return [text]
    done, cur = [], ""
    for piece in re.split(r"\n(?=##? )", text):
        if cur and len(cur) + len(piece) > size:
            done.append(cur.strip())
            cur = piece
        else:
            cur = f"{cur}\n\n{piece}" if cur else piece
    return done + [cur.strip()] if cur else done


def sections(value, text, size):
    return value(md.pack_sections(F.col("c"), size), c=text)


def test_packing_example(value):
    got = [s.section for s in sections(value, TEXT, 12)]
    assert got == ["intro\n\n# A\naa", "## B\nbb\n### C\ncc", "# D\ndd"]


def random_note(rng):
    kinds = ["# h", "## hh", "### hhh", "", "  ", "word " * rng.randint(1, 6), "x" * rng.randint(1, 30)]
    return "\n".join(rng.choice(kinds) for _ in range(rng.randint(1, 25)))


def test_packing_random(spark):
    rng = random.Random(1)
    texts = ["", "\n# a\nb", "# a", "\n\n# a\n\n## b" * 5] + [random_note(rng) for _ in range(150)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, c string")
    for size in (5, 20, 60):
        for r in rows.select("i", md.pack_sections(F.col("c"), size).alias("s")).collect():
            assert [s.section for s in r.s] == pack(texts[r.i], size)


def test_exact_line_points_at_the_same_text(spark):
    rng = random.Random(2)
    texts = [random_note(rng) + f"\nend {i}" for i in range(60)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, c string")
    cut = rows.select("i", F.inline(md.pack_sections(F.col("c"), 40)))
    lines = cut.select("i", "line_map", F.posexplode(F.split("section", "\n")).alias("p", "t"))
    for r in lines.select("i", "t", md.exact_line(F.col("p") + 1, F.col("line_map")).alias("line")).collect():
        if r.t.strip():
            assert texts[r.i].split("\n")[r.line - 1].strip() == r.t.strip()


@pytest.mark.parametrize("text", ["", "a", "é" * 7, "ab\ncd\nef\n", "x" * 12])
def test_fixed_sections_join_back(value, text):
    got = value(md.fixed_sections(F.col("c"), 4), c=text)
    assert "".join(s.section for s in got) == text
    assert len(got) == -(-len(text) // 4)
    assert [s.newlines_before for s in got] == [text[: 4 * i].count("\n") for i in range(len(got))]


PROTECTED = [
    "---\nkey: v\n---", "```py\na , b\n\n\n\nc\n```", "`a , b`", "[[Page , x|y]]", "![[img.png]]", "$$a , b$$",
    "$x , y$", "[^1]:", "<br , x>", "https://a.b/c", " ^block-1", "\n| a , b |",
]


@pytest.mark.parametrize("span", PROTECTED)
def test_mask_and_fix_spare_protected_spans(value, span):
    text = span + " tail , end" if span.startswith("---") else "head , x " + span + "\ntail , end"
    masked = value(md.mask(F.col("c")), c=text)
    assert len(masked) == len(text)
    assert masked.count("\n") == text.count("\n")
    assert not re.search(r"[A-Za-z]", masked[text.index(span) : text.index(span) + len(span)])
    fixed = value(md.safe_fix(F.col("c")), c=text)
    assert span in fixed
    assert "tail, end" in fixed


def test_plain_prices_are_not_math(value):
    assert value(md.mask(F.col("c")), c="costs $ 5 and $ 6") == "costs $ 5 and $ 6"


def rules(value, text):
    return [(f.line, f.rule) for f in value(md.lint(F.col("c")), c=text)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("", []),
        ("a , b", [(1, "comma_space")]),
        ("a\n\n\n\nb\n\n\nc", [(2, "blank_run"), (6, "blank_run")]),
        ("# a\n### b\n## c\n#### d", [(2, "heading_jump"), (4, "heading_jump")]),
        ("see https://x.y", [(1, "bare_url")]),
        ("[x](https://x.y) <https://x.y>", []),
        ("```\ncode , x\n```\n```py\n```", [(1, "fence_language")]),
        ("- a\n* b\n- c\n  * d", [(2, "mixed_bullets"), (4, "mixed_bullets")]),
        ("`a , b`", []),
    ],
)
def test_lint(value, text, expected):
    assert rules(value, text) == expected


def test_a_table_in_the_first_line_is_protected(value):
    table = "| a , b | c |\n|---|---|\n| d , e | f |\ntext , more"
    assert value(md.safe_fix(F.col("c")), c=table) == table.replace("text , more", "text, more")
    assert value(md.mask(F.col("c")), c=table).strip() == "text , more"
    assert value(md.safe_fix(F.col("c")), c="a | b , c") == "a | b, c"
