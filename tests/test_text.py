import pytest
from pyspark.sql import functions as F

from notespark.functions import text as t


@pytest.mark.parametrize(
    "text, expected", [("hello", "1n1e4y"), ("é", "6h"), ("", "0"), ("a", "2p"), ("😀", None), ("x" * 500, None)]
)
def test_text_hash(value, text, expected):
    h = 0
    units = text.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = (h * 31 + int.from_bytes(units[i : i + 2], "little")) & 0xFFFFFFFF
    h = abs(h - (1 << 32) if h >= 1 << 31 else h)
    digits = ""
    while h:
        h, r = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
    got = value(t.text_hash(F.col("s")), s=text)
    assert got == (digits or "0")
    if expected is not None:
        assert got == expected


def test_fold_sees_earlier_output_and_keeps_dollar(value):
    pairs = F.array(
        F.struct(F.lit("teh").alias("o"), F.lit("the").alias("s")),
        F.struct(F.lit("the cat").alias("o"), F.lit("a $& dog").alias("s")),
    )
    assert value(t.apply_pairs(F.lit("teh cat teh"), pairs, "o", "s")) == "a $& dog the"


def test_fold_of_nothing_is_identity(value):
    none = F.array().cast("array<struct<o:string,s:string>>")
    assert value(t.apply_pairs(F.lit("abc"), none, "o", "s")) == "abc"


@pytest.mark.parametrize(
    "n, shown",
    [
        (0, "0 Bytes"), (1, "1 Bytes"), (1023, "1023 Bytes"), (1536, "1.5 KB"), (1300, "1.27 KB"),
        (1029, "1 KB"), (1034, "1.01 KB"), (1048576, "1 MB"), (5 * 1024**3, "5 GB"), (2 * 1024**4, "2048 GB"),
    ],
)
def test_file_size(value, n, shown):
    assert value(t.file_size(F.col("n")), n=n) == shown


@pytest.mark.parametrize("ms, shown", [(0, "0s"), (59999, "59s"), (61000, "1m 1s"), (3660000, "1h 1m")])
def test_duration(value, ms, shown):
    assert value(t.duration(F.col("n")), n=ms) == shown


@pytest.mark.parametrize("ratio, shown", [(0.345, 35), (0.125, 13), (0.0, 0), (1.0, 100), (0.004, 0)])
def test_percent_is_half_up(value, ratio, shown):
    assert value(t.percent(F.col("x")), x=ratio) == shown


def test_trim_takes_all_white_space(value):
    assert value(t.trim(F.col("s")), s="﻿ \n\t a b 　\r\n") == "a b"


def test_highlight_escapes_and_ignores_case(value):
    h = t.highlight(F.col("c"), F.col("o"))
    assert value(h, c="a C++ b c++", o="c++") == (
        'a <mark class="error-highlight">C++</mark> b <mark class="error-highlight">c++</mark>'
    )
    assert value(h, c="É é", o="é").count("<mark") == 2
    assert value(h, c="abc", o="") == "abc"
    assert value(h, c=r"a\d", o=r"\d") == r'a<mark class="error-highlight">\d</mark>'


def test_paths_and_links(value):
    d = t.derived_path(F.col("p"), F.col("b"), "corrected")
    assert value(d, p="x/n.md/n.md", b="n") == "x/n.md/n-corrected.md"
    assert value(d, p="n.md", b="n") == "n-corrected.md"
    assert value(t.wiki_link(F.col("p")), p="a/b.md") == "[[a/b.md]]"


def test_default_covers_null_and_empty(value):
    assert value(t.default_to(F.col("s"), F.lit("d")), s="") == "d"
    assert value(t.default_to(F.lit(None).cast("string"), F.lit("d"))) == "d"
    assert value(t.default_to(F.col("s"), F.lit("d")), s="x") == "x"


def test_run_lengths(value):
    got = value(t.run_lengths(F.array(*map(F.lit, ["b", "a", "b", "c", "b"]))))
    assert [(r.item, r.n) for r in got] == [("a", 1), ("b", 3), ("c", 1)]
    assert value(t.run_lengths(F.array().cast("array<string>"))) == []


def test_compat_keys(value):
    assert value(t.spell_key(F.lit("en"), F.lit("hello"), "standard")) == "spell:en:1n1e4y:standard"
    assert value(t.link_key(F.lit("a.md"), F.lit("b.md"))) == "smart-link:a.md:b.md"
    assert value(t.theme_chunk_key(F.lit(3))) == "vault-analysis-chunk-3"
