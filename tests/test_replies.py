import json

import pytest
from pyspark.sql import functions as F

from notespark.operators import findings, replies

GOOD = {
    "corrections": [
        {"original": "teh", "suggested": "the", "line": 2, "confidence": 0.9},
        {"original": "", "suggested": "x", "line": 1, "confidence": 1},
        {"suggested": "x"},
    ],
    "formattingIssues": [
        {"issue": "comma", "line": 1, "suggestion": "s", "fixable": True, "originalText": " ,", "suggestedText": ","},
        {"issue": "bare", "line": "3", "suggestion": "s", "fixable": True},
        {"issue": "", "line": 1},
        {"issue": "no", "line": 4, "suggestion": "s", "fixable": False, "originalText": "a", "suggestedText": "b"},
    ],
}


def parse(spark, raw):
    return replies.parse_findings(spark.createDataFrame([(raw,)], "raw_reply string")).first()


@pytest.mark.parametrize("wrap", ["{}", "<think>a {{b}}</think>{}", "Sure: {} done", "```json\n{}\n```"])
def test_findings_shapes(spark, wrap):
    r = parse(spark, wrap.format(json.dumps(GOOD)))
    assert r.parse_ok
    assert [(c.original, c.suggested, c.line, c.context) for c in r.corrections] == [
        ("teh", "the", 2, "No context available")
    ]
    assert [(i.issue, i.line, i.fixable) for i in r.issues] == [("comma", 1, True), ("bare", 3, True), ("no", 4, False)]
    assert r.issues[1].originalText == "No original text available"


@pytest.mark.parametrize(
    "raw", ['{"corrections": [', "no json", "", "null", None, '{"corrections": {"a": 1}}', '{"corrections": "x"}']
)
def test_unreadable(spark, raw):
    r = parse(spark, raw)
    assert r.parse_ok is False and r.corrections is None and r.issues is None


@pytest.mark.parametrize("raw", ["{}", "[]", '{"corrections": null}', '{"corrections": false, "formattingIssues": ""}'])
def test_readable_but_empty(spark, raw):
    r = parse(spark, raw)
    assert r.parse_ok and r.corrections == [] and r.issues == []


def test_only_applicable_issues_are_fixed(spark):
    df = replies.parse_findings(spark.createDataFrame([(json.dumps(GOOD),)], "raw_reply string"))
    text = "No original text available a , b"
    got = df.select(findings.apply_fixes(F.lit(text), F.col("issues")).alias("t"), findings.fixable(F.col("issues")).alias("f"))
    assert got.first().t == "No original text available a, b"
    assert len(got.first().f) == 1
    counts = findings.counts(df.withColumn("path", F.lit("p"))).first()
    assert (counts.n_corrections, counts.n_issues, counts.n_fixable, counts.clean) == (1, 3, 2, False)


@pytest.mark.parametrize(
    "raw, themes, compat",
    [
        ('["a", "b"]', ["a", "b"], ["a", "b"]),
        ('```json\n["a"]\n```', ["a"], []),
        ('x ["a"] y', ["a"], ["a"]),
        ('["a', [], []),
        ("none", [], []),
        ("[1, true]", ["1", "true"], ["1", "true"]),
    ],
)
def test_themes(spark, raw, themes, compat):
    df = spark.createDataFrame([(raw,)], "raw_reply string")
    assert replies.parse_themes(df).first().themes == themes
    assert replies.parse_themes(df, compat=True).first().themes == compat


def link(spark, raw, **kw):
    df = spark.createDataFrame([("b", "x/b.md", "start", raw)], "basename string, path string, preview string, raw_reply string")
    return replies.parse_links(df, **kw).collect()


def test_links(spark):
    ok = '{"shouldLink": true, "relevance": 0.31, "connectionType": "reference", "reasoning": "r"}'
    (row,) = link(spark, ok)
    assert (row.title, row.path, row.relevance, row.common_themes, row.content_preview) == ("b", "x/b.md", 0.31, [], "start")
    assert link(spark, ok.replace("0.31", "0.3")) == []
    assert link(spark, ok.replace("true", "false")) == []
    assert link(spark, "broken {") == []
    fenced = f"```json\n{ok}\n```"
    assert len(link(spark, fenced)) == 1
    assert link(spark, fenced, compat=True) == []


def test_accept_rules(value):
    corrected = replies.accept_corrected(F.col("r"), F.lit("orig"))
    assert value(corrected, r="x" * 50) == "orig"
    assert value(corrected, r=" " + "x" * 51 + "\n") == "x" * 51
    assert value(corrected, r="<think>" + "y" * 60 + "</think>" + "x" * 51) == "x" * 51
    enhanced = replies.accept_enhanced(F.col("r"), F.lit("orig"))
    assert value(enhanced, r="no heading") == "orig"
    assert value(enhanced, r="  # h") == "# h"
    assert value(enhanced, r="<think>x</think>\n# h") == "orig"


def test_last_think_wins(value):
    assert value(replies.strip_reasoning(F.col("r")), r="a</think>b</think>c") == "c"
    assert value(replies.strip_reasoning(F.col("r")), r="abc") == "abc"


def test_a_malformed_element_does_not_void_the_list(spark):
    raw = '{"corrections":[{"original":"teh","suggested":"the","line":3,"confidence":0.8},{"original":{"x":[1]},"suggested":"y"},7,null],"formattingIssues":[]}'
    r = replies.parse_findings(spark.createDataFrame([(raw,)], "raw_reply string")).first()
    assert r.parse_ok and [(c.original, c.suggested, c.line, c.confidence) for c in r.corrections if c.original == "teh"] == [("teh", "the", 3, 0.8)]
