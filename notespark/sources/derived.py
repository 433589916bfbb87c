"""Note views over the given test tables.

The tables hold no notes, replies or cache log, so these views derive them, row by row, from whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notespark import params
from notespark.functions.text import native_spell_key
from notespark.session import SPREAD

_EXTENSIONS = ("md", "md", "md", "md", "md", "md", "MD", "pdf", "PNG", "txt")
_FIRST_WORDS = r"^\P{L}*(\p{L}+)(?:\P{L}+(\p{L}+))?(?:\P{L}+(\p{L}+))?"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, spread over more tasks than its row groups give only if the session asks for it."""
    docs, spread = table(spark, sf_dir, "documents"), spark.conf.get(SPREAD, "")
    return docs.repartition(int(spread), "doc_id") if spread else docs


def _basename() -> Column:
    text = F.lower("text")
    first = F.filter(
        F.array(*[F.regexp_extract(text, _FIRST_WORDS, i) for i in (1, 2, 3)]), lambda w: w != ""
    )
    return F.concat(F.array_join(first, "-"), F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 6, "0"))


def _files(docs: DataFrame) -> DataFrame:
    extension = F.get(F.array(*map(F.lit, _EXTENSIONS)), (F.col("doc_id") % 10).cast("int"))
    named = docs.withColumn("basename", _basename()).withColumn("extension", extension)
    return named.withColumn(
        "path", F.concat("source", F.lit("/"), "basename", F.lit("."), "extension")
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, path, basename, extension`` without content."""
    return _files(documents(spark, sf_dir)).select("doc_id", "lang", "path", "basename", "extension")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files`` with content: headings, some spaced commas, and every fourth note links to its predecessor."""
    docs = documents(spark, sf_dir)
    body = F.array_join(
        F.transform(
            F.split("text", "\n", -1),
            lambda line, i: F.concat(
                F.when(i == 0, "# ").when(i % 8 == 0, "## ").otherwise(""),
                F.when(i % 5 == 3, F.replace(line, F.lit(", "), F.lit(" , "))).otherwise(line),
            ),
        ),
        "\n",
    )
    cited = table(spark, sf_dir, "documents").where(F.col("doc_id") % 4 == 3)  # only these names are cited
    previous = cited.select((F.col("doc_id") + 1).alias("doc_id"), _basename().alias("previous"))
    link = F.concat(F.lit("\n\n\nSee [["), F.col("previous"), F.lit("]] and `code x`."))
    return (
        _files(docs)
        .withColumn("body", body)
        .join(previous, "doc_id", "left")
        .select(
            "doc_id",
            "lang",
            "path",
            "basename",
            "extension",
            F.concat(
                "body",
                F.when((F.col("doc_id") % 4 == 0) & F.col("previous").isNotNull(), link).otherwise(""),
            ).alias("content"),
        )
    )


def _finding_json(word: Column) -> Column:
    return F.concat(
        F.lit('{"corrections":[{"original":"'), word, F.lit('","suggested":"'), word,
        F.lit('x","line":2,"confidence":0.9,"context":""},{"original":"","suggested":"y","line":1,"confidence":0.8}],'
              '"formattingIssues":[{"issue":"comma spacing","line":4,"suggestion":"drop space","fixable":true,'
              '"originalText":" , ","suggestedText":", "}]}'),
    )


def _reply(kind: Column, json: Column) -> Column:
    """Six shapes: clean, after reasoning, inside prose, fenced, cut off, empty object."""
    return (
        F.when(kind == 0, json)
        .when(kind == 1, F.concat(F.lit("<think>a {b}</think>"), json))
        .when(kind == 2, F.concat(F.lit("Sure: "), json, F.lit(" done")))
        .when(kind == 3, F.concat(F.lit("```json\n"), json, F.lit("\n```")))
        .when(kind == 4, '{"corrections": [')
        .otherwise("{}")
    )


def _first_word(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"\p{L}+", 0), F.lit("")), F.lit("x"))


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, request_key, raw_reply``: one spelling reply per document."""
    json = _finding_json(_first_word(F.col("text")))
    return documents(spark, sf_dir).select(
        "doc_id",
        F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("request_key"),
        _reply(F.col("doc_id") % 6, json).alias("raw_reply"),
    )


def section_replies(sections: DataFrame, language: Column | None = None) -> DataFrame:
    """One spelling reply per distinct section text and language, keyed like its request; the shape follows its length, and
    so does the ``third`` that ``aged`` deals out."""
    reply = _reply(F.length("section") % 6, _finding_json(_first_word(F.col("section"))))
    by_key = sections.groupBy(section_key(F.col("section"), language).alias("key"))
    return by_key.agg(F.min(reply).alias("raw_reply"), F.min(F.length("section") % 3).alias("third"))


def aged(answers: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(cache, new replies) from ``(key, raw_reply, third)``: a third is cached an hour ago, a third so long ago that it
    has expired, and a third arrives now."""
    hours = F.when(F.col("third") == 0, -1).otherwise(-48)
    cached = answers.where("third < 2").select(
        "key",
        F.col("raw_reply").alias("value"),
        F.timestamp_add("HOUR", hours, now).alias("ts"),
        F.lit(params.CACHE_TTL_MS).cast("long").alias("ttl_ms"),
    )
    return cached, answers.where("third = 2").select("key", "raw_reply")


def section_key(section: Column, language: Column | None = None) -> Column:
    language = F.lit(params.LANGUAGE) if language is None else language
    return native_spell_key(language, section, params.PROMPT_VARIANT, params.CHECK_MODEL)


def link_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, request_key, raw_reply`` for the pair (doc_id, doc_id - 1); no preview in the reply."""
    d = F.col("doc_id")
    relevance = (d % 100 / 100.0).cast("decimal(3,2)").cast("string")
    return (
        documents(spark, sf_dir)
        .where(d > 0)
        .select(
            "doc_id",
            F.concat(F.lit("link:"), d.cast("string"), F.lit(":"), (d - 1).cast("string")).alias("request_key"),
            F.concat(
                F.lit('{"shouldLink":'),
                F.when(d % 7 == 0, "false").otherwise("true"),
                F.lit(',"relevance":'),
                relevance,
                F.lit(',"connectionType":"'),
                F.when(d % 4 == 0, "conceptual")
                .when(d % 4 == 1, "sequential")
                .when(d % 4 == 2, "complementary")
                .otherwise("reference"),
                F.lit('","reasoning":"r","commonThemes":["t'),
                (d % 5).cast("string"),
                F.lit('"]}'),
            ).alias("raw_reply"),
        )
    )


def theme_replies(chunks: DataFrame) -> DataFrame:
    """One theme reply per chunk of names: plain, fenced, in prose, or cut off; themes are its first name's words."""
    first = F.element_at(F.split("names", "\n"), 1)
    array = F.concat(F.lit('["'), F.array_join(F.split(first, "-"), '","'), F.lit('"]'))
    kind = F.col("chunk_no") % 4
    return chunks.select(
        "chunk_no",
        F.when(kind == 0, array)
        .when(kind == 1, F.concat(F.lit("```json\n"), array, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Themes: "), array, F.lit(".")))
        .otherwise('["cut off')
        .alias("raw_reply"),
    )


def rewrite_replies(sections: DataFrame, *more: Column) -> DataFrame:
    """One rewrite per section, its shape by the section's length: after reasoning, fenced, too short, plain."""
    kind = F.length("section") % 4
    text = F.replace("section", F.lit("e"), F.lit("E"))
    return sections.select(
        "path",
        "section_no",
        *more,
        F.when(kind == 0, F.concat(F.lit("<think>plan</think>"), text))
        .when(kind == 1, F.concat(F.lit("```md\nfenced\n```\n"), text))
        .when(kind == 2, "too short")
        .otherwise(F.concat(F.lit("# "), text, F.lit("\n")))
        .alias("raw_reply"),
    )


def cache_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, ts, key, op, ttl_ms, value`` from the event stream."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.concat(F.lit("spell:en:"), F.col("user_id").cast("string"), F.lit(":standard")).alias("key"),
        F.when(F.col("event_type").isin("view", "click"), "get").otherwise("set").alias("op"),
        F.when(F.col("event_type") == "error", 3600000).otherwise(86400000).cast("long").alias("ttl_ms"),
        F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("value"),
    )


def reply_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache rows for the notes that ``labels`` covers, a minute apart by document number."""
    labelled = notes(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    entries = labelled.select(
        section_key(F.col("content")).alias("key"),
        F.concat(F.lit("q"), F.col("quality").cast("string")).alias("value"),
        F.timestamp_add("MINUTE", F.col("doc_id"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"),
        F.lit(params.CACHE_TTL_MS).cast("long").alias("ttl_ms"),
    )
    return entries.groupBy("key").agg(F.max(F.struct("ts", "value", "ttl_ms")).alias("e")).select("key", "e.*")


def path_code(path: Column) -> Column:
    """24 bits that follow a path."""
    return F.conv(F.substring(F.md5(path.cast("binary")), 1, 6), 16, 10).cast("long")


def link_judgement(path: Column) -> Column:
    """A link reply that follows the path: refused for a seventh of them."""
    code = path_code(path)
    return F.concat(
        F.lit('{"shouldLink":'), F.when(code % 7 == 0, "false").otherwise("true"),
        F.lit(',"relevance":'), (code % 101 / 100.0).cast("decimal(3,2)").cast("string"),
        F.lit(',"connectionType":"'), F.when(code % 4 == 0, "conceptual").otherwise("complementary"), F.lit('","reasoning":"r"}'),
    )
