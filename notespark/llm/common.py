"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What the word contracts call a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def without(df: DataFrame, *names: str) -> list[Column]:
    """The columns of df but those of these names, whatever their case."""
    gone = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in gone]


def uniform_bits(text: Column) -> Column:
    """52 pseudorandom bits of a string as a long; the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def remainder_of_id(column: str, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo a divisor. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)


def first_by_hash(rows: DataFrame, key: Column, n: int, *ties: str) -> DataFrame:
    """The first n rows by a hash of the key. A bound on the hash leaves about 8 n rows to be sorted, however many
    rows and tasks there are; if chance should leave fewer than n, fewer are taken."""
    order = uniform_bits(F.coalesce(key.cast("string"), F.lit("")))
    share = F.lit(8.0 * n) / F.greatest(rows.select(F.count(F.lit(1))).scalar(), F.lit(1))
    return rows.where(order < share * F.lit(2.0**52)).orderBy(order, *ties).limit(n)
