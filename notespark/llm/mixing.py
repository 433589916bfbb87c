"""Mixing sources to target weights: packed blocks, multinomial shard counts, pseudorandom permutations of block numbers."""

from __future__ import annotations

from collections.abc import Sequence
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from notespark.llm.common import WORD, text_or_empty, uniform_bits

BLOCK_WORDS = 128
LEAST_BLOCKS = 256
SHARDS = 64
MOST_TIMES = 3
WEIGHTS = (1.0, 2.0, 3.0)
DOCS_PER_CELL = 1000
RUN = 4096


def source_key(column: Column) -> Column:
    """A key that is never null: "=" and the name, or "" for null, which no name gives."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def with_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """Adds the target of every source to src, source_size.

    Sources by code point, null last, take the weights in turn. Targets share the sum of all sizes by weight, but stop
    at `most` times their source's size, what is over being shared again by weight. With sources in the order of limit
    by weight, each is limited if its share of what the ones before leave exceeds its limit; from the first that isn't,
    all get the same share. The window holds one row a source.
    """
    by_name, by_limit = Window.orderBy(F.col("src") == "", "src"), Window.orderBy("ratio", "src")
    nth = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(nth, F.lit(len(weights))) + 1).cast("int"))
    limited = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    limited = limited.withColumn("ratio", F.col("limit") / F.col("weight"))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(0, Window.unboundedFollowing)
    everywhere = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everywhere) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    shared = limited.withColumn("share", left / F.sum("weight").over(onward))
    free = F.when(F.col("weight") * F.col("share") <= F.col("limit"), F.struct("ratio", "src", "share"))
    final = shared.withColumn("final", F.min(free).over(everywhere)["share"])
    target = F.least(F.col("limit").cast("double"), F.col("weight") * F.col("final"))
    return final.withColumn("target", F.coalesce(target, F.lit(0.0))).drop("limit", "ratio", "share", "final")


def shard_counts(draws: Column, src: Column, shards: int, seed: int) -> Column:
    """How many of a source's draws each output shard gets: a multinomial draw, the same for the same source and seed."""

    @pandas_udf(ArrayType(LongType()))
    def split(n: pd.Series, name: pd.Series) -> pd.Series:
        one = [1 / shards] * shards
        made = [np.random.default_rng([seed, crc32(s.encode())]).multinomial(k, one).tolist() for k, s in zip(n, name)]
        return pd.Series(made, dtype=object)

    return split(draws, src)


def permuted(at: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each row the image of `at` under a permutation of 0 .. size - 1 that the key chooses.

    A Feistel network over the least even number of bits that holds size, walked on until the image is below size.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2).astype(np.float64))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = at.astype(np.uint64), np.arange(len(at))
    key, size = key.astype(np.uint64), size.astype(np.uint64)
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for i in range(4):
            mixed = (right + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9) ^ k
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


@pandas_udf(LongType())
def _image(at: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(at.to_numpy(), size.to_numpy(), key.to_numpy()))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


class Mix:
    """The mix of a table of documents.

    Every source's words form one stream, documents in the order of a hash of id and text, cut into blocks of
    `block_words` words (a source of few words: shorter ones, so that it has about LEAST_BLOCKS). A source is drawn as
    many whole passes as fit into its target, then blocks for the rest; a pass takes each block at most once, so no
    document comes up more than `most` times. The draws are dealt over the output shards by a multinomial draw for
    each source, numbered through, and mapped to block numbers by a permutation for each source and pass.

    Null text and text without words: size 0, nothing taken; null source: a source of its own, last; equal rows: each
    for itself; empty table: no rows; null ids are allowed. Reruns agree, as nothing depends on the order of rows.
    """

    def __init__(
        self,
        docs: DataFrame,
        key: str = "doc_id",
        text: str = "text",
        source: str = "source",
        weights: Sequence[float] = WEIGHTS,
        block_words: int = BLOCK_WORDS,
        shards: int = SHARDS,
        most: int = MOST_TIMES,
        seed: int = 0,
    ) -> None:
        self.docs, self.key, self.text, self.source = docs, key, text, source
        self.identity = self._identity()
        rows = docs.select(*self.identity.values()).groupBy("src", "key", "size", "crc").agg(F.count(F.lit(1)).alias("n"))
        stats = rows.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
        length = F.least(F.lit(block_words), F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(LEAST_BLOCKS)))).cast("long")
        target = with_targets(stats, weights, most).withColumn("length", length)
        passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
        plan = target.withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")).cast("long")).withColumn("passes", passes)
        rest = F.round((F.col("target") - F.col("passes") * F.col("source_size")) / F.col("length")).cast("long")
        rest = F.when(F.col("passes") >= most, F.lit(0)).otherwise(F.least(F.col("blocks"), rest))
        self.sources = plan.withColumn("draws", F.col("passes") * F.col("blocks") + F.greatest(rest, F.lit(0)))
        self.shards, self.seed = shards, seed
        self.placed = self._placed(rows)

    def _identity(self) -> dict[str, Column]:
        value = text_or_empty(self.text)
        return {
            "src": source_key(F.col(self.source)).alias("src"),
            "key": F.col(self.key).alias("key"),
            "size": F.regexp_count(value, F.lit(WORD)).cast("long").alias("size"),
            "crc": F.crc32(value.cast("binary")).alias("crc"),
        }

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Every document with the place of its first word in its source's stream.

        A stream is cut by the order's hash into cells of about DOCS_PER_CELL documents, which start where the ones
        before end; so a source with most of the documents is spread over many tasks.
        """
        order = uniform_bits(F.concat_ws("/", F.col("key").cast("string"), "crc", "size", F.lit(f"mix{self.seed}")))
        cells = F.ceil(F.col("docs") / F.lit(DOCS_PER_CELL)).cast("double")
        columns = ["src", "source_size", "target", "length", "docs"]
        rows = rows.withColumn("h", order).join(self.sources.select(*columns), "src")
        # Dealt by cell, as the join before may have dealt by source.
        rows = rows.withColumn("cell", F.floor(F.col("h") * cells / F.lit(2.0**52))).repartition("src", "cell")
        words = F.col("size") * F.col("n")
        before = Window.partitionBy("src").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        starts = rows.groupBy("src", "cell").agg(F.sum(words).alias("words"))
        starts = starts.select("src", "cell", _zero(F.sum("words").over(before)).alias("start"))
        inside = Window.partitionBy("src", "cell").orderBy("h", "key", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
        ranked = rows.withColumn("words", words).withColumn("first", _zero(F.sum("words").over(inside)))
        runs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long")))
        copies = F.explode(F.sequence("run", F.least(F.col("n"), F.col("run") + RUN) - 1))
        copied = ranked.join(starts, ["src", "cell"]).withColumn("run", runs).withColumn("copy", copies)
        return copied.select(
            *columns[:4], "key", "size", "crc", "copy", (F.col("start") + F.col("first") + F.col("copy") * F.col("size")).alias("start")
        )

    def slots(self) -> DataFrame:
        """shard, slot, src, index: which block of which source stands in each place of each output shard."""
        counts = shard_counts(F.col("draws"), F.col("src"), self.shards, self.seed)
        dealt = self.sources.where("draws > 0").select("src", "blocks", F.posexplode(counts).alias("shard", "n"))
        upto = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        runs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long")))
        ranges = dealt.withColumn("first", _zero(F.sum("n").over(upto))).where("n > 0").withColumn("run", runs)
        ranges = ranges.repartition("src", "shard", "run")
        each = F.explode(F.sequence("run", F.least(F.col("n"), F.col("run") + RUN) - 1))
        drawn = ranges.withColumn("slot", each).withColumn("draw", F.col("first") + F.col("slot"))
        pass_key = F.xxhash64("src", F.floor(F.col("draw") / F.col("blocks")), F.lit(self.seed))
        index = _image(F.pmod("draw", "blocks"), F.col("blocks"), pass_key)
        return drawn.select("shard", "slot", "src", index.alias("index"))

    def pieces(self) -> DataFrame:
        """The documents' parts in their blocks, with the times that each was drawn; one row without a block for size 0."""
        first, last = (F.floor(x / F.col("length")) for x in (F.col("start"), F.col("start") + F.col("size") - 1))
        spans = F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(None).cast("long")))
        cut = self.placed.withColumn("index", F.explode(spans))
        begin = F.greatest(F.col("start"), F.col("index") * F.col("length"))
        end = F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * F.col("length"))
        cut = cut.withColumns({"offset": begin - F.col("start"), "words": _zero(end - begin)})
        times = self.slots().groupBy("src", "index").agg(F.count(F.lit(1)).alias("times"))
        # Spark takes the numbered draws for as small as the ranges they come from and would broadcast them.
        return cut.join(times.hint("merge"), ["src", "index"], "left").withColumn("times", _zero(F.col("times")))

    def taken(self) -> DataFrame:
        """One row per input row: key, size, source_size, target, taken."""
        same = ["src", "key", "size", "crc", "copy", "source_size", "target"]
        sums = self.pieces().groupBy(*same).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        return sums.select(F.col("key").alias(self.key), "size", "source_size", "target", "taken")

    def documents(self) -> DataFrame:
        """The mix as documents with the columns of the input: for each time that words of a document are drawn, its
        drawn words in their order. A text that is drawn whole stays as it is; what isn't drawn isn't in the mix."""
        same = ["src", "key", "size", "crc", "copy"]
        parts = (
            self.pieces()
            .where("times > 0")
            .groupBy(*same)
            .agg(
                F.array_sort(F.collect_list(F.struct("offset", "words", "times"))).alias("parts"),
                F.max("times").alias("most"),
            )
        )
        texts = self.docs.select(F.struct("*").alias("row"), *self.identity.values())
        null_safe = F.col("p.key").eqNullSafe(F.col("t.key"))
        equal = [F.col(f"p.{c}") == F.col(f"t.{c}") for c in ("src", "size", "crc")]
        # Equal rows are alike, so each group of them needs its row once; its copies come from the parts.
        joined = parts.alias("p").join(texts.dropDuplicates(["src", "key", "size", "crc"]).alias("t"), [null_safe, *equal])
        turns = joined.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("most"))))
        turns = turns.withColumn("now", F.filter("parts", lambda p: p["times"] >= F.col("turn")))
        words = F.regexp_extract_all(F.col(f"row.{self.text}"), F.lit(f"({WORD})"), 1)
        drawn = F.aggregate("now", F.lit(0).cast("long"), lambda n, p: n + p["words"])
        turns = turns.withColumn("whole", drawn == F.col("p.size")).withColumn("all", F.when(~F.col("whole"), words))
        pieces = F.transform("now", lambda p: F.array_join(F.slice("all", (p["offset"] + 1).cast("int"), p["words"].cast("int")), " "))
        text = F.when(F.col("whole"), F.col(f"row.{self.text}")).otherwise(F.array_join(pieces, " "))
        out = turns.withColumn("new_text", text)
        replaced = {self.text.lower(): F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
        return out.select(*[replaced.get(c.lower(), F.col(f"row.`{c}`")).alias(c) for c in self.docs.columns])
