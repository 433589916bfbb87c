"""Near duplicates by SimHash; neighbours are found over the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notespark.llm.common import text_or_empty
from notespark.llm.components import components
from notespark.session import cut_lineage

SHINGLE_WORDS = 4
DISTANCE = 4
PARTS = 3
SEED = 42
BLOCK = 1 << 15
CELL_ROWS = 50_000


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """64 bits: each is set if it is set in over half of the hashes of the text's shingles. No words: 0."""
    found = text.lower().split()  # bytes: A-Z only, and exactly the blanks of the contract
    n = len(found)
    if not n:
        return 0
    joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    shingles = max(1, n - words + 1)
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, shingles, BLOCK):
        upto = min(k + BLOCK, shingles)
        first, last = starts[k:upto].tolist(), ends[np.arange(k, upto) + min(words, n) - 1].tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > shingles, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """key long, fp long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["key", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).cast("binary").alias("text"))
    return rows.mapInArrow(work, "key long, fp long")


# --- the covering code: parts of the 64 bits, in each a Hamming(15, 11) code beside bits that anchors copy ---------


def part_bits(parts: int) -> list[tuple[int, int]]:
    """(first bit, width) of every part; the last ones are wider."""
    cuts = [64 * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def nearest_codewords() -> np.ndarray:
    """The codeword within one bit of each 15-bit word: the syndrome is the XOR of the numbers 1 to 15 of the set bits."""
    word = np.arange(1 << 15)
    syndrome = np.zeros_like(word)
    for i in range(15):
        syndrome ^= np.where(word >> i & 1, i + 1, 0)
    return np.where(syndrome > 0, word ^ (1 << np.maximum(syndrome - 1, 0)), word)


def home(value: np.ndarray, nearest: np.ndarray) -> np.ndarray:
    """The anchor that covers a part's value: nearest codeword in the low 15 bits, the other bits as they are."""
    return (value >> 15 << 15) | nearest[value & 0x7FFF]


def reach(value: np.ndarray, width: int, threshold: int, nearest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor): every anchor that covers some value within the threshold of value[index]. Each pair once."""
    flips = [sum(1 << b for b in bits) for k in range(threshold + 1) for bits in combinations(range(width), k)]
    anchors = np.sort(home(value[:, None] ^ np.array(flips)[None, :], nearest), axis=1)
    fresh = np.ones(anchors.shape, bool)
    fresh[:, 1:] = anchors[:, 1:] != anchors[:, :-1]
    return np.nonzero(fresh)[0], anchors[fresh]


def placements(classes: DataFrame, parts: int = PARTS, distance: int = DISTANCE) -> DataFrame:
    """part, anchor, home, fp, rep: a class at its own anchor, and at each that may be the home of a neighbour.

    Two fingerprints within `distance` differ in at most distance // parts bits of some part. There the one is found at
    the home of the other: anchors cover with radius one, and a fingerprint goes to all anchors of values that near.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = nearest_codewords()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                fp, rep = (piece.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                bits = fp.view(np.uint64)
                for part, (first, width) in enumerate(part_bits(parts)):
                    value = (bits >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)
                    index, anchor = reach(value, width, distance // parts, nearest)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(index), part, np.int32)),
                            pa.array(anchor),
                            pa.array(anchor == home(value, nearest)[index]),
                            pa.array(fp[index]),
                            pa.array(rep[index]),
                        ],
                        ["part", "anchor", "home", "fp", "rep"],
                    )

    return classes.select("fp", "rep").mapInArrow(work, "part int, anchor long, home boolean, fp long, rep long")


def _links(homes: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray], distance: int) -> list[tuple[int, int]]:
    """Links (representatives) that connect whatever homes and others are within the distance of each other.

    From a home to all others not yet reached, from an other to all homes not yet reached, and so on: each step looks
    only at what is still unconnected, so a dense cell costs about one comparison a member, and gives one link for each.
    """
    sides = [list(homes), list(others)]
    out = []
    while len(sides[0][0]):
        queue = [(0, sides[0][0][0], int(sides[0][1][0]))]
        sides[0] = [x[1:] for x in sides[0]]
        while queue:
            side, fp, rep = queue.pop()
            there_fp, there_rep = sides[1 - side]
            near = np.bitwise_count(there_fp ^ fp) <= distance
            if near.any():
                hits = list(zip(there_fp[near], there_rep[near].tolist()))
                out += [(rep, r) for _, r in hits if r != rep]
                queue += [(1 - side, f, r) for f, r in hits]
                sides[1 - side] = [there_fp[~near], there_rep[~near]]
    return out


def links(placed: DataFrame, distance: int = DISTANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """a, b: links between classes that keep all connections; found anchor by anchor.

    A cell (part and anchor) of over `cell_rows` rows is cut into tiles, homes by rows and others by columns, so that
    each pair of the two still meets in one tile, and no task takes a whole large cell.
    """
    cell = ["part", "anchor"]
    heavy = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows)
    sides = heavy.select(*cell, F.ceil(F.col("n") / F.lit(cell_rows)).cast("int").alias("side"))
    one = placed.join(sides, cell, "left").withColumn("side", F.coalesce("side", F.lit(1)))
    own, every = F.pmod(F.xxhash64("fp"), F.col("side")).cast("int"), F.sequence(F.lit(0), F.col("side") - 1)
    at_home = one.where("home").select(*cell, own.alias("x"), F.explode(every).alias("y"), "home", "fp", "rep")
    around = one.select(*cell, F.explode(every).alias("x"), own.alias("y"), F.lit(False).alias("home"), "fp", "rep")
    together = at_home.unionByName(around).repartition(*cell, "x", "y").sortWithinPartitions(*cell, "x", "y")

    def compare(table: pa.Table) -> Iterator[tuple[int, int]]:
        columns = [table.column(i).to_numpy() for i in range(4)]
        home_, fp, rep = (table.column(i).to_numpy() for i in (4, 5, 6))
        fp = fp.view(np.uint64)
        change = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        starts = np.concatenate(([0], np.nonzero(change)[0] + 1, [len(fp)]))
        count = np.add.reduceat(home_.astype(np.int64), starts[:-1]) if len(fp) else np.zeros(0, int)
        for i in np.nonzero((count > 0) & (np.diff(starts) > count + 1))[0].tolist():
            a, b = starts[i], starts[i + 1]
            h = home_[a:b]
            found = _links((fp[a:b][h], rep[a:b][h]), (fp[a:b][~h], rep[a:b][~h]), distance)
            yield from found

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        seen: set[tuple[int, int]] = set()

        def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
            fresh = {(max(p), min(p)) for p in compare(table)} - seen
            if len(seen) < 1_000_000:
                seen.update(fresh)
            if fresh:
                a, b = zip(*fresh)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            last = [batch.column(i)[batch.num_rows - 1].as_py() for i in range(4)] if batch.num_rows else None
            if last is None:
                continue
            same = np.all([batch.column(i).to_numpy() == last[i] for i in range(4)], axis=0)
            cut = int(np.argmax(same))
            if cut or (kept and [kept[-1].column(i)[0].as_py() for i in range(4)] != last):
                yield from emit(pa.Table.from_batches([*kept, batch.slice(0, cut)]))
                kept = []
            kept.append(batch.slice(cut))
        if kept:
            yield from emit(pa.Table.from_batches(kept))

    return together.mapInArrow(work, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = SHINGLE_WORDS,
    distance: int = DISTANCE,
    parts: int = PARTS,
) -> DataFrame:
    """One row per input row: key, fingerprint (16 hexadecimal digits), component_id, the least key reachable.

    Equal fingerprints form a class under their least key before anything is compared, so copies are never paired.
    More bits in a part, that is fewer `parts`, give more anchors and fewer comparisons for more replicas: 3 suit up
    to some 10^8 different fingerprints, 2 more. Every choice gives the same result.

    Null or empty text: fingerprint zero, linked as any other; a null key gets the result of its text, and is nobody's
    component unless no other key is there; repeated rows stay; empty table: no rows. Other columns are not read.
    """
    rows = cut_lineage(fingerprints(docs, key, text, words))
    classes = rows.groupBy("fp").agg(F.min("key").alias("rep")).where("rep is not null")
    grouped = components(links(placements(classes, parts, distance), distance))
    named = classes.join(grouped, F.col("rep") == F.col("node"), "left").select(
        F.col("fp").alias("class_fp"), F.coalesce("component", "rep").alias("component_id")
    )
    return rows.join(named, F.col("fp") == F.col("class_fp"), "left").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of every component: that of the least key. Of rows with the same key and text one stays.

    Rows with a null key can't be named by a component, so all of them stay.
    """
    found = near_duplicates(docs, key, text, **options)
    first = found.where(F.col(key) == F.col("component_id")).select(F.col(key).alias("__kept_key")).distinct()
    known = docs.where(F.col(key).isNotNull()).join(first, F.col(key) == F.col("__kept_key"), "left_semi")
    return known.dropDuplicates([key, text]).unionByName(docs.where(F.col(key).isNull()))
