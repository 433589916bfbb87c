"""Near duplicates by the Jaccard similarity of word shingles: MinHash bands propose cells, exact sets decide in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notespark.llm.common import text_or_empty
from notespark.llm.components import components
from notespark.session import cut_lineage

SHINGLE_WORDS = 5
MIN_JACCARD = 0.8
# A pair of similarity s meets in no band with probability (1 - s**BAND_ROWS)**BANDS: 0.0001 at 0.8.
BANDS = 30
BAND_ROWS = 6
SEED = 42
BLOCK = 1 << 12
TILE_SHINGLES = 1 << 22


def shingle_set(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The different hashes of the text's shingles, sorted. A shorter text is one shingle; no words: none."""
    found = text.lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    shingles, digest = max(1, n - words + 1), xxhash.xxh64_intdigest
    cuts = zip(starts[:shingles].tolist(), ends[np.arange(shingles) + min(words, n) - 1].tolist())
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in cuts), np.uint64, shingles))


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> list[int]:
    """A key for each band of least hashes under fixed permutations; none for an empty set."""
    if not len(hashes):
        return []
    rng = np.random.default_rng(SEED)
    mask, factor = (rng.integers(0, 1 << 64, (bands * rows, 1), np.uint64) for _ in range(2))
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), BLOCK):
        least = np.minimum(least, ((hashes[at : at + BLOCK] ^ mask) * (factor | np.uint64(1))).min(axis=1))
    return [
        int(np.uint64(xxhash.xxh64_intdigest(b.tobytes(), i)).view(np.int64)) for i, b in enumerate(least.reshape(bands, rows))
    ]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common / (len(a) + len(b) - common)


def connect(sets: list[np.ndarray], least: float = MIN_JACCARD) -> list[tuple[int, int]]:
    """Links that connect whatever sets are alike: from each set reached to all not yet reached, whose sizes allow it."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order])
    out = []
    while len(order):
        queue, order, sizes = [int(order[0])], order[1:], sizes[1:]
        while queue and len(order):
            i = queue.pop()
            a, b = np.searchsorted(sizes, [np.ceil(least * len(sets[i]) - 1e-9), len(sets[i]) / least + 1e-9])
            near = np.zeros(len(order), bool)
            near[a:b] = [jaccard(sets[i], sets[j]) >= least for j in order[a:b]]
            out += [(i, int(j)) for j in order[near]]
            queue += order[near].tolist()
            order, sizes = order[~near], sizes[~near]
    return out


def sketches(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """key, set_id, n (size of the set), bands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_buffer().to_pybytes(), words) for t in batch.column(1)]
            arrays = [
                batch.column(0),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "set_id", "n", "bands"])

    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).cast("binary").alias("text"))
    return rows.mapInArrow(work, "key long, set_id binary, n long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """rep, set_id, hashes of the sets wanted (rep, set_id), each once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [shingle_set(t.as_buffer().to_pybytes(), words).tobytes() for t in batch.column(1)]
            ids = pa.array([xxhash.xxh3_128_digest(d) for d in data], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(data, pa.binary())], ["rep", "set_id", "hashes"])

    rows = docs.select(F.col(key).cast("long").alias("rep"), text_or_empty(text).cast("binary").alias("text"))
    made = rows.join(wanted.select("rep").distinct(), "rep", "left_semi").mapInArrow(work, "rep long, set_id binary, hashes binary")
    return made.groupBy("rep", "set_id").agg(F.first("hashes").alias("hashes"))


def links(docs: DataFrame, classes: DataFrame, key: str, text: str, words: int, least: float, tile: int = TILE_SHINGLES) -> DataFrame:
    """a, b: links between classes (rep, set_id, n, bands) that keep all connections of pairs that meet in a band.

    All classes of a band's key go to the cell of the least of them, so that near copies, whose bands agree in that
    least one, are few times in a cell. A cell of over `tile` shingles is cut into tiles by pairs of parts, so that each
    pair still meets in one tile and no task takes a whole large cell.
    """
    placed = classes.select("rep", "set_id", "n", F.explode("bands").alias("band"))
    shared = placed.groupBy("band").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("m")).where("m > 1")
    cells = cut_lineage(placed.join(shared, "band").select("leader", "rep", "set_id", "n").distinct())
    heavy = cells.groupBy("leader").agg(F.ceil(F.sum("n") / F.lit(tile)).cast("int").alias("side")).where("side > 1")
    one = cells.join(heavy, "leader", "left").withColumn("side", F.coalesce("side", F.lit(1)))
    own = F.pmod(F.xxhash64("set_id"), F.col("side")).cast("int")
    tiles = one.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
    tiles = tiles.select("leader", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "rep", "set_id")

    def compare(table: pa.Table) -> pa.Table:
        reps = table.column("rep").to_pylist()
        sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in table.column("hashes")]
        found = [(reps[i], reps[j]) for i, j in connect(sets, least)]
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    with_sets = tiles.join(_sets(docs, cells, key, text, words), ["rep", "set_id"])
    return with_sets.groupBy("leader", "x", "y").applyInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, least: float = MIN_JACCARD
) -> DataFrame:
    """One row per input row: key, component_id, the least key reachable over pairs of Jaccard similarity `least` or more.

    Links are exact: both sets are compared in full. A pair at 0.8 is not proposed with probability 0.0001, one further
    above it far more rarely. Equal sets form a class under their least key before anything is compared.

    Null or empty text: the empty set, alike only to itself; a null key gets the result of its text, and is nobody's
    component unless no other key is there; repeated rows stay; empty table: no rows. Other columns are not read.
    """
    rows = cut_lineage(sketches(docs, key, text, words))
    found = rows.groupBy("set_id").agg(F.min("key").alias("rep"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    classes = cut_lineage(found.where("rep is not null"))
    grouped = components(links(docs, classes, key, text, words, least))
    named = classes.join(grouped, F.col("rep") == F.col("node"), "left").select(
        "set_id", F.coalesce("component", "rep").alias("component_id")
    )
    return rows.join(named, "set_id", "left").select(F.col("key").alias(key), "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of every component: that of the least key. Of rows with the same key and text one stays.

    Rows with a null key can't be named by a component, so all of them stay.
    """
    found = near_duplicates(docs, key, text, **options)
    first = found.where(F.col(key) == F.col("component_id")).select(F.col(key).alias("__kept_key")).distinct()
    known = docs.where(F.col(key).isNotNull()).join(first, F.col(key) == F.col("__kept_key"), "left_semi")
    return known.dropDuplicates([key, text]).unionByName(docs.where(F.col(key).isNull()))
