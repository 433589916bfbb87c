"""Hard negatives from vectors in Hilbert-ordered blocks, of which bounds decide which ones an anchor has to read.

Vectors are packed into Parquet blocks along a Hilbert curve, each with the least and greatest value of every dimension (its
zone map) and of the label. Interval arithmetic over a zone map bounds the inner products of an anchor with a whole block.
An anchor's own block gives a first bound of its positives; it then reads the blocks that may hold better ones, and for the
negatives the blocks that may hold a score in one of its windows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notespark.operators.skew import first_per_key
from notespark.session import cut_lineage, ensure_checkpoint_dir

BLOCK_ROWS, PACK_ANCHORS, ZONES_PER_GROUP = 256, 256, 1024
BITS = 2
POSITIVES, NEGATIVES, SCALE = 5, 5, 256.0
LEAST_PERCENT = 80
# Below this, sums of float64 products are exact, and so are they times a hundred.
EXACT = 2.0**46
NO_KEY = (1 << 63) - 1


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Places on a Hilbert curve of rows of cell numbers of so many bits, as bytes that sort like numbers.

    The curve is walked by axes: from the highest bit down, a set bit flips the lower bits of the first axis, a clear one
    swaps them with those of the axis at hand; then the axes are Gray-coded and their bits interleaved.
    """
    x, n = cells.astype(np.uint32).T.copy(), cells.shape[1]
    for bit in range(bits - 1, 0, -1):
        low = np.uint32((1 << bit) - 1)
        for axis in range(n):
            on = (x[axis] >> bit) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(on, low, swap).astype(np.uint32)
            if axis:
                x[axis] ^= swap.astype(np.uint32)
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> bit) & 1 == 1, np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= turn
    woven = np.stack([(x >> bit) & 1 for bit in range(bits - 1, -1, -1)]).reshape(bits * n, -1)
    return [row.tobytes() for row in np.packbits(woven.T.astype(np.uint8), axis=1)]


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector between low and high, for all zones."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    far = np.abs(anchors).max(initial=0) * np.maximum(np.abs(low), np.abs(high)).max(initial=0) * max(1, anchors.shape[1])
    return (least, most) if far < EXACT else (np.full_like(least, -np.inf), np.full_like(most, np.inf))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as floats."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < EXACT:
        return a @ b.T
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return whole(a).dot(whole(b).T)


def _matrix(packed: list[bytes] | bytes, kind: str, width: int) -> np.ndarray:
    raw = packed if isinstance(packed, bytes) else b"".join(packed)
    return np.frombuffer(raw, kind).reshape(-1, width).astype(np.float64)


def mapped(df: DataFrame, schema: str, work: Callable[[dict], Iterator[tuple]], rows_out: int = 4096) -> DataFrame:
    """``work`` yields rows for each row, as dictionary; Arrow batches in between."""
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                for row in work({n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}):
                    held.append(row)
                    if len(held) >= rows_out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    return df.mapInArrow(run, target)


def write_blocks(rows: DataFrame, folder: str, bits: int, block_rows: int) -> tuple[str, int]:
    """Blocks of rows (key, label, v, anchor) ordered by label and Hilbert place; the type and number of dimensions.

    Cells of a dimension are cut at its mean and two thirds of a standard deviation on either side, about its quarters.
    """
    kind = "<f4" if rows.schema["v"].dataType.elementType.typeName() == "float" else "<f8"
    axes = (
        rows.select(F.posexplode("v").alias("axis", "x"))
        .groupBy("axis")
        .agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread"))
        .orderBy("axis")
        .collect()  # one row for each dimension
    )
    width, steps = max(1, len(axes)), (1 << bits) - 1
    shifts = np.linspace(-0.67, 0.67, steps) if steps > 1 else np.zeros(1)
    edges = np.array([[a.mean + a.spread * shift for a in axes] or [0.0] for shift in shifts])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            full = np.zeros((batch.num_rows, width), kind)
            lengths = np.diff(lists.offsets.to_numpy())
            full[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            cells = (full[None] > edges[:, None, :]).sum(axis=0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], batch.column(4), pa.array([r.tobytes() for r in full], pa.binary()), pa.array(hilbert_keys(cells, bits), pa.binary())],
                ["row", "key", "label", "anchor", "v", "place"],
            )

    order = ["label", "place", "key", "row"]
    ordered = (
        rows.select(F.monotonically_increasing_id().alias("row"), F.coalesce("key", F.lit(NO_KEY)).alias("key"), "label", "v", "anchor")
        .mapInArrow(placed, "row long, key long, label long, anchor boolean, v binary, place binary")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(rows: pa.Table) -> pa.RecordBatch:
            m = _matrix(rows["v"].to_pylist(), kind, width)
            labels = rows["label"].to_pylist()
            fields = {
                "block": [rows["row"][0].as_py()],
                "n": [len(m)],
                "label_low": [min(labels)],
                "label_high": [max(labels)],
                "low": [m.min(axis=0).astype(kind).tobytes()],
                "high": [m.max(axis=0).astype(kind).tobytes()],
                "rows": [rows["row"].to_pylist()],
                "keys": [rows["key"].to_pylist()],
                "labels": [labels],
                "anchors": [rows["anchor"].to_pylist()],
                "vectors": [m.astype(kind).tobytes()],
            }
            return pa.RecordBatch.from_pydict(fields)

        for batch in batches:
            held.append(batch)
            whole = pa.Table.from_batches(held)
            while len(whole) >= block_rows:
                yield out(whole[:block_rows])
                whole = whole[block_rows:]
            held = whole.to_batches()
        if held and sum(map(len, held)):
            yield out(pa.Table.from_batches(held))

    ordered.mapInArrow(
        packed,
        "block long, n long, label_low long, label_high long, low binary, high binary, rows array<long>, "
        "keys array<long>, labels array<long>, anchors array<boolean>, vectors binary",
    ).write.parquet(folder)
    return kind, width


class Miner:
    """The steps of a search over written blocks."""

    def __init__(self, blocks: DataFrame, kind: str, width: int, zones_per_group: int, pack_anchors: int) -> None:
        self.blocks, self.kind, self.width, self.pack = blocks, kind, width, pack_anchors
        self.groups = max(1, -(-blocks.count() // zones_per_group))

    def anchors(self, positives: int) -> DataFrame:
        """Anchors with the score that their positives have at least, by the rows of their own block."""
        kind, width = self.kind, self.width

        def work(r: dict) -> Iterator[tuple]:
            own = np.flatnonzero(r["anchors"])
            if not len(own):
                return
            m, labels = _matrix(r["vectors"], kind, width), np.array(r["labels"])
            scores = products(m[own], m)
            for k, i in enumerate(own):
                same = labels == labels[i]
                same[i] = False
                best = sorted(scores[k][same])[-positives:]
                least = int(best[0]) if len(best) == positives else None
                yield (r["rows"][i], r["keys"][i], r["labels"][i], m[i].astype(kind).tobytes(), least)

        return mapped(
            self.blocks.select("rows", "keys", "labels", "anchors", "vectors"),
            "row long, key long, label long, v binary, least long",
            work,
        )

    def read(self, anchors: DataFrame, same_label: bool, wanted: Callable, found: Callable, schema: str) -> DataFrame:
        """Rows that ``found`` takes from the blocks that ``wanted`` asks for.

        Anchors are packed; a pack meets the zone maps of a group of blocks at a time, asks for blocks, and goes on to each
        with those of its anchors that want it. Packs and groups have a bounded size, so no task holds all anchors, all
        zone maps or all that want a block.
        """
        kind, width, groups = self.kind, self.width, self.groups
        packs = F.ceil(anchors.agg(F.count(F.lit(1))).scalar() / F.lit(self.pack)).cast("long")
        packed = (
            anchors.groupBy(F.pmod(F.xxhash64("row"), F.greatest(packs, F.lit(1))).alias("pack"))
            .agg(F.collect_list(F.struct(*anchors.columns)).alias("anchors"))
            .withColumn("zone", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        )
        zone = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")
        zones = self.blocks.groupBy(zone.alias("zone")).agg(
            F.collect_list(F.struct("block", "label_low", "label_high", "low", "high")).alias("zones")
        )

        def ask(r: dict) -> Iterator[tuple]:
            a, z = r["anchors"], r["zones"]
            m = _matrix([x["v"] for x in a], kind, width)
            least, most = bounds(m, *(_matrix([x[c] for x in z], kind, width) for c in ("low", "high")))
            labels = np.array([x["label"] for x in a])[:, None]
            low, high = (np.array([x[c] for x in z])[None] for c in ("label_low", "label_high"))
            may = (low <= labels) & (labels <= high) if same_label else (low != high) | (low != labels)
            may &= wanted(a, least, most)
            for k in np.flatnonzero(may.any(axis=0)):
                yield (z[k]["block"], [a[i] for i in np.flatnonzero(may[:, k])])

        element = anchors.schema.simpleString()
        asked = mapped(packed.join(zones, "zone").select("anchors", "zones"), f"block long, anchors array<{element}>", ask, 64)

        def take(r: dict) -> Iterator[tuple]:
            a, keys, rows = r["anchors"], np.array(r["keys"]), np.array(r["rows"])
            scores = products(_matrix([x["v"] for x in a], kind, width), _matrix(r["vectors"], kind, width))
            labels = np.array(r["labels"])
            for x, own in zip(a, scores):
                fits = (labels == x["label"]) & (rows != x["row"]) if same_label else labels != x["label"]
                yield from found(x, own[fits], keys[fits], rows[fits])

        blocks = self.blocks.select("block", "rows", "keys", "labels", "vectors")
        return mapped(asked.join(blocks, "block"), schema, take)


def _first(scores: np.ndarray, keys: np.ndarray, rows: np.ndarray, n: int) -> list[int]:
    """Places of the n highest scores, ties by key and row. Only what reaches the n-th score is sorted."""
    near = np.arange(len(scores))
    if len(scores) > n:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
    return sorted(near, key=lambda i: (-scores[i], keys[i], rows[i]))[:n]


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    label: str | Column = "label",
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
    scale: float = SCALE,
    bits: int = BITS,
    block_rows: int = BLOCK_ROWS,
    pack_anchors: int = PACK_ANCHORS,
    zones_per_group: int = ZONES_PER_GROUP,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, exactly.

    Components are floor(scale * x); a score is the integer inner product with the anchor. Positives are the first
    ``positives`` other rows of the anchor's label, negatives of a positive the first ``negatives`` rows of other labels
    whose score is between ``least_percent`` of the positive's and the positive's. Higher scores are first, ties by key.

    Runs jobs: blocks are written to the shared checkpoint folder, anchors and their positives are checkpointed. What an
    anchor needn't read depends on the data: bounds of vectors without any structure exclude next to nothing in many
    dimensions, and then every anchor is compared with every row, in blocks.

    Rows with a null label, a null vector or a null or non-finite component take no part. Each row counts by itself, also
    of equal rows, so an anchor that is there twice has its rows twice; an anchor is not its own positive. Null keys come
    last in ties and stay null (the greatest long stands for them). Shorter vectors are filled with zeros; vectors without
    components score 0. An anchor without positives, and a positive without negatives, give no row. Empty table: no rows.
    Scores beyond 64 bits stop the query. Other columns are not read.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    marked = vectors.withColumn("_anchor", F.coalesce(is_anchor, F.lit(False)))
    x, of = F.col(vector), F.col(label) if isinstance(label, str) else label
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    # From 2 ** 52 on doubles are whole; of a single-precision component the whole part is single-precision too.
    scaled = F.transform(x, lambda v: v.cast("double") * F.lit(scale))
    whole = F.transform(scaled, lambda v: F.when(F.abs(v) < F.lit(2.0**52), F.floor(v).cast("double")).otherwise(v))
    if vectors.schema[vector].dataType.elementType.typeName() == "float" and math.log2(scale).is_integer():
        whole = whole.cast("array<float>")
    rows = marked.where(of.isNotNull() & x.isNotNull() & finite).select(
        F.col(key).cast("long").alias("key"), of.cast("long").alias("label"), whole.alias("v"), F.col("_anchor").alias("anchor")
    )
    folder = f"{spark.sparkContext.getCheckpointDir()}/vector-blocks-{uuid4().hex}"
    kind, width = write_blocks(rows, folder, bits, block_rows)
    miner = Miner(spark.read.parquet(folder), kind, width, zones_per_group, pack_anchors)

    def near(a: list[dict], least: np.ndarray, most: np.ndarray) -> np.ndarray:
        return most >= np.array([-np.inf if x["least"] is None else x["least"] for x in a])[:, None]

    def best(x: dict, scores: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> Iterator[tuple]:
        for i in _first(scores, keys, rows, positives):
            yield (x["row"], x["key"], x["label"], x["v"], int(scores[i]), int(keys[i]), int(rows[i]))

    anchors = cut_lineage(miner.anchors(positives))
    pairs = miner.read(
        anchors, True, near, best, "row long, anchor long, label long, v binary, score long, key long, positive long"
    )
    order = [F.desc("score"), F.asc("key"), F.asc("positive")]
    chosen = first_per_key(pairs, ["row"], order, positives, "n")
    windows = cut_lineage(
        chosen.groupBy("row").agg(
            *[F.any_value(c).alias(c) for c in ("anchor", "label", "v")],
            F.array_sort(F.collect_list(F.struct("n", "key", "score"))).alias("p"),
        )
    )

    def between(a: list[dict], least: np.ndarray, most: np.ndarray) -> np.ndarray:
        may = np.zeros(least.shape, bool)
        for n in range(positives):
            score = np.array([x["p"][n]["score"] if n < len(x["p"]) else np.nan for x in a])[:, None]
            may |= (least <= score) & (most * 100 >= score * least_percent)
        return may

    def in_windows(x: dict, scores: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> Iterator[tuple]:
        for p in x["p"]:
            fits = (scores * 100 >= p["score"] * least_percent) & (scores <= p["score"])
            if fits.any():
                s, k, r = scores[fits], keys[fits], rows[fits]
                for i in _first(s, k, r, negatives):
                    yield (x["row"], x["anchor"], p["n"], p["key"], p["score"], int(s[i]), int(k[i]), int(r[i]))

    found = miner.read(
        windows, False, between, in_windows,
        "row long, anchor long, n int, positive long, positive_score long, score long, key long, negative long",
    )
    ranked = first_per_key(found, ["row", "n"], [F.desc("score"), F.asc("key"), F.asc("negative")], negatives)
    named = lambda c: F.nullif(F.col(c), F.lit(NO_KEY))
    return ranked.select(
        named("anchor").alias("anchor_id"),
        named("positive").alias("positive_id"),
        "rank",
        named("key").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
