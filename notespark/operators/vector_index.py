"""Nearest vectors of many vectors at once, through cells of a coarse quantiser.

Every row lies in the cell of its nearest centre. A query looks into the cells nearest to it, and what lies there is
compared exactly. Centres and the number of cells to look into are learnt from a bounded sample of rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notespark import params
from notespark.operators.skew import first_per_key
from notespark.session import ensure_checkpoint_dir

# Tasks get these functions with the plan, so executors needn't have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bounds of what is learnt on the driver: rows of the sample, cells, rounds of moving the centres.
SAMPLE_ROWS, MAX_CELLS, ROUNDS = 16_384, 1024, 8
# Sampled rows that are compared with the whole sample to see how many cells a query needs for this share of its nearest.
TRIALS, WANTED_SHARE = 512, 0.97
BLOCK_ROWS, PACK_QUERIES = 4096, 256
# Queries whose best rows a task holds before it hands them on.
HELD_QUERIES = 65_536


@dataclass
class Cells:
    """Centres of unit length, and how many cells a query looks into."""

    centres: np.ndarray
    probes: int

    def order(self, unit: np.ndarray) -> np.ndarray:
        """Cells of each row, the nearest first; ties by number."""
        return np.argsort(-(unit @ self.centres.T), axis=1, kind="stable")


def unit_rows(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def usable(vector: Column) -> Column:
    """Vectors that have a cosine: no null or non-finite component, and not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def learn(vectors: DataFrame, top: int = params.MAX_SUGGESTIONS, cells: int | None = None, wanted: float = WANTED_SHARE) -> Cells:
    """Centres from at most about ``SAMPLE_ROWS`` rows, drawn by a hash of the vector, and the number of cells to look into.

    Cells are as many as the square root of the rows by default, ``MAX_CELLS`` at most. The number to look into is the
    least that holds ``wanted`` of the ``top`` nearest sampled rows of sampled rows; vectors without structure need many.
    """
    total = vectors.count()
    drawn = F.xxhash64("embedding").cast("double") / F.lit(2.0**64) + 0.5
    sample = vectors.where(drawn < F.lit(SAMPLE_ROWS / max(total, 1))).orderBy(F.xxhash64("embedding")).limit(2 * SAMPLE_ROWS)
    rows = [r.embedding for r in sample.select("embedding").collect()] or [r.embedding for r in vectors.limit(1).collect()]
    if not rows:
        return Cells(np.zeros((1, 0)), 1)
    unit = unit_rows(np.array(rows, np.float64))
    cells = min(cells or round(total**0.5), MAX_CELLS, len(unit))
    centres = unit[np.linspace(0, len(unit) - 1, max(1, cells)).astype(int)]
    for _ in range(ROUNDS):
        nearest = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        filled = np.bincount(nearest, minlength=len(centres)) > 0
        centres = np.where(filled[:, None], unit_rows(sums), centres)
    found = Cells(centres, 1)
    trials = unit[np.linspace(0, len(unit) - 1, min(TRIALS, len(unit))).astype(int)]
    near = np.argsort(-(trials @ unit.T), axis=1, kind="stable")[:, : top + 1]
    home = np.argmax(unit @ centres.T, axis=1)
    place = np.argsort(found.order(trials), axis=1)  # of each cell in each trial's order
    needed = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    found.probes = int(needed[min(len(needed) - 1, int(np.ceil(wanted * len(needed))) - 1)]) + 1
    return found


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def write_cells(vectors: DataFrame, cells: Cells, folder: str) -> None:
    """Every row under its cell, in blocks of at most ``BLOCK_ROWS``: ``cell, ids, vectors``.

    Rows are ordered by cell and number over all tasks, so a cell that holds a large share of the rows (copies of one vector,
    say) is many blocks in many tasks.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(cells)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                unit = unit_rows(_matrix(b.column("embedding"), b.num_rows))
                cell = np.argmax(unit @ shared.value.centres.T, axis=1).astype(np.int32)
                rows = pa.array([r.tobytes() for r in unit], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell), b.column("vec_id"), rows], ["cell", "vec_id", "unit"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            held = pa.concat_tables([*([held] if held else []), pa.Table.from_batches([b])])
            while len(held):
                cell = held["cell"].to_numpy()
                many = min(int(np.searchsorted(cell, cell[0], "right")), BLOCK_ROWS)
                if many == len(held) < BLOCK_ROWS:
                    break  # more of this cell may follow
                yield block(held[:many])
                held = held[many:]
        if held:
            yield block(held)

    def block(rows: pa.Table) -> pa.RecordBatch:
        ids, unit = rows["vec_id"].to_pylist(), b"".join(rows["unit"].to_pylist())
        columns = [pa.array([rows["cell"][0].as_py()], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([unit], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["cell", "ids", "vectors"])

    rows = vectors.select("vec_id", "embedding").mapInArrow(placed, "cell int, vec_id long, unit binary")
    ordered = rows.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id")
    ordered.mapInArrow(packed, "cell int, ids array<long>, vectors binary").write.parquet(folder)


def nearest(
    vectors: DataFrame, is_query: Column, top: int = params.MAX_SUGGESTIONS, cells: Cells | None = None, exact: bool = False
) -> DataFrame:
    """``(query_id, rank, vec_id, similarity)``: the ``top`` nearest other rows of every row for which ``is_query`` holds.

    ``vectors`` has ``vec_id`` and ``embedding``. Similarities are exact cosines in six decimals; the nearest rows are
    found among those of the cells looked into, so a share of them (``wanted`` in ``learn``) may be missing. ``exact``
    looks into all cells. Rows without a cosine (null, zero or non-finite) take no part. Ties by ``vec_id``.

    Runs jobs: the sample, and blocks of rows, written to the shared checkpoint folder. Queries go to cells in packs; a pack
    meets one cell's blocks one after the other; a task hands on the best of all that it has compared a query with.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    rows = vectors.where(usable(F.col("embedding")))
    cells = cells or learn(rows, top)
    folder = f"{spark.sparkContext.getCheckpointDir()}/cells-{uuid4().hex}"
    write_cells(rows, cells, folder)
    blocks = spark.read.parquet(folder)
    shared, probes = spark.sparkContext.broadcast(cells), len(cells.centres) if exact else cells.probes

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            unit, ids = unit_rows(_matrix(b.column("embedding"), b.num_rows)), b.column("vec_id").to_numpy()
            asked = shared.value.order(unit)[:, :probes]
            order = np.argsort(asked.ravel(), kind="stable")
            query, cell = order // asked.shape[1], asked.ravel()[order]
            bounds = np.flatnonzero(np.diff(cell, prepend=-1)).tolist() + [len(cell)]
            for first, last in zip(bounds, bounds[1:]):
                for at in range(first, last, PACK_QUERIES):
                    part = query[at : min(at + PACK_QUERIES, last)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(cell[at])], pa.int32()), pa.array([ids[part]], pa.list_(pa.int64())), pa.array([unit[part].tobytes()], pa.binary())],
                        ["cell", "queries", "asked"],
                    )

    queries = rows.where(F.coalesce(is_query, F.lit(False))).select("vec_id", "embedding")
    packs = queries.mapInArrow(ask, "cell int, queries array<long>, asked binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def told() -> pa.RecordBatch:
            query = np.repeat(np.array([*best], np.int64), [len(ids) for ids, _ in best.values()])
            columns = [query, *(np.concatenate(c) for c in zip(*best.values()))]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "similarity"])

        for b in batches:
            for i in range(b.num_rows):
                ids, queries = (b.column(c)[i].values.to_numpy() for c in ("ids", "queries"))
                m, q = (np.frombuffer(b.column(c)[i].as_py()).reshape(len(n), -1) for c, n in (("vectors", ids), ("asked", queries)))
                for query, own in zip(queries.tolist(), np.round(q @ m.T, 6)):
                    at = np.flatnonzero(ids != query)
                    if len(at) > top:
                        at = at[own[at] >= np.partition(own[at], len(at) - top)[len(at) - top]]
                    near, alike = ids[at], own[at]
                    if query in best:
                        near, alike = np.append(best[query][0], near), np.append(best[query][1], alike)
                    first = np.lexsort((near, -alike))[:top]
                    best[query] = near[first], alike[first]
                if len(best) >= HELD_QUERIES:
                    yield told()
                    best.clear()
        if best:
            yield told()

    found = packs.join(blocks, "cell").mapInArrow(compare, "query_id long, vec_id long, similarity double")
    ranked = first_per_key(found, ["query_id"], [F.desc("similarity"), F.asc("vec_id")], top)
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "similarity")
