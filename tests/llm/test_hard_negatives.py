import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notespark.llm import hard_negatives as hn
from notespark.llm.queries import op12_hard_negatives

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, is_anchor, positives=5, negatives=5, percent=80):
    """rows: (key, label, vector). Every anchor against every row."""
    kept = [
        (i, k, label, [math.floor(256 * x) for x in v])
        for i, (k, label, v) in enumerate(rows)
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda r: (-r[0], r[1] is None, r[1])
    out = []
    for i, k, label, v in kept:
        if not is_anchor(k):
            continue
        scored = [(dot(v, w), kk, ll) for j, kk, ll, w in kept if j != i]
        for p in sorted((s for s in scored if s[2] == label), key=order)[:positives]:
            near = [s for s in scored if s[2] != label and percent * p[0] <= 100 * s[0] <= 100 * p[0]]
            for rank, n in enumerate(sorted(near, key=order)[:negatives], 1):
                out.append((k, p[1], rank, n[1], p[0], n[0]))
    return sorted(out, key=str)


def result(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def table(spark):
    def make(rows, vector="array<float>"):
        return spark.createDataFrame(rows, f"vec_id long, label int, embedding {vector}").withColumns(
            {c: F.lit("x") for c in ("key", "row", "v", "anchor", "block", "place", "n", "p", "_x")}
        )

    return make


def every_tenth():
    return F.col("vec_id") % 10 == 0


def tenth(k):
    return k is not None and k % 10 == 0


@pytest.mark.parametrize("clusters", [0, 6])
def test_brute_force(table, clusters):
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(clusters or 1, 12)) * (clusters > 0)
    rows = []
    for i in range(700):
        c = i % (clusters or 1)
        v = centres[c] + rng.normal(size=12) * 0.3
        rows.append((i, (c + (i % 11 == 0)) % 5 if clusters else int(rng.integers(4)), [float(np.float32(x)) for x in v]))
    want = brute(rows, tenth)
    assert want and result(hn.mine(table(rows), every_tenth())) == want
    assert result(hn.mine(table(rows), every_tenth(), block_rows=7, pack_anchors=3, zones_per_group=10, bits=1)) == want


def test_odd_rows(table):
    rng = random.Random(3)
    vector = lambda: [round(rng.uniform(-1, 1), 1) for _ in range(4)]
    rows = [(i, i % 3, vector()) for i in range(60)]
    rows += [(None, 1, vector()), (None, 2, [0.5] * 4), (10, 1, [0.5] * 4), (10, 1, [0.5] * 4), (11, 2, [0.5] * 4)]
    rows += [(61 + i, i % 3, [0.5] * 4) for i in range(40)]
    rows += [(200, None, vector()), (210, 1, None), (220, 1, [0.1, None]), (230, 1, [float("nan")]), (240, 2, [float("inf")])]
    rows += [(250, 2, []), (260, 2, [1.0]), (270, 1, [0.5] * 6), (-10, 1, vector()), (300, 9, vector())]
    want = brute(rows, tenth)
    assert result(hn.mine(table(rows, "array<double>"), every_tenth(), block_rows=5, pack_anchors=2, zones_per_group=3)) == want
    assert hn.mine(table([]), every_tenth()).count() == 0
    empty = [(10, 1, []), (20, 1, []), (30, 2, [])]
    assert result(hn.mine(table(empty), every_tenth())) == brute(empty, tenth) == [(10, 20, 1, 30, 0, 0), (20, 10, 1, 30, 0, 0)]


def test_large_components_stay_exact(table):
    rows = [(i, i % 2, [float(3**i) * 1.5, float(i) * 1e6 + 0.25, -(3.0**i)]) for i in range(12)]
    want = brute(rows, lambda k: True)
    assert result(hn.mine(table(rows, "array<double>"), F.lit(True))) == want
    assert max(abs(r[4]) for r in want) > 2**53


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, zones = rng.integers(-300, 300, (20, 5)).astype(float), rng.integers(-300, 300, (8, 30, 5)).astype(float)
    least, most = hn.bounds(a, zones.min(axis=1), zones.max(axis=1))
    for z in range(8):
        scores = a @ zones[z].T
        assert (least[:, z] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= most[:, z]).all()


@pytest.mark.parametrize("n, bits", [(2, 3), (3, 2), (2, 1), (4, 2)])
def test_neighbours_on_the_curve_touch(n, bits):
    cells = np.array(np.meshgrid(*[range(1 << bits)] * n)).reshape(n, -1).T
    walk = cells[np.argsort(np.array(hn.hilbert_keys(cells, bits), dtype=object))]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_blocks_that_cannot_matter_are_not_asked_for(table, spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8))
    rows = [(i, i % 2, [float(x) for x in centres[i % 20] + rng.normal(size=8) * 0.02]) for i in range(2000)]
    df = table(rows, "array<double>").select(
        F.col("vec_id").alias("key"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda v: F.floor(v * 256).cast("double")).alias("v"), (F.col("vec_id") % 100 == 0).alias("anchor"),
    )
    kind, width = hn.write_blocks(df, f"{tmp_path}/blocks", 2, 20)
    miner = hn.Miner(spark.read.parquet(f"{tmp_path}/blocks"), kind, width, 1000, 10)
    read = []

    def wanted(a, least, most):
        return most >= np.array([x["least"] for x in a])[:, None]

    rows_read = miner.read(miner.anchors(5), True, wanted, lambda x, s, k, r: [(x["key"], len(s))], "key long, n long")
    read = rows_read.agg(F.sum("n")).first()[0]
    assert read < 0.4 * 20 * 1000


def test_query(spark):
    rows = [
        (r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding)
        for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ]
    want = brute(rows, lambda k: k % 100 == 0)
    assert want and result(op12_hard_negatives(spark, "/root/testdata/sf0.01")) == want
