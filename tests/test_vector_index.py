import numpy as np
import pytest
from pyspark.sql import functions as F

from notespark.operators import links, vector_index
from notespark.plans.catalog import QUERIES


def brute(rows, is_query, top=20):
    ids = np.array([i for i, _ in rows])
    unit = vector_index.unit_rows(np.array([v for _, v in rows], np.float64))
    out = {}
    for i in np.flatnonzero([is_query(int(k)) for k in ids]):
        alike = np.round(unit @ unit[i], 6)
        order = [int(ids[j]) for j in np.lexsort((ids, -alike)) if j != i]
        out[int(ids[i])] = order[:top]
    return out


def lists(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(out[r.query_id])
    return out


def recall(found, want):
    return sum(len({*found.get(q, [])} & {*w}) for q, w in want.items()) / sum(map(len, want.values()))


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 50 == 0)
    found = lists(QUERIES["vector_links_many"](spark, f"/root/testdata/{folder}"))
    assert found.keys() == want.keys() and all(len(x) == 20 for x in found.values())
    assert recall(found, want) >= 0.9


def test_clustered_vectors_look_into_few_cells(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(size=16) * 0.1]) for i in range(2400)]
    df = frame(spark, rows)
    cells = vector_index.learn(df)
    assert cells.probes <= 0.25 * len(cells.centres)
    found = lists(vector_index.nearest(df, F.col("vec_id") % 50 == 0, cells=cells))
    assert recall(found, brute(rows, lambda i: i % 50 == 0)) >= 0.9


def test_all_cells_are_exact_and_agree_with_one_anchor(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 7)
    monkeypatch.setattr(vector_index, "PACK_QUERIES", 3)
    monkeypatch.setattr(vector_index, "HELD_QUERIES", 4)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(300 + i, [1.0] * 8) for i in range(60)]
    df = frame(spark, rows)
    found = vector_index.nearest(df, F.col("vec_id") % 50 == 0, exact=True).cache()
    assert lists(found) == brute(rows, lambda i: i % 50 == 0)
    one = links.vector_links(df.withColumn("label", F.lit(1)), F.lit(50)).collect()
    assert [(r.vec_id, r.similarity) for r in one] == [
        (r.vec_id, r.similarity) for r in sorted(found.where("query_id = 50").collect(), key=lambda r: r.rank)
    ]


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [2.0, 0.0]), (6, [None, 1.0]), (7, [-1.0, 0.0])]
    assert lists(vector_index.nearest(frame(spark, rows), F.lit(True), exact=True)) == {1: [5, 7], 5: [1, 7], 7: [1, 5]}
    assert vector_index.nearest(frame(spark, []), F.lit(True)).count() == 0
    assert vector_index.nearest(frame(spark, rows), F.lit(None).cast("boolean")).count() == 0
