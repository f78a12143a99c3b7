"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoloom.llm import ann as A


def brute(ids, x, queries, k=20):
    out = {}
    for n, i in enumerate(ids):
        if i in queries:
            scores = sorted((-float((x[m] * x[n]).sum()), j) for m, j in enumerate(ids) if j != i)
            out[i] = scores[:k]
    return out


def recall(got, want):
    hit = sum(len({j for _, j in want[i]} & set(got.get(i, ()))) for i in want)
    return hit / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_reaches_recall(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    want = brute(ids, x, {i for i in ids if i % 20 == 0})
    got, scores = {}, {}
    for r in A.op9_nearest_neighbours(spark, f"/root/testdata/{sf}").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        scores[r.query_id, r.vec_id] = r.score
        assert r["rank"] == len(got[r.query_id])
    assert recall(got, want) >= 0.9
    at = {i: n for n, i in enumerate(ids)}
    assert all(abs(s - x[at[q]] @ x[at[i]]) < 1e-12 for (q, i), s in scores.items())


@pytest.mark.parametrize("clustered", [False, True])
def test_many_blocks(spark, monkeypatch, clustered):
    """Small blocks and samples, vectors of unequal norm, and copies of one vector in a third of the rows."""
    monkeypatch.setattr(A, "BLOCK", 64)
    monkeypatch.setattr(A, "QUERY_BLOCK", 32)
    monkeypatch.setattr(A, "SAMPLE", 600)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 12)) * rng.uniform(0.5, 2, (900, 1))
    if clustered:
        x += 4 * rng.normal(size=(9, 12))[rng.integers(0, 9, 900)]
    x[::3] = x[0]
    vectors = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, score string")
    want = brute(list(range(900)), x, set(range(0, 900, 20)))
    got = {}
    for r in A.search(vectors, vectors.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert recall(got, want) >= 0.9
    assert all(len(v) == 20 for v in got.values())


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (20, [0.5, 0.5]), (8, [1.0, 0.0]), (None, [1.0, 1.0]), (40, [1.0, 0.0]), (60, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = [tuple(r) for r in A.search(vectors, vectors.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [
        (0, 1, 8, 1.0), (0, 2, 40, 1.0), (0, 3, 20, 0.5),
        (20, 1, 0, 0.5), (20, 2, 8, 0.5), (20, 3, 40, 0.5),
        (40, 1, 0, 1.0), (40, 2, 8, 1.0), (40, 3, 20, 0.5),
    ]
    assert A.search(vectors.limit(0), vectors).count() == 0
    assert A.search(vectors, vectors.limit(0)).count() == 0


def test_every_length_is_searched(spark):
    """Vectors meet those of their own length, whichever is most frequent."""
    rows = [(i, [1.0, float(i)]) for i in range(1, 20)] + [(20, [2.0]), (40, [3.0]), (60, [1.0, 1.0]), (20, [2.0]), (80, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in A.search(vectors, vectors.where("vec_id % 20 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 40, 6.0), (40, 1, 20, 6.0), (60, 1, 19, 20.0), (60, 2, 18, 19.0), (60, 3, 17, 18.0)]


def test_narrow_walk_is_widened(spark, monkeypatch):
    """Leaves of fewer than k candidates: a query opens more of them, and blocks without queries give nothing."""
    fit = A.fit
    monkeypatch.setattr(A, "fit", lambda *a, **k: A.Tree(**{**vars(fit(*a, **k, leaf_size=8)), "visits": 1}))
    monkeypatch.setattr(A, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(60, 8)) * 10, 15, axis=0) + rng.normal(size=(900, 8)) / 100
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for queries in ("vec_id in (20, 800)", "vec_id % 20 = 0", "false"):
        asked = vectors.where(queries)
        got = A.search(vectors, asked).groupBy("query_id").count().collect()
        assert len(got) == asked.count() and all(r["count"] == 20 for r in got)


def test_calibration_holds_queries_out():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 16))
    tree = A.fit(x, float(np.sqrt((x * x).sum(axis=1)).max()))
    assert 1 < tree.visits <= tree.leaves
    assert A.fit(x[:1], 1.0).visits == 1 and A.fit(x[:0], 1.0).leaves == 1
