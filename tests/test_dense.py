"""Nearest vectors by cells and blocks against every pair."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import analysis as A
from colloquy.operators import dense as N

VECTORS, QUERIES = "by int, vec_id long, embedding array<float>, cell int", "by int, query_id long, query array<float>"


def made(spark, n, queries, seed=2, dims=16):
    """Vectors around some centres in two groups, one of them hot, with copies and vectors without direction."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    x = (centres[rng.integers(12, size=n)] + 0.35 * rng.normal(size=(n, dims))).astype(np.float32)
    x[n // 2 : n // 2 + 20] = x[0]
    group = (rng.random(n) < 0.2).astype(int)
    rows = [(int(g), k, v.tolist(), 7) for k, (g, v) in enumerate(zip(group, x, strict=True))] + [(0, n + 1, None, 7), (0, n + 2, [], 7), (0, n + 3, [0.0] * dims, 7)]
    asks = [(int(group[k]), k, x[k].tolist()) for k in range(0, n, n // queries)] + [(5, 10**6, x[0].tolist()), (0, 10**6 + 1, None)]
    return spark.createDataFrame(rows, VECTORS), spark.createDataFrame(asks, QUERIES), rows, asks


def plain(rows, asks, k):
    unit = lambda v: np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))
    good = [(g, i, unit(v)) for g, i, v, _ in rows if v and any(v)]
    out = set()
    for g, q, v in asks:
        if v:
            near = sorted((-round(float(unit(v) @ x), 6), i) for h, i, x in good if h == g)[:k]
            out |= {(q, i) for _, i in near}
    return out


@pytest.mark.parametrize("block, few", [(4096, 1024), (40, 7)])
def test_every_cell_gives_the_exact_answer(spark, monkeypatch, block, few):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "QUERIES", few)
    v, q, rows, asks = made(spark, 600, 60)
    got = N.topk(q, v, 4, 8, None)
    assert {(r.query_id, r.vec_id) for r in got.collect()} == plain(rows, asks, 4)
    assert Counter(r.rank for r in got.where("query_id = 0").collect()) == Counter([1, 2, 3, 4])


def test_recall_of_some_cells(spark):
    v, q, rows, asks = made(spark, 3000, 150)
    exact = spark.createDataFrame(sorted(plain(rows, asks, 4)), "query_id long, vec_id long")
    assert N.recall(N.topk(q, v, 4, 16, 4, sample=800), exact) >= 0.95
    assert N.recall(N.topk(q, v, 4, 16, 1, sample=800), exact) >= 0.6


def test_no_vectors(spark):
    v, q, _, _ = made(spark, 60, 6)
    assert N.topk(q, v.limit(0), 4).count() == 0 == N.topk(q.limit(0), v, 4).count()
    assert N.centroids(v.where(F.lit(False)), 4).shape[0] == 0


def test_all_pairs_in_blocks_with_those_without_a_cosine_last(spark):
    v = [(1, 1, [1.0, 0.0]), (1, 2, None), (1, 3, [0.0, 0.0]), (1, 4, [1.0, 1.0]), (1, 5, [1.0, 0.0, 0.0]), (1, 6, [float("nan"), 1.0]), (1, 7, []), (None, 8, [1.0, 0.0]), (2, 9, [1.0, 0.0])]
    asks = [(1, 50, [2.0, 0.0]), (1, 51, None), (1, 52, [0.0, 1.0, 0.0]), (2, 53, [0.0, 3.0]), (3, 54, [1.0, 0.0]), (None, 55, [1.0, 0.0])]
    found = A.dense_topk(spark.createDataFrame(asks, "sample_id int, query_id long, query array<float>"), spark.createDataFrame(v, "sample_id int, snapshot_id long, embedding array<float>"))
    got = [tuple(r) for r in found.orderBy("query_id", "rank").collect()]
    assert got[:4] == [(50, 1, 1.0, 1), (50, 4, 0.707107, 2), (50, 2, None, 3), (50, 3, None, 4)]
    assert got[4:8] == [(51, i, None, i) for i in (1, 2, 3, 4)]
    assert got[8:] == [(52, 5, 0.0, 1), (52, 1, None, 2), (52, 2, None, 3), (52, 3, None, 4), (53, 9, 0.0, 1)]
    # pairs are products of blocks, not rows of a join
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan
