"""Pivot search against all pairs: clusters, ties, shared vectors, small blocks; and how many pairs it compares."""

import numpy as np
import pytest

from loam.operators import neighbours, vectors


def frame(spark, ids, v, name):
    return spark.createDataFrame([(int(i), None if x is None else [float(c) for c in x]) for i, x in zip(ids, v)], f"{name} long, embedding array<float>")


def clustered(n=600, dim=16, groups=12, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    return (centre[rng.integers(0, groups, n)] + 0.05 * rng.normal(size=(n, dim))).astype(np.float32)


def both(spark, q, x, k, **kw):
    got = neighbours.knn(q, x, k, **kw)
    want = vectors.knn(q.filter("embedding is not null"), x.filter("embedding is not null"), k)
    key = lambda d: sorted(tuple(r) for r in d.select("query_id", "pos", "item_id", "distance").collect())
    a, b = key(got), key(want)
    assert len(a) == len(b)
    assert [(r[0], r[1], r[2]) for r in a] == [(r[0], r[1], r[2]) for r in b]
    assert np.allclose([r[3] for r in a], [r[3] for r in b], atol=2e-6)


@pytest.mark.parametrize("kw", [{}, {"most_pivots": 3}, {"block": 40}])
def test_equal_to_all_pairs(spark, kw):
    v = clustered()
    v[100:160] = v[7]  # one vector that many share
    x = frame(spark, range(600), v, "item_id")
    both(spark, x.withColumnRenamed("item_id", "query_id"), x, 4, **kw)


def test_clusters_are_not_compared_with_each_other(spark):
    v = clustered(1500)
    x = frame(spark, range(1500), v, "item_id")
    seen = []
    neighbours.knn(x.withColumnRenamed("item_id", "query_id"), x, 4, seen=seen).count()
    assert sum(n for what, n in seen if what == "compared") < 0.3 * dict(seen)["all"]


def test_edge_cases(spark):
    x = frame(spark, [1, 2, 3], [[0, 1], [1, 0], None], "item_id")
    q = frame(spark, [5, 6], [[0, 1], None], "query_id")
    both(spark, q, x, 4)
    assert neighbours.knn(q, x.limit(0), 4).count() == neighbours.knn(q.limit(0), x, 4).count() == 0
    assert neighbours.knn(q, x.limit(0), 4).columns == ["query_id", "item_id", "distance", "pos"]
