"""nearest neighbours of a stated set of queries by matrices, against a plain loop."""

import numpy as np
import pytest

from loam.operators import vectors


@pytest.mark.parametrize("most_bytes", [64 << 20, 2000])
def test_like_a_plain_loop(spark, most_bytes):
    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, (5000, 6)).astype(float)  # many ties
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9999, None)], "item_id long, embedding array<double>")
    asked = list(range(0, 5000, 100))
    q = items.filter("item_id % 100 = 0").withColumnRenamed("item_id", "query_id")
    got = {(r["query_id"], r["pos"]): (r["item_id"], r["distance"]) for r in vectors.knn(q, items, 8, most_bytes=most_bytes).collect()}
    want = {}
    for i in asked:
        d = np.round(((v - v[i]) ** 2).sum(1), 6)
        want |= {(i, n): (int(j), float(d[j])) for n, j in enumerate(np.lexsort((np.arange(len(v)), d))[:8], 1)}
    assert got == want
    assert "NestedLoop" not in vectors.knn(q, items, 8)._jdf.queryExecution().executedPlan().toString()


def test_few_items_and_none(spark):
    items = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0])], "item_id long, embedding array<double>")
    q = items.withColumnRenamed("item_id", "query_id")
    assert sorted(map(tuple, vectors.knn(q, items, 5).select("query_id", "item_id", "distance", "pos").collect())) == [(1, 1, 0.0, 1), (1, 2, 1.0, 2), (2, 1, 1.0, 2), (2, 2, 0.0, 1)]
    assert vectors.knn(q.limit(0), items, 5).count() == 0 and vectors.knn(q, items.limit(0), 5).count() == 0
