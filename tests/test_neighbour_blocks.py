"""where no bound excludes a cell, a query travels once a block of cells, not once a cell."""

import numpy as np
from pyspark.sql import functions as F
from tests.test_neighbours import both, frame

from loam.operators import neighbours


def test_rows_that_travel(spark, monkeypatch):
    v = np.random.default_rng(2).normal(size=(1500, 32)).astype(np.float32)
    x = frame(spark, range(1500), v, "item_id")
    held, write = {}, neighbours.materialise
    monkeypatch.setattr(neighbours, "materialise", lambda df, label: held.setdefault(label, write(df, label)) if label == "more" else write(df, label))
    both(spark, x.withColumnRenamed("item_id", "query_id"), x, 4)
    arrays = [c for c, t in held["more"].dtypes if t == "array<int>"]
    assert 1500 <= held["more"].agg(F.sum(F.size(arrays[0]))).first()[0] <= 2 * 1500
