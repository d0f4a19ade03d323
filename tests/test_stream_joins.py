"""Two streams joined by window: late rows, windows without a partner, keys of one side only."""

import datetime as dt
import uuid

from loam.streaming import monitor as st

START = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, batches, plan):
    """Each batch is a file a side, and a trigger; rows are (key, minute, value)."""
    root = f"file://{tmp_path}/{uuid.uuid4().hex}"
    out = []
    for i, sides in enumerate(batches):
        streams = []
        for name, rows in zip(("a", "b"), sides):
            schema = f"k string, ts timestamp, {name} double"
            spark.createDataFrame([(k, START + dt.timedelta(minutes=m), float(v)) for k, m, v in rows], schema).coalesce(1).write.parquet(f"{root}/{name}/n={i:03}")
            streams.append(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/{name}"))
        q = plan(*streams).writeStream.foreachBatch(lambda d, n: out.extend(d.collect())).option("checkpointLocation", f"{root}/c")
        q.trigger(availableNow=True).start().awaitTermination()
    return sorted((tuple(int((x - START).total_seconds() // 60) if isinstance(x, dt.datetime) else x for x in r) for r in out), key=str)


BATCHES = [
    ([("x", 1, 5), ("x", 12, 7), ("y", 3, 1)], [("x", 2, 6), ("z", 4, 9)]),
    ([("x", 18, 4), ("y", 25, 2)], [("x", 15, 3), ("y", 5, 1), ("y", 31, 1)]),  # y's baseline at 5 is late, before the watermark
    ([("x", 90, 1), ("y", 95, 1)], [("x", 92, 2), ("y", 96, 0)]),
    ([("x", 6, 99)], [("x", 7, 99)]),  # the watermark has passed them
    ([("x", 200, 1)], [("x", 200, 1)]),
    ([("x", 300, 1)], [("x", 300, 1)]),
]


def test_rates_against_baselines(spark, tmp_path):
    got = run(spark, tmp_path, BATCHES, lambda a, b: st.below_baseline(a, b.withColumnRenamed("b", "baseline"), "k", "a", "10 minutes"))
    want = [("x", 10, 5.0, 6.0, True), ("x", 20, 7.0, 3.0, False), ("y", 10, 1.0, 1.0, False), ("y", 30, 2.0, None, None)]
    want += [("x", 100, 1.0, 2.0, True), ("y", 100, 1.0, 0.0, False), ("x", 210, 1.0, 1.0, False)]
    assert got == sorted(want, key=str)


def test_shortfall(spark, tmp_path):
    got = run(spark, tmp_path, BATCHES, lambda a, b: st.shortfall(a.withColumnRenamed("a", "n"), b.withColumnRenamed("b", "n"), "k", "10 minutes"))
    assert got == sorted([("x", 20, 7.0, 3.0), ("y", 30, 2.0, None), ("y", 100, 1.0, 0.0)], key=str)
