"""The silence stream over files that arrive one by one, late reports and never-reporting keys among them."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from loam.streaming import monitor as st

START = dt.datetime(2024, 1, 1)


def told(spark, tmp_path, batches, minutes=45):
    """Each batch is a file and a trigger."""
    root = f"file://{tmp_path}/{uuid.uuid4().hex}"
    schema = "k string, ts timestamp, born boolean"
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, START + dt.timedelta(minutes=m), b) for k, m, b in rows], schema).coalesce(1).write.parquet(f"{root}/in/b={i:03}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        s = st.silences(stream, "k", minutes).writeStream.foreachBatch(lambda d, n: out.extend(d.collect())).option("checkpointLocation", f"{root}/c")
        s.trigger(availableNow=True).start().awaitTermination()
    m = lambda t: None if t is None else (t - START).total_seconds() / 60
    return sorted(((r["k"], m(r["last"]), m(r["at"])) for r in out), key=str)


def test_silence_without_an_event_and_late_reports(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = told(spark, tmp_path, [
        [("a", 0, True), ("b", 0, True), ("c", 0, True), ("a", 5, False), ("b", 10, False)],
        [("a", 70, False), ("b", 40, False)],
        [("a", 60, False), ("b", 75, False)],  # a's report at 60 is late, and still ten minutes before the watermark: 5 to 60 stays a gap
        [("a", 100, False), ("a", 90, False), ("b", 110, False)],
        [("a", 300, False)],
        [("a", 310, False), ("b", 400, False)],
    ])
    assert got == sorted([("a", 5, 50), ("c", None, 45), ("b", 110, 155), ("a", 100, 145), ("a", 310, 355)], key=str)


def test_each_silence_is_told_once_and_gaps_filled_late_are_none(spark, tmp_path):
    got = told(spark, tmp_path, [
        [("x", 0, True), ("x", 1, False), ("y", 0, True)],
        [("x", 60, False)],
        [("x", 35, False), ("y", 32, False)],  # fill the gap before the watermark, 30 minutes behind, has passed it
        [("x", 200, False)],
        [("x", 201, False)],
        [("x", 202, False)],
    ])
    assert got == sorted([("x", 60, 105), ("y", 32, 77)], key=str)
