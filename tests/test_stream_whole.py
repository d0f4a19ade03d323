"""the streamed count has every window of the table, in whatever order its files come."""

from collections import Counter
from datetime import datetime, timedelta

from loam.plans.registry import ORACLE_SQL, QUERIES


def test_every_window(spark, tmp_path):
    at = [datetime(2024, 1, 5) - timedelta(minutes=7 * i) for i in range(400)]  # the newest first
    rows = [(i, i % 9, "click" if i % 3 else "error", 1.0, t) for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp")
    df.orderBy("event_id").coalesce(1).write.option("maxRecordsPerFile", 4).parquet(f"{tmp_path}/events.parquet")  # 100 files, two batches
    got = {(r["event_type"], r["minute"]): r["n"] for r in QUERIES["w02_stream_counts"](spark, str(tmp_path)).collect()}
    epoch = datetime(1970, 1, 1)
    want = Counter((r[2], int((r[4] - epoch).total_seconds()) // 600 * 10 + 10) for r in rows)
    assert got == dict(want)
    assert "WHERE" not in ORACLE_SQL["w02_stream_counts"]
