"""Streaming twins of the windowed rules, and incremental index upkeep as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loam.operators import chunk_table
from loam.session import materialise


def event_stream(spark, path: str, schema, files_a_trigger: int = 64) -> DataFrame:
    """A folder of Parquet event files as a stream. ``ts`` becomes TIMESTAMP, as watermarks need."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, key: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by tumbling window and key, ``end, key, n``; late ones are counted until the watermark passes, when the state of a
    window ends."""
    x = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), key).agg(F.count("*").alias("n"))
    return x.select(F.col("w.end").alias("end"), key, "n")


def error_ratios(stream: DataFrame, key: str, late: str = "30 minutes", limit: float = 0.02, least: int = 20) -> DataFrame:
    x = stream.withWatermark("ts", late).groupBy(F.window("ts", "10 minutes", "1 minute").alias("w"), key).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    x = x.select(F.col("w.end").alias("end"), key, "n", "errors")
    return x.withColumn("breach", (F.col("errors") / F.col("n") > limit) & (F.col("n") >= least))


def hourly(stream: DataFrame, key: str, value: str, limit: float, late: str = "1 hour") -> DataFrame:
    """``key, end, breach``: whether the mean of an hour exceeds a limit, once the watermark has passed the hour."""
    x = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), key).agg(F.avg(value).alias("mean"))
    return x.select(key, F.window_time("w").alias("end"), (F.col("mean") > limit).alias("breach"))


def hold_states(evaluations: DataFrame, key: str, hold_minutes: int) -> DataFrame:
    """``key, end, state`` of a stream of evaluations (key, end, breach): inactive, pending, firing, resolved.

    A key's state is two values: since when its breach lasts, and whether it fires. Evaluations of one trigger are taken in
    order of time; the state of a silent key ends with the watermark."""

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        since, firing = state.get if state.exists else (None, False)
        rows = pd.concat(list(frames)).sort_values("end", kind="stable")  # one row a key and window
        out = []
        for end, breach in zip(rows["end"], rows["breach"]):
            micros = int(end.value // 1000)
            if breach:
                since = micros if since is None else since
                now = micros - since >= hold_minutes * 60_000_000
                out.append("firing" if now else "pending")
            else:
                now, since = False, None
                out.append("resolved" if firing else "inactive")
            firing = now
        state.update((since, firing))
        state.setTimeoutTimestamp(max(int(rows["end"].max().value // 1_000_000), state.getCurrentWatermarkMs()) + 86_400_000)
        yield pd.DataFrame({key: [k[0]] * len(out), "end": rows["end"].values, "state": out})

    kind = dict(evaluations.dtypes)[key]
    return evaluations.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, end timestamp, state string", "since long, firing boolean", "append", GroupStateTimeout.EventTimeTimeout)


def silences(reports: DataFrame, key: str, minutes: int, late: str = "30 minutes") -> DataFrame:
    """``key, last, at`` of each silence in a stream of reports (key, ts, born): no report for ``minutes`` after ``last``, told at ``at``.

    A ``born`` row registers a key; a key that has not reported since then is silent with a null ``last``. Reports wait in the state
    until the watermark has passed them, so that late ones still fill a gap, and a timer tells a silence that no event ends.
    Each silence is told once. The state of a key is its last report, whether its silence is told, and what still waits."""
    span = minutes * 60_000_000

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, first, told, wait = state.get if state.exists else (None, True, False, [])
        wait = list(wait)
        for f in frames:
            if not state.hasTimedOut:
                wait += [int(t.value // 1000) * 2 + int(not b) for t, b in zip(f["ts"], f["born"])]  # the lowest bit: a report
        now, out = state.getCurrentWatermarkMs() * 1000, []
        wait.sort()
        while wait and (wait[0] >> 1) <= now:
            t, report = wait[0] >> 1, wait.pop(0) & 1
            if last is None or t > last:
                if last is not None and t - last > span and not told:
                    out.append((None if first else last, last + span))
                if last is None or report:
                    last, first, told = t, not report, False
            elif report and first and t == last:
                first = False
        if last is not None and not told and last + span <= now:
            out.append((None if first else last, last + span))
            told = True
        state.update((last, first, told, wait))
        due = [wait[0] >> 1] if wait else []
        due += [last + span] if last is not None and not told else []
        if due:
            state.setTimeoutTimestamp(max(min(due) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({key: [k[0]] * len(out), "last": pd.to_datetime(pd.Series([x[0] for x in out], dtype="Int64"), unit="us"), "at": pd.to_datetime(pd.Series([x[1] for x in out], dtype="int64"), unit="us")})

    kind = dict(reports.dtypes)[key]
    return reports.withWatermark("ts", late).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, last timestamp, at timestamp", "last long, first boolean, told boolean, wait array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def _windows(stream: DataFrame, key: str, value, name: str, width: str, late: str) -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), key).agg(value.alias(name))


def below_baseline(rates: DataFrame, baselines: DataFrame, key: str, value: str, width: str = "20 minutes", late: str = "30 minutes") -> DataFrame:
    """``key, end, rate, baseline, breach``: the greatest value of a window of one stream (key, ts, value) against the greatest
    that another (key, ts, baseline) records in it.

    Windows of both streams are joined by key and window once the slower watermark has passed them, each told once; where no
    baseline came in time, it and the breach are null. State ends with the watermark on both sides."""
    x = _windows(rates, key, F.max(value), "rate", width, late).join(_windows(baselines, key, F.max("baseline"), "baseline", width, late), ["w", key], "left")
    return x.select(key, F.col("w.end").alias("end"), "rate", "baseline", (F.col("rate") < F.col("baseline")).alias("breach"))


def shortfall(wanted: DataFrame, there: DataFrame, key: str, width: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    """``key, end, wanted, available`` of windows with fewer replicas (key, ts, n) than asked for; of windows in which none is
    reported ``available`` is null."""
    x = _windows(wanted, key, F.max("n"), "wanted", width, late).join(_windows(there, key, F.max("n"), "available", width, late), ["w", key], "left")
    return x.select(key, F.col("w.end").alias("end"), "wanted", "available").filter("available is null or wanted > available")


def incremental_index(stream: DataFrame, root: str, chunker: Callable[[DataFrame], DataFrame], checkpoint: str, late: str = "1 day"):
    """A query that brings changed notes (path, title, category, mtime, content, seen) into the chunk table at ``root``.

    Rows seen twice within the watermark are dropped. Each trigger chunks its changed notes alone and rewrites the buckets
    they lie in; a trigger that is repeated finds them unchanged. Nothing is pruned, as a stream of changes doesn't say what
    is gone."""
    once = stream.withWatermark("seen", late).dropDuplicatesWithinWatermark(["path", "mtime"])

    def batch(df: DataFrame, epoch: int) -> None:
        latest = df.groupBy("path").agg(F.max_by(F.struct("title", "category", "mtime", "content"), "mtime").alias("n")).select("path", "n.*")
        chunk_table.upsert(df.sparkSession, root, materialise(latest, "latest"), chunker, prune=False)

    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
