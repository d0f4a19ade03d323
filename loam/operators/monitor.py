"""Windowed quality and latency rules over event tables, and their alert states. Times are TIMESTAMP, in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Upper bounds of latency buckets in seconds; the last one is open.
BUCKETS = (0.05, 0.1, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0, 10.0)


def bucket(value: Column, edges: tuple[float, ...] = BUCKETS) -> Column:
    """Number of the first bucket that holds a value, from 0; the open one is ``len(edges)``."""
    return F.coalesce(*(F.when(value <= e, i) for i, e in enumerate(edges)), F.lit(len(edges)))


def histogram(events: DataFrame, key: str, value: str, width: str = "10 minutes", slide: str = "1 minute", edges: tuple[float, ...] = BUCKETS) -> DataFrame:
    """``key, end, b, n``: events of each sliding window by bucket. Events are first summed by slide step, so each is
    shuffled once at most and only step sums are multiplied by the windows they lie in."""
    step = events.groupBy(key, F.window("ts", slide)["start"].alias("step"), bucket(F.col(value), edges).alias("b")).agg(F.count("*").alias("n"))
    return step.groupBy(key, F.window("step", width, slide)["end"].alias("end"), "b").agg(F.sum("n").alias("n"))


def quantile(hist: DataFrame, key: str, q: float = 0.95, edges: tuple[float, ...] = BUCKETS) -> DataFrame:
    """``key, end, n, q`` with linear interpolation inside the bucket; in the open bucket its lower edge."""
    w = W.partitionBy(key, "end").orderBy("b")
    x = hist.withColumns({"_cum": F.sum("n").over(w), "_all": F.sum("n").over(W.partitionBy(key, "end"))}).withColumn("_before", F.col("_cum") - F.col("n"))
    at = F.col("_all") * q
    x = x.filter((F.col("_cum") >= at) & (F.col("_before") < at))
    lo = F.element_at(F.array(F.lit(0.0), *map(F.lit, edges)), F.col("b") + 1)
    hi = F.get(F.array(*map(F.lit, edges)), F.col("b"))
    return x.select(key, "end", F.col("_all").alias("n"), F.when(hi.isNull(), lo).otherwise(lo + (hi - lo) * (at - F.col("_before")) / F.col("n")).alias("q"))


def latency_high(events: DataFrame, key: str, value: str, limit: float = 3.0) -> DataFrame:
    return quantile(histogram(events, key, value), key).withColumn("breach", F.col("q") > limit)


def error_ratio(events: DataFrame, key: str, is_error: Column, limit: float = 0.02, least: int = 20) -> DataFrame:
    """``key, end, n, errors, breach``: over ten minutes, sliding by one."""
    step = events.groupBy(key, F.window("ts", "1 minute")["start"].alias("step")).agg(F.count("*").alias("n"), F.count_if(is_error).alias("errors"))
    x = step.groupBy(key, F.window("step", "10 minutes", "1 minute")["end"].alias("end")).agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"))
    return x.withColumn("breach", (F.col("errors") / F.col("n") > limit) & (F.col("n") >= least))


def stale_jobs(created: DataFrame, successes: DataFrame, key: str, now: Column, hours: float = 26.0) -> DataFrame:
    """``key, age_hours, stale``: since the last success, or since creation where there was none."""
    last = successes.groupBy(key).agg(F.max("ts").alias("last"))
    x = created.groupBy(key).agg(F.max("ts").alias("made")).join(last, key, "left")
    age = (F.unix_micros(now) - F.unix_micros(F.coalesce("last", "made"))) / 3.6e9
    return x.select(key, F.round(age, 6).alias("age_hours"), (age > hours).alias("stale"))


def gauge(events: DataFrame, key: str, value: str, limit: float, width: str = "10 minutes") -> DataFrame:
    """``key, end, most, breach``."""
    return events.groupBy(key, F.window("ts", width)["end"].alias("end")).agg(F.max(value).alias("most")).withColumn("breach", F.col("most") > limit)


def below_baseline(events: DataFrame, baseline: DataFrame, key: str, value: str, width: str = "20 minutes") -> DataFrame:
    """``key, end, rate, baseline, breach``: a window's greatest value against a recorded one (key, baseline)."""
    x = events.groupBy(key, F.window("ts", width)["end"].alias("end")).agg(F.max(value).alias("rate")).join(baseline, key)
    return x.withColumn("breach", F.col("rate") < F.col("baseline"))


def silent(events: DataFrame, keys: DataFrame, key: str, now: Column, minutes: float = 45.0) -> DataFrame:
    """``key, silence_minutes, state``: silent, reporting, or never."""
    x = keys.select(key).distinct().join(events.groupBy(key).agg(F.max("ts").alias("last")), key, "left")
    gap = (F.unix_micros(now) - F.unix_micros("last")) / 6e7
    return x.select(key, F.round(gap, 6).alias("silence_minutes"), F.when(gap.isNull(), "never").when(gap > minutes, "silent").otherwise("reporting").alias("state"))


def held(breaches: DataFrame, key: str, hold_minutes: int) -> DataFrame:
    """``key, end, state`` of evaluations (key, end, breach): inactive, pending, firing once a breach has lasted, resolved
    at the first evaluation without it after firing. Runs of breaches are islands between evaluations without."""
    w = W.partitionBy(key).orderBy("end")
    x = breaches.withColumn("_g", F.sum((~F.col("breach")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    x = x.withColumn("_since", F.min(F.when(F.col("breach"), F.col("end"))).over(W.partitionBy(key, "_g")))
    fires = F.col("breach") & (F.unix_micros("end") - F.unix_micros("_since") >= hold_minutes * 60_000_000)
    x = x.withColumn("_f", fires)
    return x.select(key, "end", F.when(F.col("_f"), "firing").when(F.col("breach"), "pending").when(F.coalesce(F.lag("_f").over(w), F.lit(False)), "resolved").otherwise("inactive").alias("state"))


def alert_actions(notices: DataFrame, *key: str) -> DataFrame:
    """``key, ts, action`` of notices (key, ts, status): create on firing with no open issue, comment while one is open,
    comment and close on resolved, else nothing."""
    w = W.partitionBy(*key).orderBy("ts")
    opened = F.coalesce(F.lag("status").over(w), F.lit("resolved")) == "firing"
    action = F.when((F.col("status") == "firing") & ~opened, "create").when(F.col("status") == "firing", "comment").when(opened, "comment+close").otherwise("none")
    return notices.select(*key, "ts", action.alias("action"))


def shortfall(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """``key, end, wanted, available`` of five-minute windows with fewer replicas than asked for (key, ts, n)."""
    top = lambda d, n: d.groupBy(key, F.window("ts", "5 minutes")["end"].alias("end")).agg(F.max("n").alias(n))
    return top(wanted, "wanted").join(top(there, "available"), [key, "end"]).filter("wanted > available")


def latency_buckets(events: DataFrame, key: str, value: str) -> DataFrame:
    """``key, le, n``: cumulative counts by bucket bound, the open one as infinity."""
    h = events.groupBy(key, bucket(F.col(value)).alias("b")).agg(F.count("*").alias("n"))
    grid = h.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(len(BUCKETS)))).alias("b")).join(h, [key, "b"], "left")
    le = F.get(F.array(*map(F.lit, BUCKETS), F.lit(float("inf"))), F.col("b"))
    return grid.select(key, le.alias("le"), F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy(key).orderBy("b")).alias("n"))
