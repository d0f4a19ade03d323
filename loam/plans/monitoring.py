"""Queries of windowed rules over ``events``. A minute of the rules is an hour here: events come in a few an hour, so their
times are squeezed by sixty."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import markdown as md
from loam.operators import chunk_table
from loam.operators import monitor as mo
from loam.plans.registry import query
from loam.plans.retrieval import N as CHUNKS
from loam.session import shared_dir, table
from loam.sources import corpus
from loam.streaming import monitor as st

#: Squeezed times, in whole seconds from the first of January 2024.
TS = "to_timestamp(CAST(floor((epoch(ts) - 1704067200) / 60) AS BIGINT) + 1704067200)"
E = f"WITH e AS (SELECT event_id, user_id, event_type, value, value / 25.0e0 AS sec, CAST(user_id % 4 AS INT) AS ns, CAST(floor((epoch(ts) - 1704067200) / 60) AS BIGINT) AS s FROM events)"


def events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200) / 60)
    return e.select("event_id", "user_id", "event_type", "value", (F.col("value") / 25.0).alias("sec"), (F.col("user_id") % 4).cast("int").alias("ns"), F.timestamp_seconds(s + 1704067200).alias("ts"))


def minute(c="end"):
    """Window ends as minutes, which both engines write alike."""
    return F.round((F.unix_seconds(c) - 1704067200) / 60).cast("long")


BUCKET = "CASE " + " ".join(f"WHEN sec <= {e}e0 THEN {i}" for i, e in enumerate(mo.BUCKETS)) + f" ELSE {len(mo.BUCKETS)} END"
HIST = f"""st AS (SELECT ns, s // 60 AS m, {BUCKET} AS b, count(*) AS n FROM e GROUP BY ALL), h AS (SELECT ns, m + k AS minute, b, sum(n) AS n FROM st, range(1, 11) r(k) GROUP BY ALL)"""
LO = "list_extract([0.0e0, " + ", ".join(f"{e}e0" for e in mo.BUCKETS) + "], b + 1)"
HI = "list_extract([" + ", ".join(f"{e}e0" for e in mo.BUCKETS) + "], b + 1)"
QUANT = f"""cu AS (SELECT *, sum(n) OVER (PARTITION BY ns, minute ORDER BY b) AS cum, sum(n) OVER (PARTITION BY ns, minute) AS total FROM h),
qu AS (SELECT ns, minute, total AS n, CASE
  WHEN b = {len(mo.BUCKETS)} THEN {mo.BUCKETS[-1]}e0 ELSE {LO} + ({HI} - {LO}) * (total * 0.95e0 - (cum - n)) / n END AS q FROM cu
  WHERE cum >= total * 0.95e0 AND cum - n < total * 0.95e0)"""


@query("w01_latency_p95", f"{E}, {HIST}, {QUANT} SELECT ns, minute, n, round(q, 6) AS q, q > 3.0e0 AS breach FROM qu")
def w01(spark, sf_dir):
    return mo.latency_high(events(spark, sf_dir), "ns", "sec").select("ns", minute().alias("minute"), "n", F.round("q", 6).alias("q"), "breach")


RATIO = """em AS (SELECT ns, s // 60 AS m, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM e GROUP BY ALL),
  er AS (SELECT ns, m + k AS minute, sum(n) AS n, sum(errors) AS errors, sum(errors) / CAST(sum(n) AS DOUBLE) > 0.02e0 AND sum(n) >= 20 AS breach
  FROM em, range(1, 11) r(k) GROUP BY ALL)"""


def ratio(spark, sf_dir):
    return mo.error_ratio(events(spark, sf_dir), "ns", F.col("event_type") == "error")


@query("w02_error_ratio", f"{E}, {RATIO} SELECT ns, minute, n, errors, breach FROM er")
def w02(spark, sf_dir):
    return ratio(spark, sf_dir).select("ns", minute().alias("minute"), "n", "errors", "breach")


@query("w03_stale_jobs", f"""{E} SELECT user_id, round((43200 - coalesce(max(s) FILTER (event_type = 'purchase'),
  max(s))) / 3600.0e0, 6) AS age_hours, (43200 - coalesce(max(s) FILTER (event_type = 'purchase'), max(s))) / 3600.0e0 > 5.0 AS stale FROM e GROUP BY user_id""")
def w03(spark, sf_dir):
    e = events(spark, sf_dir)
    return mo.stale_jobs(e, e.filter("event_type = 'purchase'"), "user_id", F.timestamp_seconds(F.lit(1704067200 + 43200)), 5.0)


@query("w04_gauge", f"{E} SELECT ns, (s // 600 + 1) * 10 AS minute, max(value) AS most, max(value) > 80 AS breach FROM e GROUP BY ALL")
def w04(spark, sf_dir):
    return mo.gauge(events(spark, sf_dir), "ns", "value", 80.0).select("ns", minute().alias("minute"), "most", "breach")


@query("w05_below_baseline", f"""{E}, b AS (SELECT ns, avg(value) AS baseline FROM e GROUP BY ns) SELECT ns, (s // 1200 + 1) * 20 AS minute, max(value) AS rate,
  max(value) < any_value(baseline) AS breach FROM e JOIN b USING (ns) GROUP BY ALL""")
def w05(spark, sf_dir):
    e = events(spark, sf_dir)
    return mo.below_baseline(e, e.groupBy("ns").agg(F.avg("value").alias("baseline")), "ns", "value").select("ns", minute().alias("minute"), "rate", "breach")


@query("w06_silence", f"""{E} SELECT user_id, round((43200 - max(s) FILTER (event_type = 'error')) / 60.0e0, 6) AS silence_minutes, CASE
  WHEN max(s) FILTER (event_type = 'error') IS NULL THEN 'never'
  WHEN (43200 - max(s) FILTER (event_type = 'error')) / 60.0e0 > 45 THEN 'silent' ELSE 'reporting' END AS state FROM e GROUP BY user_id""")
def w06(spark, sf_dir):
    e = events(spark, sf_dir)
    return mo.silent(e.filter("event_type = 'error'"), e, "user_id", F.timestamp_seconds(F.lit(1704067200 + 43200)))


HELD = """g AS (SELECT *, sum(CASE WHEN breach THEN 0 ELSE 1 END) OVER (PARTITION BY ns ORDER BY minute) AS g FROM er), si AS (SELECT *, min(CASE
  WHEN breach THEN minute END) OVER (PARTITION BY ns, g) AS since FROM g),
fi AS (SELECT *, breach AND minute - since >= 10 AS f FROM si), hs AS (SELECT ns, minute, CASE WHEN f THEN 'firing' WHEN breach THEN 'pending'
  WHEN coalesce(lag(f) OVER (PARTITION BY ns ORDER BY minute), false) THEN 'resolved' ELSE 'inactive' END AS state FROM fi)"""


@query("w07_hold", f"{E}, {RATIO}, {HELD} SELECT ns, minute, state FROM hs")
def w07(spark, sf_dir):
    return mo.held(ratio(spark, sf_dir), "ns", 10).select("ns", minute().alias("minute"), "state")


@query("w08_alert_actions", f"""{E}, {RATIO}, {HELD}, nt AS (SELECT ns, minute, state AS status FROM hs WHERE state IN ('firing', 'resolved')),
  p AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY ns ORDER BY minute), 'resolved') = 'firing' AS o FROM nt)
  SELECT ns, minute, CASE WHEN status = 'firing' AND NOT o THEN 'create' WHEN status = 'firing' THEN 'comment' WHEN o THEN 'comment+close' ELSE 'none' END AS action FROM p""")
def w08(spark, sf_dir):
    n = mo.held(ratio(spark, sf_dir), "ns", 10).filter("state in ('firing', 'resolved')").select("ns", F.col("end").alias("ts"), F.col("state").alias("status"))
    return mo.alert_actions(n, "ns").select("ns", minute("ts").alias("minute"), "action")


@query("w10_shortfall", f"""{E}, w AS (SELECT ns, s // 300 AS w, max(value) FILTER (event_type = 'click') AS wanted,
  max(value) FILTER (event_type = 'view') AS available FROM e GROUP BY ALL) SELECT ns, (w + 1) * 5 AS minute, wanted, available FROM w WHERE wanted > available""")
def w10(spark, sf_dir):
    e = events(spark, sf_dir)
    of = lambda t: e.filter(F.col("event_type") == t).select("ns", "ts", F.col("value").alias("n"))
    return mo.shortfall(of("click"), of("view"), "ns").select("ns", minute().alias("minute"), "wanted", "available")


@query("w11_latency_buckets", f"""{E}, c AS (SELECT ns, {BUCKET} AS b, count(*) AS n FROM e GROUP BY ALL), g AS (SELECT DISTINCT ns, r.k AS b
  FROM e, range(0, {len(mo.BUCKETS) + 1}) r(k)) SELECT g.ns, g.b, sum(coalesce(n, 0)) OVER (PARTITION BY g.ns ORDER BY g.b) AS n FROM g LEFT
  JOIN c ON c.ns = g.ns AND c.b = g.b""")
def w11(spark, sf_dir):
    le = mo.latency_buckets(events(spark, sf_dir), "ns", "sec")
    return le.select("ns", mo.bucket(F.col("le")).alias("b"), "n")


@query("w02_stream_counts", "SELECT event_type, CAST(epoch(time_bucket(INTERVAL '10 minutes', ts)) / 60 AS BIGINT) + 10 AS minute, count(*) AS n FROM events GROUP BY ALL")
def w02_stream(spark, sf_dir):
    """The windowed count as a stream over the table's files, run to its end: every window, those too that the watermark has not
    passed yet. A batch writes the windows that it changed; a count only grows, so the greatest is the last. Windows leave the
    state with the watermark, which lies as far back here as events do: files of a table don't come in order of time."""
    t = table(spark, sf_dir, "events").agg(F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("b"))
    span = t.select(F.unix_seconds("b") - F.unix_seconds("a")).first()[0] or 0
    done = _streamed(spark, sf_dir, lambda s: st.windowed_counts(s, "event_type", late=f"{max(1800, span + 600)} seconds"), "update")
    return done.groupBy("event_type", F.round(F.unix_seconds("end") / 60).cast("long").alias("minute")).agg(F.max("n").alias("n"))


@query("w02_stream_ratios", """WITH x AS (SELECT event_type = 'error' AS bad, user_id % 4 AS ns, CAST(floor(epoch(ts) / 60) AS BIGINT) AS m FROM events),
  w AS (SELECT ns, m + k AS minute, count(*) AS n, count(*) FILTER (bad) AS errors FROM x, range(1, 11) r(k) GROUP BY ALL)
  SELECT CAST(ns AS INT) AS ns, minute, n, errors, errors * 1.0e0 / n > 0.02e0 AND n >= 20 AS breach FROM w
  WHERE minute * 60 <= (SELECT max(epoch(ts)) FROM events) - 1800""")
def w02_stream_ratios(spark, sf_dir):
    """The error ratio over sliding windows as a stream, up to the watermark."""
    plan = lambda s: st.error_ratios(s.withColumn("ns", (F.col("user_id") % 4).cast("int")), "ns")
    return _streamed(spark, sf_dir, plan, "append").select("ns", F.round(F.unix_seconds("end") / 60).cast("long").alias("minute"), "n", "errors", "breach")


#: Two streams of events over half an hour's windows; what the slower watermark has passed.
PAIR = """WITH x AS (SELECT CAST(user_id % 4 AS INT) AS ns, CAST(floor(epoch(ts)) AS BIGINT) // 1800 AS w, event_type, value, ts FROM events),
  a AS (SELECT ns, w, max(value) AS av FROM x WHERE event_type = '{}' GROUP BY ALL), b AS (SELECT ns, w, max(value) AS bv FROM x WHERE event_type = '{}' GROUP BY ALL),
  j AS (SELECT a.ns, (a.w + 1) * 30 AS minute, av, bv FROM a LEFT JOIN b ON a.ns = b.ns AND a.w = b.w
  WHERE (a.w + 1) * 1800 <= (SELECT least(max(epoch(ts)) FILTER (event_type = '{}'), max(epoch(ts)) FILTER (event_type = '{}')) FROM x) - 1800)"""
SIDES = ("click", "purchase")


def _sides(stream, value):
    """The two sides of a joined stream."""
    x = stream.withColumn("ns", (F.col("user_id") % 4).cast("int"))
    return [x.filter(F.col("event_type") == t).select("ns", "ts", F.col("value").alias(n)) for t, n in zip(SIDES, value)]


@query("w05_stream_below", f"{PAIR.format(*SIDES, *SIDES)} SELECT ns, minute, av AS rate, bv AS baseline, av < bv AS breach FROM j")
def w05_stream(spark, sf_dir):
    """Rates (clicks) against recorded baselines (purchases), as two streams joined by window."""
    plan = lambda s: st.below_baseline(*_sides(s, ("value", "baseline")), "ns", "value", "30 minutes")
    return _streamed(spark, sf_dir, plan, "append").select("ns", F.round(F.unix_seconds("end") / 60).cast("long").alias("minute"), "rate", "baseline", "breach")


@query("w10_stream_shortfall", f"{PAIR.format(*SIDES, *SIDES)} SELECT ns, minute, av AS wanted, bv AS available FROM j WHERE bv IS NULL OR av > bv")
def w10_stream(spark, sf_dir):
    """Replicas asked for (clicks) against those there (purchases), as two streams joined by window."""
    plan = lambda s: st.shortfall(*_sides(s, ("n", "n")), "ns", "30 minutes")
    return _streamed(spark, sf_dir, plan, "append").select("ns", F.round(F.unix_seconds("end") / 60).cast("long").alias("minute"), "wanted", "available")


@query("w06_stream_silence", """WITH r AS (SELECT user_id, epoch_us(ts) AS t, 1 AS report FROM events WHERE event_type = 'error'
  UNION ALL SELECT DISTINCT user_id, 1704067200000000, 0 FROM events),
  x AS (SELECT user_id, t, report, lead(t) OVER (PARTITION BY user_id ORDER BY t, report) AS n FROM r)
  SELECT user_id, CASE WHEN report = 1 THEN t END AS last, t + 86400000000 AS at FROM x WHERE coalesce(n - t > 86400000000, true)
  AND t + 86400000000 < (SELECT max(t) // 1000 * 1000 FROM r) - 1800000000""")
def w06_stream(spark, sf_dir):
    """A day without an error event, told by a timer; users that never had one are silent since they were registered."""
    import uuid

    root = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex[:12]}"
    e = table(spark, sf_dir, "events")
    users = e.select("user_id").distinct().select("user_id", F.timestamp_seconds(F.lit(1704067200)).alias("ts"), F.lit(True).alias("born"))
    errors = e.filter("event_type = 'error'").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(False).alias("born"))
    users.unionByName(errors).write.parquet(root)
    stream = spark.readStream.schema(spark.read.parquet(root).schema).parquet(root)
    out = _run(spark, st.silences(stream, "user_id", 1440), "append")
    return out.select("user_id", F.unix_micros("last").alias("last"), F.unix_micros("at").alias("at"))


@query("w07_stream_hold", """WITH h AS (SELECT CAST(user_id % 4 AS INT) AS ns, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 60 + 60 AS minute, avg(value) > 50.0e0 AS breach FROM events GROUP BY ALL),
  er AS (SELECT * FROM h WHERE minute * 60 <= (SELECT max(epoch(ts)) FROM events) - 3600),
  g AS (SELECT *, sum(CASE WHEN breach THEN 0 ELSE 1 END) OVER (PARTITION BY ns ORDER BY minute) AS g FROM er), si AS (SELECT *, min(CASE
  WHEN breach THEN minute END) OVER (PARTITION BY ns, g) AS since FROM g),
  fi AS (SELECT *, breach AND minute - since >= 120 AS f FROM si)
  SELECT ns, minute, CASE WHEN f THEN 'firing' WHEN breach THEN 'pending' WHEN coalesce(lag(f) OVER (PARTITION BY ns ORDER BY minute), false) THEN 'resolved' ELSE 'inactive' END AS state FROM fi""")
def w07_stream(spark, sf_dir):
    """Two streams: hourly means, one row a key once the watermark has passed the hour, and the states over what the first
    one wrote."""
    hours = _streamed(spark, sf_dir, lambda s: st.hourly(s.withColumn("ns", (F.col("user_id") % 4).cast("int")), "ns", "value", 50.0), "append")
    again = spark.readStream.schema(hours.schema).option("recursiveFileLookup", "true").parquet(hours.inputFiles()[0].rsplit("/", 2)[0]) if hours.inputFiles() else None
    if again is None:
        return hours.select("ns", F.lit(0).cast("long").alias("minute"), F.lit("").alias("state"))
    states = _run(spark, st.hold_states(again.withWatermark("end", "1 hour"), "ns", 120), "append")
    return states.select("ns", F.round((F.unix_micros("end") + 1) / 6e7).cast("long").alias("minute"), "state")


def _streamed(spark, sf_dir, plan, mode):
    """What a plan over the events as a stream writes."""
    name = f"{sf_dir}/events.parquet"
    # a stream reads a folder; the glob finds a single file as well as a folder of files
    return _run(spark, plan(st.event_stream(spark, name + "*", spark.read.parquet(name).schema)), mode)


def _run(spark, stream, mode):
    """A stream run to its end. Results go to a Parquet folder batch by batch."""
    import uuid

    from loam.session import shared_dir

    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"

    def put(df, epoch):
        df.write.parquet(f"{root}/out/{epoch}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{root}/out")
    return done


@query("w12_stream_index", f"""{CHUNKS}, later AS ({corpus.LATER_SQL}) SELECT chunk_id, source, greatest(c.mtime, coalesce(l.mtime, 0)) AS mtime FROM chunks c
  LEFT JOIN (SELECT path, mtime FROM later) l ON l.path = c.source""")
def w12(spark, sf_dir):
    """Two scans arrive as files of changes; the chunk table after both."""
    import uuid

    from loam.session import shared_dir

    root = f"{shared_dir(spark)}/index-{uuid.uuid4().hex[:12]}"
    n = corpus.notes(spark, sf_dir).drop("doc_id")
    late = corpus.later_notes(corpus.notes(spark, sf_dir)).drop("doc_id")
    seen = lambda d, s: d.withColumn("seen", F.timestamp_seconds(F.lit(1704067200 + s)))
    seen(n, 0).write.parquet(f"{root}/in/scan=1")
    seen(late, 60).write.parquet(f"{root}/in/scan=2")
    chunk_table.create(md.chunk_notes(n.limit(0)), f"{root}/table")
    schema = seen(n, 0).schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 64).parquet(f"{root}/in")
    st.incremental_index(stream, f"{root}/table", md.chunk_notes, f"{root}/state").awaitTermination()
    return chunk_table.read(spark, f"{root}/table").select("chunk_id", "source", "mtime")
