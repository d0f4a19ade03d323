"""Queries of index upkeep and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import markdown as md
from loam.operators import chunk_table
from loam.operators import maintenance as m
from loam.plans.notes import NWORDS
from loam.plans.registry import query
from loam.plans.retrieval import N as CHUNKS
from loam.plans.retrieval import chunks
from loam.session import materialise, shared_dir, table
from loam.sources import corpus

#: Notes and their chunks, and a later scan.
N = f"{CHUNKS}, later AS ({corpus.LATER_SQL})"
STATUS = """st AS (SELECT coalesce(l.path, n.path) AS source, CASE WHEN n.path IS NULL THEN 'new' WHEN l.path IS NULL THEN 'gone'
  WHEN abs(l.mtime - n.mtime) <= 1e-6 THEN 'unchanged' ELSE 'changed' END AS status
  FROM (SELECT * FROM later) l FULL JOIN (SELECT * FROM notes WHERE doc_id % 23 <> 0) n ON l.path = n.path)"""


def pair(spark, sf_dir):
    """What is indexed (every 23rd note isn't yet) and what a later scan finds."""
    n = corpus.notes(spark, sf_dir)
    return n.filter("doc_id % 23 <> 0"), corpus.later_notes(n)


def chunked(notes):
    return md.chunk_notes(notes).drop("tags")


def states(spark, sf_dir):
    old, new = pair(spark, sf_dir)
    return m.status(new, old.select(F.col("path").alias("source"), "mtime"))


@query("i01_status", f"{N}, {STATUS} SELECT source, status FROM st")
def i01(spark, sf_dir):
    return states(spark, sf_dir)


@query("i02_prune", f"{N}, {STATUS} SELECT source FROM st WHERE status = 'gone'")
def i02(spark, sf_dir):
    return states(spark, sf_dir).filter("status = 'gone'").select("source")


@query("i03_apply", f"{N}, {STATUS} SELECT chunk_id, later.mtime FROM later JOIN chunks ON source = path WHERE path IN (SELECT source FROM st WHERE status <> 'gone')")
def i03(spark, sf_dir):
    old, new = pair(spark, sf_dir)
    return m.apply(chunked(old), states(spark, sf_dir), new, chunked).select("chunk_id", "mtime")


@query("i04_rebuild", f"{N} SELECT source, count(*) AS n_chunks FROM chunks GROUP BY source")
def i04(spark, sf_dir):
    return m.rebuild(corpus.notes(spark, sf_dir), chunked).groupBy("source").agg(F.count("*").alias("n_chunks"))


@query("i05_summary", f"""{N}, {STATUS} SELECT count(*) FILTER (status <> 'gone') AS scanned, count(*) FILTER (status = 'unchanged') AS skipped,
  count(*) FILTER (status IN ('new', 'changed')) AS reindexed,
  count(*) FILTER (status = 'gone') AS pruned, (SELECT count(*) FROM chunks WHERE source IN (SELECT source FROM st
  WHERE status IN ('new', 'changed'))) AS chunks_written, 0 AS batches_failed, CAST(NULL AS VARCHAR) AS failure FROM st""")
def i05(spark, sf_dir):
    old, new = pair(spark, sf_dir)
    st = states(spark, sf_dir)
    return m.verdict(m.summary(st, chunked(m.changed_notes(new, st))))


@query("i07_census", f"""{N} SELECT (SELECT count(*) FROM chunks) AS chunks, count(*) AS files, count(*) FILTER (category <> 'chat') AS notes,
  count(*) FILTER (category = 'chat') AS chats FROM notes WHERE path IN (SELECT source FROM chunks)""")
def i07(spark, sf_dir):
    return m.census(chunks(spark, sf_dir))


@query("i09_mirror", f"""{N} SELECT coalesce(l.path, n.path) AS path, CASE WHEN l.path IS NULL THEN 'remove'
  WHEN n.path IS NOT NULL AND length(l.content) = length(n.content) AND abs(l.mtime - n.mtime) < 1 THEN 'skip' ELSE 'copy' END AS action FROM later l FULL
  JOIN (SELECT * FROM notes WHERE doc_id % 23 <> 0) n ON l.path = n.path""")
def i09(spark, sf_dir):
    old, new = pair(spark, sf_dir)
    size = F.char_length("content").alias("size")
    return m.mirror(new.select("path", size, "mtime"), old.select("path", size, "mtime"))


@query("s09_upsert", f"{N}, {STATUS} SELECT status, count(DISTINCT source) AS n_notes, count(*) AS n_chunks FROM st JOIN chunks USING (source) WHERE status <> 'gone' GROUP BY status")
def s09(spark, sf_dir):
    """The chunk table of what is indexed, and the same table after a later scan, of which only changed buckets were rewritten."""
    import uuid

    root = f"{shared_dir(spark)}/table-{uuid.uuid4().hex[:12]}"
    old, new = pair(spark, sf_dir)
    before = materialise(states(spark, sf_dir), "states")
    chunk_table.create(chunked(old), root)
    chunk_table.upsert(spark, root, new, chunked)
    out = chunk_table.read(spark, root).join(before, "source")
    return out.groupBy("status").agg(F.countDistinct("source").alias("n_notes"), F.count("*").alias("n_chunks"))


@query("i06_provenance", """WITH s AS (SELECT source, min(lang) AS stamp FROM documents WHERE doc_id % 3 = 0 GROUP BY source),
  r AS (SELECT doc_id, lang, doc_id % 10 = 0 AS f, stamp FROM documents LEFT JOIN s USING (source))
  SELECT doc_id, CASE WHEN f THEN 'rebuild' WHEN stamp IS NOT NULL AND lang IS DISTINCT FROM stamp THEN 'refused' WHEN stamp IS NULL THEN 'new' ELSE 'incremental' END AS verdict FROM r""")
def i06(spark, sf_dir):
    """Sources stand for indexes, languages for models."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("index"), F.col("lang").alias("model"), (F.col("doc_id") % 10 == 0).alias("full"))
    stamps = d.filter("doc_id % 3 = 0").groupBy("index").agg(F.min("model").alias("model"))
    return m.provenance(stamps, d).select("doc_id", "verdict")


@query("s12_retention", f"""{N}, s AS (SELECT CAST(mtime / 86400 AS BIGINT) AS name, max(mtime) AS mtime FROM notes GROUP BY 1) SELECT name FROM (SELECT *,
  row_number() OVER (ORDER BY mtime DESC, name DESC) AS n FROM s) WHERE n > 7""")
def s12(spark, sf_dir):
    s = corpus.notes(spark, sf_dir).groupBy(F.round(F.col("mtime") / 86400).cast("long").alias("name")).agg(F.max("mtime").alias("mtime"))
    return m.expired(s).select("name")


@query("a09_freshness", f"{N} SELECT count(*) AS indexed_notes, max(mtime) AS newest FROM notes")
def a09(spark, sf_dir):
    return m.freshness(chunks(spark, sf_dir))


@query("a10_stale", f"""{N} SELECT (SELECT count(*) FROM later) AS indexed_notes, (SELECT max(mtime) FROM later) AS newest, (SELECT count(*)
  FROM notes) AS health_notes, (SELECT count(*) FROM later) > 0 AND ((SELECT count(*) FROM later) <> (SELECT count(*) FROM notes) OR (SELECT max(mtime)
  FROM later) > 1706054400.0e0) AS stale""")
def a10(spark, sf_dir):
    n = corpus.notes(spark, sf_dir)
    return m.snapshot_stale(m.freshness(chunked(corpus.later_notes(n))), n, F.lit(1706054400.0))


@query("m02_chunk_sizes", f"{N} SELECT n_words, count(*) AS n_chunks FROM (SELECT CAST({NWORDS.format('chunk')} AS INT) AS n_words FROM chunks) GROUP BY n_words")
def chunk_sizes(spark, sf_dir):
    c = md.chunk_notes(corpus.notes(spark, sf_dir))
    return c.groupBy(F.size(md.words(F.col("chunk"))).alias("n_words")).agg(F.count("*").alias("n_chunks"))


@query("s11_history", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS runs FROM events WHERE event_type = 'error' GROUP BY 1")
def s11(spark, sf_dir):
    import uuid

    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex[:12]}"
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", "ts", "value")
    for half in (0, 1):  # two runs append
        m.append_history(e.filter(F.col("event_id") % 2 == half), path, F.to_date("ts"))
    return spark.read.parquet(path).groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("runs"))
