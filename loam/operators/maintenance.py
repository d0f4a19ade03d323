"""Upkeep of the chunk table: change detection, pruning, new versions, summaries, mirrors and retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOLERANCE = 1e-6


def status(scan: DataFrame, indexed: DataFrame) -> DataFrame:
    """``source, status``: new, changed, unchanged or gone, of ``scan`` (path, mtime) against ``indexed`` (source,
    mtime; rows of a source may repeat). Only names and times are joined."""
    i = indexed.groupBy("source").agg(F.max("mtime").alias("old"))
    x = scan.select(F.col("path").alias("source"), F.col("mtime").alias("new"), F.lit(True).alias("_here")).join(i.withColumn("_there", F.lit(True)), "source", "full")
    same = F.coalesce(F.abs(F.col("new") - F.col("old")) <= TOLERANCE, F.lit(False))
    return x.select("source", F.when(F.col("_there").isNull(), "new").when(F.col("_here").isNull(), "gone").when(same, "unchanged").otherwise("changed").alias("status"))


def apply(old: DataFrame, states: DataFrame, notes: DataFrame, chunker: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The next chunk table: what was unchanged, and chunks of the new and changed ``notes``, which alone are chunked."""
    keep = old.join(states.filter("status = 'unchanged'").select("source"), "source", "left_semi").select(old.columns)
    return keep.unionByName(chunker(changed_notes(notes, states)).select(old.columns))


def changed_notes(notes: DataFrame, states: DataFrame) -> DataFrame:
    """``notes`` (path, ...) that are new or changed."""
    return notes.join(states.filter("status in ('new', 'changed')").select(F.col("source").alias("path")), "path", "left_semi")


def write_version(chunks: DataFrame, root: str, version: int, buckets: int = 64) -> None:
    """One version of the chunk table, clustered by a hash of the source so that a note's chunks lie together."""
    chunks.withColumn("bucket", F.pmod(F.xxhash64("source"), F.lit(buckets)).cast("int")).repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/v={version}")


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A written version of the chunk table, the newest if none is named."""
    every = spark.read.parquet(root)
    if version is None:
        version = every.agg(F.max("v")).first()[0]
    return every.filter(F.col("v") == version).drop("v", "bucket")


def rebuild(notes: DataFrame, chunker) -> DataFrame:
    """The chunk table from scratch."""
    return chunker(notes)


def summary(states: DataFrame, fresh: DataFrame, failed_batches: Column | None = None) -> DataFrame:
    """One row: files scanned, skipped, reindexed, pruned, chunks written (those of ``fresh``), batches failed."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    s = states.agg(n("new", "changed", "unchanged").alias("scanned"), n("unchanged").alias("skipped"), n("new", "changed").alias("reindexed"), n("gone").alias("pruned"))
    w = fresh.agg(F.count("*").alias("chunks_written"))
    return s.crossJoin(w).withColumn("batches_failed", failed_batches if failed_batches is not None else F.lit(0))


def verdict(s: DataFrame) -> DataFrame:
    """Adds ``failure``, null if the run was complete."""
    return s.withColumn("failure", F.when(F.col("batches_failed") > 0, "batches failed").when((F.col("chunks_written") == 0) & (F.col("reindexed") > 0), "nothing written"))


def provenance(stamps: DataFrame, runs: DataFrame) -> DataFrame:
    """``runs`` (index, model, full) with ``verdict``: refused where the index is stamped (index, model) with another model
    and the run is not a full one, else new, incremental or rebuild."""
    x = runs.join(stamps.select("index", F.col("model").alias("stamp")), "index", "left")
    other = F.col("stamp").isNotNull() & ~F.col("stamp").eqNullSafe(F.col("model"))
    return x.withColumn("verdict", F.when(F.col("full"), "rebuild").when(other, "refused").when(F.col("stamp").isNull(), "new").otherwise("incremental")).drop("stamp")


def check_provenance(spark: SparkSession, meta: DataFrame | None, model: str, full: bool = False) -> DataFrame:
    """The one-row stamp to write with an index. An incremental run over an index of another model is refused."""
    row = meta.select("model").first() if meta is not None else None
    if row is not None and row["model"] != model and not full:
        raise ValueError(f"the index was made with {row['model']!r}, not {model!r}: rebuild it")
    return spark.createDataFrame([(model,)], "model string")


def census(chunks: DataFrame) -> DataFrame:
    """One row: chunks, files, notes and chats; a file's category is that of its first chunk."""
    first = chunks.groupBy("source").agg(F.min_by("category", "chunk_ix").alias("category"), F.count("*").alias("n"))
    chat = F.coalesce(F.col("category") == "chat", F.lit(False))
    return first.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count("*").alias("files"), F.count_if(~chat).alias("notes"), F.count_if(chat).alias("chats"))


def freshness(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.countDistinct(F.nullif("source", F.lit(""))).alias("indexed_notes"), F.max("mtime").alias("newest"))


def snapshot_stale(fresh: DataFrame, health_notes: DataFrame, scanned_at: Column) -> DataFrame:
    """``stale``: the counts differ, or the index holds something newer than the scan; never for an empty index."""
    x = fresh.crossJoin(F.broadcast(health_notes.agg(F.count("*").alias("health_notes"))))
    stale = (F.col("indexed_notes") > 0) & ((F.col("indexed_notes") != F.col("health_notes")) | F.coalesce(F.col("newest") > scanned_at, F.lit(False)))
    return x.withColumn("stale", stale)


def expired(snapshots: DataFrame, keep: int = 7) -> DataFrame:
    """Snapshots (name, mtime) beyond the newest ``keep``."""
    top = snapshots.orderBy(F.desc("mtime"), F.desc("name")).limit(keep)
    return snapshots.join(F.broadcast(top.select("name")), "name", "left_anti")


def append_history(rows: DataFrame, path: str, date: Column) -> None:
    rows.withColumn("date", date).write.mode("append").partitionBy("date").parquet(path)


def mirror(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """``path, action``: copy, skip or remove, of wanted files and a target listing (path, size, mtime). A file is skipped
    if its size is equal and its time less than a second off."""
    x = wanted.select("path", F.col("size").alias("s"), F.col("mtime").alias("m"), F.lit(True).alias("_w")).join(there.select("path", F.col("size").alias("s2"), F.col("mtime").alias("m2")), "path", "full")
    same = (F.col("s") == F.col("s2")) & (F.abs(F.col("m") - F.col("m2")) < 1)
    return x.select("path", F.when(F.col("_w").isNull(), "remove").when(F.coalesce(same, F.lit(False)), "skip").otherwise("copy").alias("action"))


def sync_report(plan: DataFrame, findings: DataFrame) -> DataFrame:
    """``verdict, n, reasons``: files of each verdict, and for refused ones how many reasons are told, five a file."""
    top = findings.withColumn("r", F.row_number().over(W.partitionBy("path").orderBy("line", "name"))).filter("r <= 5").groupBy("path").agg(F.count("*").alias("told"))
    return plan.join(top, "path", "left").groupBy("verdict").agg(F.count("*").alias("n"), F.coalesce(F.sum("told"), F.lit(0)).alias("reasons"))
