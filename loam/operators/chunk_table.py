"""The chunk table on disk, in hash buckets of sources: a run rewrites the buckets that hold changed notes and no others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators.maintenance import status
from loam.session import files, materialise

#: Buckets of a new table, and bytes of a bucket on disk beyond which the table is dealt into more.
BUCKETS, BUCKET_BYTES = 16, 256 << 20


def bucket_of(source: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(buckets)).cast("int")


def current(spark: SparkSession, root: str) -> int:
    """Number of buckets of the table at ``root``: the folder of most buckets whose write was completed."""
    fs, p = files(spark, root)
    made = [int(s.getPath().getName()[2:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("b=")]
    done = [n for n in made if fs.exists(files(spark, f"{root}/b={n}/_SUCCESS")[1])]
    if not done:
        raise FileNotFoundError(f"no chunk table at {root}")
    return max(done)


def _write(chunks: DataFrame, path: str, tasks: int, what: str = "static") -> None:
    """One file a bucket, chunks of a source together. ``what``: static for a whole table, dynamic for the buckets that are there."""
    w = chunks.repartition(tasks, "bucket").sortWithinPartitions("bucket", "source", "chunk_ix").write.mode("overwrite")
    w.option("partitionOverwriteMode", what).partitionBy("bucket").parquet(path)


def create(chunks: DataFrame, root: str, buckets: int = BUCKETS, bucket_bytes: int = BUCKET_BYTES) -> None:
    """A new table of ``chunks``, dealt into more buckets where ``bucket_bytes`` ask for it."""
    chunks.limit(0).withColumn("bucket", F.lit(0)).write.mode("overwrite").parquet(f"{root}/schema")  # for a table without rows
    _write(chunks.withColumn("bucket", bucket_of("source", buckets)), f"{root}/b={buckets}", buckets)
    settle(chunks.sparkSession, root, bucket_bytes)


def read(spark: SparkSession, root: str, inner: bool = False) -> DataFrame:
    """The chunks; ``inner`` with their bucket, on which scans are pruned."""
    df = spark.read.schema(spark.read.parquet(f"{root}/schema").schema).parquet(f"{root}/b={current(spark, root)}")
    return df if inner else df.drop("bucket")


def settle(spark: SparkSession, root: str, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Deals a table whose buckets have grown beyond ``bucket_bytes`` on average into twice as many as it needs, so that a
    table which grows is dealt anew each time it has doubled."""
    n = current(spark, root)
    fs, p = files(spark, f"{root}/b={n}")
    size = fs.getContentSummary(p).getLength()
    if size <= n * bucket_bytes:
        return
    more = n
    while more * bucket_bytes < 2 * size:
        more *= 2
    _write(read(spark, root).withColumn("bucket", bucket_of("source", more)), f"{root}/b={more}", more)
    fs.delete(p, True)


def upsert(spark: SparkSession, root: str, notes: DataFrame, chunker: Callable[[DataFrame], DataFrame], prune: bool = True, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Brings the table at ``root`` up to ``notes`` (path, mtime and what ``chunker`` reads); gives ``source, status, bucket`` of what
    was new, changed or gone (kept if not ``prune``).

    Names and times are compared first. Only new and changed notes are chunked, and only buckets that hold such notes or
    ones that are gone are read and overwritten. States are taken from the table itself, so that a run that is repeated, or
    taken up after it was broken off, finds nothing to do where it was done. Texts of other buckets are never touched."""
    n = current(spark, root)
    there = read(spark, root, True)
    states = status(notes.select("path", "mtime"), there.select("source", "mtime")).filter("status <> 'unchanged'")
    states = states if prune else states.filter("status <> 'gone'")
    states = materialise(states.withColumn("bucket", bucket_of("source", n)), "states")
    touched = [r["bucket"] for r in states.select("bucket").distinct().collect()]  # at most the number of buckets
    if not touched:
        return states
    fresh = states.filter("status <> 'gone'").select(F.col("source").alias("path"))
    new = chunker(notes.join(fresh, "path", "left_semi")).withColumn("bucket", bucket_of("source", n))
    old = there.filter(F.col("bucket").isin(touched))
    kept = old.join(states.select("source"), "source", "left_anti")
    _write(kept.unionByName(new.select(kept.columns)), f"{root}/b={n}", len(touched), "dynamic")
    # a bucket without any row left has not been overwritten: it still holds what went
    fs, _ = files(spark, root)
    times = states.join(notes.select(F.col("path").alias("source"), F.col("mtime").alias("now")), "source", "left").select("source", "now")
    after = read(spark, root, True).filter(F.col("bucket").isin(touched)).select("bucket", "source", "mtime")
    stale = after.join(times, "source").filter("now is null or abs(mtime - now) > 1e-6").select("bucket").distinct()
    for r in stale.collect():
        fs.delete(files(spark, f"{root}/b={n}/bucket={r['bucket']}")[1], True)
    settle(spark, root, bucket_bytes)
    return states
