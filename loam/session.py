"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def session(name: str = "loam", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; keyword arguments use ``__`` for dots."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent (tests, local mode) a temporary folder of this machine stands in for it."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if d:
        return d
    key = spark.sparkContext.applicationId
    if key not in _fallback:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _fallback[key] = "file://" + tempfile.mkdtemp(prefix="loam-")
    return _fallback[key]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files(spark: SparkSession, path: str):
    """Hadoop's file system of ``path``, and the path as it takes it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def bucketed(df: DataFrame, label: str, key: str, buckets: int | None = None) -> DataFrame:
    """``df`` written as Parquet below the shared folder in hash buckets of ``key`` and read back with them, so that joins and
    groups by ``key`` need no further shuffle. The catalog's entry goes once the table is resolved; the files stay."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"loam_{label}_{uuid.uuid4().hex[:12]}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved now
    spark.sql(f"DROP TABLE {name}")
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of texts as its files are split. A caller whose table is one small file, which no scan can split, may ask for
    ``spark.loam.textPartitions``: rows are then dealt over that many tasks, whatever the size; without it nothing is shuffled."""
    df = table(spark, sf_dir, name)
    n = spark.conf.get("spark.loam.textPartitions", None)
    return df.repartition(int(n)) if n else df
