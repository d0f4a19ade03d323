"""Ranks and running values over whole tables without a window that gathers all rows, or a large group, in one task."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.session import materialise


def global_rank(df: DataFrame, name: str, *order: Column, parts: int | None = None) -> DataFrame:
    """Adds ``name``: 1, 2, ... over all rows by ``order``. Rows are dealt by range and written, each part is ranked by
    itself, and the sizes of the parts before it, one row a part, are added."""
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_in", inside).join(F.broadcast(before), "_part").withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def in_groups(df: DataFrame, by: list[str], order: list[Column], running: dict[str, tuple[Callable, Column]] | None = None, parts: int | None = None) -> DataFrame:
    """Adds ``_no`` (0, 1, ... of the group, groups in ascending order, null first), ``_row`` (0, 1, ... in the group by
    ``order``) and ``_rows`` (of the group); and, for each name in ``running``, the aggregate (``F.sum`` or ``F.bit_xor``) of a
    number over the group's rows as far as this one.

    Rows are dealt by range of group and order and written; windows lie within a part of a group. What a part needs of
    those before it are its first and last group alone, two rows a part at most, which are broadcast. So a group of any
    size is shared among tasks."""
    spark, running = df.sparkSession, running or {}
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    asc = [F.col(c).asc() for c in by]
    values = {f"_v{i}": F.coalesce(v.cast("long"), F.lit(0).cast("long")) for i, (_, v) in enumerate(running.values())}
    x = materialise(df.withColumns(values).repartitionByRange(n, *asc, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    aggs = [f for f, _ in running.values()]
    cells = x.groupBy("_part", *by).agg(F.count("*").alias("_n"), *(f(c).alias(c) for f, c in zip(aggs, values)))
    group, earlier = W.partitionBy(*by), W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    cells = materialise(
        cells.select(
            "_part", *by, "_n", F.sum("_n").over(group).alias("_total"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            *(F.coalesce(f(c).over(earlier), F.lit(0)).alias(f"_b{c}") for f, c in zip(aggs, values)),
        ),
        "cells",
    )
    starts = cells.groupBy("_part").agg(F.count_if(F.col("_before") == 0).alias("_new"), F.max((F.col("_before") > 0).cast("int")).alias("_goes_on"))
    starts = starts.select("_part", (F.coalesce(F.sum("_new").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("_goes_on")).alias("_from"))
    spans = cells.filter("_n <> _total").select(F.col("_part").alias("_at"), *(F.col(c).alias(f"_by_{c}") for c in by), "_total", "_before", *(f"_b{c}" for c in values))
    cell = W.partitionBy("_part", *by)
    so_far = cell.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    x = x.withColumns(
        {"_row": F.row_number().over(cell.orderBy(*order)).cast("long") - 1, "_rows": F.count("*").over(cell), "_no": F.dense_rank().over(W.partitionBy("_part").orderBy(*asc)).cast("long") - 1}
        | {c: f(c).over(so_far) for f, c in zip(aggs, values)}
    )
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by), F.col("_part") == F.col("_at"))
    x = x.join(F.broadcast(starts), "_part").join(F.broadcast(spans), same, "left")
    add = {F.sum: Column.__add__, F.bit_xor: Column.bitwiseXOR}
    return x.withColumns(
        {"_no": F.col("_no") + F.col("_from"), "_row": F.col("_row") + F.coalesce("_before", F.lit(0)), "_rows": F.coalesce("_total", "_rows")}
        | {name: add[f](F.col(c), F.coalesce(f"_b{c}", F.lit(0))) for (name, (f, _)), c in zip(running.items(), values)}
    ).drop("_part", "_at", "_from", "_total", "_before", *(f"_by_{c}" for c in by), *values, *(f"_b{c}" for c in values))


def grouped_rank(df: DataFrame, name: str, by: list[str], *order: Column, parts: int | None = None) -> DataFrame:
    """Adds ``name``: 1, 2, ... within each group of ``by``, by ``order``; a group of very many rows is no single task."""
    return in_groups(df, by, list(order), parts=parts).withColumn(name, F.col("_row") + 1).drop("_no", "_row", "_rows")
