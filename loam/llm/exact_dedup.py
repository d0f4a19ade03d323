"""Exact deduplication by two passes over a Bloom filter; DataFrame operations only.

Pass 1 counts the 64-bit hashes of rows, one number a row, and those of two rows or more fill a blocked Bloom filter. Pass 2 tests
every row: one whose bits are not in it can have no equal and passes straight through; only the others are shuffled and grouped
by their exact key. Texts are never shuffled: rows are dropped where they lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.components import drop_rows, free_name, join_groups, numbered
from loam.session import materialise, texts

#: Bits of one block of the filter, as in the bitmap functions, and bits of the filter for each repeated hash.
BLOCK, BITS_PER_KEY = 32768, 16
SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """Text without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def _slots(slot: str, blocks: int) -> list[Column]:
    """Block of a 64-bit hash and two different bits in it."""
    g = F.xxhash64(slot, F.lit(1))
    one, step = F.pmod(g, F.lit(BLOCK)), F.pmod(F.shiftright(g, 20), F.lit(BLOCK - 1)) + 1
    return [F.pmod(F.col(slot), F.lit(blocks)), one, F.pmod(one + step, F.lit(BLOCK))]


def _bit(bitmap: str, at: str) -> Column:
    return F.expr(f"shiftright(cast(conv(hex(substring({bitmap}, cast({at} div 8 + 1 as int), 1)), 16, 10) as int), cast({at} % 8 as int)) & 1 = 1")


def repeated_filter(rows: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Pass 1: ``block, bitmap`` of a filter that holds the hashes of keys that two rows or more have, and its number of blocks.

    What is shuffled is one number for each different key of a task, so a key that many rows hold costs one row a task. The
    filter has 16 bits for each repeated hash, whatever the number of rows; blocks without bits are no rows."""
    often = materialise(rows.select(F.xxhash64(key).alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).filter("n > 1").select("slot"), "often")
    blocks = max(1, -(-often.count() * BITS_PER_KEY // BLOCK))
    block, one, two = _slots("slot", blocks)
    bits = often.select(block.alias("block"), F.explode(F.array(one, two)).alias("bit"))
    return bits.groupBy("block").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap")), blocks


def flagged(rows: DataFrame, key: str, broadcast_bytes: int) -> DataFrame:
    """``rows`` (narrow, a written table) with ``maybe``: whether another row may have the same key (never false for one that has).

    The filter, 2 bytes a repeated hash, is broadcast up to ``broadcast_bytes``, which is 32 million repeated hashes for 64 MB;
    rows meet a larger one by block in a shuffle of what they are: ids and hashes."""
    filt, blocks = repeated_filter(rows, key)
    filt = materialise(filt, "bloom")
    if blocks * (BLOCK // 8) <= broadcast_bytes:
        filt = F.broadcast(filt)
    x = rows.withColumn("_slot", F.xxhash64(key))
    block, one, two = _slots("_slot", blocks)
    tested = x.withColumns({"_block": block, "_one": one, "_two": two}).join(filt.withColumnRenamed("block", "_block"), "_block", "left")
    return tested.withColumn("maybe", F.coalesce(_bit("bitmap", "_one") & _bit("bitmap", "_two"), F.lit(False))).drop("_slot", "_block", "_one", "_two", "bitmap")


def exact_groups(docs: DataFrame, broadcast_bytes: int = 64 << 20, row_id: str | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): ``doc_id, keep_id, group_size, kept, text_sha256``, and ``row_id`` from the column of
    that name, if given.

    Texts are equal when identical without white space. The longest original text stays, then the smallest doc_id, null
    last, then the first row. Repeated rows of one id are told apart, so exactly one row of a group is kept. Null texts
    are empty texts, which are equal to each other. An empty table gives no row.

    Texts are read and hashed once; ids, hashes and lengths are written, and all else reads those. Groups that hold over a
    thousandth of the possibly repeated rows, 1000 at most, are joined by broadcast and never meet in a task."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.sha2(normalised(F.col("text")), 256).alias("text_sha256"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("_chars"),
        *([F.col(row_id).cast("long").alias("row_id")] if row_id else []),
    )
    names = ["row_id"] if row_id else []
    rows = materialise(rows, "hashed")
    tested = flagged(rows, "text_sha256", broadcast_bytes)
    alone = tested.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", *names)
    some = materialise(tested.filter("maybe").drop("maybe").withColumn("_row", F.col("row_id") if row_id else F.monotonically_increasing_id()), "repeated")
    best = F.min(F.struct((-F.col("_chars")).alias("c"), F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("d"), F.col("_row").alias("r")))
    groups = some.groupBy("text_sha256").agg(F.count("*").cast("long").alias("group_size"), best.alias("b"))
    groups = materialise(groups.select("text_sha256", "group_size", F.col("b.d").alias("keep_id"), F.col("b.r").alias("_best")), "groups")
    both = join_groups(some, groups, "text_sha256", "group_size", some.count())
    return alone.unionByName(both.select("doc_id", "keep_id", "group_size", (F.col("_row") == F.col("_best")).alias("kept"), "text_sha256", *names))


def exact_dedup(docs: DataFrame, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows are written with numbers and dropped by them where they lie."""
    name = free_name(docs.columns, "_row_id")
    rows = numbered(docs, name)
    gone = exact_groups(rows, broadcast_bytes, name).filter("not kept").select(F.col("row_id").alias(name))
    return drop_rows(rows, gone, name, broadcast_bytes).select(docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, size and survivor of every row of ``documents``; edge cases as in exact_groups."""
    return exact_groups(texts(spark, sf_dir))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept,
  text_sha256
FROM d
"""
