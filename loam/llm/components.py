"""Connected components of large edge tables, and joins of rows to their groups without hot tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.session import materialise


def free_name(columns: list[str], stem: str) -> str:
    """``stem``, with underscores before it until no column has that name."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b): ``root`` is the smallest node of its component.

    Alternating large-star and small-star rounds; each reads the table that the one before wrote to the shared folder.
    Self-links give their node alone only if it has no other link. No edges give no row. Neighbours are aggregated,
    never collected, so a node of many links is no large row."""
    e = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(), "edges")
    for _ in range(most_rounds):
        deep = e.select("b").distinct().join(e.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        if not deep and not e.groupBy("a").count().filter("count > 1").limit(1).count():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("held")).select("u", F.least("u", "m").alias("m"), "held"), "least")
        large = join_groups(both, least, "u", "held", both.count()).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = materialise(large.distinct(), "large")
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(m, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(m.select("a", F.col("m").alias("b")))
        e = materialise(small.distinct(), "small")
    raise RuntimeError(f"no end after {most_rounds} rounds")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``groups`` (``how``: inner or left), which has one row a key and the number of rows in ``size``.

    Keys that over a thousandth of the rows hold, 1000 at most, are joined by broadcast where the rows lie; the others'
    rows meet in tasks. So no task gets more than a thousandth of the rows for one key."""
    large = max(1000, n_rows // 1000)
    hot, rest = groups.filter(F.col(size) >= large), groups.filter(F.col(size) < large)
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"))), key, "left")
    a = marked.filter("_hot").drop("_hot").join(F.broadcast(hot), key)
    return a.unionByName(marked.filter("_hot is null").drop("_hot").join(rest, key, how))


#: Bits of a block of row numbers, as in the bitmap functions.
BLOCK = 32768


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` written with a number for each row in column ``name``, so that every pass reads the same numbers. They rise within
    a file, and files have ranges of their own."""
    return materialise(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def drop_rows(rows: DataFrame, gone: DataFrame, name: str, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``rows`` (of ``numbered``) without the numbers in ``gone``; rows themselves are never shuffled.

    Numbers are broadcast up to ``broadcast_bytes``. Beyond that they become bitmaps, a bit a row, in ranges of numbers that
    each fit the bound; a range reads its own files, as the numbers in their footers tell, and tests its rows by broadcast."""
    gone = materialise(gone.select(name).distinct(), "gone")
    if gone.count() * 16 <= broadcast_bytes:
        return rows.join(F.broadcast(gone), name, "left_anti").select(rows.columns)
    block, bit, bits = (free_name(rows.columns, c) for c in ("_block", "_bit", "_bits"))
    maps = gone.select(F.expr(f"`{name}` div {BLOCK}").alias(block), (F.col(name) % BLOCK).alias(bit)).groupBy(block).agg(F.expr(f"bitmap_construct_agg({bit})").alias(bits))
    maps = materialise(maps, "maps")
    n = max(1, -(-maps.count() * (BLOCK // 8) // max(broadcast_bytes, BLOCK // 8)))
    edges = sorted(set(maps.select(F.percentile_approx(block, [i / n for i in range(1, n)], 10_000)).first()[0])) if n > 1 else []
    out = None
    for lo, hi in zip([None, *edges], [*edges, None]):
        inside = F.lit(True) if lo is None else F.col(name) >= lo * BLOCK
        inside = inside if hi is None else inside & (F.col(name) < hi * BLOCK)
        own = F.lit(True) if lo is None else F.col(block) >= lo
        own = own if hi is None else own & (F.col(block) < hi)
        part = rows.filter(inside).withColumns({block: F.expr(f"`{name}` div {BLOCK}"), bit: F.col(name) % BLOCK}).join(F.broadcast(maps.filter(own)), block, "left")
        hit = F.expr(f"shiftright(cast(conv(hex(substring({bits}, cast({bit} div 8 + 1 as int), 1)), 16, 10) as int), cast({bit} % 8 as int)) & 1 = 1")
        part = part.filter(~F.coalesce(hit, F.lit(False))).select(rows.columns)
        out = part if out is None else out.unionByName(part)
    return out
