"""Exact nearest neighbours of many vectors without comparing all pairs: pivots, cells and triangle bounds.

Items are dealt to the cell of their nearest pivot. A query first searches the nearest cells that hold ``k`` items, which bounds
its ``k``-th distance; then it visits the cells that the bound and the triangle inequality leave, and no others."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.session import materialise

#: Pivots at most, items and queries that meet in a task at most, and room for rounding in distances.
MOST_PIVOTS, BLOCK, SLACK = 1024, 100_000, 1e-5
#: Bytes of a block's vectors at most.
BLOCK_BYTES = 64 << 20


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors])


def _away(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` from all rows of ``b``."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


class Best:
    """The ``k`` nearest items of some queries (a matrix), by squared distance to six decimals, then place. ``limit``: a squared distance that
    each one's k-th nearest does not exceed."""

    def __init__(self, q: np.ndarray, k: int, limit: np.ndarray):
        self.q, self.k, self.limit, self.norm = q, k, limit, (q * q).sum(1)
        self.left = np.hstack([-2 * q, np.ones((len(q), 1))])
        self.distance, self.place = np.full((len(q), k), np.inf), np.full((len(q), k), -1)

    def add(self, x: np.ndarray, place: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Compares the queries, or those in ``rows``, with the items ``x``, of which the last column is the square of the length.

        A product of matrices tells which may be among the nearest, with room for rounding; their distances are then summed in order."""
        rows = np.arange(len(self.q)) if rows is None else rows
        d = self.left[rows] @ x.T
        most = np.minimum(self.limit[rows], self.distance[rows, -1])
        if d.shape[1] >= self.k and np.isinf(most).any():
            most = np.minimum(most, np.partition(d, self.k - 1, axis=1)[:, self.k - 1] + self.norm[rows])
        r, c = np.nonzero(d <= (most - self.norm[rows] + 1e-5 + 1e-9 * (self.norm[rows] + x[:, -1].max()))[:, None])
        if not len(r):
            return
        r = rows[r]
        exact = np.concatenate([np.round(((x[c[i : i + 65536], :-1] - self.q[r[i : i + 65536]]) ** 2).cumsum(1)[:, -1], 6) for i in range(0, len(r), 65536)])
        had = np.unique(r)
        row, dist, at = np.concatenate([np.repeat(had, self.k), r]), np.concatenate([self.distance[had].ravel(), exact]), np.concatenate([self.place[had].ravel(), place[c]])
        order = np.lexsort((at, dist, row))
        row, dist, at = row[order], dist[order], at[order]
        pos = np.arange(len(row)) - np.searchsorted(row, row)
        keep = pos < self.k
        self.distance[row[keep], pos[keep]], self.place[row[keep], pos[keep]] = dist[keep], at[keep]

    def rows(self, queries: np.ndarray, items: np.ndarray) -> pd.DataFrame:
        r, c = np.nonzero(self.place >= 0)
        return pd.DataFrame({"query": queries[r], "item": items[self.place[r, c]], "distance": self.distance[r, c]})


def _long(x: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of items in order, with the squares of their lengths as last column, and the items' places by id."""
    m, place = _matrix(x["v"]), np.empty(len(x), int)
    place[np.argsort(x["item"].to_numpy(), kind="stable")] = np.arange(len(x))
    return np.hstack([m, (m * m).sum(1)[:, None]]), place


def best(q: pd.DataFrame, x: pd.DataFrame, k: int) -> pd.DataFrame:
    """``query, item, distance`` (squared, six decimals): the ``k`` nearest rows of ``x`` (item, v) for each of ``q`` (query, v), by id in ties."""
    m, place = _long(x)
    items, out = np.sort(x["item"].to_numpy(), kind="stable"), []
    for i in range(0, len(q), 512):
        part = q.iloc[i : i + 512]
        b = Best(_matrix(part["v"]), k, np.full(len(part), np.inf))
        for j in range(0, len(m), 4096):
            b.add(m[j : j + 4096], place[j : j + 4096])
        out.append(b.rows(part["query"].to_numpy(), items))
    return pd.concat(out)


class Cells:
    """Pivots, and for each cell its number of items and their least and greatest distance from the pivot."""

    def __init__(self, pivots: np.ndarray, n: np.ndarray, near: np.ndarray, far: np.ndarray):
        self.pivots, self.n, self.near, self.far = pivots, n, near, far
        self.between = _away(pivots, pivots)

    def first(self, d: np.ndarray, k: int) -> list[np.ndarray]:
        """For each row of distances from the pivots the nearest cells that hold ``k`` items together."""
        order = np.argsort(d, axis=1, kind="stable")
        have = np.cumsum(self.n[order], axis=1)
        stop = np.minimum((have < k).sum(1), d.shape[1] - 1)
        return [o[: s + 1][self.n[o[: s + 1]] > 0] for o, s in zip(order, stop)]

    def left(self, d: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Cells that may hold an item within ``bound`` of each row: by the ring of the cell's items around its pivot, and by
        the plane between its pivot and the row's nearest one."""
        own = d.argmin(1)
        ring = np.maximum(np.maximum(d - self.far, self.near - d), 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d**2 - d.min(1)[:, None] ** 2) / (2 * self.between[own])
        plane = np.where(self.between[own] > 1e-9, plane, 0)
        return (np.maximum(ring, plane) <= bound[:, None] + SLACK) & (self.n > 0)


def knn(queries: DataFrame, items: DataFrame, k: int, query_id: str = "query_id", item_id: str = "item_id", most_pivots: int = MOST_PIVOTS, block: int = BLOCK, seen: list | None = None) -> DataFrame:
    """``query_id, item_id, distance, pos``: the ``k`` nearest items (item_id, embedding) of each query (query_id, embedding) by squared
    distance to six decimals, then id. No items or no queries give no rows; null vectors are left out.

    Of items with one vector the ``k`` of least id count, so that a vector that very many share is no large cell. Cells are searched in
    blocks of at most about ``block`` items and queries or ``BLOCK_BYTES`` of vectors, each pair of them a task. Pivots are as many as the square root of the items, at most
    ``most_pivots``; they and a row for each cell are all that the driver holds. ``seen`` gets the number of pairs compared and
    that of all pairs."""
    spark = items.sparkSession
    kind_v = "array<float>" if dict(items.dtypes)["embedding"] == dict(queries.dtypes)["embedding"] == "array<float>" else "array<double>"
    same = W.partitionBy("v").orderBy("item")
    x = items.filter("embedding is not null").select(F.col(item_id).alias("item"), F.col("embedding").cast(kind_v).alias("v"))
    x = materialise(x.withColumn("_p", F.row_number().over(same)).filter(F.col("_p") <= k).drop("_p"), "items")
    n = x.count()
    q = materialise(queries.filter("embedding is not null").select(F.col(query_id).alias("query"), F.col("embedding").cast(kind_v).alias("v")), "queries")
    kinds = {f: dict(d.dtypes)[c] for f, d, c in (("query", q, "query"), ("item", x, "item"))}
    empty = spark.createDataFrame([], f"{query_id} {kinds['query']}, {item_id} {kinds['item']}, distance double, pos int")
    if not n or not q.limit(1).count():
        return empty
    m = min(most_pivots, max(1, int(n**0.5)))
    pivots = _matrix(r["v"] for r in x.orderBy(F.xxhash64("v"), "item").limit(m).collect())

    def assign(batches):
        for b in batches:
            if len(b):
                d = _away(_matrix(b["v"]), pivots)
                yield b.assign(cell=d.argmin(1), away=d.min(1))

    x = materialise(x.mapInPandas(assign, f"item {kinds['item']}, v {kind_v}, cell int, away double"), "assigned")
    rows = x.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("near"), F.max("away").alias("far")).collect()  # a row a pivot
    stat = np.zeros((3, m))
    for r in rows:
        stat[:, r["cell"]] = r["n"], r["near"], r["far"]
    cells = Cells(pivots, stat[0].astype(int), stat[1], stat[2])

    def start(batches):
        for b in batches:
            for i in range(0, len(b), 1000):
                part = b.iloc[i : i + 1000]
                yield part.assign(cells=[c.tolist() for c in cells.first(_away(_matrix(part["v"]), pivots), k)])

    kind = f"query {kinds['query']}, v {kind_v}, cells array<int>"
    first = _searched(materialise(q.mapInPandas(start, kind), "first"), x, cells.n, k, block, kinds, seen)
    bound = first.groupBy("query").agg(F.sort_array(F.collect_list("distance")).alias("d"))  # k a cell visited
    bound = bound.select("query", F.sqrt(F.coalesce(F.get("d", F.lit(k - 1)), F.lit(float("inf")))).alias("bound"))

    # enough blocks for all cores, large enough that few copies of a row travel
    many = max(int((2 * spark.sparkContext.defaultParallelism) ** 0.5), 1)
    most = max(1, min(block, BLOCK_BYTES // (8 * pivots.shape[1] or 1), max(1000, -(-n // many))))
    order = np.argsort(cells.between[0], kind="stable")
    ends = np.cumsum(cells.n[order])
    lo, hi = np.zeros(m, int), np.zeros(m, int)  # first and last block of a cell
    lo[order], hi[order] = (ends - cells.n[order]) // most, np.maximum(ends - 1, 0) // most
    hi = np.maximum(lo, hi)
    inside = (lo[:, None] <= np.arange(hi.max() + 1)) & (np.arange(hi.max() + 1) <= hi[:, None])

    def left(v: np.ndarray, bound: np.ndarray) -> np.ndarray:
        d = _away(v, pivots)
        out = cells.left(d, bound)
        for r, c in enumerate(cells.first(d, k)):
            out[r, c] = False
        return out

    def more(batches):
        for b in batches:
            for i in range(0, len(b), 1000):
                part = b.iloc[i : i + 1000]
                f = left(_matrix(part["v"]), part["bound"].to_numpy())
                yield part.assign(blocks=[np.flatnonzero(t).tolist() for t in f.astype(np.float32) @ inside.astype(np.float32)], pairs=f @ cells.n)

    asked = materialise(q.join(bound, "query").mapInPandas(more, f"query {kinds['query']}, v {kind_v}, bound double, blocks array<int>, pairs long"), "more")
    if seen is not None:
        seen.append(("compared", asked.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]))
    each = asked.select("query", "v", "bound", F.explode("blocks").alias("block"))
    size = each.groupBy("block").agg(F.count("*").alias("n")).collect()  # a row a block
    parts = F.broadcast(spark.createDataFrame([(r["block"], -(-r["n"] // most)) for r in size] or [(-1, 1)], "block int, parts int"))
    places = F.broadcast(spark.createDataFrame([(c, int(lo[c]), int(hi[c] - lo[c] + 1)) for c in range(m)], "cell int, lo int, many int"))
    each = each.join(parts, "block").select("query", "v", "bound", "block", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int").alias("part"))
    held = x.join(places, "cell").withColumn("block", (F.col("lo") + F.pmod(F.xxhash64("item"), F.col("many"))).cast("int"))
    held = held.join(parts, "block").select("item", "v", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": [], "item": [], "distance": []})]
        if len(a) and len(b):
            b = b.sort_values("cell", kind="stable")
            vectors, place = _long(b)
            items, (there, at) = np.sort(b["item"].to_numpy(), kind="stable"), np.unique(b["cell"].to_numpy(), return_index=True)
            at = [*at.tolist(), len(b)]
            for i in range(0, len(a), 512):
                part = a.iloc[i : i + 512]
                v, bound = _matrix(part["v"]), part["bound"].to_numpy()
                f, found, j = left(v, bound)[:, there], Best(v, k, bound * bound), 0
                while j < len(there):
                    e = j + 1
                    while e < len(there) and at[e + 1] - at[j] <= 4096 and (f[:, e] == f[:, j]).all():  # cells that the same queries visit
                        e += 1
                    rows = np.flatnonzero(f[:, j])
                    for s in range(at[j], at[e], 4096) if len(rows) else ():
                        found.add(vectors[s : min(s + 4096, at[e])], place[s : min(s + 4096, at[e])], rows)
                    j = e
                out.append(found.rows(part["query"].to_numpy(), items))
        return pd.concat([o for o in out if len(o)] or out)

    pairs = each.groupBy("block", "part").cogroup(held.groupBy("block", "part"))
    rest = materialise(pairs.applyInPandas(search, f"query {kinds['query']}, item {kinds['item']}, distance double"), "near")
    if seen is not None:
        seen.append(("all", q.count() * n))
    w = W.partitionBy("query").orderBy("distance", "item")
    top = first.unionByName(rest).withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)
    return top.select(F.col("query").alias(query_id), F.col("item").alias(item_id), "distance", "pos")


def _searched(asked: DataFrame, x: DataFrame, n: np.ndarray, k: int, block: int, kinds: dict[str, str], seen: list | None) -> DataFrame:
    """``query, item, distance``: the ``k`` nearest of each cell that ``asked`` (query, v, cells) names. A cell's items and queries meet in
    blocks of at most about ``block`` of each."""
    spark = x.sparkSession
    each = asked.select("query", "v", F.explode("cells").alias("cell"))
    size = {r["cell"]: r["n"] for r in each.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a pivot
    if seen is not None:
        seen.append(("compared", int(sum(size[c] * n[c] for c in size))))
    parts = F.broadcast(spark.createDataFrame([(int(c), int(-(-int(n[c]) // block)), -(-size[c] // block)) for c in size] or [(-1, 1, 1)], "cell int, xs int, qs int"))
    some = each.join(parts, "cell").withColumn("_q", F.pmod(F.xxhash64("query"), F.col("qs")).cast("int")).withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)))
    held = x.select("item", "v", "cell").join(parts, "cell").withColumn("_x", F.pmod(F.xxhash64("item"), F.col("xs")).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    keys = ["cell", "_x", "_q"]

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return best(a, b, k) if len(a) and len(b) else pd.DataFrame({"query": [], "item": [], "distance": []})

    pairs = some.select("query", "v", *keys).groupBy(*keys).cogroup(held.select("item", "v", *keys).groupBy(*keys))
    return materialise(pairs.applyInPandas(search, f"query {kinds['query']}, item {kinds['item']}, distance double"), "near")
