"""SimHash near-duplicates: a self-join of binary tries over the fingerprints, and its connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.components import components, drop_rows, free_name, join_groups, numbered
from loam.session import materialise, texts

#: Fingerprints that one task's trie holds at a time, and node pairs that are split at a time in a task.
HELD, FRONT = 1 << 18, 1 << 16
#: Node pairs of more fingerprints are split into pairs of their children, so many bits lower, until none has more.
LARGE, SPLIT_BITS = 200_000, 2


def fingerprint(text: str | None, size: int = 4) -> int:
    """64 bits; each is set if it is in over half the XXH64 hashes (seed 42) of the word shingles, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    buf = b" ".join(words)
    if len(words) <= size:
        return digest(buf, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = len(words) - size + 1
    count = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        a, b = starts[i : min(i + 8192, n)].tolist(), ends[i + size - 1 : min(i + 8192, n) + size - 1].tolist()
        h = np.array([digest(buf[x:y], 42) for x, y in zip(a, b)], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 4, row_id: str | None = None) -> DataFrame:
    """``doc_id, row_id, fp`` (the 64 bits as a signed long) of each whole text; 0 for texts without words. The row ids
    are those of the column ``row_id``, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, size) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_id"), pa.array(fp)], ["doc_id", "row_id", "fp"])

    row = F.col(row_id) if row_id else F.lit(None)
    return docs.select(F.col("doc_id").cast("long"), row.cast("long").alias("row_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, row_id long, fp long")


def layouts(n: int, distance: int) -> list[list[tuple[int, int]]]:
    """Orders of the bit blocks (shift, width). Two fingerprints that differ in at most ``distance`` bits agree on
    the leading blocks of one of them: one of ``distance + 1`` blocks, or for many fingerprints two of ``distance + 2``."""
    lead = 1 if n <= 1 << 26 else 2
    k = distance + lead
    edges = [64 * i // k for i in range(k + 1)]
    blocks = [(a, b - a) for a, b in zip(edges, edges[1:])]
    return [[blocks[i] for i in c] + [b for i, b in enumerate(blocks) if i not in c] for c in combinations(range(k), lead)]


def _ordered(fp: str, layout: list[tuple[int, int]]) -> Column:
    out = F.lit(0).cast("long")
    for shift, width in layout:
        out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned(F.col(fp), shift).bitwiseAND(F.lit((1 << width) - 1)))
    return out


def _back(x: np.ndarray, layout: list[tuple[int, int]]) -> np.ndarray:
    out, at = np.zeros(len(x), np.uint64), 64
    for shift, width in layout:
        at -= width
        out |= (x >> np.uint64(at) & np.uint64((1 << width) - 1)) << np.uint64(shift)
    return out


class Trie:
    """Binary trie over sorted 64-bit values, kept as ranges of the array, and the forest of links found in it."""

    def __init__(self, values: np.ndarray, distance: int):
        self.v, self.distance, self.n = values, distance, len(values)
        self.comp = np.arange(self.n)
        self.changes = np.arange(self.n)
        self.ones: dict[int, np.ndarray] = {}
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def _ones(self, depth: int) -> np.ndarray:
        if depth not in self.ones:
            bit = (self.v >> np.uint64(63 - depth) & np.uint64(1)).astype(np.int32)
            self.ones[depth] = np.r_[np.int32(0), np.cumsum(bit, dtype=np.int32)]
        return self.ones[depth]

    def _unite(self) -> None:
        """Bring the links that wait into the components."""
        if not self.found:
            return
        a, b = (np.concatenate(x) for x in zip(*self.found))
        c = self.comp
        while True:
            low = np.minimum(c[a], c[b])
            old = c.copy()
            np.minimum.at(c, c[a], low)
            np.minimum.at(c, c[b], low)
            while (c[c] != c).any():
                c = c[c]
            if (c == old).all():
                break
        self.comp, self.found, self.waiting = c, [], 0
        self.changes = np.r_[0, np.cumsum(c[1:] != c[:-1])]

    def _open(self, p: np.ndarray) -> np.ndarray:
        """Node pairs that aren't of one component already."""
        alo, ahi, blo, bhi = p[:4]
        ch = self.changes
        one = (ch[alo] == ch[ahi - 1]) & (ch[blo] == ch[bhi - 1]) & (self.comp[alo] == self.comp[blo])
        return p[:, ~one]

    def join(self, pairs: np.ndarray, depth: int) -> None:
        """Traverse node pairs (columns alo, ahi, blo, bhi, differing bits) of one depth downwards, together.

        A pair is dropped when its bits so far differ in more places than allowed, when a side is empty, or when all
        its members are linked already; single values are compared at once."""
        stack = [(depth, pairs)]
        while stack:
            depth, p = stack.pop()
            if p.shape[1] > FRONT:
                stack += [(depth, p[:, i : i + FRONT]) for i in range(0, p.shape[1], FRONT)]
                continue
            if self.waiting > max(self.n, FRONT):
                self._unite()
                p = self._open(p)
            single = (p[1] - p[0] == 1) & (p[3] - p[2] == 1)
            if single.any():
                a, b = p[0][single], p[2][single]
                near = (np.bitwise_count(self.v[a] ^ self.v[b]) <= self.distance) & (a != b)
                if near.any():
                    self.found.append((a[near], b[near]))
                    self.waiting += int(near.sum())
                p = p[:, ~single]
            if not p.shape[1] or depth == 64:
                continue
            ones = self._ones(depth)
            alo, ahi, blo, bhi, d = p
            amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
            own = alo == blo
            cross = ~own
            down = [
                np.stack([alo, amid, blo, bmid, d]),
                np.stack([amid, ahi, bmid, bhi, d]),
                np.stack([alo, amid, bmid, bhi, d + 1]),
                np.stack([amid, ahi, blo, bmid, d + 1])[:, cross],
            ]
            nxt = np.concatenate(down, axis=1)
            ok = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & (nxt[4] <= self.distance)
            ok &= (nxt[0] != nxt[2]) | (nxt[1] - nxt[0] > 1)
            if ok.any():
                stack.append((depth + 1, nxt[:, ok]))

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        self._unite()
        own = np.flatnonzero(self.comp != np.arange(self.n))
        return self.comp[own], own


def _node_pairs(hot: DataFrame, blocks: DataFrame, width: list[int], distance: int) -> tuple[DataFrame, list[int]]:
    """Pairs of trie nodes below the hot blocks that may hold links, each of at most ``LARGE`` fingerprints, and the depths
    (bits below the block) that they lie at: ``layout, block, depth, a, b, pair``, with a = b for a node and itself.

    ``hot`` (layout, block, x) are the fingerprints of hot blocks and ``blocks`` (layout, block, n) their counts. Only
    counts of nodes are joined: pairs are split level by level while they are too large, and dropped when their bits
    differ in more than ``distance`` places."""
    todo = blocks.select("layout", "block", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    out, depth = [], 0
    while True:
        depth += SPLIT_BITS
        last = depth + SPLIT_BITS > 64 - max(width)
        nodes = hot.groupBy("layout", "block", _prefix(width, depth).alias("p")).agg(F.count("*").alias("n"))
        nodes = materialise(nodes.withColumn("up", F.shiftrightunsigned("p", SPLIT_BITS)), "nodes")
        one = nodes.select("layout", "block", F.col("up").alias("a"), F.col("p").alias("pa"), F.col("n").alias("na"))
        two = nodes.select("layout", "block", F.col("up").alias("b"), F.col("p").alias("pb"), F.col("n").alias("nb"))
        pairs = todo.join(one, ["layout", "block", "a"]).join(two, ["layout", "block", "b"]).filter("(a <> b or pa <= pb)").filter(F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) <= distance)
        size = F.when(F.col("pa") == F.col("pb"), F.col("na")).otherwise(F.col("na") + F.col("nb"))
        pairs = materialise(pairs.select("layout", "block", F.col("pa").alias("a"), F.col("pb").alias("b"), (size > F.lit(-1 if last else LARGE)).alias("more")), "node-pairs")
        out.append(pairs.filter(F.lit(True) if last else ~F.col("more")).select("layout", "block", F.lit(depth).alias("depth"), "a", "b"))
        todo = pairs.filter("more").drop("more")
        if last or not todo.limit(1).count():
            every = reduce(DataFrame.unionByName, out)
            return materialise(every.withColumn("pair", F.monotonically_increasing_id()), "pairs"), list(range(SPLIT_BITS, depth + 1, SPLIT_BITS))


def _prefix(width: list[int], depth: int) -> Column:
    """The ``depth`` bits of ``x`` that follow the block of its layout."""
    shift = "case layout " + " ".join(f"when {i} then {64 - w - depth}" for i, w in enumerate(width)) + " end"
    return F.expr(f"shiftrightunsigned(x, {shift})").bitwiseAND(F.lit((1 << depth) - 1))


def links(distinct: DataFrame, distance: int = 4, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``a, b`` (fingerprints as longs): a forest that links the same fingerprints as all pairs of at most
    ``distance`` differing bits do. ``distinct`` has each ``fp`` once.

    Each fingerprint goes to one trie for each layout of its bits, dealt by the leading block; nodes of a trie are
    traversed in pairs. A task keeps a forest, never all pairs, so what it returns is at most its input. A block that
    many fingerprints share is dealt by pairs of its lower nodes, each small enough for one task."""
    spark, n = distinct.sparkSession, distinct.count()
    plans = layouts(n, distance)
    width = [sum(w for _, w in p[: len(p) - distance]) for p in plans]
    each = F.array(*(F.struct(F.lit(i).alias("layout"), _ordered("fp", p).alias("x"), F.shiftrightunsigned(_ordered("fp", p), 64 - width[i]).alias("block")) for i, p in enumerate(plans)))
    rows = distinct.select(F.explode(each).alias("e")).select("e.*")
    blocks = materialise(rows.groupBy("layout", "block").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE), "blocks")
    few = lambda t, size: F.broadcast(t) if t.count() * size <= broadcast_bytes else t
    marked = rows.join(few(blocks.select("layout", "block", F.lit(True).alias("hot")), 64), ["layout", "block"], "left")
    dealt = marked.filter("hot is null").select("layout", "block", F.lit(-1).cast("long").alias("pair"), F.lit(-1).alias("how"), "x")
    if blocks.limit(1).count():
        hot = materialise(marked.filter("hot").select("layout", "block", "x"), "hot")
        pairs, depths = _node_pairs(hot, blocks, width, distance)
        at = hot.withColumn("node", F.explode(F.array(*(F.struct(F.lit(t).alias("depth"), _prefix(width, t).alias("p")) for t in depths)))).select("layout", "block", "x", "node.*")
        differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) * 4 + F.col("depth") * 128
        own = pairs.select("layout", "block", "depth", F.col("a").alias("p"), "pair", (differ + F.when(F.col("a") == F.col("b"), 2).otherwise(0)).alias("how"))
        other = pairs.filter("a <> b").select("layout", "block", "depth", F.col("b").alias("p"), "pair", (differ + 1).alias("how"))
        for side in (own, other):
            dealt = dealt.unionByName(at.join(few(side, 100), ["layout", "block", "depth", "p"]).select("layout", "block", "pair", F.col("how").cast("int").alias("how"), "x"))
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "layout", "block", "pair").sortWithinPartitions("layout", "block", "pair")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(layout, block, pair, how, x):
            """``how``: -1 for a whole block; else the side (left, right, a node and itself), bits that differ, depth."""
            for i in np.unique(layout):
                of = layout == i
                g, h = np.stack([block[of], pair[of]]), how[of]
                v = x[of].view(np.uint64)
                order = np.lexsort((v, h & 3, g[1], g[0]))
                v, g, h = v[order], g[:, order], h[order]
                starts = np.flatnonzero(np.r_[True, (g[:, 1:] != g[:, :-1]).any(0)])
                ends = np.r_[starts[1:], len(v)]
                whole = h[starts] < 0
                trie = Trie(v, distance)
                lo, hi = starts[whole], ends[whole]
                todo = [(width[i], np.stack([lo, hi, lo, hi, np.zeros_like(lo)])[:, hi - lo > 1])]
                for s, e in zip(starts[~whole].tolist(), ends[~whole].tolist()):
                    depth, differ = width[i] + (int(h[s]) >> 7), int(h[s]) >> 2 & 31
                    if h[s] & 3 == 2:
                        todo.append((depth, np.array([[s], [e], [s], [e], [0]])))
                        continue
                    m = s + int(np.searchsorted(h[s:e] & 3, 1))
                    if s < m < e:
                        todo.append((depth, np.array([[s], [m], [m], [e], [differ]])))
                for depth, t in todo:
                    if t.shape[1]:
                        trie.join(t, depth)
                a, b = trie.forest()
                yield _back(v[a], plans[i]).view(np.int64), _back(v[b], plans[i]).view(np.int64)

        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy() for c in ("layout", "block", "pair", "how", "x")]
            held.append(cols)
            size += b.num_rows
            if size >= HELD:
                cols = [np.concatenate(c) for c in zip(*held)]
                same = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
                cut = int(same[-1]) + 1 if len(same) else 0
                if cut:
                    for a, c in solve(*(x[:cut] for x in cols)):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])
                held, size = [[x[cut:] for x in cols]], size - cut
        if size:
            for a, c in solve(*(np.concatenate(c) for c in zip(*held))):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])

    return dealt.mapInArrow(task, "a long, b long")


def near_groups(docs: DataFrame, size: int = 4, distance: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id, group_size`` for each row of ``docs`` (doc_id, text).

    Texts whose fingerprints differ in at most ``distance`` bits are linked; ``component_id`` is the smallest doc_id
    that links reach, null ids last. Null, empty and blank texts have fingerprint 0 and are linked as any other. Repeated
    rows are rows of their own in one component. An empty table gives no row.

    Rows are summed to distinct fingerprints before anything is joined, so copies cost nothing further."""
    out = _grouped(docs, size, distance)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("best.d").alias("component_id"), "group_size")


def _grouped(docs: DataFrame, size: int, distance: int, row_id: str | None = None) -> DataFrame:
    """``doc_id, row_id, fp, best, group_size``; ``best`` is the first row of the component: smallest doc_id, null last,
    then the smallest row id."""
    rows = materialise(fingerprints(docs, size, row_id), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("d"), F.col("row_id").alias("r")))
    distinct = materialise(rows.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n")), "distinct")
    roots = materialise(components(links(distinct.select("fp"), distance)), "roots")
    known = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    comps = known.groupBy("root").agg(F.min("first").alias("best"), F.sum("n").alias("group_size"), F.count("*").alias("fps"))
    label = materialise(join_groups(known.select("fp", "root", "n"), comps, "root", "fps", distinct.count()), "labels")
    return join_groups(rows, label.select("fp", "best", "group_size", "n"), "fp", "n", rows.count())


def near_dedup(docs: DataFrame, size: int = 4, distance: int = 4) -> DataFrame:
    """One row of ``docs`` of each component, all columns: that of the smallest doc_id, null last, and of equal ids the
    first. Rows are written with numbers and dropped by them, so equal or missing doc_ids don't matter."""
    name = free_name(docs.columns, "_row_id")
    rows = numbered(docs, name)
    gone = _grouped(rows, size, distance, name).filter(F.col("row_id") != F.col("best.r")).select(F.col("row_id").alias(name))
    return drop_rows(rows, gone, name).select(docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``; edge cases as in near_groups."""
    return near_groups(texts(spark, sf_dir))
