"""Near-duplicates by HyperMinHash: one compressed register a bucket, banded; exact confirmation of links on full sets.

A text's set is its distinct word shingles. Its sketch keeps, for each of 128 buckets of the hash range, the least hash as
leading-zero count and ten mantissa bits. Bands of four registers bring sets together, collision-corrected estimates of the
Jaccard similarity drop pairs that are far from a link, and what is left is confirmed on the sets themselves. Sets that may be
linked are gathered in clusters; a cluster's sets are read once and searched by a task. Clusters too large for that are taken
apart around pivots: the triangle inequality of the Jaccard distance tells which members may still be linked to others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from loam.llm.components import components, drop_rows, free_name, join_groups, numbered
from loam.session import materialise, table

#: Buckets are the first seven bits of a hash; mantissa bits kept after the leading one.
BUCKETS, MANTISSA = 128, 10
#: Bands of the registers: of two sets at 0.8 all miss with probability (1 - 0.8 ** 4) ** 32 = 5e-8.
BANDS, BAND_ROWS = 32, 4
#: Standard deviations that an estimate may fall short by before a pair is dropped.
SIGMAS = 6
#: Members of a bucket that are compared by sketch; larger buckets are clusters as they are.
MOST_IN_BUCKET = 20_000
#: Members and shingles (8 bytes each) of a cluster that one task searches.
MOST_SETS, MOST_SHINGLES = 10_000, 4_000_000
CACHE_WORDS = 200_000
EMPTY = np.uint16(0xFFFF)
_GOLD, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))  # splitmix64
_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: For each bucket, the order in which it borrows the register of another one where it is empty.
BORROW = np.argsort(_mix(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + _GOLD).reshape(BUCKETS, BUCKETS), axis=1)


def shingles(text: str | None, size: int = 2) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``size``-word shingles, A-Z in lower case; of all words as one where they are fewer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    got = list(map(_words.get, words))
    if None in got:
        for i, w in enumerate(words):
            if got[i] is None:
                got[i] = xxhash.xxh64_intdigest(w)
                if len(_words) < CACHE_WORDS:
                    _words[w] = got[i]
    h = np.array(got, np.uint64)
    k = min(size, len(words))
    acc = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        acc = _mix((acc + _GOLD) ^ h[i : len(h) - k + 1 + i])
    return np.unique(acc)


def registers(h: np.ndarray) -> np.ndarray:
    """A register for each bucket of the sorted hashes ``h``: leading zeros and mantissa of the least rest; EMPTY without any."""
    out = np.full(BUCKETS, EMPTY, np.uint16)
    bucket, first = np.unique((h >> np.uint64(57)).astype(np.int64), return_index=True)
    rest = (h[first] & np.uint64((1 << 57) - 1)) >> np.uint64(4)  # 53 bits, which a double holds exactly
    length = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    lead = np.maximum(length - 1 - MANTISSA, 0).astype(np.uint64)
    up = np.maximum(MANTISSA + 1 - length, 0).astype(np.uint64)
    mantissa = ((rest >> lead) << up) & np.uint64((1 << MANTISSA) - 1)
    out[bucket] = ((53 - length).astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def dense(reg: np.ndarray) -> np.ndarray:
    """Registers with empty ones borrowed, so that sets of few shingles agree in a bucket as often as they are similar."""
    full = reg != EMPTY
    if full.all() or not full.any():
        return reg
    empty = np.flatnonzero(~full)
    order = BORROW[empty]
    out = reg.copy()
    out[empty] = reg[order[np.arange(len(empty)), full[order].argmax(1)]]
    return out


def _chance(n: np.ndarray, m: int) -> np.ndarray:
    """Probability that registers of one bucket are equal by chance, for sets of ``n`` and ``m`` shingles."""
    edge = 2.0 ** -np.arange(0, 54)
    edge[-1] = 0

    def level(k):  # the least of k / BUCKETS uniform numbers lies between two powers of two
        k = np.maximum(np.asarray(k, float) / BUCKETS, 1e-9)[..., None]
        return np.diff((1 - edge) ** k, axis=-1)

    return (level(n) * level(m)).sum(-1) / (1 << MANTISSA)


def estimates(reg: np.ndarray, n: np.ndarray, other: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of each sketch (rows of ``reg``) with another one, corrected for chance, and its lower bound for a link
    at 0.8: pairs below it are no links but for a chance of about 1e-9."""
    used = (reg != EMPTY) | (other != EMPTY)
    same = ((reg == other) & used).sum(1)
    u = np.maximum(used.sum(1), 1)
    c = _chance(n, m)
    return (same / u - c) / (1 - c), u


def likely(reg: np.ndarray, n: np.ndarray, other: np.ndarray, m: int, percent: int) -> np.ndarray:
    """Which sketches may belong to sets that are linked with another one: by size, and by the estimate less its error."""
    j = percent / 100
    sized = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)).astype(bool)
    est, u = estimates(reg, n, other, m)
    return sized & (est >= j - SIGMAS * np.sqrt(j * (1 - j) / u))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether ``100 * intersection >= percent * union`` of two sorted arrays of distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def forest(n: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that reach what all links reach: each reached element looks among those that aren't reached yet."""
    rest, out = np.arange(len(n)), []
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            hit = near(x, rest)
            found = rest[hit].tolist()
            out += [(x, y) for y in found]
            todo += found
            rest = rest[~hit]
    return out


def sketches(docs: DataFrame, size: int = 2, row_id: str | None = None) -> DataFrame:
    """``doc_id, row_id, n, sig, reg`` of each whole text: number of distinct shingles, 128 bits of them and the registers; ``sig``
    and ``reg`` are null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            n, sig, reg = [], [], []
            for t in b.column("text"):
                h = shingles(t.as_py(), size)
                n.append(len(h))
                sig.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                reg.append(registers(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_id"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(reg, pa.binary())], ["doc_id", "row_id", "n", "sig", "reg"])

    row = F.col(row_id) if row_id else F.lit(None)
    return docs.select(F.col("doc_id").cast("long"), row.cast("long").alias("row_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, row_id long, n long, sig binary, reg binary")


def bands(sets: DataFrame) -> DataFrame:
    """``key, sid``: a key for each band of each sketch of ``sets`` (sid, reg)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                reg = np.stack([dense(np.frombuffer(r.as_py(), np.uint16)) for r in part.column("reg")])
                key = _mix(_mix(reg.view(np.uint64).reshape(len(reg), BANDS) + salt))
                sid = np.repeat(part.column("sid").to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(sid)], ["key", "sid"])

    return sets.select("sid", "reg").mapInArrow(run, "key long, sid long")


def _grouped(rows: DataFrame, key: str, columns: list[str], solve: Callable[..., list[tuple[int, int]]]) -> DataFrame:
    """``a, b``: what ``solve`` gives for the rows of each ``key``; a task holds one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def out():
            e = solve(*([x for part in held for x in part[i]] for i in range(len(columns)))) if held else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in e], pa.int64()), pa.array([x[1] for x in e], pa.int64())], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(key).to_numpy()
            cols = [b.column(c) for c in columns]
            cut = np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)]
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if k[s] != at:
                    yield out()
                    held, at = [], k[s]
                held.append([c.slice(s, e - s).to_pylist() for c in cols])
        yield out()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(key, *columns).repartition(n, key).sortWithinPartitions(key).mapInArrow(run, "a long, b long")


def _by_sketch(percent: int):
    def solve(sid, n, reg):
        if len(sid) < 2:
            return []
        n, reg = np.array(n), np.stack([np.frombuffer(r, np.uint16) for r in reg])
        return [(sid[a], sid[b]) for a, b in forest(n, lambda x, rest: likely(reg[rest], n[rest], reg[x], n[x], percent))]

    return solve


def _by_sets(percent: int):
    def solve(sid, reg, hashes):
        if len(sid) < 2:
            return []
        sets = [np.frombuffer(h, np.uint64) for h in hashes]
        n, reg = np.array([len(s) for s in sets]), np.stack([np.frombuffer(r, np.uint16) for r in reg])

        def near(x, rest):
            hit = likely(reg[rest], n[rest], reg[x], n[x], percent)
            for i in np.flatnonzero(hit):
                hit[i] = linked(sets[x], sets[rest[i]], percent)
            return hit

        return [(sid[a], sid[b]) for a, b in forest(n, near)]

    return solve


def clusters(sets: DataFrame, percent: int = 80) -> DataFrame:
    """``node, root``: clusters of ``sets`` (sid, n, reg; a written table) that may hold links, by components of likely pairs.

    Buckets of bands with the same members count once. A bucket's members are compared by sketch in a task, and a spanning
    forest of the likely pairs is kept; buckets of over ``MOST_IN_BUCKET`` members are linked whole, which only makes the
    cluster larger."""
    keys = materialise(bands(sets), "bands")
    of = keys.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor("sid").alias("x"), F.bit_xor(F.xxhash64("sid")).alias("y"), F.min("sid").alias("lo")).filter("size > 1")
    of = materialise(of.groupBy("size", "x", "y", "lo").agg(F.min("key").alias("key")), "buckets")
    pairs = of.filter("size = 2").select("key", "size", F.explode(F.array("lo", F.col("lo").bitwiseXOR(F.col("x")))).alias("sid"))
    more = of.filter("size > 2").select("key", "size", "lo")
    rows = materialise(join_groups(keys, more, "key", "size", keys.count()), "members")
    whole = rows.filter(F.col("size") > MOST_IN_BUCKET).filter("sid <> lo").select(F.col("lo").alias("a"), F.col("sid").alias("b"))
    some = pairs.select("key", "sid").unionByName(rows.filter(F.col("size") <= MOST_IN_BUCKET).select("key", "sid")).join(sets.select("sid", "n", "reg"), "sid")
    return components(_grouped(some, "key", ["sid", "n", "reg"], _by_sketch(percent)).unionByName(whole))


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int, broadcast_bytes: int) -> DataFrame:
    """``wanted`` (doc, sig, ...) with ``hashes`` (8 bytes each), read again from the texts of ``docs``. Wanted rows are
    broadcast up to a checked size, else texts are shuffled once to meet them."""
    none = -(1 << 62)  # stands for a null id; the signature decides
    w = wanted.withColumn("_doc", F.coalesce("doc", F.lit(none))).drop("doc")
    few = wanted.count() * 500 <= broadcast_bytes
    names = [c for c in w.columns if c != "_doc"]
    x = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(none)).alias("_doc"), F.col("text").cast("string").alias("_text")).join(F.broadcast(w) if few else w, "_doc").select("_text", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                h = [shingles(t.as_py(), size).tobytes() for t in part.column("_text")]
                keep = pa.array([xxhash.xxh3_128_digest(x) == s.as_py() for x, s in zip(h, part.column("sig"))], pa.bool_())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(h, pa.binary())], [*names, "hashes"]).filter(keep)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in w.schema if f.name != "_doc")
    return x.mapInArrow(run, f"{schema}, hashes binary")


@F.pandas_udf(LongType())
def _shared(a, b):
    import pandas as pd

    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b)], dtype="int64")


def _apart(sets: DataFrame, percent: int, broadcast_bytes: int, most_sets: int, most_shingles: int, most_rounds: int = 12) -> list[DataFrame]:
    """Links of clusters that are too large for a task: ``sets`` (root, sid, n, reg, hashes; a written table).

    In each round every member is compared with its cluster's pivot. Members that aren't linked with it go on, and of those
    that are only the ones that may be linked with one of the former: by the triangle inequality their distance from the pivot
    is at most ``1 - percent / 100`` less. Clusters that have become small are searched by a task. Those that don't become
    smaller are dealt in pairs of chunks, each pair a task."""
    found, before = [], None
    for k in range(most_rounds + 1):
        size = materialise(sets.groupBy("root").agg(F.count("*").alias("held"), F.sum("n").alias("words"), F.min("sid").alias("lo")), "sizes")
        large = (F.col("held") > most_sets) | (F.col("words") > most_shingles)
        total = size.agg(F.sum(F.when(large, F.col("held"))), F.count("*")).first()
        known = sets.join(F.broadcast(size) if total[1] * 100 <= broadcast_bytes else size, "root")
        found.append(_grouped(known.filter(~large & (F.col("held") > 1)), "root", ["sid", "reg", "hashes"], _by_sets(percent)))
        if not total[0]:
            return found
        if k == most_rounds or before and total[0] > 0.8 * before:
            break
        before = total[0]
        pivots = known.filter(large & (F.col("sid") == F.col("lo"))).select("root", F.col("sid").alias("pivot"), F.col("n").alias("pn"), F.col("hashes").alias("ph")).dropDuplicates(["root"])
        pivots = materialise(pivots, "pivots")
        bytes_ = pivots.agg(F.sum("pn")).first()[0] * 8
        met = known.filter(large).join(F.broadcast(pivots) if bytes_ <= broadcast_bytes else pivots, "root").filter("sid <> pivot")
        met = met.withColumn("both", _shared("hashes", "ph")).withColumn("either", F.col("n") + F.col("pn") - F.col("both"))
        met = met.withColumns({"links": F.expr(f"100 * both >= {percent} * either"), "away": F.lit(1.0) - F.col("both") / F.col("either")})
        met = materialise(met.select("root", "sid", "n", "reg", "hashes", "pivot", "links", "away"), "met")
        found.append(met.filter("links").select(F.col("pivot").alias("a"), F.col("sid").alias("b")))
        least = met.filter("not links").groupBy("root").agg(F.min("away").alias("least"))
        least = F.broadcast(least) if total[1] * 100 <= broadcast_bytes else least
        sets = materialise(met.join(least, "root").filter(F.expr(f"not links or away >= least - {1 - percent / 100} - 1e-9")).select("root", "sid", "n", "reg", "hashes"), "rest")
    parts = F.greatest(F.ceil(F.col("held") * 2 / most_sets), F.ceil(F.col("words") * 2 / most_shingles)).cast("int")
    dealt = known.filter(large).withColumn("parts", parts).withColumn("c", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    task = F.xxhash64("root", F.least("c", "d"), F.greatest("c", "d"))
    return [*found, _grouped(dealt.withColumn("task", task), "task", ["sid", "reg", "hashes"], _by_sets(percent))]


def links(sets: DataFrame, docs: DataFrame, size: int = 2, percent: int = 80, broadcast_bytes: int = 64 << 20, most_sets: int = MOST_SETS, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """``a, b`` (sids): a forest that connects the sets (sid, n, sig, reg, doc) that confirmed links connect. Both bounds say what
    one task may search."""
    c = materialise(clusters(sets, percent), "clusters")
    size_ = materialise(c.withColumnRenamed("node", "sid").join(sets.select("sid", "n"), "sid").groupBy("root").agg(F.count("*").alias("held"), F.sum("n").alias("words")), "sizes")
    known = join_groups(c.withColumnRenamed("node", "sid"), size_, "root", "held", c.count())
    wanted = materialise(known.join(sets, "sid").select("doc", "sig", "root", "sid", "n", "reg", "held", "words"), "wanted")
    got = materialise(_sets_of(docs, wanted, size, broadcast_bytes), "sets")
    large = (F.col("held") > most_sets) | (F.col("words") > most_shingles)
    out = _grouped(got.filter(~large), "root", ["sid", "reg", "hashes"], _by_sets(percent))
    if size_.filter(large).limit(1).count():
        hot = materialise(got.filter(large).select("root", "sid", "n", "reg", "hashes").dropDuplicates(["sid"]), "hot")
        for part in _apart(hot, percent, broadcast_bytes, most_sets, most_shingles):
            out = out.unionByName(part)
    return out


def _labelled(docs: DataFrame, size: int, percent: int, row_id: str | None = None, **bounds: int) -> DataFrame:
    """``doc_id, row_id, n, best``; ``best`` (x, d, r) is the first row of the component: smallest doc_id, null last, then row id."""
    rows = materialise(sketches(docs, size, row_id), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("d"), F.col("row_id").alias("r")))
    sets = rows.filter("n > 0").groupBy("sig").agg(first.alias("best"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("reg").alias("reg"))
    sets = materialise(sets.withColumn("sid", F.monotonically_increasing_id()), "classes")
    found = links(sets.select("sid", "n", "sig", "reg", F.col("best.d").alias("doc")), docs, size, percent, **bounds)
    roots = materialise(components(found), "roots").withColumnRenamed("node", "sid")
    known = sets.select("sid", "sig", "best", "copies").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    comps = known.groupBy("root").agg(F.min("best").alias("least"), F.count("*").alias("held"))
    label = materialise(join_groups(known.select("sig", "root", "copies"), comps, "root", "held", sets.count()).select("sig", "copies", F.col("least").alias("best")), "labels")
    some = join_groups(rows.filter("n > 0").select("doc_id", "row_id", "n", "sig"), label, "sig", "copies", rows.count()).select("doc_id", "row_id", "n", "best")
    alone = rows.filter("n = 0").select("doc_id", "row_id", "n", F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("d"), F.col("row_id").alias("r")).alias("best"))
    return some.unionByName(alone)


def near_groups(docs: DataFrame, size: int = 2, percent: int = 80, **bounds: int) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs`` (doc_id, text).

    Sets are linked when ``100 * intersection >= percent * union``; ``component_id`` is the smallest doc_id that links reach, null
    ids last; ``kept`` is ``doc_id = component_id``, where nulls are equal. Texts of fewer words than a shingle are one shingle;
    null, empty and blank texts are linked with nothing. Repeated rows are equal sets. An empty table gives no row. Shingles
    are 64-bit hashes; equal sets are told by 128 bits."""
    x = _labelled(docs, size, percent, **bounds)
    return x.select("doc_id", F.col("n").alias("n_shingles"), F.col("best.d").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("best.d")).alias("kept"))


def near_dedup(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """One row of ``docs`` of each component, all columns: that of the smallest doc_id, null last, and of equal ids the first."""
    name = free_name(docs.columns, "_row_id")
    rows = numbered(docs, name)
    gone = _labelled(rows, size, percent, name).filter(F.col("row_id") != F.col("best.r")).select(F.col("row_id").alias(name))
    return drop_rows(rows, gone, name).select(docs.columns)


def op13_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and survivor of every row of ``documents``; edge cases as in near_groups."""
    return near_groups(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN list_transform(w, lambda x: x) ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b)
SELECT a AS doc_id, coalesce(n, 0) AS n_shingles, min(b) AS component_id, a = min(b) AS kept FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a, n
"""
