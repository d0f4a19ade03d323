"""Content-addressed store of token ids: chunks by rolling hash, recipes of documents, Merkle manifests.

A store is a folder of five Parquet tables; the ids in it are little-endian unsigned integers.

``chunks``    hash (binary, 16 bytes of BLAKE2b), ids (binary), width — each distinct chunk once
``recipes``   part, doc_id, row_id, start, n_tokens, chunks (array of hashes in order), root (hash of the recipe), place
``nodes``     part, level, place, root — inner nodes of the Merkle tree, each of at most FAN children
``parts``     part, first_id, n_docs, n_tokens, root — one row for each range of doc_id, in ascending order
``manifest``  version, width, end_id, n_docs, n_tokens, root — one row
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.llm.components import join_groups
from loam.llm.tokens import default_vocabulary, encoder
from loam.session import materialise, shared_dir, texts

#: Ids that the rolling hash covers (a power of two), and the least and greatest ids of a chunk.
WINDOW, LEAST, MOST = 16, 64, 4096
#: A boundary falls where so many bits of the rolling hash are zero: one id in 2**BITS.
BITS = 9
#: Children of one node of the Merkle tree, and bytes of a broadcast row of a chunk's hash with its first place.
FAN, HASH_ROW = 1024, 200
#: Chunks are written in row groups of so many bytes, which a task holds in memory.
WRITE = {"compression": "zstd", "parquet.block.size": str(16 << 20)}


def marks(ids: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places behind which a boundary may fall: where the rolling hash of the last ``WINDOW`` values has ``bits`` zero bits. A
    value is an id plus one; zeros stand between the documents of a batch and count for nothing."""
    h = ids.astype(np.uint64)
    h = (h ^ (h << np.uint64(21))) * np.uint64(0x9E3779B97F4A7C15)
    span = 1
    while span < WINDOW:  # h[i] becomes the sum of the last 2 * span values, each shifted by its distance
        h[span:] = h[span:] + (h[:-span] << np.uint64(span))
        span *= 2
    return np.flatnonzero((h >> np.uint64(40)) & np.uint64((1 << bits) - 1) == 0) + 1


def ends(places: list[int], n: int, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of ``n`` ids with boundaries at ``places`` where the least and greatest lengths allow it."""
    out, at = [], 0
    for m in [*places, n]:
        while m - at > most:
            at += most
            out.append(at)
        if m - at >= least or m == n and m > at:
            at = m
            out.append(at)
    return out


def cuts(ids: np.ndarray, bits: int = BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of one id stream. They depend on the last ``WINDOW`` ids alone, apart from the least and
    greatest lengths, so equal passages fall into equal chunks wherever they stand."""
    return ends(marks(ids.astype(np.uint64) + np.uint64(1), bits).tolist(), len(ids), least, most)


def cuts_of(streams: list[np.ndarray], batch: int = 1 << 18) -> Iterator[list[int]]:
    """``cuts`` of each stream; short ones are hashed together, with zeros between them that no window reaches across."""
    i = 0
    while i < len(streams):
        k, size = i, 0
        while k < len(streams) and (k == i or size + len(streams[k]) <= batch):
            size += len(streams[k]) + WINDOW
            k += 1
        flat, at, starts = np.zeros(size, np.uint64), 0, []
        for s in streams[i:k]:
            starts.append(at)
            flat[at : at + len(s)] = s
            flat[at : at + len(s)] += np.uint64(1)
            at += len(s) + WINDOW
        found = marks(flat)
        lo = np.searchsorted(found, starts, side="right")  # a boundary lies behind an id: from start + 1 to start + n
        hi = np.searchsorted(found, np.array(starts) + [len(s) for s in streams[i:k]], side="right")
        for s, start, a, b in zip(streams[i:k], starts, lo, hi):
            yield ends((found[a:b] - start).tolist(), len(s))
        i = k


def _digest(*parts: bytes) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        h.update(p)
    return h.digest()


def chunked(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """``doc_id, row_id, seq, hash, ids``: the chunks of each document's ids with the end id."""
    names = ["doc_id", "row_id", "seq", "hash", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.array([end_id], enc.type).tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                p = batch.slice(i, 256)
                rows = []
                raws = [raw + end for raw in enc.encode(p.column("text").to_pylist())]
                cut = cuts_of([np.frombuffer(raw, enc.type) for raw in raws])
                for d, r, raw, found in zip(p.column("doc_id").to_pylist(), p.column("row_id").to_pylist(), raws, cut):
                    at = 0
                    for k, c in enumerate(found):
                        part = raw[at * enc.width : c * enc.width]
                        rows.append((d, r, k, _digest(part), part))
                        at = c
                for j in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[j : j + 2000]), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names)

    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row_id"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, row_id long, seq long, hash binary, ids binary")


def _root(chunks: str) -> Column:
    """Hash of a recipe: SHA-256 of its chunks' hashes in upper-case hexadecimal digits, joined."""
    return F.sha2(F.array_join(F.transform(chunks, lambda h: F.hex(h)), ""), 256)


def _running(by_part: DataFrame) -> DataFrame:
    """Sums before each part; there is one row a part, so one task does."""
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return by_part.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, parts: int | None = None, broadcast_bytes: int = 64 << 20) -> None:
    """Encode ``docs`` (doc_id, text) and write the store to ``path``, a folder that all executors reach.

    Documents stand in ascending doc_id order, null ids last, rows of one id in input order; null texts count as empty,
    so each document has its end id at least. Repeated rows are stored as documents of their own and share all chunks.

    Tasks write chunks as they cut them to a table outside the store, which is deleted at the end; of the hashes that
    occur again (narrow rows, broadcast only up to ``broadcast_bytes``) the first occurrence is kept, so ids themselves are
    shuffled only beyond that bound. Recipes hold hashes. Documents are ordered by a range partition of narrow rows;
    positions come from sums by part."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    scratch = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex[:12]}"
    chunked(docs, vocabulary, end_id).write.options(**WRITE).parquet(f"{scratch}/cut")
    cut = spark.read.schema("doc_id long, row_id long, seq long, hash binary, ids binary").parquet(f"{scratch}/cut")
    width = encoder(vocabulary).width
    twice = cut.groupBy("hash").agg(F.count("*").alias("c"), F.min(F.struct("row_id", "seq")).alias("kept")).filter("c > 1")
    twice = materialise(twice, "repeated-chunks")
    if twice.count() * HASH_ROW <= broadcast_bytes:
        marked = cut.join(F.broadcast(twice), "hash", "left")
    else:
        marked = join_groups(cut, twice, "hash", "c", cut.count(), "left")
    first = F.col("kept").isNull() | ((F.col("kept.row_id") == F.col("row_id")) & (F.col("kept.seq") == F.col("seq")))
    marked.filter(first).select("hash", "ids", F.lit(width).alias("width")).write.options(**WRITE).parquet(f"{path}/chunks")

    n: Column = F.expr(f"octet_length(ids) div {width}")
    docs_ = cut.select("doc_id", "row_id", "seq", "hash", n.alias("n")).groupBy("doc_id", "row_id").agg(
        F.sum("n").alias("n_tokens"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "hash"))), lambda x: x["hash"]).alias("chunks")
    )
    key = [F.col("doc_id").asc_nulls_last(), F.col("row_id").asc()]
    ordered = docs_.withColumn("root", _root("chunks")).repartitionByRange(parts, *key).withColumn("part", F.spark_partition_id().cast("long")).sortWithinPartitions(*key)
    ordered.write.parquet(f"{scratch}/ordered")
    ordered = spark.read.schema(ordered.schema).parquet(f"{scratch}/ordered")
    by_part = _running(ordered.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_id")))
    in_part = W.partitionBy("part").orderBy(*key)
    recipes = (
        ordered.withColumn("at", F.coalesce(F.sum("n_tokens").over(in_part.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("place", F.row_number().over(in_part) - 1)
        .join(F.broadcast(by_part.select("part", "before")), "part")
        .select("part", "doc_id", "row_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "chunks", "root", F.col("place").cast("long").alias("place"))
    )
    recipes.write.parquet(f"{path}/recipes")
    nodes = tree(spark.read.parquet(f"{path}/recipes"))
    nodes.write.parquet(f"{path}/nodes")
    tops = _tops(spark.read.parquet(f"{path}/nodes"))
    by_part.join(tops, "part").select("part", "first_id", "n_docs", "n_tokens", "root").write.parquet(f"{path}/parts")
    p = spark.read.parquet(f"{path}/parts")
    p.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), _fold("part", "root").alias("root")).select(
        F.lit(1).alias("version"), F.lit(width).alias("width"), F.lit(end_id).alias("end_id"), "n_docs", "n_tokens", "root"
    ).write.parquet(f"{path}/manifest")
    _delete(spark, scratch)


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store its path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _fold(order: str, root: str) -> Column:
    """SHA-256 of the children's hashes in order: an inner node of the Merkle tree."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, root))), lambda x: x[root]), ""), 256)


def tree(recipes: DataFrame) -> DataFrame:
    """``part, level, place, root`` of all inner nodes over the roots of ``recipes`` (part, place, root).

    A node folds at most ``FAN`` children, so no row and no task grows with a part; each level is a thousandth of the one
    below, and levels go on until every part has one node."""
    level, out = materialise(recipes.select("part", "place", "root"), "roots"), []
    while True:
        k = len(out) + 1
        up = level.withColumn("up", F.expr(f"place div {FAN}")).groupBy("part", "up").agg(_fold("place", "root").alias("root"))
        level = materialise(up.select("part", F.lit(k).alias("level"), F.col("up").alias("place"), "root"), "nodes")
        out.append(level)
        if not level.filter("place > 0").limit(1).count():
            return reduce(DataFrame.unionByName, out)


def _tops(nodes: DataFrame) -> DataFrame:
    """``part, root``: the node of the highest level of each part."""
    return nodes.groupBy("part").agg(F.max_by("root", "level").alias("root"))


def _meet(steps: DataFrame, chunks: DataFrame) -> DataFrame:
    """``steps`` (with hash) left-joined to ``chunks``. Hashes of over a thousandth of the steps, 1000 at most, get their
    chunks by broadcast, so that a chunk of very many documents is no single task."""
    least = max(1000, steps.count() // 1000)
    hot = materialise(steps.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("hash", F.lit(True).alias("_hot")), "hot")
    if not hot.limit(1).count():
        return steps.join(chunks, "hash", "left")
    marked = steps.join(F.broadcast(hot), "hash", "left")
    many = marked.filter("_hot").drop("_hot").join(F.broadcast(chunks.join(F.broadcast(hot.select("hash")), "hash", "left_semi")), "hash", "left")
    return many.unionByName(marked.filter("_hot is null").drop("_hot").join(chunks, "hash", "left"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, row_id, start, n_tokens, ids`` (array of binaries in order) of every document, from the stored chunks."""
    read = lambda t: spark.read.parquet(f"{path}/{t}")
    recipes = read("recipes")
    steps = recipes.select("row_id", F.posexplode("chunks").alias("seq", "hash"))
    lists = _meet(steps, read("chunks").select("hash", "ids")).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("x"))
    return recipes.select("doc_id", "row_id", "start", "n_tokens").join(lists, "row_id").withColumn("ids", F.col("x.ids")).drop("x")


@lru_cache(maxsize=1)
def _zeros() -> list[np.ndarray]:
    """For each k, what 2**k zero bytes make of a CRC-32 register that holds one bit (32 columns over GF(2))."""
    step = np.array([0xEDB88320, *(1 << i for i in range(31))], np.uint32)  # one zero bit
    square = lambda m: np.array([np.bitwise_xor.reduce(m[[j for j in range(32) if int(v) >> j & 1]]) for v in m], np.uint32)
    for _ in range(3):
        step = square(step)
    out = [step]
    for _ in range(47):
        out.append(square(out[-1]))
    return out


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC-32 values as they enter a CRC over ``n`` more bytes; the CRC of joined parts is the XOR of such values."""
    crc, n = crc.astype(np.uint32), n.astype(np.int64)
    for k, m in enumerate(_zeros()[: max(1, int(n.max(initial=0)).bit_length())]):
        on = np.flatnonzero(n >> k & 1)
        if len(on):
            old, new = crc[on], np.zeros(len(on), np.uint32)
            for j in range(32):
                new ^= np.where(old >> np.uint32(j) & np.uint32(1), m[j], np.uint32(0))
            crc[on] = new
    return crc


def chunk_digests(chunks: DataFrame, width: int) -> DataFrame:
    """``hash, n, crc, good`` of each stored chunk: its ids, their CRC-32 as 32-bit values, whether the hash is right."""
    kind = np.dtype("<u2" if width == 2 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids").to_pylist()
            crc = [zlib.crc32(np.frombuffer(x, kind).astype("<u4").tobytes()) for x in ids]
            good = [_digest(x) == h for x, h in zip(ids, b.column("hash").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("hash"), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(good, pa.bool_())], ["hash", "n", "crc", "good"])

    return chunks.select("hash", "ids").mapInArrow(run, "hash binary, n long, crc long, good boolean")


def digests(spark: SparkSession, path: str, width: int) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, intact, row_id`` of each document, from the stored chunks and recipes.

    Each chunk file is read once; a document's CRC-32 comes from its chunks' by ``shifted``, so that only narrow rows
    are shuffled. A missing or changed chunk, or a recipe that doesn't fit its root, makes ``intact`` false."""
    recipes = spark.read.parquet(f"{path}/recipes")
    steps = recipes.select("row_id", F.posexplode("chunks").alias("seq", "hash"))
    found = _meet(steps, materialise(chunk_digests(spark.read.parquet(f"{path}/chunks"), width), "digests"))
    lists = found.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "crc", "good", "hash"))).alias("x"))
    rows = recipes.select("doc_id", "row_id", "start", "root").join(lists, "row_id")
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "intact", "row_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x")
            ends = np.cumsum([len(v) for v in x])
            flat = x.flatten()
            get = lambda f, t, z: np.array(flat.field(f).fill_null(z).to_numpy(zero_copy_only=False), t)
            n, crc, good, h = get("n", np.int64, 0), get("crc", np.uint32, 0), get("good", bool, False), flat.field("hash").to_pylist()
            starts = np.r_[0, ends[:-1]]
            done = np.cumsum(n)
            after = np.repeat(done[ends - 1], ends - starts) - done
            total = np.bitwise_xor.reduceat(shifted(crc, after * 4), starts)
            ok = [bool(good[s:e].all()) and hashlib.sha256(b"".join(h[s:e]).hex().upper().encode()).hexdigest() == r for s, e, r in zip(starts, ends, b.column("root").to_pylist())]
            cols = [b.column("doc_id"), b.column("start"), pa.array(np.add.reduceat(n, starts)), pa.array(total.astype(np.int64)), pa.array(ok), b.column("row_id")]
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.select("doc_id", "row_id", "start", "root", "x").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, intact boolean, row_id long")


def tree_holds(spark: SparkSession, path: str) -> bool:
    """Whether all nodes, parts' roots and the manifest's root and sums follow from the recipes."""
    read = lambda t: spark.read.parquet(f"{path}/{t}")
    key = ["part", "level", "place"]
    bad = tree(read("recipes")).withColumnRenamed("root", "again").join(read("nodes"), key, "full").filter(~F.col("again").eqNullSafe(F.col("root"))).limit(1).count()
    bad += _tops(read("nodes")).withColumnRenamed("root", "again").join(read("parts"), "part", "full").filter(~F.col("again").eqNullSafe(F.col("root"))).limit(1).count()
    sums = read("parts").agg(_fold("part", "root").alias("root"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    return not bad and sums.join(read("manifest"), ["root", "n_docs", "n_tokens"]).count() == 1


def verify(spark: SparkSession, path: str) -> bool:
    """Whether the tree holds and every document's recipe and chunks fit their hashes."""
    width = spark.read.parquet(f"{path}/manifest").first()["width"]
    return tree_holds(spark, path) and not digests(spark, path, width).filter("not intact").limit(1).count()


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``documents`` as a store in the shared folder, verify its tree and read every document back from its chunks.

    One row for each row of ``documents``: doc_id, start, n_tokens (with the end id), ids_crc32; then ``intact``, whether
    tree, recipe and chunks fit their hashes, and the number of the row. Null texts have the end id alone."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex[:12]}"
    vocabulary = default_vocabulary()
    write_store(texts(spark, sf_dir), path, vocabulary)
    holds = tree_holds(spark, path)
    return digests(spark, path, encoder(vocabulary).width).withColumn("intact", F.col("intact") & F.lit(holds))
