"""Packing of token streams into windows by minimum bin slack."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.tokens import default_vocabulary, encoder
from loam.session import texts

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def fill(counts: list[int], capacity: int, first: int) -> dict[int, int]:
    """The multiset of lengths, ``first`` among them, whose sum comes closest to ``capacity`` without exceeding it.

    ``counts[n]`` pieces of length ``n`` are at hand. A bitset holds the sums that can be reached; lengths enter from
    the longest to the shortest, each as powers of two of its count, until the capacity itself is reached. Then the
    steps are walked back to count what each length gives. ``first`` counts as taken once."""
    room = capacity - first
    keep = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n in range(min(room, len(counts) - 1), 0, -1):
        left = min(counts[n] - (n == first), room // n)
        k = 1
        while left > 0:
            take = min(k, left)
            grown = (reach | reach << take * n) & keep
            if grown != reach:
                steps.append((n, take, reach))
                reach = grown
            left -= take
            k *= 2
        if reach >> room & 1:
            break
    got: dict[int, int] = defaultdict(int)
    got[first] += 1
    total = reach.bit_length() - 1
    for n, take, before in reversed(steps):
        if not before >> total & 1:
            got[n] += take
            total -= take * n
    return dict(got)


def bins(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into ``lengths`` (1 to ``capacity - 1`` each). The longest piece left always opens the next bin;
    a multiset that is found is used as often as the counts allow."""
    where: list[list[int]] = [[] for _ in range(capacity)]
    for i in range(len(lengths) - 1, -1, -1):
        where[lengths[i]].append(i)
    counts, out = [len(x) for x in where], []
    for first in range(capacity - 1, 0, -1):
        while counts[first]:
            got = fill(counts, capacity, first)
            for _ in range(min(counts[n] // c for n, c in got.items())):
                out.append([where[n].pop() for n, c in got.items() for _ in range(c)])
                for n, c in got.items():
                    counts[n] -= c
    return out


def _group(docs: list[tuple[int | None, bytes]], width: int, capacity: int, base: int) -> Iterator[list]:
    """Pieces of one group of documents; sequences are numbered from ``base``.

    Full windows leave first. The rest of each document goes to a bin; a bin that stays short after that takes what
    can be cut from the shortest bins, so one sequence at most stays short, and it is cut at powers of two, which need
    no padding."""
    kind = np.dtype("<u2" if width == 2 else "<u4")
    wide = [np.frombuffer(raw, kind).astype("<u4") for _, raw in docs]
    seqs: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for d, ids in enumerate(wide):
        n = len(ids)
        seqs += [[(d, at, capacity)] for at in range(0, n - capacity + 1, capacity)]
        if n % capacity:
            rest.append((d, n - n % capacity, n % capacity))
    packed = [[rest[i] for i in b] for b in bins([x[2] for x in rest], capacity)]
    size = lambda s: sum(x[2] for x in s)
    seqs += [s for s in packed if size(s) == capacity]
    short = sorted((s for s in packed if size(s) < capacity), key=size)
    lo, hi = 0, len(short) - 1
    while lo <= hi:
        s, need = short[hi], capacity - size(short[hi])
        while need and lo < hi:
            d, at, n = short[lo].pop()
            cut = min(n, need)
            s.append((d, at, cut))
            if cut < n:
                short[lo].append((d, at + cut, n - cut))
            if not short[lo]:
                lo += 1
            need -= cut
        if not need:
            seqs.append(s)
        else:
            seqs += _powers(s)
        hi -= 1
    for k, s in enumerate(seqs):
        offset, total = 0, size(s)
        for d, at, n in s:
            yield [docs[d][0], at, n, zlib.crc32(wide[d][at : at + n].tobytes()), len(wide[d]), base + k, offset, total]
            offset += n


def _powers(s: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces of a short sequence, cut into sequences of as many ids as powers of two add up to its length."""
    s, left, out = list(reversed(s)), sum(x[2] for x in s), []
    while left:
        need = 1 << (left.bit_length() - 1)
        left -= need
        out.append([])
        while need:
            d, at, n = s.pop()
            cut = min(n, need)
            out[-1].append((d, at, cut))
            if cut < n:
                s.append((d, at + cut, n - cut))
            need -= cut
    return out


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, group_tokens: int = 4_000_000) -> DataFrame:
    """One row for each piece of a document (``doc_id``, ``text``) in a sequence of at most ``capacity`` ids.

    Each task encodes its own rows and packs them in groups of about ``group_tokens`` ids, so nothing is shuffled and
    memory has a bound, but for a single text. Null and empty texts have the end id alone. Repeated rows and ids are
    packed one by one; a null doc_id is kept as null; other columns are ignored; an empty table gives no row.

    A group's last sequence, if short, is cut at powers of two. The rows of a partition are taken in the order they
    come in: read them from a table, so that a repeated task sees the same rows."""
    if not 2 <= capacity <= 1 << 20:
        raise ValueError("capacity: 2 to 2**20")
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.array([end_id], enc.type).tobytes()
        base, held, size = TaskContext.get().partitionId() << 36, [], 0

        def flush():
            rows = list(_group(held, enc.width, capacity, base))
            for i in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 50_000])], names)
            return len({r[5] for r in rows})

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for d, raw in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text").to_pylist())):
                    held.append((d, raw + end))
                    size += len(raw) // enc.width + 1
                if size >= group_tokens:
                    base += yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all ``documents`` in sequences of 2048 ids; edge cases as in pack."""
    return pack(texts(spark, sf_dir), default_vocabulary())
