"""Benchmark decontamination: a generalised suffix automaton of the test items reads every document's words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.components import drop_rows, free_name, numbered
from loam.session import materialise, table, texts

#: Maps every byte that is in no word to a space and A-Z to a-z; bytes from 0x80 on are word bytes.
_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: Words of one block of items: at most twice as many states of the automaton, about 200 MB in a worker.
BLOCK_WORDS = 300_000
FOLD = bytes((c if c in _WORD else 0x20) for c in bytes(range(256)).lower())


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text after lower-casing A-Z; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences, with what is needed to tell windows from other matches.

    A window is ``window`` words in a row of an item, or the whole of a shorter item. ``held[s]`` are the items with a
    window that is the suffix of length ``window`` of state s; ``whole[s]`` the short items that end in s or in a
    suffix of it, longest first."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        seqs = [(k, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for k, ws in items]
        for _, seq in seqs:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.at = self._window_states()
        held: dict[int, set[str]] = {}
        short: dict[int, set[tuple[int, str]]] = {}
        for k, seq in seqs:
            s = 0
            for i, c in enumerate(seq):
                s = self.next[s][c]
                if i + 1 >= window:
                    held.setdefault(self.at[s], set()).add(k)
            if 0 < len(seq) < window:
                short.setdefault(s, set()).add((len(seq), k))
        self.held = {s: tuple(v) for s, v in held.items()}
        self.whole: list[tuple[tuple[int, str], ...]] = [()] * len(self.len)
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            self.whole[s] = tuple(sorted(short.get(s, ()), reverse=True)) + self.whole[self.link[s]]
        self.least = min((min(len(seq), window) for _, seq in seqs if seq), default=0)

    def _window_states(self) -> list[int]:
        """For each state the one of its suffix of the window's length, taken from its link in order of length; itself where it
        has no longer link."""
        out = list(range(len(self.len)))
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            if self.len[self.link[s]] >= self.window:
                out[s] = out[self.link[s]]
        return out

    def _clone(self, p: int, c: int, q: int) -> int:
        r = len(self.len)
        self.len.append(self.len[p] + 1)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.link[q] = r
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = r
            p = self.link[p]
        return r

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q)
        cur = len(self.len)
        self.len.append(self.len[last] + 1)
        self.next.append({})
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return cur

    def read(self, ids: list[int], start: int, spans: list[list[int]], items: set[str]) -> int:
        """Follow known words; append hit spans (word positions, end exclusive) and items. Longest match."""
        s, n, best = 0, 0, 0
        for i, c in enumerate(ids, start):
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.len[s]
            if c in self.next[s]:
                s = self.next[s][c]
                n += 1
            best = max(best, n)
            size = 0
            if n >= self.window:
                size = self.window
                items.update(self.held.get(self.at[s], ()))
            for length, k in self.whole[s]:
                if length <= n:
                    size = max(size, length)
                    items.add(k)
            if size:
                if spans and spans[-1][1] >= i + 1 - size:
                    spans[-1][0] = min(spans[-1][0], i + 1 - size)
                    spans[-1][1] = i + 1
                else:
                    spans.append([i + 1 - size, i + 1])
        return best


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def matches(auto: Automaton, text: str | None) -> tuple[int, list[list[int]], set[str], int]:
    """Number of words, hit spans in order, items hit and longest match of one text."""
    ws = words(text)
    spans, found, best = [], set(), 0
    if auto.least and len(ws) >= auto.least:
        get = auto.vocab.get
        ids = np.array([get(w, -1) for w in ws], np.int32)
        known = np.flatnonzero(np.diff(np.r_[False, ids >= 0, False]))
        for a, e in known.reshape(-1, 2).tolist():  # runs of words that some item has
            if e - a >= auto.least:
                best = max(best, auto.read(ids[a:e].tolist(), a, spans, found))
    return len(ws), merged(spans), found, best


SCAN = "doc_id long, row_id long, n_words long, spans array<array<long>>, items array<string>, longest long"
_SCAN_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()), pa.int64()]


def _scan(docs: DataFrame, items: list[tuple[str, list[bytes]]], window: int, hits_only: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(items, window))
    names = [x.split()[0] for x in SCAN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value
        for b in batches:
            out = []
            for d, r, t in zip(b.column("doc_id").to_pylist(), b.column("row_id").to_pylist(), b.column("text").to_pylist()):
                n, spans, found, best = matches(auto, t)
                if spans or not hits_only:
                    out.append((d, r, n, spans, sorted(found), best))
            for i in range(0, len(out), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 5000]), _SCAN_TYPES)], names)

    return docs.mapInArrow(run, SCAN)


class Blocks:
    """Items in blocks of about ``block_words`` words, dealt by a hash on Spark; the driver holds one block at a time.

    A null item_id counts as the empty string, whatever the type of the others. One item is never divided."""

    def __init__(self, items: DataFrame, block_words: int):
        rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string"))
        size = rows.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))).alias("n")).first()["n"] or 0
        self.n = max(1, -(-size // block_words))
        self.rows = rows if self.n == 1 else materialise(rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n))), "items")

    def read(self, k: int) -> list[tuple[str, list[bytes]]]:
        """Identifiers and words of the items of block ``k``."""
        rows = self.rows if self.n == 1 else self.rows.filter(F.col("block") == k)
        return [(r["item_id"], words(r["text"])) for r in rows.select("item_id", "text").toLocalIterator()]


def scan(docs: DataFrame, items: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS, row_id: str | None = None) -> DataFrame:
    """``doc_id, row_id, n_words, spans, items, longest`` for every row of ``docs`` (doc_id, text).

    ``spans`` are word positions (end exclusive) that lie in an occurrence of a window of ``items`` (item_id, text):
    ``window`` words in a row, or a whole item of fewer words. ``longest`` is the longest match in runs of words that are
    long enough for a window. Null texts have no words; items without words, or none at all, hit nothing; a null item_id
    counts as the empty string; repeated rows are judged one by one and equal items are all named. Row ids are those of
    the column ``row_id``, if given. An empty table gives no row.

    Items are read in blocks of about ``block_words`` words, each an automaton of bounded size that is broadcast. Test
    sets beyond that take one pass a block over rows that are written with numbers; what each pass finds is written, and
    only rows with hits are merged."""
    return _scanned(docs, Blocks(items, block_words), window, row_id)


def _scanned(docs: DataFrame, blocks: Blocks, window: int, row_id: str | None) -> DataFrame:
    number = F.col(row_id) if row_id else F.monotonically_increasing_id()
    rows = docs.select(F.col("doc_id").cast("long"), number.alias("row_id"), F.col("text").cast("string"))
    if blocks.n == 1:
        return _scan(rows, blocks.read(0), window, False)
    rows = rows if row_id else materialise(rows, "numbered")
    parts = [materialise(_scan(rows, blocks.read(k), window, k > 0), "scanned") for k in range(blocks.n)]
    every = reduce(DataFrame.unionByName, parts).groupBy("row_id").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"),
    )
    join = F.udf(merged, "array<array<long>>")
    return every.select("doc_id", "row_id", "n_words", join("s").alias("spans"), "items", "longest")


def judged(scanned: DataFrame, share: float = 0.05) -> DataFrame:
    """Adds ``n_hit`` and ``contaminated``: some word is hit, and hit words are at least ``share`` of all."""
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return scanned.withColumn("n_hit", n).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * round(1 / share) >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame, window: int = 13, share: float = 0.05, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without contaminated rows, all columns; null and empty texts stay, an empty table gives no row.

    Each row is judged by its own text, whatever its doc_id. With items of one block each task drops its own rows and
    nothing is shuffled. With more, rows are written with numbers, judged over all blocks and dropped by number, with the
    same result."""
    blocks = Blocks(items, block_words)
    if blocks.n > 1:
        name = free_name(docs.columns, "_row_id")
        rows = numbered(docs, name)
        bad = judged(_scanned(rows, blocks, window, name), share).filter("contaminated").select(F.col("row_id").alias(name))
        return drop_rows(rows, bad, name).select(docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(blocks.read(0), window))
    at = docs.columns.index("text")
    part = round(1 / share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for t in b.column(at).to_pylist():
                n, spans, _, _ = matches(shared.value, t)
                hit = sum(e - a for a, e in spans)
                keep.append(not hit or hit * part < n)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def remove_spans(docs: DataFrame, items: DataFrame, window: int = 13, most_words: int = 200, share: float = 0.05) -> DataFrame:
    """``docs`` with ``text`` freed of hit spans. A document goes wholly if a span has over ``most_words`` words or hit
    words are at least ``share`` of all; from the others each span is cut out, from its first word to its last."""
    number = free_name(docs.columns, "_row_id")
    rows = numbered(docs, number)
    judged_ = judged(scan(rows, items, window, row_id=number), share)
    longest = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: F.greatest(a, s[1] - s[0]))
    hit = judged_.filter("n_hit > 0").select(F.col("row_id").alias(number), "spans", (F.col("contaminated") | (longest > most_words)).alias("_go"))
    kept = drop_rows(rows, hit.filter("_go").select(number), number)

    @F.pandas_udf("string")
    def cut(text, spans):
        import re

        word = re.compile(rb"[0-9a-z\x80-\xff]+")

        def one(t, s):
            if s is None:
                return t
            raw = t.encode("utf-8", "surrogatepass")
            at = [m.span() for m in word.finditer(raw.translate(FOLD))]
            for a, b in reversed([tuple(x) for x in s]):
                raw = raw[: at[a][0]] + raw[at[b - 1][1] :]
            return raw.decode("utf-8", "surrogatepass")

        return text.combine(spans, one)

    name = free_name(docs.columns, "_spans")
    spans = hit.filter("not _go").select(number, F.col("spans").alias(name))
    joined = kept.join(spans, number, "left")
    return joined.withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(cut("text", name))).select(docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and hit items of every document, and whether it is contaminated (a twentieth of its words or more).

    One row for each row of ``documents``, null texts with 0 words; ``longest`` is the longest match."""
    x = judged(scan(texts(spark, sf_dir), table(spark, sf_dir, "benchmark")))
    names = F.array_join(F.array_sort("items"), ",")
    return x.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated", "longest")
