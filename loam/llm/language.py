"""Language identification: bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.llm.quality import remainder
from loam.session import texts

#: Lengths of the n-grams, hash functions, and slots of the filter, each with one bit a language.
LENGTHS, HASHES, SLOTS = (1, 2, 3, 4), 3, 1 << 17

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def grams(text: str | None) -> np.ndarray:
    """64-bit hashes of the n-grams of a text's letters in lower case, one space between words and around them."""
    if not text:
        return np.zeros(0, np.uint64)
    p = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    p = np.where(_letter_table()[p], p, 32)
    p = np.r_[32, p, 32]
    p = p[np.r_[True, (p[1:] != 32) | (p[:-1] != 32)]].astype(np.uint64)
    if len(p) < 2:
        return np.zeros(0, np.uint64)
    out, h = [], np.zeros(len(p), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        if len(p) < n:
            break
        h = (h[: len(p) - n + 1] * np.uint64(0x100000001B3) + p[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        if n in LENGTHS:
            out.append(h[h != h[0]] if n == 1 else h)  # a space alone says nothing
    x = np.concatenate(out)
    return x ^ x >> np.uint64(29)


def _slots(h: np.ndarray) -> list[np.ndarray]:
    """One slot of each hash function."""
    out = []
    for k in range(HASHES):
        h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((h >> np.uint64(40)).astype(np.int64) % SLOTS)
    return out


class Filters:
    """Slot s holds a mask of the languages that set bit s, in words of 64 languages; the masks of an n-gram's slots, ANDed,
    are the languages that contain it."""

    def __init__(self, grams_of: dict[str, np.ndarray]):
        self.languages = sorted(grams_of)
        self.masks = np.zeros((max(1, -(-len(self.languages) // 64)), SLOTS), np.uint64)
        for i, name in enumerate(self.languages):
            for s in _slots(grams_of[name]):
                self.masks[i // 64][s] |= np.uint64(1 << i % 64)
        bits = [float((self.masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean()) for i in range(len(self.languages))]
        self.false = np.array([b**HASHES for b in bits])

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Of n-grams that each language contains, corrected for those that it only seems to contain."""
        slots = _slots(h)
        mask = [np.bitwise_and.reduce([m[s] for s in slots]) for m in self.masks]
        seen = np.array([int((mask[i // 64] >> np.uint64(i % 64) & np.uint64(1)).sum()) for i in range(len(self.languages))], float)
        return np.maximum((seen - len(h) * self.false) / np.maximum(1 - self.false, 1e-9), 0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the most n-grams, first by name if several have, and its share of all languages' counts."""
        h = grams(text)
        if not len(h) or not self.languages:
            return "und", 0.0
        c = self.counts(h)
        return self.languages[int(c.argmax())], float(c.max() / c.sum()) if c.sum() else 0.0


def learn(docs: DataFrame, per_language: int = 2000, grams_each: int = 4000) -> Filters:
    """Filters of the ``grams_each`` most frequent n-grams of each language in about ``per_language`` of its documents.

    Only rows whose remainder isn't 2 and that have a text and a language teach. The bound is kept by a hash of doc_id
    against the language's share, so what is counted and what reaches the driver grow with the languages, not with the
    corpus. Every language of such rows is learned."""
    some = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "lang").filter("doc_id is not null and text is not null and lang is not null").filter(remainder() != 2)
    of = some.groupBy("lang").count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = some.join(F.broadcast(of), "lang").filter(part * F.col("count") < per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: dict[str, list[np.ndarray]] = {}
            for name, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                texts.setdefault(name, []).append(grams(t))
            for name, hs in texts.items():
                h, n = np.unique(np.concatenate(hs), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(h)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = some.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= grams_each)
    found: dict[str, list[int]] = {}
    for r in top.select("lang", "gram").toLocalIterator():
        found.setdefault(r["lang"], []).append(r["gram"])
    return Filters({k: np.array(sorted(v), np.int64).view(np.uint64) for k, v in found.items()})


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """``doc_id, lang_pred, score`` of each whole text; ``und`` and 0 for null texts and those without letters."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # SLOTS masks for each 64 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``, one row for each; edge cases as in identify."""
    docs = texts(spark, sf_dir)
    return identify(docs, learn(docs)).select("doc_id", (remainder() == 2).alias("held_out"), "lang_pred", "score")
