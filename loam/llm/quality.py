"""Quality classifier: n-gram indicators scaled by class log-count ratios, and a linear hinge-loss model on them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.components import free_name
from loam.session import table, texts

#: Character classes of the shape n-grams; characters of no class here are letters of lower case (2), of upper case
#: (3), digits (4), white space (0) or others (15).
MARKS = {"\n": 1, ".": 5, ",": 6, "!": 7, "?": 7, "#": 8, "$": 9, "%": 10, "&": 11, "*": 12, "|": 13}
SHAPES, REPEATS, WORD_BITS = 5, 4, 18
_SHAPE_AT = [sum(16**k for k in range(1, n)) for n in range(1, SHAPES + 2)]
_REPEAT_AT = _SHAPE_AT[-1]
_WORD_AT = _REPEAT_AT + 2 ** (REPEATS + 1)
SIZE = _WORD_AT + (2 << WORD_BITS)

_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    if not _classes:
        t = np.full(1 << 16, 15, np.uint8)
        for i in range(1 << 16):
            c = chr(i)
            t[i] = MARKS.get(c, 0 if c.isspace() else 3 if c.isupper() else 2 if c.isalpha() else 4 if c.isdigit() else 14 if i < 128 else 15)
        _classes.append(t)
    return _classes[0]


def features(text: str | None) -> np.ndarray:
    """Ascending indices of the n-grams that a text has: of its character classes with runs taken once, of whether each
    word repeats the one before, and hashed words and word pairs in lower case. A text without characters has none."""
    if not text:
        return np.zeros(0, np.int32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    shape = _class_table()[np.minimum(points, 0xFFFF)]
    shape = shape[np.r_[True, shape[1:] != shape[:-1]]].astype(np.int32)
    out, code = [], np.zeros(len(shape), np.int32)
    for n in range(1, SHAPES + 1):
        if len(shape) >= n:
            code = code[: len(shape) - n + 1] * 16 + shape[n - 1 :]
            out.append(code + _SHAPE_AT[n - 1])
    words = text.lower().split()
    same = np.array([a == b for a, b in zip(words, words[1:])], np.int32)
    code = np.ones(len(same), np.int32)
    for n in range(1, REPEATS + 1):
        if len(same) >= n:
            code = code[: len(same) - n + 1] * 2 + same[n - 1 :]
            out.append(code + _REPEAT_AT)
    h = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    out.append((h % np.uint64(1 << WORD_BITS)).astype(np.int32) + _WORD_AT)
    if len(h) > 1:
        two = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - WORD_BITS)
        out.append(two.astype(np.int32) + _WORD_AT + (1 << WORD_BITS))
    return np.unique(np.concatenate(out))


def _fit(x: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights of the L1-loss linear support vector machine by dual coordinate descent, and its bias."""
    w, b = np.zeros(SIZE, np.float32), 0.0
    vals = [_scaled(i, ratio) for i in x]
    q = np.array([float(v @ v) + 1 for v in vals])
    share = {s: max((y == s).mean(), 1e-9) for s in (-1, 1)}
    most = np.array([cost * 0.5 / share[s] for s in y])
    alpha, rng = np.zeros(len(x)), np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            g = y[i] * (float(w[x[i]] @ vals[i]) + b) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x[i]] += np.float32(step) * vals[i]
                b += step
                alpha[i] = new
    return w, b


def _scaled(i: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    v = ratio[i]
    n = float(np.sqrt(v @ v))
    return v / np.float32(n) if n else v


def _ratio(x: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log ratio of smoothed indicator counts of the two classes; n-grams of one text only have none."""
    pos, neg = np.ones(SIZE), np.ones(SIZE)
    for i, s in zip(x, y):
        (pos if s > 0 else neg)[i] += 1
    r = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    r[pos + neg <= 3] = 0
    return r.astype(np.float32)


@dataclass
class Model:
    """Score of a text: sigmoid(slope * margin + shift)."""

    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, text: str | None) -> float:
        i = features(text)
        m = float(self.weights[i] @ _scaled(i, self.ratio)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -500, 500))))


def _calibrated(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a sigmoid by Newton steps on smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - t) * margins).sum() + 1e-3 * a, (p - t).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margins * margins).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 5 / max(np.abs(d).max(), 1e-9))
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-6:
            break
    return float(a), float(b)


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; the remainder 2 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 8000, cost: float = 1.0, rounds: int = 8, seed: int = 1) -> Model:
    """Fit on at most ``most_rows`` labelled rows that aren't held out, chosen by a hash of doc_id.

    The bound keeps what reaches the driver small whatever the corpus: the chosen ids are broadcast, their texts become
    n-gram indices on the executors. Of rows that share an id the least text teaches, and the greater label. The sigmoid is
    fitted to margins of rows left out in turn. Rows with a null id, text or label teach nothing; with one class or none,
    scores are 1, 0 or 0.5 everywhere."""
    ids = labels.filter("doc_id is not null and quality in (0, 1)").filter(remainder() != 2).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most_rows)
    some = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("text is not null").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t).astype("<i4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(x, pa.binary())], ["doc_id", "quality", "x"])

    once = some.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = {r["doc_id"]: r for r in once.mapInArrow(run, "doc_id long, quality int, x binary").toLocalIterator()}
    rows = [rows[k] for k in sorted(rows)]
    x = [np.frombuffer(r["x"], "<i4") for r in rows]
    y = np.array([1 if r["quality"] else -1 for r in rows])
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0.0, 0.0, 0.0 if not len(y) else 500.0 * y[0])
    margins, fold = np.zeros(len(y)), np.arange(len(y)) % 3
    for k in range(3):
        inn, out = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        ratio = _ratio([x[i] for i in inn], y[inn])
        w, b = _fit([x[i] for i in inn], y[inn], ratio, cost, rounds, seed)
        margins[out] = [float(w[x[i]] @ _scaled(x[i], ratio)) + b for i in out]
    ratio = _ratio(x, y)
    w, b = _fit(x, y, ratio, cost, rounds, seed)
    return Model(ratio, w, b, *_calibrated(margins, y))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score as column ``name``, which takes the place of one of that name; null and empty texts get the score of a text without n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by SIZE

    @F.pandas_udf("double")
    def score(text):
        return text.map(shared.value.score, na_action=None).astype(float)

    return docs.withColumn(name, score(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, all columns."""
    name = free_name(docs.columns, "_quality")
    return scored(docs, train(docs, labels), name).filter(F.col(name) >= threshold).select(docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """Score of every whole text of ``documents``, one row for each; null texts score as texts without n-grams."""
    docs = texts(spark, sf_dir)
    s = scored(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return s.select("doc_id", (remainder() == 2).alias("held_out"), "score").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
