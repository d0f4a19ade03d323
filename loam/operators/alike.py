"""Near duplicates among phrases of two words: phrases that share a part of themselves meet in groups and are compared there.

Words (a, b) and (c, d) are near duplicates in one of these ways, so each pair is found once, in one group:

1. a is c, and b and d are one or two edits apart; groups of one first word
2. b is d, and a and c are one or two edits apart; groups of one second word
3. each word is one edit from the other's; groups of what is left of a first word when a character goes or none
4. two edits move the blank: c is a, perhaps a character, and m, b is m, perhaps a character, and d; groups of (a, d), to which the first
   phrase comes with each end of b, the second with each beginning of c
5. they are the same two words the other way round, and not two edits apart

Only phrases and hashes are shuffled, about 15 rows a phrase; what is left of words when characters go is made and compared in tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Two words with one blank between them.
TWO = r"^[^ \x00]+ [^ \x00]+\z"
FIRST, SECOND, BOTH, BEFORE, AFTER, TURNED = 1, 2, 3, 4, 5, 6
#: Shuffled rows a task gets about, rows it compares at a time, and pairs it looks at at a time.
PART_ROWS, BLOCK_ROWS, MOST_PAIRS = 1_500_000, 120_000, 2_000_000
_BASE, _ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BACK2 = np.uint64(pow(int(_BASE), -2, 1 << 64))
_SEED = [np.uint64(int(_ODD) * k % (1 << 64)) for k in range(7)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return (h ^ (h >> np.uint64(29))) * _ODD


class Words:
    """Words as rows of a matrix of characters, zeros behind them, and sums from which the hash of a word without some characters follows."""

    def __init__(self, chars: np.ndarray):
        self.m, self.n = chars, (chars != 0).sum(1)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(chars.shape[1] - 1, 0), _BASE)]))[: chars.shape[1]]
        self.f = np.zeros((len(chars), chars.shape[1] + 1), np.uint64)
        np.cumsum(chars * power, axis=1, out=self.f[:, 1:])
        self.whole = self.f[:, -1]

    def starts(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Those of the rows whose character ``i`` is there and not the one before it again, as it makes no difference which goes."""
        rows = rows[self.n[rows] > i]
        return rows if i == 0 else rows[self.m[rows, i] != self.m[rows, i - 1]]

    def without(self, rows: np.ndarray, i: np.ndarray | int) -> np.ndarray:
        return self.f[rows, i] + _BACK * (self.whole[rows] - self.f[rows, np.add(i, 1)])

    def end(self, rows: np.ndarray, i: np.ndarray | int) -> np.ndarray:
        """Hash of what begins with character ``i``."""
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.m.shape[1] + 1, _BACK)]))
        return (self.whole[rows] - self.f[rows, np.minimum(i, self.m.shape[1])]) * back[i]

    def rests(self, rows: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and hashes of what is left of their words when up to ``most`` characters go."""
        yield rows, self.whole[rows]
        for i in range(self.m.shape[1]):
            r = self.starts(i, rows)
            if not len(r):
                continue
            yield r, self.without(r, i)
            for j in range(i + 1, self.m.shape[1] if most > 1 else 0):
                s = r[self.n[r] > j] if j == i + 1 else self.starts(j, r)
                if len(s):
                    f = self.f
                    yield s, f[s, i] + _BACK * (f[s, j] - f[s, i + 1]) + _BACK2 * (self.whole[s] - f[s, j + 1])


def _two_words(phrases: list[str]) -> tuple[np.ndarray, Words, Words]:
    """The phrases, their first and their second words."""
    a = np.array(phrases, dtype=np.str_)
    m = a.view(np.uint32).reshape(len(a), -1)
    m = m.astype(np.uint8) if m.max() < 256 else m
    at = (m == 32).argmax(1)
    n = (m != 0).sum(1)
    col = np.arange(m.shape[1])
    first = np.where(col < at[:, None], m, 0)[:, : at.max()]
    from_ = np.minimum(at[:, None] + 1 + col, m.shape[1] - 1)
    second = np.where(col < (n - at - 1)[:, None], np.take_along_axis(m, from_, 1), 0)[:, : (n - at - 1).max()]
    return m, Words(first), Words(second)


def _edits(x: np.ndarray, y: np.ndarray, most: int = 2) -> np.ndarray:
    """Edits between words (rows of characters, zeros behind them), ``most + 1`` for more: the band of the distance matrix around its
    diagonal, for all pairs at a time."""
    nx, ny = (x != 0).sum(1), (y != 0).sum(1)
    out = np.full(len(x), most + 1, np.int8)
    near = np.nonzero(np.abs(nx - ny) <= most)[0]
    if not len(near):
        return out
    x, y, nx, ny = np.ascontiguousarray(x[near].T), np.ascontiguousarray(y[near].T), nx[near], ny[near]
    far = np.int8(most + 1)
    last = int(nx.max())
    band = [np.full(len(near), k if k >= 0 else far, np.int8) for k in range(-most, most + 1)]
    got, side = np.full(len(near), far, np.int8), ny - nx + most
    for i in range(last + 1):
        if i:
            new = []
            for k in range(-most, most + 1):
                j = i + k
                if j < 0 or j > len(y):
                    new.append(np.full(len(near), far, np.int8))
                    continue
                d = band[k + most] + (x[i - 1] != y[j - 1]) if j else np.full(len(near), min(i, far), np.int8)
                if k < most:
                    d = np.minimum(d, band[k + most + 1] + np.int8(1))
                if k > -most:
                    d = np.minimum(d, new[-1] + np.int8(1))
                new.append(np.minimum(d, far).astype(np.int8))
            band = new
        here = np.nonzero(nx == i)[0]
        for k in range(2 * most + 1 if len(here) else 0):
            some = here[side[here] == k]
            got[some] = band[k][some]
    out[near] = got
    return out


def _met(rows: list[np.ndarray], hashes: list[np.ndarray], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows below ``n`` that have a hash in common, some at a time; a pair may come more than once."""
    bits = np.uint64(max(1, (n - 1).bit_length()))
    s = np.concatenate([((h >> bits) << bits) | r.astype(np.uint64) for r, h in zip(rows, hashes)])
    s.sort()
    hash_, row = s >> bits, (s & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    same = np.concatenate([[False], hash_[1:] == hash_[:-1], [False]])
    some = same[1:] | same[:-1]
    hash_, row = hash_[some], row[some]
    at, step, held, size = np.arange(len(row)), 1, [], 0
    while len(at):
        at = at[at + step < len(row)]
        at = at[hash_[at + step] == hash_[at]]
        for k in range(0, len(at), MOST_PAIRS):
            i, j = row[at[k : k + MOST_PAIRS]], row[at[k : k + MOST_PAIRS] + step]
            held.append((np.minimum(i, j) * n + np.maximum(i, j))[i != j])
            size += len(held[-1])
            if size >= MOST_PAIRS:
                yield np.divmod(np.unique(np.concatenate(held)), n)
                held, size = [], 0
        step += 1
    if held:
        yield np.divmod(np.unique(np.concatenate(held)), n)


def _pairs(group: np.ndarray, kind: np.ndarray, at: np.ndarray, phrases: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of near duplicates among rows of whole groups."""
    m, a, b = _two_words(phrases)
    n, out = len(phrases), [np.zeros(0, np.int64)]
    g = group.astype(np.uint64) * _BASE

    def compare(rests: Iterator[tuple[np.ndarray, np.ndarray]], judge) -> None:
        x = [(r, _mixed(h + g[r])) for r, h in rests]
        if x:
            found = [np.zeros(0, np.int64)]
            for i, j in _met(*zip(*x), n):
                ok = group[i] == group[j]
                i, j = i[ok], j[ok]
                ok = judge(i, j)
                found.append(i[ok] * n + j[ok])
            out.append(np.unique(np.concatenate(found)))

    apart = lambda w, i, j, most=2: _edits(w.m[i], w.m[j], most)

    def one_word(same: Words, other: Words):
        def judge(i, j):
            ok = (same.m[i] == same.m[j]).all(1)
            ok[ok] = apart(other, i[ok], j[ok]) <= 2
            return ok

        return judge

    def each_one(i, j):
        ok = (np.abs(a.n[i] - a.n[j]) <= 1) & (apart(b, i, j, 1) == 1)
        ok[ok] = apart(a, i[ok], j[ok], 1) == 1
        i, j = i[ok], j[ok]
        # of the groups that may hold both it counts in that of the shorter word, or of the words without the first character that differs
        rest = np.where(a.n[i] == a.n[j], a.without(i, (a.m[i] != a.m[j]).argmax(1)), np.where(a.n[i] < a.n[j], a.whole[i], a.whole[j]))
        here = np.where(at[i] < 0, a.whole[i], a.without(i, np.maximum(at[i], 0)))
        ok[ok] = rest == here
        return ok

    def moved(i, j):
        ok = kind[i] != kind[j]
        ok[ok] = apart(a, i[ok], j[ok]) + apart(b, i[ok], j[ok]) > 2
        ok[ok] = _edits(m[i[ok]], m[j[ok]]) <= 2
        return ok

    def turned(i, j):
        ok = (a.n[i] == b.n[j]) & (b.n[i] == a.n[j])
        w = max(a.m.shape[1], b.m.shape[1])
        wide = lambda x: np.pad(x, ((0, 0), (0, w - x.shape[1])))
        ok[ok] = (wide(a.m[i[ok]]) == wide(b.m[j[ok]])).all(1) & (wide(b.m[i[ok]]) == wide(a.m[j[ok]])).all(1)
        ok[ok] = _edits(m[i[ok]], m[j[ok]]) > 2
        return ok

    of = lambda k: np.nonzero(kind == k)[0]
    compare(b.rests(of(FIRST), 2) if len(of(FIRST)) else iter(()), one_word(a, b))
    compare(a.rests(of(SECOND), 2) if len(of(SECOND)) else iter(()), one_word(b, a))
    compare(b.rests(of(BOTH), 1) if len(of(BOTH)) else iter(()), each_one)
    p, q = of(BEFORE), of(AFTER)
    if len(p) and len(q):
        compare(iter([(p, b.f[p, at[p]]), (p, b.f[p, at[p] - 1]), (q, a.end(q, at[q])), (q, a.end(q, at[q] + 1))]), moved)
    t = of(TURNED)
    if len(t):
        compare(iter([(t, np.zeros(len(t), np.uint64))]), turned)
    return np.divmod(np.concatenate(out), n)


def _dealt(shortest: tuple[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, at, phrase``: each phrase for each of its groups; the last three bits of a key tell the way."""
    seed = lambda h, k: _mixed(h + _SEED[k])
    for batch in batches:
        for i in range(0, len(batch), 20_000):
            part = batch.slice(i, 20_000).column(0)
            _, a, b = _two_words(part.to_pylist())
            every, out = np.arange(len(part)), []
            put = lambda rows, h, kind, at: out.append((rows, (h << np.uint64(3)) | np.uint64(kind), np.full(len(rows), at, np.int16)))
            put(every, seed(a.whole, FIRST), FIRST, -1)
            put(every, seed(b.whole, SECOND), SECOND, -1)
            put(every, seed(a.whole, BOTH), BOTH, -1)
            put(every, seed(a.whole, TURNED) + seed(b.whole, TURNED), TURNED, -1)
            for k in range(a.m.shape[1]):
                r = a.starts(k, every)
                put(r, seed(a.without(r, k), BOTH), BOTH, k)
                r = every[a.n > k] if k >= shortest[0] else every[:0]
                put(r, seed(seed(a.f[r, k], BEFORE) + b.whole[r], BEFORE), AFTER, k)
            for k in range(1, b.m.shape[1]):
                r = every[b.n - k >= shortest[1]]
                put(r, seed(seed(a.whole[r], BEFORE) + b.end(r, k), BEFORE), BEFORE, k)
            rows, key, at = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(at), part.take(pa.array(rows))], ["key", "at", "phrase"])


def _compared(counts: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near duplicates among the rows of a task, which has whole groups: ``a, b`` of each pair, or ``phrase, n`` of those that have some."""
    held = list(batches)
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    del held
    key, at = t.column(0).to_numpy().view(np.uint64), t.column(1).to_numpy()
    order = np.argsort(key)
    group = key[order] >> np.uint64(3)
    new = np.concatenate([[True], group[1:] != group[:-1]])
    number = np.cumsum(new) - 1
    order = order[np.bincount(number)[number] > 1]  # a phrase by itself has nothing to be compared with
    group = key[order] >> np.uint64(3)
    edge = np.concatenate([np.nonzero(np.concatenate([[True], group[1:] != group[:-1]]))[0], [len(order)]]) if len(order) else np.zeros(1, np.int64)
    start = 0
    while start < len(order):
        end = int(edge[np.searchsorted(edge, min(start + BLOCK_ROWS, len(order)))])
        rows = order[start:end]
        phrases = t.column(2).chunk(0).take(pa.array(rows))
        i, j = _pairs(group[start:end], (key[rows] & np.uint64(7)).astype(np.int8), at[rows], phrases.to_pylist())
        if len(i) and counts:
            n = np.bincount(i, minlength=len(rows)) + np.bincount(j, minlength=len(rows))
            some = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([phrases.take(pa.array(some)), pa.array(n[some], pa.int64())], ["phrase", "n"])
        for k in range(0, 0 if counts else len(i), 100_000):
            x, y = phrases.take(pa.array(i[k : k + 100_000])), phrases.take(pa.array(j[k : k + 100_000]))
            yield pa.RecordBatch.from_arrays([x, y], ["a", "b"])
        start = end


def compared(phrases: DataFrame, counts: bool = False) -> DataFrame:
    """``a, b`` of each pair of near duplicates among the distinct ``phrases`` (phrase; written, each of two words), in either order; or, as ``counts``,
    ``phrase, n`` in rows whose ``n`` sum up to a phrase's near duplicates."""
    length = F.char_length("phrase")
    first = F.instr("phrase", " ") - 1
    n, *shortest = phrases.agg(F.count("*"), F.coalesce(F.min(first), F.lit(1)), F.coalesce(F.min(length - first - 1), F.lit(1))).first()
    parts = max(int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * 16 // PART_ROWS))
    x = phrases.select("phrase").mapInArrow(partial(_dealt, tuple(shortest)), "key long, at short, phrase string")
    x = x.repartition(parts, F.shiftright("key", 3))
    return x.mapInArrow(partial(_compared, counts), "phrase string, n long" if counts else "a string, b string")
