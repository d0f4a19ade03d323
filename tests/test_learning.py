"""Learning in rounds against a plain loop over chats."""

import random

import pytest
from pyspark.sql import functions as F

from loam.operators import topics


def close(x, y, most=2):
    if abs(len(x) - len(y)) > most:
        return False
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1] <= most


def alike(a, b):
    sa, sb = a.split(), b.split()
    place = sa[0] == sb[0] and close(sa[1], sb[1]) or sa[1] == sb[1] and close(sa[0], sb[0])
    return a == b or sorted(set(sa)) == sorted(set(sb)) or close(a, b) or place


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_give_what_a_loop_over_chats_gives(spark, seed):
    rng = random.Random(seed)
    stems = ["kernel", "kernels", "garden", "gardens", "gardener", "budget", "budgets", "spark", "sparks", "planet", "planner", "rust", "trust"]
    rows = []
    for k in range(500):
        seen = list(dict.fromkeys(f"{rng.choice(stems)}{rng.choice(['', '', 'x', 'yz'])} {rng.choice(stems)}{rng.choice(['', 'q', 'longer' + str(rng.randrange(40))])}" for _ in range(rng.randrange(8))))
        rows += [(k, i, f"t{k % 5}", p) for i, p in enumerate(seen)]
    want, n = [], {}
    kept = []
    for k, i, t, p in rows:
        if n.get(k, 0) < topics.PER_CHAT and not any(alike(p, q) for q in kept):
            kept.append(p)
            n[k] = n.get(k, 0) + 1
            want.append((k, i, t, p))
    got = topics.in_order(spark.createDataFrame(rows, "k long, pos int, topic string, phrase string").repartition(3))
    assert sorted(map(tuple, got.select("k", "pos", "topic", "phrase").collect())) == want and len(want) > 30


def test_no_candidates(spark):
    empty = spark.createDataFrame([], "k long, pos int, topic string, phrase string")
    assert topics.in_order(empty).count() == 0


def test_phrases_that_share_a_short_piece(spark):
    p = [f"ab{c}d ef{g}h" for c in "qwertz" for g in "uiopas"] + ["abqd efuh", "efuh abqd"]
    df = spark.createDataFrame([(x,) for x in p], "phrase string")
    got = {tuple(r) for r in topics.near_duplicate_pairs(df).collect()}
    assert got == {(a, b) for a in set(p) for b in set(p) if a < b and alike(a, b)}
