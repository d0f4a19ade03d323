"""F1 of round 4: near duplicates of two words are compared in groups that share a part, and no table of what is left of phrases is made."""

import random

import pyarrow as pa
import pytest
from tests.test_learning import close

from loam.operators import alike, topics


def near(p, q):
    a, b = p.split(" "), q.split(" ")
    return p != q and (set(a) == set(b) or close(p, q))


def phrases(seed):
    rng = random.Random(seed)
    letters = ["ab", "abc", "aé日b", "abcdefgh-1"][seed % 4]
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1 if seed % 3 else 3, 6 if seed % 5 else 12)))
    out = {f"{word()} {word()}" for _ in range(150)}
    for p in sorted(out)[:60]:
        x = list(p)
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(x))
            x[i : i + rng.randint(0, 1)] = rng.choice([[], [rng.choice(letters + " ")]])
        out |= {"".join(x), " ".join(reversed(p.split(" ")))}
    return sorted(p for p in out if len(p.split(" ")) == 2 and all(p.split(" ")))


@pytest.mark.parametrize("seed", range(12))
def test_groups_find_each_pair_once(seed, monkeypatch):
    if seed % 2:  # several blocks and chunks of pairs
        monkeypatch.setattr(alike, "BLOCK_ROWS", 50)
        monkeypatch.setattr(alike, "MOST_PAIRS", 30)
    p = phrases(seed)
    shortest = tuple(min(len(x.split(" ")[i]) for x in p) for i in (0, 1))
    dealt = list(alike._dealt(shortest, iter([pa.RecordBatch.from_arrays([pa.array(p)], ["phrase"])])))
    got = sorted(tuple(sorted(x)) for b in alike._compared(False, iter(dealt)) for x in zip(*(c.to_pylist() for c in b.columns)))
    want = [(x, y) for i, x in enumerate(p) for y in p[i + 1 :] if near(x, y)]
    assert got == want and len(want) > 20
    n = dict.fromkeys(p, 0)
    for b in alike._compared(True, iter(dealt)):
        for x, c in zip(*(c.to_pylist() for c in b.columns)):
            n[x] += c
    assert n == {x: sum(near(x, y) for y in p) for x in p}


def test_phrases_of_other_shapes_are_counted_too(spark):
    p = ["garden budget", "gardenbudget", "garden  budget", "gardens budget", "budget garden", "budget garden garden", "general public license", "general public licenses", " garden budge", "garden budget\n"]
    got = {r["phrase"]: r["n_near"] for r in topics.near_duplicate_counts(spark.createDataFrame([(x,) for x in p] * 2, "phrase string")).collect()}
    want = {tuple(sorted((r["a"], r["b"]))) for r in topics.near_duplicates(spark.createDataFrame([(x,) for x in p], "phrase string"), spark.createDataFrame([(x,) for x in p], "phrase string")).filter("a <> b").collect()}
    assert got == {x: sum(x in w for w in want) for x in p} and sum(got.values()) > 10
    assert {(r["a"], r["b"]) for r in topics.near_duplicate_pairs(spark.createDataFrame([(x,) for x in p], "phrase string")).collect()} == want


def test_few_rows_a_phrase_are_shuffled_and_none_is_broadcast(spark, tmp_path):
    """The table of rests, of which a plan sees but the size of the phrases, was broadcast: 2.1 GB at sf0.1."""
    rows = [(f"word{i % 40:02d}abcd {i:05d}efgh",) for i in range(2000)]
    spark.createDataFrame(rows, "phrase string").write.parquet(f"{tmp_path}/p")
    p = spark.read.parquet(f"{tmp_path}/p")
    for x in (topics.near_duplicate_pairs(p), topics.near_duplicate_counts(p)):
        assert "Broadcast" not in x._jdf.queryExecution().executedPlan().toString()
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows])], ["phrase"])
    assert sum(len(b) for b in alike._dealt((10, 9), iter([batch]))) < 30 * len(rows)


def test_sizes_that_plans_take_too_low_are_not_broadcast(spark, monkeypatch, tmp_path):
    """what is many rows in a small file was sent through the driver. Beyond the bound nothing is, and the rows are the same."""
    rows = [(k, i, "t", f"{'abcdefgh'[(k * 7 + i * 3) % 8] * 4}{k % 13} planet{(k + i) % 17}") for k in range(120) for i in range(4)]
    cands = spark.createDataFrame(rows, "k long, pos int, topic string, phrase string")
    want = sorted(map(tuple, topics.in_order(cands).select("k", "pos", "topic", "phrase").collect()))
    spark.createDataFrame([(p,) for p in sorted({r[3] for r in rows})], "phrase string").write.parquet(f"{tmp_path}/p")
    spark.createDataFrame([("aaaa1 planet2",), ("license",)], "phrase string").write.parquet(f"{tmp_path}/o")
    p, o = spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/o")
    got = topics.near_duplicates(p, o)
    found = sorted(map(tuple, got.collect()))
    assert found and "Broadcast" in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(topics, "BROADCAST", 0)
    got = topics.near_duplicates(p, o)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString() and sorted(map(tuple, got.collect())) == found
    assert sorted(map(tuple, topics.in_order(cands).select("k", "pos", "topic", "phrase").collect())) == want and len(want) > 5
