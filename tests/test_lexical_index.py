"""The keyword index in segments against a rebuilt one, and the early stop against scores of all chunks."""

import os
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.operators import lexical

SCHEMA = "chunk_id string, source string, chunk_ix int, chunk string, title string, category string, mtime double"


def chunks_of(spark, n=120, later=False):
    """Notes of one to three chunks; in the later state some are gone, changed (more or fewer chunks) or new."""
    out = []
    for i in range(n + 10 * later):
        words, size, t = random.Random(i), 1 + i % 3, 1.0
        if later and i % 11 == 3:
            continue
        if later and i % 7 == 2:
            words, size, t = random.Random(1000 + i), 1 + (i + 1) % 3, 2.0
        for k in range(size):
            text = " ".join(f"w{int(words.paretovariate(0.7)) % 400}" for _ in range(words.choice([0, 3, 30, 80])))
            out.append((f"n{i}.md_chunk_{k}", f"n{i}.md", k, text, f"n{i}", random.Random(i * 31 + k).choice(["note", "chat", None]), t))
    return spark.createDataFrame(out, SCHEMA)


def questions(spark):
    rng = random.Random(3)
    rows = [(q, " ".join(f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.choice([1, 4, 12]))), rng.choice(["notes", "chats", "all"])) for q in range(30)]
    return spark.createDataFrame([*rows, (90, "", "all"), (91, None, "all"), (92, "w1 w1 w1 w2", "all"), (93, "nowhere", "all")], "query_id int, question string, scope string")


def plain(d):
    return sorted(map(str, d.collect()))


@pytest.mark.parametrize("k", [1, 5, 40])
def test_early_stop_gives_what_all_scores_give(spark, k):
    c, q = chunks_of(spark), questions(spark)
    idx = lexical.index(c)
    every = lexical.scores(q, idx).withColumn("score", F.round("score", 6)).filter("score > 0")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    want = every.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)
    for early in (False, True):
        got = lexical.search(q, c, k, idx, early)
        assert plain(got.select("query_id", "chunk_id", "score", "pos")) == plain(want.select("query_id", "chunk_id", "score", "pos"))
    # some terms need not be looked up for candidates
    t = lexical.thresholds(lexical._asked(q.drop("scope"), idx), idx["postings"], 1).groupBy("needed").agg(F.sum("df").alias("n"))
    n = {r["needed"]: r["n"] for r in t.collect()}
    assert n[False] > 0.2 * (n[True] + n[False])


def test_counting_and_scoring_share_one_shuffle(spark):
    """Postings are grouped and weighed by chunk where they lie: no exchange by chunk over the written index."""
    idx = lexical.index(chunks_of(spark))
    plan = lexical.best(questions(spark), idx, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("- Exchange ") == plan.count("hashpartitioning(query_id") == 1


def same_index(spark, path, chunks):
    got, want = lexical.read_index(spark, path), lexical.index(chunks)
    assert plain(got["postings"].select("chunk_id", "term", "tf", "dl", "chat")) == plain(want["postings"].select("chunk_id", "term", "tf", "dl", "chat"))
    r = lambda t: plain(t.select("term", "df", F.round("idf", 9)))
    assert r(got["terms"]) == r(want["terms"]) and plain(got["stats"].select("n_docs", F.round("avgdl", 9))) == plain(want["stats"].select("n_docs", F.round("avgdl", 9)))
    q = questions(spark)
    assert plain(lexical.search(q, chunks, 5, got)) == plain(lexical.search(q, chunks, 5, want))


def test_segments_equal_a_rebuilt_index(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    first, second, third = chunks_of(spark), chunks_of(spark, later=True), chunks_of(spark, n=60).withColumn("mtime", F.lit(3.0))
    lexical.write_index(first, path, buckets=8)
    same_index(spark, path, first)
    before = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / "i/postings/segment=0") for f in fs}
    assert lexical.follow(spark, path, second) == 2
    assert before == {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / "i/postings/segment=0") for f in fs}
    same_index(spark, path, second)
    assert lexical.follow(spark, path, second) == 2  # nothing to do
    # a run that was broken off before its statistics were written doesn't count, and is written over
    third.select("chunk_id").limit(3).write.parquet(f"{path}/gone/segment=2")
    same_index(spark, path, second)
    assert lexical.follow(spark, path, third) == 3
    same_index(spark, path, third)
    assert lexical.follow(spark, path, first, most_segments=3) == 1 and len(os.listdir(tmp_path / "i/stats")) <= 3
    same_index(spark, path, first)
    lexical.follow(spark, path, first.limit(0))
    assert lexical.read_index(spark, path)["postings"].count() == 0 and lexical.search(questions(spark), first, 5, lexical.read_index(spark, path)).count() == 0
