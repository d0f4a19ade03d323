"""Keyword automaton, pattern literals, models in workers, and the scan in two phases."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from loam.operators import screen, topics, vectors
from loam.sources import corpus

ROUTES = "id string, title string, folder string, description string, keywords array<string>, learned_keywords array<string>, route_ix int"


def routes(spark, words):
    return spark.createDataFrame([(f"r{i}", f"R{i}", "f", "", w, [], i) for i, w in enumerate(words)], ROUTES)


def test_first_keyword_of_many_equals_the_condition_on_each_pair(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 6)))
    words = [[r.choice([word(), f"{word()} {word()}", f"{word()}-{word()}", word().upper(), "", " "]) for _ in range(30)] for _ in range(8)]
    words[3][0] = words[1][0]  # one keyword of two routes
    texts = [(i, " ".join(r.choice([word(), word() + "_", word() + "9", word() + "."]) for _ in range(12))) for i in range(300)] + [(900, None), (901, ""), (902, "É" * 9)]
    df, rt = spark.createDataFrame(texts, "doc_id long, text string"), routes(spark, words)
    kws = topics.route_keywords(rt)
    low = df.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    best = F.min_by(F.struct("id", "kw"), F.struct((-F.col("kw_len")).alias("l"), "route_ix", "kw_ix")).alias("b")
    want = low.join(kws, topics.keyword_hit(F.col("t"), F.col("kw"))).groupBy("doc_id").agg(best).select("doc_id", "b.id", "b.kw")
    want = sorted(map(tuple, want.collect()))
    assert len(want) > 200
    for most in (16 << 20, 4000):  # in one pass and in several
        assert sorted(map(tuple, topics.match_routes(df, rt, most_bytes=most).collect())) == want
    assert topics.match_routes(df, routes(spark, [[]])).count() == 0
    assert topics.match_routes(df.limit(0), rt).count() == 0


def test_ten_thousand_keywords(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("about keyword"), F.col("id").cast("string"), F.lit(" and more")).alias("text"))
    words = [[f"keyword{i}" for i in range(k, 10_000, 10)] for k in range(10)]
    got = topics.match_routes(df, routes(spark, words))
    assert got.filter(F.col("kw") == F.concat(F.lit("keyword"), F.col("doc_id").cast("string"))).count() == 2000
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_near_duplicates_among_others_equal_every_pair(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(3, 6)))
    p = spark.createDataFrame([(f"{word()} {word()}",) for _ in range(120)], "phrase string").filter("length(phrase) >= 7")
    some = [x["phrase"] for x in p.collect()]
    others = [(x[:-1],) for x in some[:30]] + [(" ".join(reversed(x.split())),) for x in some[30:40]] + [(word(),) for _ in range(40)] + [(f"{word()} {word()} {word()}",) for _ in range(40)] + [("",), ("a",)]
    o = spark.createDataFrame(others, "phrase string")
    want = p.distinct().select(F.col("phrase").alias("a")).crossJoin(o.distinct().select(F.col("phrase").alias("b"))).filter(topics.near_duplicate(F.col("a"), F.col("b")))
    assert sorted(map(tuple, topics.near_duplicates(p, o).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("regex, want", [
    (r"\bAKIA[0-9A-Z]{16}\b", ["akia"]), (r"(?i)\b(?:password|token)\s*=", ["password", "token"]), (r"[a-z]+", []), (r"(?:abc)?x", ["x"]), (r"(?:abc){2}", ["abc"]),
    (r"(?:abc|[0-9])", []), (r"\p{L}abc", []), (r"Ünder", ["nder"]), (r"(?!nothere)ab", ["ab"]), ("", []),
])
def test_literals_of_patterns(regex, want):
    assert screen.factors(regex) == want


def test_scan_with_literals_equals_the_patterns_alone(spark):
    lines = ["key AKIA" + "A" * 16, "PassWord: 'x1yyyyyy'", "token=your1aaaaaa", "AWS_SECRET_ACCESS_KEY=" + "a" * 40, "nothing", "sk-" + "a" * 40, "Authorization: Bearer " + "t" * 30, "ghp_" + "a" * 36, "İ token = a1bbbbbb"]
    df = spark.createDataFrame([(i, "\n".join(lines[i:] + lines[:i])) for i in range(len(lines))] + [(50, None), (51, "a\x00b"), (52, "")], "path int, content string")
    got = sorted(map(tuple, screen.scan(df).collect()))
    x = df.filter("path < 50").select("path", F.posexplode(F.split("content", "\n")).alias("line", "s"))
    want = [(r["path"], n, r["line"] + 1) for k, n, p in screen.SECRETS if k == "content" for r in x.filter(F.col("s").rlike(p)).collect()]
    assert got == sorted([*want, (50, "unreadable", 0), (51, "unreadable", 0)]) and len(want) > 40


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    log = str(tmp_path / "loads")
    os.makedirs(log)

    def load():
        open(f"{log}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(i, "x" * (i % 7) if i % 5 else None) for i in range(4000)], "id int, t string").repartition(32)
    got = {r["id"]: list(r["embedding"]) for r in vectors.embed(df, "id", "t", prefix="ask: ", load=load).collect()}
    assert got == {i: [5.0 + (i % 7 if i % 5 else 0), 1.0] for i in range(4000)}
    workers = [f.split("-")[0] for f in os.listdir(log)]
    assert len(workers) == len(set(workers)) <= 32
    rt = routes(spark, [["one"], ["two"]])
    made = topics.decisions(df.limit(20).withColumnRenamed("t", "text"), rt, "id", load)
    assert made.count() == 20 and topics.decisions(df.limit(20).withColumnRenamed("t", "text"), rt, "id", load, most_bytes=1).count() == 20


def test_scan_reads_new_and_changed_files_alone(spark, tmp_path):
    names = [f"{d}/n {i}[{i}]+%20.md" for d in ("a", "b c") for i in range(6)]
    for n in names:
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text(f"# {n}\r\ntext")
    (tmp_path / "a" / "Index.md").write_text("no note")
    (tmp_path / "a" / "x.txt").write_text("no note")
    root = f"file://{tmp_path}"
    listing = corpus.list_notes(spark, root)
    assert "content" not in listing.columns and sorted(r["path"] for r in listing.collect()) == sorted(names)
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString()
    seen = listing.select(F.col("path").alias("source"), "mtime").collect()
    old = [(r["source"], r["mtime"] - (60.0 if r["source"] == names[2] else 0.0)) for r in seen if r["source"] not in names[:2]] + [("gone.md", 1.0)]
    indexed = spark.createDataFrame(old, "source string, mtime double")
    states, notes = corpus.scan_changed(spark, root, indexed)
    kinds = {r["source"]: r["status"] for r in states.collect()}
    assert kinds == {n: "new" if n in names[:2] else "changed" if n == names[2] else "unchanged" for n in names} | {"gone.md": "gone"}
    for n in names[3:]:
        (tmp_path / n).unlink()  # a scan that opened one of them would fail
    full = {r["path"]: r["content"] for r in notes.collect()}
    assert full == {n: f"# {n}\ntext" for n in names[:3]}
    same = spark.createDataFrame([(r["path"], r["mtime"]) for r in corpus.list_notes(spark, root).collect()], "source string, mtime double")
    assert corpus.scan_changed(spark, root, same)[1].count() == 0
