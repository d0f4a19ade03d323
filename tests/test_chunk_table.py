"""The bucketed chunk table: untouched buckets stay as they are, only changed notes are chunked, repeated runs do nothing."""

import os

import pytest
from pyspark.sql import functions as F

from loam.functions.markdown import chunk_notes
from loam.operators import chunk_table as ct


def notes_of(spark, rows):
    rows = [(p, p[:-3], "note", float(t), f"# {p}\n{text}\n") for p, t, text in rows]
    return spark.createDataFrame(rows, "path string, title string, category string, mtime double, content string")


def listing(root):
    return {os.path.join(d, f): (os.path.getmtime(os.path.join(d, f)), os.path.getsize(os.path.join(d, f))) for d, _, fs in os.walk(root) for f in fs if f.startswith("part-") and "bucket=" in d}


def content(df):
    return sorted(map(str, df.select("chunk_id", "chunk", "mtime").collect()))


@pytest.fixture()
def table(spark, tmp_path):
    first = [(f"n{i}.md", 100 + i, f"text {i}") for i in range(60)]
    root = f"file://{tmp_path}/t"
    ct.create(chunk_notes(notes_of(spark, first)), root, buckets=8)
    return root, str(tmp_path / "t"), first


def test_only_touched_buckets_are_rewritten(spark, table):
    root, folder, first = table
    before = listing(folder)
    assert len(before) == 8
    later = [(p, t + (p == "n7.md") * 50, "new text" if p == "n7.md" else x) for p, t, x in first if p != "n9.md"] + [("fresh.md", 500, "fresh")]
    seen = []

    def chunker(df):
        seen.append(sorted(r["path"] for r in df.select("path").collect()))
        return chunk_notes(df)

    states = ct.upsert(spark, root, notes_of(spark, later), chunker)
    assert {(r["source"], r["status"]) for r in states.collect()} == {("n7.md", "changed"), ("n9.md", "gone"), ("fresh.md", "new")}
    assert seen == [["fresh.md", "n7.md"]]
    touched = {r["bucket"] for r in states.select("bucket").collect()}
    after = listing(folder)
    same = {f for f in before if after.get(f) == before[f]}
    assert {f.split("bucket=")[1].split("/")[0] for f in before.keys() - same} == {str(b) for b in touched} and len(same) == 8 - len(touched)
    assert content(ct.read(spark, root)) == content(chunk_notes(notes_of(spark, later)))
    # the same scan again changes nothing
    assert ct.upsert(spark, root, notes_of(spark, later), chunker).count() == 0 and listing(folder) == after and len(seen) == 1


def test_emptied_buckets_and_notes_without_chunks(spark, table):
    root, _, first = table
    few = [first[0][:2] + (" ",)]
    one = notes_of(spark, few).withColumn("content", F.lit("")).withColumn("mtime", F.lit(999.0))  # changed, and nothing left in it
    ct.upsert(spark, root, one, chunk_notes)
    assert ct.read(spark, root).count() == 0
    ct.upsert(spark, root, notes_of(spark, first[:5]), chunk_notes)
    assert content(ct.read(spark, root)) == content(chunk_notes(notes_of(spark, first[:5])))


def test_buckets_grow_with_the_table(spark, tmp_path):
    root = f"file://{tmp_path}/g"
    rows = [(f"n{i}.md", i, f"text {i}") for i in range(40)]
    ct.create(chunk_notes(notes_of(spark, rows[:1])), root, buckets=1, bucket_bytes=1 << 30)
    assert ct.current(spark, root) == 1
    ct.upsert(spark, root, notes_of(spark, rows), chunk_notes, bucket_bytes=2000)
    assert ct.current(spark, root) >= 4 and not os.path.exists(f"{tmp_path}/g/b=1")
    assert content(ct.read(spark, root)) == content(chunk_notes(notes_of(spark, rows)))


def test_without_pruning_and_from_an_empty_table(spark, tmp_path):
    root = f"file://{tmp_path}/e"
    with pytest.raises(Exception):
        ct.current(spark, root)
    rows = [(f"n{i}.md", i, f"text {i}") for i in range(6)]
    ct.create(chunk_notes(notes_of(spark, rows).limit(0)), root)
    assert ct.read(spark, root).count() == 0
    ct.upsert(spark, root, notes_of(spark, rows), chunk_notes)
    ct.upsert(spark, root, notes_of(spark, [("n2.md", 77, "changed")]), chunk_notes, prune=False)
    got = {r["source"]: r["mtime"] for r in ct.read(spark, root).collect()}
    assert len(got) == 6 and got["n2.md"] == 77
