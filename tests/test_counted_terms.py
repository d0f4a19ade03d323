"""terms are counted where a chunk lies, a stored row a chunk."""

from loam.operators import lexical


def test_counts_without_a_shuffle(spark):
    rows = [("a", "One two, two_ TWO", "chat"), ("b", None, None), ("c", "é ?", "note")]
    c = spark.createDataFrame(rows, "chunk_id string, chunk string, category string")
    p = lexical.postings_of(c)
    assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, p.collect())) == [("a", "one", 1, 4, True), ("a", "two", 2, 4, True), ("a", "two_", 1, 4, True)]
    assert lexical.index(c)["stats"].first()["n_docs"] == 3
