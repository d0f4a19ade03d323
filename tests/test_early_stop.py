"""F3 of round 4: candidates of the early stop are completed where their postings lie."""

from tests.test_lexical_index import chunks_of, plain, questions

from loam.operators import lexical


def test_nothing_is_shuffled_but_the_best(spark):
    """Candidates and the postings that complete them had rows, which met in a shuffle."""
    idx = lexical.index(chunks_of(spark))
    got = lexical.best(questions(spark), idx, 5, early=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("- Exchange ") == plan.count("hashpartitioning(query_id") == 1
    assert plain(got) == plain(lexical.best(questions(spark), idx, 5).select(got.columns))


def test_an_index_for_the_early_stop_is_not_shuffled(spark):
    """Its rows were dealt into buckets, for which they lay on disk twice."""
    idx = lexical.index(chunks_of(spark), dealt=False)
    read = idx["rows"]._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" not in read and "Exchange" not in read
    got = lexical.search(questions(spark), chunks_of(spark), 4, early=True)
    assert plain(got.select("query_id", "chunk_id", "score", "pos")) == plain(lexical.best(questions(spark), lexical.index(chunks_of(spark)), 4).select("query_id", "chunk_id", "score", "pos"))


def test_early_stop_over_segments_and_in_blocks_of_questions(spark, tmp_path, monkeypatch):
    c, q = chunks_of(spark), questions(spark)
    lexical.write_index(c, f"file://{tmp_path}/index", 3)
    idx = lexical.read_index(spark, f"file://{tmp_path}/index")
    want = lexical.best(q, lexical.index(c), 4)
    assert plain(lexical.best(q, idx, 4, early=True).select(want.columns)) == plain(want)
    asked = lexical.thresholds(lexical._asked(q, idx), idx["postings"], 4)
    monkeypatch.setattr(lexical, "MOST_MATCHES", 50)  # a few rows at a time
    rows = lexical._stored_rows(idx, asked)
    assert plain(lexical._best_rows(asked, rows, 4, lexical.Needed, lexical._completed, 2000).select(want.columns)) == plain(want)


def test_completed_only_where_needed_terms_reach_the_threshold():
    import numpy as np
    import pandas as pd

    rows = pd.DataFrame({"query_id": [7, 7, 8], "scope": "all", "term": ["rare", "often", "often"], "w": [4.0, 0.5, 1.0], "avgdl": 10.0, "needed": [True, False, True], "least": [3.0, 3.0, np.nan], "rest": [0.6, 0.6, 0.0]})
    a = lexical.Needed(rows)
    at = {t.decode(): i for t, i in a.terms.items()}
    row, term = np.array([0, 0, 1, 2]), np.array([at["rare"], at["often"], at["often"], at["rare"]])
    s = dict(zip(a.ids, a.sums(row, term, np.array([1.0, 1.0, 1.0, 0.5]), 3).reshape(3, 2).T))
    assert s[7].tolist() == [4.5, 0.0, 0.0] and s[8].tolist() == [1.0, 1.0, 0.0]  # 0.5 * 4 + 0.6 stays below 3
