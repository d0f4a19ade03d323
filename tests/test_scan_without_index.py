"""one batch of questions is answered from the texts, without postings; the rows are those of the index."""

import pytest
from pyspark.sql import functions as F
from tests.test_lexical_index import chunks_of, plain, questions

from loam.operators import lexical


def test_no_index_is_made(spark, monkeypatch):
    monkeypatch.setattr(lexical, "index", lambda *a, **k: pytest.fail("postings of all chunks were written"))
    assert lexical.search(questions(spark), chunks_of(spark), 5).count()


@pytest.mark.parametrize("most_bytes", [64 << 20, 3000])
@pytest.mark.parametrize("k", [1, 5, 40])
def test_equal_to_the_index(spark, monkeypatch, k, most_bytes):
    monkeypatch.setattr(lexical, "MOST_TERMS", 20)
    monkeypatch.setattr(lexical, "MOST_MATCHES", 50)
    c, q = chunks_of(spark), questions(spark)
    c = c.unionByName(c.filter("chunk_ix = 0").limit(9).crossJoin(spark.range(40)).withColumn("chunk_id", F.concat("chunk_id", F.lit("_"), "id")).drop("id"))  # copies
    assert plain(lexical.scanned(q, c, k, most_bytes)) == plain(lexical.best(q, lexical.index(c), k).select("query_id", "chunk_id", "score", "pos"))


def test_tokens_of_bytes(spark):
    rows = [("Ünïted STATES_of-A9",), ("273 Kelvin, K",), ("İstanbul DİZ",), ("",), ("\x00a\x7fb c ǅ ß \U0001f600x",)]
    for r in spark.createDataFrame(rows, "t string").select("t", lexical.tokenise("t").alias("w")).collect():
        assert [w.decode() for w in lexical.tokens(r["t"].encode())] == r["w"]


def test_nothing_to_find(spark):
    c, q = chunks_of(spark), questions(spark)
    for a, b in ((q, c.limit(0)), (q.limit(0), c), (q.filter("query_id > 92"), c), (q, c.withColumn("chunk", F.lit(None).cast("string")))):
        assert lexical.scanned(a, b, 5).count() == 0
