"""phrases that begin with one word don't all meet."""

from pyspark.sql import functions as F

from loam.operators import topics


def test_one_word_in_front_of_many(spark):
    p = spark.range(3000).select(F.concat(F.lit("frequent "), F.translate(F.left(F.md5(F.col("id").cast("string")), F.lit(9)), "0123456789", "ghijklmnop")).alias("phrase"))
    p = p.unionByName(spark.createDataFrame([("frequent abcdefgh",), ("frequent abcdexgh",), ("abcdefgh frequent",)], "phrase string"))
    met = topics.rests(p, "a").join(topics.rests(p, "b"), "rest").filter("a < b").select("a", "b").distinct().count()
    assert met < 1000  # of 4.5 million pairs
    got = {(r["a"], r["b"]) for r in topics.near_duplicate_pairs(p).filter("a like '%abcde%' and b like '%abcde%'").collect()}
    assert {("frequent abcdefgh", "frequent abcdexgh"), ("abcdefgh frequent", "frequent abcdefgh")} <= got
