"""Exact histogram of encoded lengths, with the sums that answer questions about every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.llm.tokens import default_vocabulary, encoder
from loam.session import materialise, texts

#: Lengths that share one window partition of the suffix sums.
BAND = 1024


def encoded_lengths(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens``: ids of each whole text; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                p = b.slice(i, 256)
                n = [len(x) // enc.width for x in enc.encode(p.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([p.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """One row for each length that occurs, exact for the whole table.

    ``n_docs`` of that length; ``docs_ge`` and ``tokens_ge`` sum over that length and longer ones; ``docs_lt`` and
    ``tokens_lt`` over shorter ones; ``truncated_total`` is the number of ids left when every document is cut at that
    length; ``quantile`` is the share of documents of at most that length. Repeated rows count each; a null length
    counts as 0; an empty table gives no row.

    Documents are summed up to one row a length before any shuffle, and that table is written, so that texts are encoded
    once. Suffix sums take two levels: bands of ``BAND`` lengths in parallel, then the bands' totals, of which there are
    as many as the longest document has thousands. So a task of the sums gets ``BAND`` rows at most, however many documents
    there are."""
    h = lengths.groupBy(F.coalesce(F.col(column).cast("long"), F.lit(0)).alias("length")).agg(F.count("*").alias("n_docs"))
    h = materialise(h.withColumns({"band": F.expr(f"length div {BAND}"), "n_tokens": F.col("length") * F.col("n_docs")}), "histogram")
    tot = h.groupBy("band").agg(F.sum("n_docs").alias("bd"), F.sum("n_tokens").alias("bt"))
    one = W.partitionBy(F.lit(0)).orderBy("band")
    before, every = one.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    tot = tot.select("band", zero(F.sum("bd").over(before)).alias("d0"), zero(F.sum("bt").over(before)).alias("t0"), F.sum("bd").over(every).alias("all_docs"), F.sum("bt").over(every).alias("all_tokens"))
    inside = W.partitionBy("band").orderBy("length").rowsBetween(W.unboundedPreceding, -1)
    x = h.withColumns({"dl": zero(F.sum("n_docs").over(inside)), "tl": zero(F.sum("n_tokens").over(inside))}).join(tot, "band")
    return x.select(
        "length", "n_docs",
        (F.col("all_docs") - F.col("d0") - F.col("dl")).alias("docs_ge"),
        (F.col("all_tokens") - F.col("t0") - F.col("tl")).alias("tokens_ge"),
        (F.col("d0") + F.col("dl")).alias("docs_lt"),
        (F.col("t0") + F.col("tl")).alias("tokens_lt"),
        (F.col("t0") + F.col("tl") + F.col("length") * (F.col("all_docs") - F.col("d0") - F.col("dl"))).alias("truncated_total"),
        ((F.col("d0") + F.col("dl") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def truncated_totals(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """For each different ``limit``: ids of all documents, ids ``left`` when cut there, and ``cut_docs``, documents that are cut.

    The answer stands in the sums of the first length that reaches the limit, which is looked up in the limit's band, else
    in the next band that has lengths. An empty histogram gives 0 for every limit."""
    cols = ["length", "n_docs", "docs_ge", "tokens_lt"]
    h = histogram.select(F.col("length").alias("at"), F.expr(f"length div {BAND}").alias("band"), F.struct(*cols).alias("row"))
    ask = limits.select(F.col("limit").cast("long").alias("limit")).filter("limit is not null").distinct().withColumn("band", F.expr(f"limit div {BAND}"))
    both = h.withColumn("limit", F.lit(None).cast("long")).unionByName(ask.withColumn("at", F.col("limit")), allowMissingColumns=True)
    on = W.partitionBy("band").orderBy(F.col("at"), F.col("limit").isNull()).rowsBetween(W.currentRow, W.unboundedFollowing)
    here = both.withColumn("here", F.first("row", ignorenulls=True).over(on)).filter("limit is not null").select("limit", "band", "here")
    after = W.partitionBy(F.lit(0)).orderBy("band").rowsBetween(1, W.unboundedFollowing)  # one row a band
    bands = both.groupBy("band").agg(F.min_by("row", F.when(F.col("row").isNotNull(), F.col("at"))).alias("row"))
    x = here.join(bands.select("band", F.first("row", ignorenulls=True).over(after).alias("next")), "band").withColumn("r", F.coalesce("here", "next"))
    total = histogram.agg(F.coalesce(F.max(F.col("tokens_lt") + F.col("tokens_ge")), F.lit(0)).alias("total"))
    left = F.coalesce(F.col("r.tokens_lt") + F.col("limit") * F.col("r.docs_ge"), F.col("total"))
    cut = F.col("r.docs_ge") - F.when(F.col("r.length") == F.col("limit"), F.col("r.n_docs")).otherwise(0)
    return x.join(F.broadcast(total)).select("limit", "total", left.alias("left"), F.coalesce(cut, F.lit(0)).alias("cut_docs"))


def length_quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share ``q`` of the documents doesn't exceed."""
    return histogram.filter(F.col("quantile") >= q).agg(F.min("length").alias("length"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact length histogram of ``documents`` with its sums, one row for each length; null texts have length 0."""
    return length_histogram(encoded_lengths(texts(spark, sf_dir), default_vocabulary()))
