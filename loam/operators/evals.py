"""Retrieval evaluation: case scores, aggregates, sweep views, latency, samples, scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions.ranking import global_rank
from loam.operators.rank import cap_per_source


def unique_sources(cands: DataFrame) -> DataFrame:
    """``query_id, pos, source``: sources in the order of their first candidate."""
    first = cands.groupBy("query_id", "source").agg(F.min("pos").alias("_p"))
    return first.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy("_p"))).select("query_id", "pos", "source")


def _expected(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Query ids and expected sources (query_id, source) of cases: rows (query_id, expected_sources) or, where a case may
    expect very many, one row a source (query_id, source)."""
    if "source" in cases.columns:
        return cases.select("query_id").distinct(), cases.select("query_id", "source").distinct()
    return cases.select("query_id"), cases.select("query_id", F.explode("expected_sources").alias("source")).distinct()


def score_cases(ranked: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """``query_id, hit, rank, reciprocal_rank`` of every case (see _expected): the first expected source among the first
    ``k`` of ``ranked`` (query_id, pos, source)."""
    ids, e = _expected(cases)
    r = ranked.filter(F.col("pos") <= k).join(e, ["query_id", "source"]).groupBy("query_id").agg(F.min("pos").alias("rank"))
    x = ids.join(r, "query_id", "left")
    return x.select("query_id", F.col("rank").isNotNull().alias("hit"), "rank", F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("reciprocal_rank"))


def score_at(cands: DataFrame, cases: DataFrame, ks: list[int]) -> DataFrame:
    """The same at several ``k``; each cut is made on chunks, before sources are taken once."""
    out = None
    for k in sorted(set(ks)):
        x = score_cases(unique_sources(cands.filter(F.col("pos") <= k)), cases, k).withColumn("k", F.lit(k))
        out = x if out is None else out.unionByName(x)
    return out


def aggregate(scores: DataFrame, *by: str) -> DataFrame:
    """``hit_rate, mrr, cases``; zeros without cases."""
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return scores.groupBy(*by).agg(zero(F.avg(F.col("hit").cast("double"))).alias("hit_rate"), zero(F.avg("reciprocal_rank")).alias("mrr"), F.count("*").alias("cases"))


def gradable(cases: DataFrame, indexed: DataFrame) -> DataFrame:
    """Cases of which some expected source is indexed (source)."""
    e = _expected(cases)[1].join(indexed.select("source").distinct(), "source", "left_semi")
    return cases.join(e.select("query_id").distinct(), "query_id", "left_semi")


def run(cands: DataFrame, pool: DataFrame, cases: DataFrame, indexed: DataFrame, k: int, ks: list[int]) -> tuple[DataFrame, DataFrame]:
    """Rows (query_id, status, rank, in_pool) of every case, and the aggregates at each ``k``, 4 always among them."""
    ok = gradable(cases, indexed)
    s = score_at(cands, ok, [*ks, 4, k])
    in_pool = score_cases(unique_sources(pool), ok, 1 << 30).select("query_id", F.col("hit").alias("in_pool"))
    rows = _expected(cases)[0].join(s.filter(F.col("k") == k), "query_id", "left").join(in_pool, "query_id", "left")
    rows = rows.select("query_id", F.when(F.col("hit").isNull(), "ungradable").when(F.col("hit"), "hit").otherwise("miss").alias("status"), "rank", "in_pool")
    return rows, aggregate(s, "k")


def sweep_views(pool: DataFrame, ranked: DataFrame, cases: DataFrame, ks: list[int]) -> DataFrame:
    """``view, k, hit_rate, mrr, cases`` of six ways to serve one scored pool."""
    out = None
    for name, x, early in (
        ("reranked_served", ranked, True), ("reranked_notes", ranked, False), ("reranked_cap1", cap_per_source(ranked, 1), True),
        ("reranked_cap2", cap_per_source(ranked, 2), True), ("fused_served", pool, True), ("fused_notes", pool, False),
    ):
        if early:
            s = score_at(x, cases, ks)
        else:
            u, s = unique_sources(x), None
            for k in ks:
                one = score_cases(u, cases, k).withColumn("k", F.lit(k))
                s = one if s is None else s.unionByName(one)
        s = aggregate(s, "k").withColumn("view", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out


def latency(samples: DataFrame, value: str, *by: str) -> DataFrame:
    """``n, median, p95, mean, min, max``; p95 is the sample at the rounded rank 0.95 (n - 1), half to even. Null samples
    are left out.

    Ranks are taken over the whole table by range parts, so that a group of very many samples is no single task."""
    key = F.struct(*by) if by else F.lit(0)  # null keys are groups too
    x = global_rank(samples.select(key.alias("_k"), value).filter(F.col(value).isNotNull()), "_g", "_k", value)
    g = x.groupBy("_k").agg(F.min("_g").alias("_0"), F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    at = F.bround(0.95 * (F.col("n") - 1)).cast("long")
    lo, hi = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    i = F.col("_g") - F.col("_0")
    few = x.join(g.select("_k", "_0", "n"), "_k").filter((i == at) | (i == lo) | (i == hi))
    pick = lambda c: F.max(F.when(i == c, F.col(value)))
    told = few.groupBy("_k").agg(((pick(lo) + pick(hi)) / 2).alias("median"), pick(at).alias("p95"))
    return g.join(told, "_k").select(*(F.col(f"_k.{c}").alias(c) for c in by), "n", "median", "p95", "mean", "min", "max")


def sweep_report(files: DataFrame, samples: DataFrame) -> DataFrame:
    """Score files (model, max_len, batch, file_no, hit4) grouped: metrics of the first, samples pooled (``sample_ms``), best
    first as ``pos``."""
    by = ["model", "max_len", "batch"]
    m = files.groupBy(*by).agg(F.min_by("hit4", "file_no").alias("hit4"), F.count("*").alias("rounds"))
    x = m.join(latency(samples, "sample_ms", *by).select(*by, F.col("n").alias("n_timed"), "median", "p95"), by, "left")
    return x.withColumn("pos", F.row_number().over(W.orderBy(F.desc("hit4"), F.coalesce("median", F.lit(0.0)), *by)))


def spread_sample(cases: DataFrame, n: int) -> DataFrame:
    """``n`` cases spread evenly by position (``case_id`` order): those at int(i * size / n)."""
    x = global_rank(cases, "_r", F.col("case_id").asc()).withColumn("_r", F.col("_r") - 1).crossJoin(F.broadcast(cases.agg(F.count("*").alias("_c"))))
    size = F.col("_c")
    picked = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * size / n))
    return x.filter((size <= n) | F.array_contains(picked, F.col("_r").cast("long"))).drop("_r", "_c")


def fingerprint(cases: DataFrame, block: int = 1024) -> DataFrame:
    """``cases, sha256`` of a case table: the hash of the hashes of blocks of rows in order of case_id, each the hash of
    its rows' hashes. So no row gathers more than a block, or one hash a block."""
    row = F.sha2(F.concat_ws("\x01", F.col("case_id").cast("string"), "question", F.array_join("expected_sources", "\x02"), "scope"), 256)
    x = global_rank(cases.select("case_id", row.alias("h")), "_r", F.col("case_id").asc(), F.col("h").asc())
    join = lambda by: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "h"))), lambda x: x["h"]), ""), 256)
    parts = x.groupBy(F.expr(f"(_r - 1) div {block}").alias("b")).agg(F.count("*").alias("n"), join("_r").alias("h"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cases"), join("b").alias("sha256"))


def baseline(scorecards: DataFrame, of: DataFrame) -> DataFrame:
    """Recorded scorecards of exactly the same cases."""
    return of.join(scorecards, ["cases", "sha256"], "left")


def drift(current: Column, before: Column) -> Column:
    """``warn`` if the hit rate fell by 5.0 points or more, rounded to one decimal."""
    return F.when(F.round((before - current) * 100, 1) >= 5.0, "warn").otherwise("ok")


def scorecard(config: DataFrame, index: DataFrame, dataset: DataFrame, metrics: DataFrame) -> DataFrame:
    """One nested row of four one-row tables; ``metrics`` has one row a k."""
    m = metrics.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", F.struct("hit_rate", "mrr"))))).alias("metrics"))
    one = lambda d, n: d.select(F.struct(*d.columns).alias(n))
    return one(config, "config").crossJoin(one(index, "index")).crossJoin(one(dataset, "dataset")).crossJoin(m)


def check_summary(checks: DataFrame) -> DataFrame:
    """One row of checks (ok, ms): counts and the greatest latency."""
    return checks.agg(F.count("*").alias("checks"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.max("ms").alias("ms_max"))


def newest(history: DataFrame, n: int, order: str) -> DataFrame:
    """The newest ``n`` rows by a text time, missing values as ``-``."""
    return history.orderBy(F.desc(order)).limit(n).select(*(F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in history.columns))
