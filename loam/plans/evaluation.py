"""Queries of retrieval evaluation. Cases ask benchmark texts; expected are the notes that hold their first six words."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.operators import evals as ev
from loam.operators import lexical, rank
from loam.plans.registry import query
from loam.plans.retrieval import BM25, RERANKED, SEARCH, chunks, questions, stored
from loam.plans.retrieval import N as NC
from loam.session import materialise, table
from loam.sources import corpus

#: Expected notes hold the first six words of a question in a row; every third question expects a note that isn't there.
EXP = """ex AS (SELECT query_id, path AS source FROM (SELECT query_id, array_to_string(list_slice(w, 1, 6), ' ') AS key FROM (SELECT query_id, regexp_extract_all(lower(question), '[a-z0-9_]+') AS w FROM q) WHERE len(w) >= 6)
  JOIN (SELECT path, ' ' || array_to_string(regexp_extract_all(lower(content), '[a-z0-9_]+'), ' ') || ' ' AS t FROM notes) ON contains(t, ' ' || key || ' ') AND query_id % 3 <> 2
  UNION ALL SELECT query_id, 'gone.md' FROM q WHERE query_id % 3 = 2)"""
POOL = """pool AS (SELECT query_id, pos, chunk_id, score AS rrf_score, source, title, chunk, category, mtime, scope, question FROM hits
  JOIN (SELECT query_id, question FROM q) USING (query_id) WHERE pos <= 30)"""
BASE = f"{NC}, {BM25}, {SEARCH}, {POOL}, {RERANKED}, {EXP}"


def cases(spark, sf_dir):
    """A question's expected notes, one a row: those that hold its first six words in a row; every third question expects a note
    that isn't there.

    Notes meet questions by the longest of the six words; only those that hold it are searched for all six."""
    n = corpus.notes(spark, sf_dir).select(F.col("path").alias("source"), lexical.tokenise("content").alias("w"))
    q = questions(spark, sf_dir).withColumn("w", F.slice(lexical.tokenise("question"), 1, 6))
    some = q.filter((F.size("w") == 6) & (F.col("query_id") % 3 != 2)).select("query_id", F.array_join("w", " ").alias("key"), F.array_sort(F.transform("w", lambda x: F.struct((-F.char_length(x)).alias("n"), x.alias("x"))))[0]["x"].alias("word"))
    some = materialise(some, "asked")
    near = n.select("source", F.explode(F.array_distinct("w")).alias("word")).join(few(some), "word").select("source", "query_id", "key")
    near = materialise(near, "near")
    held = n.select("source", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("t")).join(few(near), "source")
    e = held.filter(F.contains("t", F.concat(F.lit(" "), F.col("key"), F.lit(" ")))).select("query_id", "source")
    return e.unionByName(q.filter("query_id % 3 = 2").select("query_id", F.lit("gone.md").alias("source")))


def few(df):
    """A written table, to be broadcast where its size allows."""
    return F.broadcast(df) if df.count() * 200 <= 64 << 20 else df


def pool(spark, sf_dir):
    """Keyword candidates, written once: a few dozen rows a question."""
    return materialise(lexical.search(questions(spark, sf_dir), stored(spark, sf_dir), 30), "pool")


def reranked(spark, sf_dir, p):
    return materialise(rank.rerank(p, questions(spark, sf_dir)), "reranked")


@query("e01_unique_sources", f"{BASE} SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) AS pos FROM pool GROUP BY query_id, source")
def e01(spark, sf_dir):
    return ev.unique_sources(pool(spark, sf_dir))


def scored(k: int, src: str = "pool", early: bool = True) -> str:
    """Case scores at ``k``: cut on chunks before notes are taken once, or after."""
    cut = f"WHERE pos <= {k}" if early else ""
    once = f"SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) AS pos FROM {src} {cut} GROUP BY query_id, source"
    return f"""SELECT query_id, rank, rank IS NOT NULL AS hit, coalesce(1.0e0 / rank, 0.0e0) AS rr FROM (SELECT DISTINCT query_id FROM ex)
  LEFT JOIN (SELECT query_id, min(pos) AS rank FROM ({once}) u JOIN ex USING (query_id, source) WHERE pos <= {k} GROUP BY query_id) USING (query_id)"""


@query("e02_case_scores", f"{BASE}, sc AS ({scored(8, early=False)}) SELECT query_id, hit, rank, round(rr, 6) AS reciprocal_rank FROM sc")
def e02(spark, sf_dir):
    return ev.score_cases(ev.unique_sources(pool(spark, sf_dir)), cases(spark, sf_dir), 8).withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))


@query("e03_scores_at", f"{BASE}, sc AS (" + " UNION ALL ".join(f"SELECT *, {k} AS k FROM ({scored(k)}) z{k}" for k in (1, 4, 8, 30)) + ") SELECT query_id, k, hit, rank FROM sc")
def e03(spark, sf_dir):
    return ev.score_at(pool(spark, sf_dir), cases(spark, sf_dir), [1, 4, 8, 30]).select("query_id", "k", "hit", "rank")


@query("e04_aggregate", f"{BASE}, sc AS ({scored(8, early=False)}) SELECT round(avg(CASE WHEN hit THEN 1.0e0 ELSE 0.0e0 END), 6) AS hit_rate, round(avg(rr), 6) AS mrr, count(*) AS cases FROM sc")
def e04(spark, sf_dir):
    return ev.aggregate(ev.score_cases(ev.unique_sources(pool(spark, sf_dir)), cases(spark, sf_dir), 8))


RUN = f"""{BASE}, gr AS (SELECT DISTINCT query_id FROM ex WHERE source IN (SELECT path FROM notes)), sc AS ({scored(8, 'ranked')}),
  ip AS (SELECT DISTINCT query_id FROM pool JOIN ex USING (query_id, source))
  SELECT sc.query_id, CASE WHEN gr.query_id IS NULL THEN 'ungradable' WHEN hit THEN 'hit' ELSE 'miss' END AS status, CASE
  WHEN gr.query_id IS NOT NULL THEN rank END AS rank, CASE WHEN gr.query_id IS NOT NULL THEN ip.query_id IS NOT NULL END AS in_pool FROM sc LEFT
  JOIN gr USING (query_id) LEFT JOIN ip USING (query_id)"""


@query("e05_run", RUN)
def e05(spark, sf_dir):
    p = pool(spark, sf_dir)
    return ev.run(reranked(spark, sf_dir, p), p, materialise(cases(spark, sf_dir), "cases"), corpus.notes(spark, sf_dir).select(F.col("path").alias("source")), 8, [6])[0]


@query("e06_served_scores", f"""{BASE}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id, title ORDER BY pos) AS n FROM pool),
  v AS (SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS pos FROM t WHERE n = 1), sc AS ({scored(8, 'v')})
  SELECT query_id, hit, rank FROM sc""")
def e06(spark, sf_dir):
    from loam.operators.serve import search_results

    served = search_results(pool(spark, sf_dir)).select("query_id", "pos", F.col("id").alias("source"))
    return ev.score_cases(served, cases(spark, sf_dir), 8).select("query_id", "hit", "rank")


def view(name: str, src: str, early: bool = True) -> str:
    of = lambda k: f"""SELECT '{name}' AS view, {k} AS k, round(avg(CASE WHEN hit THEN 1.0e0 ELSE 0.0e0 END), 6) AS hit_rate, round(avg(rr), 6) AS mrr,
  count(*) AS cases FROM ({scored(k, src, early)}) v{k}"""  # noqa: E731
    return " UNION ALL ".join(map(of, (4, 8)))


def capped(n: int) -> str:
    """The reranked list with ``n`` chunks a note at most."""
    return f"""cap{n} AS (SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS pos
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY pos) AS m FROM ranked) WHERE m <= {n})"""


VIEWS = [
    view("reranked_served", "ranked"), view("reranked_notes", "ranked", False), view("reranked_cap1", "cap1"), view("reranked_cap2", "cap2"),
    view("fused_served", "pool"), view("fused_notes", "pool", False),
]


@query("e07_sweep_views", f"{BASE}, {capped(1)}, {capped(2)} " + " UNION ALL ".join(VIEWS))
def e07(spark, sf_dir):
    p = pool(spark, sf_dir)
    return ev.sweep_views(p, reranked(spark, sf_dir, p), materialise(cases(spark, sf_dir), "cases"), [4, 8])


LAT = "lt AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


@query("e08_latency", f"""WITH {LAT} SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median,
  max(value) FILTER (i = round_even(0.95e0 * (n - 1), 0)) AS p95, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM lt
  GROUP BY event_type""")
def e08(spark, sf_dir):
    x = ev.latency(table(spark, sf_dir, "events"), "value", "event_type")
    return x.withColumns({"median": F.round("median", 6), "mean": F.round("mean", 6)})


@query("e09_sweep_report", """WITH s AS (SELECT event_type AS model, user_id % 2 AS max_len, 1 AS batch, value FROM events), m AS (SELECT model, max_len, batch,
  count(*) AS n_timed, quantile_cont(value, 0.5) AS median, length(model) % 3 AS hit4 FROM s GROUP BY ALL)
  SELECT model, max_len, hit4, n_timed, round(median, 6) AS median, row_number() OVER (ORDER BY hit4 DESC, median, model, max_len) AS pos FROM m""")
def e09(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), (F.col("user_id") % 2).alias("max_len"), F.lit(1).alias("batch"), F.col("value").alias("sample_ms"), "event_id")
    files = s.groupBy("model", "max_len", "batch", (F.col("event_id") % 3).alias("file_no")).agg(F.max(F.length("model") % 3).alias("hit4"))
    return ev.sweep_report(files, s).select("model", "max_len", "hit4", "n_timed", F.round("median", 6).alias("median"), "pos")


@query("e10_spread_sample", """WITH c AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS r, count(*) OVER () AS n FROM benchmark)
  SELECT item_id AS case_id FROM c WHERE r IN (SELECT CAST(floor(i * (SELECT max(n) FROM c) / 10.0e0) AS BIGINT) FROM range(0, 10) t(i))""")
def e10(spark, sf_dir):
    return ev.spread_sample(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id")), 10)


def case_rows(spark, sf_dir):
    return questions(spark, sf_dir).select(F.col("query_id").alias("case_id"), "question", F.array(F.lit("x.md")).alias("expected_sources"), "scope")


FP = """fp AS (SELECT CAST(sum(n) AS BIGINT) AS cases, sha256(string_agg(h, '' ORDER BY b)) AS sha256 FROM (SELECT b, count(*) AS n, sha256(string_agg(h, ''
  ORDER BY item_id)) AS h FROM (SELECT item_id, (row_number()
  OVER (ORDER BY item_id) - 1) // 1024 AS b, sha256(concat_ws(chr(1), CAST(item_id AS VARCHAR), coalesce(text, ''), 'x.md', CASE item_id % 3 WHEN 0 THEN 'notes'
  WHEN 1 THEN 'chats' ELSE 'all' END)) AS h FROM benchmark) GROUP BY b))"""


@query("e11_baseline", f"WITH {FP} SELECT cases, sha256, 0.8e0 AS hit_rate FROM fp")
def e11(spark, sf_dir):
    fp = ev.fingerprint(case_rows(spark, sf_dir))
    cards = fp.withColumn("hit_rate", F.lit(0.8)).unionByName(fp.withColumn("sha256", F.lit("other")).withColumn("hit_rate", F.lit(0.9)))
    return ev.baseline(cards, fp)


@query("e13_drift", f"""{BASE}, a AS (SELECT avg(CASE WHEN hit THEN 1.0e0 ELSE 0.0e0 END) AS h FROM ({scored(1)})), b AS (SELECT avg(CASE WHEN hit THEN 1.0e0 ELSE 0.0e0 END) AS h FROM ({scored(30)}))
  SELECT round(a.h, 6) AS hit_rate, round(b.h, 6) AS before, CASE WHEN round((round(b.h, 6) - round(a.h, 6)) * 100, 1) >= 5.0 THEN 'warn' ELSE 'ok' END AS verdict FROM a, b""")
def e13(spark, sf_dir):
    """The first candidate alone against the whole pool."""
    a = ev.aggregate(ev.score_at(pool(spark, sf_dir), materialise(cases(spark, sf_dir), "cases"), [1, 30]), "k")
    a = a.agg(F.max(F.when(F.col("k") == 1, F.col("hit_rate"))).alias("hit_rate"), F.max(F.when(F.col("k") == 30, F.col("hit_rate"))).alias("before"))
    return a.withColumn("verdict", ev.drift(F.col("hit_rate"), F.col("before")))


CARD = " UNION ALL ".join(f"SELECT {k} AS k, round(avg(CASE WHEN hit THEN 1.0e0 ELSE 0.0e0 END), 6) AS hit_rate, round(avg(rr), 6) AS mrr FROM ({scored(k)}) c{k}" for k in (4, 8))


@query("e13_scorecard", f"""{BASE}, {FP}, m AS ({CARD}), ch AS (SELECT count(*) AS chunks, count(DISTINCT source) AS files FROM chunks)
  SELECT 8 AS config_k, chunks, files, cases, sha256, k, hit_rate, mrr FROM m, ch, fp""")
def e13_card(spark, sf_dir):
    """The scorecard's nested row, laid out as one row for each k."""
    from loam.operators.maintenance import census

    s = ev.aggregate(ev.score_at(pool(spark, sf_dir), materialise(cases(spark, sf_dir), "cases"), [4, 8]), "k")
    card = ev.scorecard(spark.range(1).select(F.lit(8).alias("k")), census(chunks(spark, sf_dir)), ev.fingerprint(case_rows(spark, sf_dir)), s)
    flat = card.select(F.col("config.k").alias("config_k"), "index.chunks", "index.files", "dataset.cases", "dataset.sha256", F.explode("metrics").alias("k", "m"))
    return flat.select("config_k", "chunks", "files", "cases", "sha256", "k", "m.hit_rate", "m.mrr")


@query("e15_check_summary", "SELECT count(*) AS checks, count(*) FILTER (event_type <> 'error') AS passed, count(*) FILTER (event_type = 'error') AS failed, max(value) AS ms_max FROM events")
def e15(spark, sf_dir):
    return ev.check_summary(table(spark, sf_dir, "events").select((F.col("event_type") != "error").alias("ok"), F.col("value").alias("ms")))


@query("e16_newest_rows", """SELECT CAST(event_id AS VARCHAR) AS event_id, coalesce(CAST(CASE WHEN user_id % 2 = 0 THEN user_id END AS VARCHAR), '-') AS user_id,
  concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), '/', lpad(CAST(event_id AS VARCHAR), 9, '0')) AS stamp FROM events ORDER BY stamp DESC LIMIT 20""")
def e16(spark, sf_dir):
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("/"), F.lpad(F.col("event_id").cast("string"), 9, "0"))
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("user_id"), stamp.alias("stamp"))
    return ev.newest(e, 20, "stamp")


@query("s05_cases", """SELECT item_id AS case_id, CASE item_id % 5 WHEN 1 THEN 'question is missing or blank' WHEN 2 THEN 'expected_sources is missing or empty'
  WHEN 3 THEN 'unknown scope' ELSE 'valid' END AS outcome FROM benchmark WHERE item_id % 5 <> 4""")
def s05(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    m = F.col("item_id") % 5
    line = F.when(m == 4, "  ").otherwise(F.to_json(F.struct(F.when(m == 1, " ").otherwise(F.col("text")).alias("question"), F.when(m == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit(" a.md "))).alias("expected_sources"), F.when(m == 3, "both").otherwise("all").alias("scope"))))
    good, bad = corpus.eval_cases(b.select(F.col("item_id").alias("line_no"), line.alias("line")))
    return good.select("case_id", F.lit("valid").alias("outcome")).unionByName(bad.select(F.col("line_no").alias("case_id"), F.col("reason").alias("outcome")))
