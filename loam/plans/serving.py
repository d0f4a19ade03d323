"""Queries of result lists, prompts and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.operators import graph, serve
from loam.plans.notes import STRIP
from loam.plans.registry import query
from loam.plans.retrieval import BM25, SEARCH, candidates, chunks
from loam.plans.retrieval import N as NC
from loam.session import table
from loam.sources import corpus

N = f"WITH notes AS ({corpus.NOTES_SQL})"
HITS = f"{NC}, {BM25}, {SEARCH}, top AS (SELECT * FROM hits WHERE pos <= 30)"


@query("a01_search_results", f"""{HITS}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id, title ORDER BY pos) AS n FROM top) SELECT query_id,
  row_number() OVER (PARTITION BY query_id ORDER BY pos) AS pos, title, source AS id, left(chunk, 150) AS snippet FROM t WHERE n = 1""")
def a01(spark, sf_dir):
    return serve.search_results(candidates(spark, sf_dir))


@query("a02_sources", f"{HITS} SELECT query_id, pos, title, source, CASE WHEN length(chunk) > 400 THEN concat(left(chunk, 400), '...') ELSE chunk END AS snippet, 0.0e0 AS distance FROM top")
def a02(spark, sf_dir):
    return serve.source_list(candidates(spark, sf_dir))


@query("a03_grounding", f"""{HITS} SELECT query_id, md5(string_agg(concat('From Note: ', title, chr(10), 'Content: ', chunk), concat(chr(10), chr(10))
  ORDER BY pos)) AS context_md5 FROM top GROUP BY query_id""")
def a03(spark, sf_dir):
    return serve.grounding(candidates(spark, sf_dir)).select("query_id", F.md5("context").alias("context_md5"))


HISTORY = f"""h0 AS (SELECT conv_id, turn, role, left({STRIP.format("coalesce(text, '')")}, 3000) AS content FROM conversations WHERE role IN ('user', 'assistant')),
h1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM h0 WHERE content <> ''),
h2 AS (SELECT *, sum(length(content)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS t FROM h1 WHERE n <= 6), h AS (SELECT conv_id, turn, role, content FROM h2 WHERE t <= 12000)"""


@query("a04_history", f"WITH {HISTORY} SELECT conv_id, turn, role, content FROM h")
def a04(spark, sf_dir):
    return serve.clean_history(table(spark, sf_dir, "conversations"))


@query("a05_retrieval_text", f"""WITH {HISTORY}, u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM h WHERE role = 'user'),
  b AS (SELECT conv_id, string_agg(content, chr(10) ORDER BY turn) AS t FROM u WHERE n <= 2 GROUP BY conv_id)
  SELECT conv_id, concat_ws(chr(10), t, concat('more about ', CAST(conv_id AS VARCHAR))) AS text FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN b USING (conv_id)""")
def a05(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    q = c.select("conv_id").distinct().withColumn("question", F.concat(F.lit("more about "), F.col("conv_id").cast("string")))
    return serve.retrieval_text(serve.clean_history(c), q)


@query("a06_ask_log", """WITH a AS (SELECT conv_id * 1000 + turn AS id, conv_id * 60 + turn AS asked_at, trim(text) AS question, text AS snippet
  FROM conversations WHERE role = 'user' AND regexp_matches(text, '\\S')),
  k AS (SELECT id, CASE WHEN length(snippet) > 240 THEN concat(regexp_replace(left(snippet, 240), '\\s+$', ''), '...') ELSE snippet END AS snippet FROM a
  ORDER BY asked_at DESC, id DESC LIMIT 300) SELECT id, snippet FROM k WHERE id % 5 <> 0""")
def a06(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    new = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("conv_id") * 60 + F.col("turn")).alias("asked_at"), F.col("text").alias("question"), F.col("text").alias("snippet"))
    log = serve.record_asks(new.limit(0), new)
    return serve.delete_asks(log, log.filter("id % 5 = 0")).select("id", "snippet")


@query("a07_recent_notes", f"""{NC} SELECT source, max(mtime) AS mtime, left(string_agg(chunk, concat(chr(10), chr(10)) ORDER BY chunk_ix), 200) AS preview
  FROM chunks GROUP BY source ORDER BY 2 DESC, 1 LIMIT 6""")
def a07(spark, sf_dir):
    return serve.recent_notes(chunks(spark, sf_dir))


@query("a08_daily_sample", f"{N} SELECT path AS id, title AS label FROM notes ORDER BY md5(concat('2024-02-01', path)), path LIMIT 3")
def a08(spark, sf_dir):
    return serve.daily_sample(graph.nodes(chunks(spark, sf_dir)).select("id", "label"), "2024-02-01")


@query("a11_redacted", "SELECT page_id, regexp_replace(concat(url, CASE WHEN page_id % 2 = 0 THEN '?q=secret' ELSE '' END), '\\?.*$', '?<redacted>') AS url FROM pages")
def a11(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("url", F.concat("url", F.when(F.col("page_id") % 2 == 0, "?q=secret").otherwise("")))
    return p.select("page_id", serve.redacted(F.col("url")).alias("url"))


@query("a13_unique_sources", f"""{HITS}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY pos) AS n FROM top),
  u AS (SELECT query_id, title, source, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS pos FROM o WHERE n = 1) SELECT query_id, pos, title, source
  FROM u WHERE pos <= 6""")
def a13(spark, sf_dir):
    return serve.unique_sources(candidates(spark, sf_dir)).select("query_id", "pos", "title", "source")


@query("f05_lookup", f"{N} SELECT upper(title) AS ref, path AS id FROM notes WHERE doc_id % 9 = 0")
def f05(spark, sf_dir):
    n = corpus.notes(spark, sf_dir)
    return serve.find_notes(n.select(F.col("path").alias("id"), F.col("title").alias("label"), F.col("doc_id").alias("pos")), n.filter("doc_id % 9 = 0").select(F.upper("title").alias("ref")))
