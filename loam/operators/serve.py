"""Result lists, prompts and histories in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions import markdown as md
from loam.operators.rank import renumber

TURNS, TURN_CHARS, TOTAL_CHARS = 6, 3000, 12000


def search_results(cands: DataFrame) -> DataFrame:
    """``query_id, pos, title, id, snippet``: the first candidate of each title, 150 characters of it."""
    x = cands.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "title").orderBy("pos"))).filter("_n = 1")
    return renumber(x).select("query_id", "pos", "title", F.col("source").alias("id"), F.left("chunk", F.lit(150)).alias("snippet"))


def source_list(cands: DataFrame) -> DataFrame:
    distance = F.coalesce("distance", F.lit(0.0)) if "distance" in cands.columns else F.lit(0.0)
    snippet = F.when(F.char_length("chunk") > 400, F.concat(F.left("chunk", F.lit(400)), F.lit("..."))).otherwise(F.col("chunk"))
    return cands.select("query_id", "pos", "title", "source", snippet.alias("snippet"), distance.alias("distance"))


def grounding(cands: DataFrame) -> DataFrame:
    """``query_id, context``: the candidates' texts in order. A list is at most a few dozen rows."""
    part = F.concat(F.lit("From Note: "), "title", F.lit("\nContent: "), "chunk")
    return cands.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))


def clean_history(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) of user and assistant that aren't blank, trimmed and cut; the last six, newest
    first within a total length."""
    x = turns.filter(F.col("role").isin("user", "assistant")).withColumn("content", F.left(md.strip(F.coalesce("text", F.lit(""))), F.lit(TURN_CHARS))).filter("content <> ''")
    last = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    x = x.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= TURNS)
    x = x.withColumn("_t", F.sum(F.char_length("content")).over(last.rowsBetween(W.unboundedPreceding, 0))).filter(F.col("_t") <= TOTAL_CHARS)
    return x.select("conv_id", "turn", "role", "content")


def retrieval_text(history: DataFrame, questions: DataFrame) -> DataFrame:
    """``conv_id, text``: the last two user turns of the cleaned history and the question (conv_id, question)."""
    u = history.filter("role = 'user'").withColumn("_n", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).filter("_n <= 2")
    t = u.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda x: x["content"]), "\n").alias("before"))
    return questions.join(t, "conv_id", "left").select("conv_id", F.concat_ws("\n", "before", "question").alias("text"))


def record_asks(log: DataFrame, new: DataFrame, keep: int = 300) -> DataFrame:
    """The log (id, asked_at, question, snippet) with new entries, snippets cut to 240, the newest ``keep``."""
    cut = F.when(F.char_length("snippet") > 240, F.concat(F.regexp_replace(F.left("snippet", F.lit(240)), r"\s+$", ""), F.lit("..."))).otherwise(F.col("snippet"))
    return log.unionByName(new.filter(F.col("question").rlike(r"\S")).withColumn("question", md.strip(F.col("question"))).withColumn("snippet", cut)).orderBy(F.desc("asked_at"), F.desc("id")).limit(keep)


def delete_asks(log: DataFrame, ids: DataFrame) -> DataFrame:
    return log.join(ids.select("id"), "id", "left_anti")


def recent_notes(chunks: DataFrame, k: int = 6) -> DataFrame:
    """The ``k`` newest notes with 200 characters of text; only their chunks are put together."""
    top = chunks.groupBy("source").agg(F.max("mtime").alias("mtime")).orderBy(F.desc("mtime"), "source").limit(k)
    text = md.indexed_text(chunks.join(F.broadcast(top.select("source")), "source", "left_semi"))
    return top.join(text, "source", "left").select("source", "mtime", F.left("text", F.lit(200)).alias("preview"))


def daily_sample(nodes: DataFrame, day: str, k: int = 3) -> DataFrame:
    """``k`` nodes that stay the same all day."""
    return nodes.orderBy(F.md5(F.concat(F.lit(day), F.col("id"))), "id").limit(k)


def redacted(url: Column) -> Column:
    return F.regexp_replace(url, r"\?.*$", "?<redacted>")


def unique_sources(cands: DataFrame, most: int = 6) -> DataFrame:
    """``query_id, pos, title, source, snippet``: once a note, the first ``most``, snippet without heading marks."""
    key = F.coalesce(F.nullif("source", F.lit("")), F.nullif("title", F.lit("")))
    x = cands.withColumn("_k", key).filter("_k is not null").withColumn("_n", F.row_number().over(W.partitionBy("query_id", "_k").orderBy("pos"))).filter("_n = 1")
    x = renumber(x).filter(F.col("pos") <= most)
    return x.select("query_id", "pos", F.coalesce(F.nullif("title", F.lit("")), "_k").alias("title"), "source", md.clean_snippet(F.col("chunk"), F.coalesce("title", F.lit(""))).alias("snippet"))


def find_notes(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """``ref, id``: for each ref the first node (pos) whose id or label is equal without regard to case."""
    keys = nodes.select("id", "pos", F.explode(F.array_distinct(F.array(F.lower("id"), F.lower("label")))).alias("k"))
    return refs.withColumn("k", F.lower("ref")).join(keys, "k").groupBy("ref").agg(F.min_by("id", "pos").alias("id"))
