"""Queries of scopes, keyword and vector retrieval, fusion and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import markdown as md
from loam.operators import chunk_table, lexical, neighbours, rank, vectors
from loam.plans.notes import CHUNKED
from loam.plans.registry import query
from loam.session import materialise, shared_dir, table
from loam.sources import corpus

#: Notes, and their chunks by the same fold as the chunk queries.
N = f"""{CHUNKED}, chunks AS MATERIALIZED (SELECT concat(path, '_chunk_', CAST(chunk_ix AS VARCHAR)) AS chunk_id, path AS source, CAST(chunk_ix AS INT) AS chunk_ix, text AS chunk,
  heading, title, category, mtime FROM chunked JOIN notes USING (path))"""
#: Benchmark texts as questions; scopes in turn.
QUESTIONS_SQL = "SELECT item_id AS query_id, coalesce(text, '') AS question, CASE item_id % 3 WHEN 0 THEN 'notes' WHEN 1 THEN 'chats' ELSE 'all' END AS scope FROM benchmark"
TOKENS = "regexp_extract_all(lower({}), '[a-z0-9_]+')"

#: Okapi BM25 over ``chunks`` for ``questions``.
BM25 = f"""
q AS ({QUESTIONS_SQL}),
tok AS (SELECT chunk_id, unnest({TOKENS.format('chunk')}) AS term FROM chunks),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT chunk_id, len({TOKENS.format('chunk')}) AS dl FROM chunks),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5e0) - ln(count(*) + 0.5e0) AS r FROM tf, st GROUP BY term),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25e0 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qt AS (SELECT query_id, unnest({TOKENS.format('question')}) AS term FROM q),
s AS (SELECT query_id, chunk_id, round(sum(idf * tf * 2.5e0 / (tf + 1.5e0 * (1 - 0.75e0 + 0.75e0 * dl / avgdl))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (chunk_id), st GROUP BY ALL)"""
SCOPED = "CASE scope WHEN 'chats' THEN category = 'chat' WHEN 'notes' THEN category <> 'chat' ELSE true END"
SEARCH = f"""hits AS (SELECT query_id, chunk_id, source, title, chunk, category, mtime, scope, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos
  FROM s JOIN chunks USING (chunk_id) JOIN q USING (query_id) WHERE score > 0 AND {SCOPED})"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(QUESTIONS_SQL.replace("FROM benchmark", "FROM {benchmark}"), benchmark=table(spark, sf_dir, "benchmark"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.chunk_notes(corpus.notes(spark, sf_dir)).drop("tags")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table, written once for the steps that read it."""
    return materialise(chunks(spark, sf_dir), "chunks")


def candidates(spark: SparkSession, sf_dir: str, k: int = 30) -> DataFrame:
    q = questions(spark, sf_dir)
    return lexical.search(q, stored(spark, sf_dir), k).join(q.select("query_id", "scope"), "query_id")


@query("f01_scope", f"{N}, q AS ({QUESTIONS_SQL}) SELECT query_id, count(*) AS n_chunks FROM q, chunks WHERE {SCOPED} GROUP BY query_id")
def f01(spark, sf_dir):
    n = chunks(spark, sf_dir).groupBy("category").count()
    q = questions(spark, sf_dir)
    return q.join(F.broadcast(n), lexical.scope_matches(F.col("scope"), F.col("category"))).groupBy("query_id").agg(F.sum("count").alias("n_chunks"))


LIKE = "(category = 'chat' OR regexp_matches(lower(source), '05 ai chats/|ai chat links/|transcript|conversation|imessage|slack') OR regexp_matches(lower(title), 'transcript|conversation|imessage|slack'))"


@query("f02_chat_like", f"{N} SELECT chunk_id, {LIKE} AS chat_like FROM chunks")
def f02(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", rank.chat_like(F.col("source"), F.col("title"), F.col("category")).alias("chat_like"))


GUARDED = f"""kept AS (SELECT *, scope <> 'notes' OR NOT {LIKE} AS keep FROM hits WHERE pos <= 30),
guarded AS (SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY query_id ORDER BY pos) AS pos FROM (SELECT *, max(keep)
  OVER (PARTITION BY query_id) AS any_keep FROM kept) WHERE keep OR NOT any_keep)"""


@query("f03_guard", f"{N}, {BM25}, {SEARCH}, {GUARDED} SELECT query_id, pos, chunk_id FROM guarded")
def f03(spark, sf_dir):
    return rank.guard(candidates(spark, sf_dir)).select("query_id", "pos", "chunk_id")


@query("f04_context_nodes", f"{N} SELECT chunk_id, source, 0.0e0 AS distance FROM chunks WHERE source IN (SELECT source FROM chunks WHERE title LIKE 'Home%')")
def f04(spark, sf_dir):
    c = stored(spark, sf_dir)
    nodes = c.filter(F.col("title").startswith("Home")).select("source").distinct()
    return c.join(nodes, "source", "left_semi").select("chunk_id", "source", F.lit(0.0).alias("distance"))


@query("b01_tokenise", f"{N} SELECT chunk_id, len({TOKENS.format('chunk')}) AS n_tokens, md5(array_to_string({TOKENS.format('chunk')}, ' ')) AS tokens_md5 FROM chunks")
def b01(spark, sf_dir):
    t = lexical.tokenise("chunk")
    return chunks(spark, sf_dir).select("chunk_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@query("b02_terms", f"{N}, {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def b02(spark, sf_dir):
    return lexical.index(stored(spark, sf_dir))["terms"].select("term", "df", F.round("idf", 6).alias("idf"))


@query("b02_postings", f"{N}, {BM25} SELECT term, count(*) AS n_chunks, sum(tf) AS total FROM tf GROUP BY term")
def b02_postings(spark, sf_dir):
    return lexical.index(stored(spark, sf_dir))["postings"].groupBy("term").agg(F.count("*").alias("n_chunks"), F.sum("tf").alias("total"))


@query("b02_stored_index", f"{N}, {BM25}, {SEARCH} SELECT query_id, pos, chunk_id, score FROM hits WHERE pos <= 10")
def b02_stored(spark, sf_dir):
    """The search over an index that was written and read back."""
    import uuid

    path = f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex[:12]}"
    c = stored(spark, sf_dir)
    lexical.write_index(c, path)
    return lexical.search(questions(spark, sf_dir), c, 10, lexical.read_index(spark, path)).select("query_id", "pos", "chunk_id", "score")


#: The chunks of a later scan.
LATER_N = N.replace("JOIN notes USING (path))", "JOIN notes USING (path) WHERE doc_id % 17 <> 0)")


@query("b02_segments", f"{LATER_N}, {BM25} SELECT term, any_value(df) AS df, round(any_value(idf), 6) AS idf, count(*) AS n_chunks, sum(tf) AS total FROM tf JOIN idf USING (term) GROUP BY term")
def b02_segments(spark, sf_dir):
    """An index of what was there first, brought up to a later scan by one more segment; its statistics and live postings."""
    import uuid

    root = f"{shared_dir(spark)}/follow-{uuid.uuid4().hex[:12]}"
    n = corpus.notes(spark, sf_dir)
    chunker = lambda x: md.chunk_notes(x).drop("tags")
    chunk_table.create(chunker(n.filter("doc_id % 23 <> 0")), f"{root}/chunks")
    lexical.write_index(chunk_table.read(spark, f"{root}/chunks"), f"{root}/index")
    chunk_table.upsert(spark, f"{root}/chunks", corpus.later_notes(n), chunker)
    lexical.follow(spark, f"{root}/index", chunk_table.read(spark, f"{root}/chunks"))
    idx = lexical.read_index(spark, f"{root}/index")
    live = idx["postings"].groupBy("term").agg(F.count("*").alias("n_chunks"), F.sum("tf").alias("total"))
    return idx["terms"].select("term", "df", F.round("idf", 6).alias("idf")).join(live, "term")


@query("b03_bm25", f"{N}, {BM25}, {SEARCH} SELECT query_id, pos, chunk_id, score FROM hits WHERE pos <= 10")
def b03(spark, sf_dir):
    return lexical.search(questions(spark, sf_dir), stored(spark, sf_dir), 10).select("query_id", "pos", "chunk_id", "score")


@query("b03_early_stop", f"{N}, {BM25}, {SEARCH} SELECT query_id, pos, chunk_id, score FROM hits WHERE pos <= 3")
def b03_early(spark, sf_dir):
    """The same with a threshold that leaves out what can't be among the best."""
    return lexical.search(questions(spark, sf_dir), stored(spark, sf_dir), 3, early=True).select("query_id", "pos", "chunk_id", "score")


#: Every second question is blank, and so is every third chunk by length.
BLANK_Q = QUESTIONS_SQL.replace("coalesce(text, '')", "CASE WHEN item_id % 2 = 0 THEN ' ?! ' ELSE coalesce(text, '') END")

BLANK_N = N.replace("text AS chunk", "CASE WHEN length(text) % 3 = 0 THEN '- é !' ELSE text END AS chunk")


@query("b04_degenerate", f"{BLANK_N}, {BM25.replace(QUESTIONS_SQL, BLANK_Q)}, {SEARCH} SELECT query_id, pos, chunk_id, score FROM hits WHERE pos <= 10")
def b04(spark, sf_dir):
    """Blank questions find nothing, blank chunks are never found; they count with length 0. Without chunks nothing is found."""
    c = chunks(spark, sf_dir).withColumn("chunk", F.when(F.char_length("chunk") % 3 == 0, "- é !").otherwise(F.col("chunk")))
    q = questions(spark, sf_dir).withColumn("question", F.when(F.col("query_id") % 2 == 0, " ?! ").otherwise(F.col("question")))
    c = materialise(c, "chunks")
    some = lexical.search(q, c, 10)
    return some.unionByName(lexical.search(q, c.limit(0), 10)).select("query_id", "pos", "chunk_id", "score")


TIME = "CASE WHEN regexp_matches(regexp_extract(source, '([^/]*)$', 1), '^[0-9]{4}-[0-9]{2}-[0-9]{2}($|[^0-9])') THEN epoch(CAST(left(regexp_extract(source, '([^/]*)$', 1), 10) AS DATE)) + 43200.0e0 ELSE mtime END"


@query("b05_recent", f"""{N}, q AS ({QUESTIONS_SQL}), r AS (SELECT scope, chunk_id, {TIME} AS t, row_number() OVER (PARTITION BY scope ORDER BY {TIME} DESC, source) AS pos
  FROM (SELECT DISTINCT scope FROM q), chunks WHERE chunk_ix = 0 AND {SCOPED}) SELECT query_id, pos, chunk_id FROM q JOIN r USING (scope) WHERE pos <= 12""")
def b05(spark, sf_dir):
    return lexical.recent(stored(spark, sf_dir), questions(spark, sf_dir), 12).select("query_id", "pos", "chunk_id")


@query("r13_note_time", f"{N} SELECT source, CAST({TIME} AS DOUBLE) AS note_time FROM chunks")
def r13(spark, sf_dir):
    return chunks(spark, sf_dir).select("source", lexical.note_time(F.col("source"), F.col("mtime")).alias("note_time"))


EMBED = """
sl AS (SELECT {key} AS k, CAST(concat('0x', right(md5(w), 2)) AS INT) % 64 AS slot, count(*) AS n
  FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9_]+')) AS w FROM {src}) GROUP BY ALL),
nm AS (SELECT k, sqrt(sum(n * n)) AS norm FROM sl GROUP BY k)"""


@query("v01_embed", f"{N}, {EMBED.format(key='chunk_id', text='chunk', src='chunks')} SELECT k AS chunk_id, slot, round(n / norm, 6) AS v FROM sl JOIN nm USING (k)")
def v01(spark, sf_dir):
    e = vectors.embed(chunks(spark, sf_dir), "chunk_id", "chunk")
    return e.select("chunk_id", F.posexplode("embedding").alias("slot", "v")).filter("v <> 0").select("chunk_id", "slot", F.round("v", 6).alias("v"))


L2 = "round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))), 6)"


@query("v02_knn", f"""SELECT query_id, pos, item_id, distance FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {L2} AS distance, row_number()
  OVER (PARTITION BY a.vec_id ORDER BY {L2}, b.vec_id) AS pos
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE pos <= 8""")
def v02(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    q = e.filter("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    return vectors.knn(q, e, 8).select("query_id", "pos", "item_id", "distance")


@query("v05_cosine_top2", """WITH t AS (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i
  FROM embeddings WHERE vec_id % 20 = 0) GROUP BY label, i),
x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT vec_id, label, round(sum(x.v * t.v) / sqrt(sum(CAST(x.v AS DOUBLE) * x.v) * sum(t.v * t.v)), 6) AS cosine FROM x JOIN t USING (i) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, label) AS n, lead(cosine) OVER (PARTITION BY vec_id ORDER BY cosine DESC, label) AS second FROM c)
SELECT vec_id, label AS topic, cosine AS best, round(cosine - coalesce(second, 0), 6) AS margin FROM r WHERE n = 1""")
def v05(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    topics = e.filter("vec_id % 20 = 0").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    topics = topics.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("t"))
    c = e.join(F.broadcast(topics.withColumnRenamed("label", "topic"))).select("vec_id", "topic", F.round(vectors.cosine("embedding", "t"), 6).alias("cosine"))
    top = c.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "topic"))), 1, 2).alias("x"))
    return top.select("vec_id", F.col("x")[0]["topic"].alias("topic"), (-F.col("x")[0]["c"]).alias("best"), F.round(-F.col("x")[0]["c"] + F.coalesce(F.get(F.col("x"), F.lit(1))["c"], F.lit(0.0)), 6).alias("margin"))


@query("v06_clusters")
def v06(spark, sf_dir):
    c = stored(spark, sf_dir)
    v = materialise(vectors.embed(c, "chunk_id", "chunk").join(c.select("chunk_id", "source", "chunk_ix"), "chunk_id"), "vectors")
    return vectors.note_clusters(v, 8)


@query("v04_near_pairs", f"""SELECT query_id, pos, item_id, distance FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {L2} AS distance, row_number()
  OVER (PARTITION BY a.vec_id ORDER BY {L2}, b.vec_id) AS pos
  FROM embeddings a, embeddings b) WHERE pos <= 4""")
def v04(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return neighbours.knn(e.withColumnRenamed("item_id", "query_id"), e, 4).select("query_id", "pos", "item_id", "distance")


def scoped_neighbours(q: DataFrame, c: DataFrame, k: int, prefix: str = "", load=None) -> DataFrame:
    """The ``k`` nearest chunks in the scope of each question (query_id, question, scope): a search for each scope, over
    its own chunks alone. ``prefix`` stands before questions only; ``load`` as in ``vectors.embed``."""
    scope = F.coalesce(F.when(F.col("scope").isin("chats", "notes"), F.col("scope")), F.lit("all"))
    asked = materialise(vectors.embed(q, "query_id", "question", prefix=prefix, load=load).join(q.select("query_id", "scope"), "query_id"), "asked")
    held = materialise(vectors.embed(c, "chunk_id", "chunk", load=load).join(c.select("chunk_id", "category"), "chunk_id"), "vectors")
    out = None
    for s in ("chats", "notes", "all"):
        part = vectors.knn(asked.filter(scope == s), held.filter(lexical.scope_matches(F.lit(s), F.col("category"))), k, "query_id", "chunk_id")
        out = part if out is None else out.unionByName(part)
    return out.join(c, "chunk_id").join(q.select("query_id", "scope"), "query_id")


#: Two lists to fuse: keyword hits, and the newest notes of the scope.
FUSED = f"""rec AS (SELECT scope, chunk_id, row_number() OVER (PARTITION BY scope ORDER BY {TIME} DESC, source) AS pos FROM (SELECT DISTINCT scope FROM q), chunks WHERE chunk_ix = 0 AND {SCOPED}),
legs AS (SELECT query_id, chunk_id, pos, 0 AS leg FROM hits WHERE pos <= 30 UNION ALL SELECT query_id, chunk_id, pos, 1 FROM q JOIN rec USING (scope) WHERE pos <= 30),
f AS (SELECT query_id, chunk_id, round(sum(1.0e0 / (60 + pos)), 9) AS rrf_score, min(leg * 1000 + pos) AS o FROM legs GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, o) AS pos FROM f),
pool AS (SELECT query_id, pos, chunk_id, rrf_score, source, title, chunk, category, mtime, scope, question FROM fused JOIN chunks USING (chunk_id) JOIN q USING (query_id) WHERE pos <= 30)"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = questions(spark, sf_dir), stored(spark, sf_dir)
    return rank.rrf([lexical.search(q, c, 30), lexical.recent(c, q, 30)], 30)


@query("r01_fusion", f"{N}, {BM25}, {SEARCH}, {FUSED} SELECT query_id, pos, chunk_id, rrf_score FROM pool")
def r01(spark, sf_dir):
    return fused(spark, sf_dir).select("query_id", "pos", "chunk_id", "rrf_score")


WORDSET = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w <> ''))"
RERANKED = f"""rr AS (SELECT * EXCLUDE (pos), pos AS old, CAST(len(list_intersect({WORDSET.format('question')}, {WORDSET.format('chunk')})) AS DOUBLE) AS rerank_score FROM pool),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, old) AS pos FROM rr)"""


@query("r02_rerank", f"{N}, {BM25}, {SEARCH}, {FUSED}, {RERANKED} SELECT query_id, pos, chunk_id, rerank_score FROM ranked")
def r02(spark, sf_dir):
    return rank.rerank(fused(spark, sf_dir), questions(spark, sf_dir)).select("query_id", "pos", "chunk_id", "rerank_score")


#: Questions with cue words, so that rules of anchors, expansion and intent apply.
CUES_SQL = """SELECT query_id, concat(question, CASE query_id % 7 WHEN 0 THEN ' open the city portal app' WHEN 1 THEN ' wrong container job' WHEN 2 THEN ' slides before the exam'
  WHEN 3 THEN ' resume redo session' WHEN 4 THEN ' cleanup script lately' WHEN 5 THEN ' what''s new this week' ELSE ' read code before changing, venv; chat' END) AS question, scope FROM ({}) z"""


def cue_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CUES_SQL.format("SELECT * FROM {q}"), q=questions(spark, sf_dir))


CUES = f"cue AS ({CUES_SQL.format(QUESTIONS_SQL)})"


def hints_sql(question: str) -> str:
    """Terms that the cue rules append to a question."""
    of = lambda alts: " OR ".join("(" + " AND ".join("(" + " OR ".join(f"contains(lower({question}), '{w}')" for w in g) + ")" for g in a) + ")" for a in alts)
    return "concat_ws(' ', " + ", ".join(f"CASE WHEN {of(alts)} THEN '{t}' END" for alts, t in rank.EXPANSIONS) + ")"


def siblings_sql(src: str, out: str, base: str, up: float) -> str:
    """The sibling order of list ``src`` as list ``out``."""
    return f"""
{out}a AS (SELECT x.*, coalesce(an.a, []) AS an, lower(title) AS lt, lower(source) AS ls, regexp_extract(lower(source), '^(.*)/[^/]*$', 1) AS fo FROM {src} x
  LEFT JOIN (SELECT query_id, list(t) AS a FROM anchor GROUP BY query_id) an USING (query_id)),
{out}b AS (SELECT *, len(list_filter(an, lambda w: contains(lt, w))) > 0 AS th, len(list_filter(an, lambda w: contains(ls, w))) > 0 AS ph FROM {out}a),
{out}c AS (SELECT *, count(*) OVER w AS fn, sum(CASE WHEN th OR ph THEN 1 ELSE 0 END) OVER w AS fh FROM {out}b WINDOW w AS (PARTITION BY query_id, fo)),
{out}d AS (SELECT *, CASE WHEN len(an) = 0 THEN -CAST(pos AS DOUBLE) ELSE round({base} + CASE WHEN th THEN {rank.ALPHA * up}e0 ELSE 0.0e0 END + CASE WHEN ph THEN {rank.BETA * up}e0 ELSE 0.0e0 END
  - CASE WHEN fo <> '' AND fn >= 2 AND fh = 1 AND NOT (th OR ph) THEN {rank.GAMMA * up}e0 ELSE 0.0e0 END, 9) END AS ss FROM {out}c),
{out} AS (SELECT * EXCLUDE (pos, an, lt, ls, fo, th, ph, fn, fh, ss), row_number() OVER (PARTITION BY query_id ORDER BY ss DESC, pos) AS pos FROM {out}d)"""


def guard_sql(src: str, out: str) -> str:
    return f"""
{out}k AS (SELECT *, scope <> 'notes' OR NOT {LIKE} AS keep FROM {src}), {out} AS (SELECT * EXCLUDE (pos, keep, any_keep), row_number() OVER (PARTITION BY query_id ORDER BY pos) AS pos
  FROM (SELECT *, max(keep) OVER (PARTITION BY query_id) AS any_keep FROM {out}k) WHERE keep OR NOT any_keep)"""


ANCHOR = """anchor AS (SELECT query_id, unnest(['course home', 'container', 'docker', 'data structure']) AS t FROM aq
  WHERE contains(x, 'course home') OR (contains(x, 'container') AND regexp_matches(x, 'wrong|job|reach'))
  UNION SELECT query_id, unnest(['slides', 'exam', 'slide', 'school notes']) FROM aq WHERE contains(x, 'slide') AND regexp_matches(x, 'test|exam|before')
  UNION SELECT query_id, unnest(['resume', 'rebuild', 'job hunt']) FROM aq WHERE contains(x, 'resume') AND regexp_matches(x, 'redo|redid|rebuild|session')
  UNION SELECT query_id, unnest(['cleanup', 'hand-written', 'handwritten', 'pipeline', 'chat memory', 'clean_empty_chats', 'recovered']) FROM aq
  WHERE contains(x, 'cleanup') AND regexp_matches(x, 'script|handwritten|deleted|hand-written')
  UNION SELECT query_id, 'architecture' FROM aq WHERE contains(x, 'architecture') OR (contains(x, 'portal') AND contains(x, 'city')))"""

@query("r04_anchors", f"""WITH {CUES}, aq AS (SELECT query_id, lower(question) AS x FROM cue), {ANCHOR} SELECT query_id, coalesce(string_agg(t, ','
  ORDER BY t), '') AS anchors FROM aq LEFT JOIN anchor USING (query_id) GROUP BY query_id""")
def r04(spark, sf_dir):
    return cue_questions(spark, sf_dir).select("query_id", F.array_join(F.array_sort(rank.anchors(F.col("question"))), ",").alias("anchors"))


@query("r03_siblings", f"""{N}, {BM25}, {SEARCH}, {FUSED}, {CUES}, aq AS (SELECT query_id, lower(question) AS x FROM cue), {ANCHOR},
  s0 AS (SELECT * EXCLUDE (title), CASE WHEN pos % 4 = 0 THEN concat(title, ' architecture') ELSE title END AS title
  FROM pool), {siblings_sql('s0', 's1', 'rrf_score', 1.0)} SELECT query_id, pos, chunk_id, rrf_score FROM s1""")
def r03(spark, sf_dir):
    c = fused(spark, sf_dir).withColumn("title", F.when(F.col("pos") % 4 == 0, F.concat("title", F.lit(" architecture"))).otherwise(F.col("title")))
    return rank.siblings(c, cue_questions(spark, sf_dir)).select("query_id", "pos", "chunk_id", "rrf_score")


@query("r05_expansion", f"""WITH {CUES}, h AS (SELECT query_id, regexp_replace(question, '^\\s+|\\s+$', '', 'g') AS q, {hints_sql('question')} AS h FROM cue),
  n AS (SELECT query_id, q, concat('synonyms of the words second clause', CASE WHEN t = '' THEN '' ELSE concat(' ', t) END) AS c
  FROM (SELECT query_id, q, array_to_string(list_filter(string_split(h, ' '), lambda w: w <> '' AND NOT contains('synonyms of the words; second clause', lower(w))), ' ') AS t
  FROM h) z)
  SELECT query_id, concat(q, ' ', array_to_string(list_filter(regexp_split_to_array(c, '\\s+'), lambda w: w <> '')[1:20], ' ')) AS expanded FROM n""")
def r05(spark, sf_dir):
    return cue_questions(spark, sf_dir).select("query_id", rank.expand(F.col("question"), F.lit("Query: synonyms of the words; second clause")).alias("expanded"))


@query("r06_vocabulary_guard", f"""WITH {CUES} SELECT query_id, NOT regexp_matches(lower(question), '\\bchat\\b') AND query_id % 2 = 0 AS rejected FROM cue""")
def r06(spark, sf_dir):
    rewrite = F.when(F.col("query_id") % 2 == 0, F.lit("a Chat about it")).otherwise(F.lit("chats about it"))
    return cue_questions(spark, sf_dir).select("query_id", rank.new_chat_words(F.col("question"), rewrite).alias("rejected"))


INTENT = rank.RECENCY.replace("'", "''").replace("(?i)", "")


@query("r07_recency_intent", f"WITH {CUES} SELECT query_id, regexp_matches(question, '{INTENT}', 'i') AS intent FROM cue")
def r07(spark, sf_dir):
    return cue_questions(spark, sf_dir).select("query_id", rank.has_recency_intent(F.col("question")).alias("intent"))


@query("r08_decay", f"{N} SELECT source, round(pow(0.5e0, greatest(0.0e0, (1706745600.0e0 - {TIME}) / 86400.0e0) / 14.0e0), 6) AS decay FROM chunks")
def r08(spark, sf_dir):
    return chunks(spark, sf_dir).select("source", F.round(rank.decay(lexical.note_time(F.col("source"), F.col("mtime")), 1706745600.0, F.lit(14.0)), 6).alias("decay"))


@query("r09_recency", f"""{N}, {BM25}, {SEARCH}, {FUSED}, {RERANKED}, w AS (SELECT *, query_id % 2 = 0 AS intent, {TIME} AS t, count(*) OVER p AS n,
  min(rerank_score) OVER p AS lo, max(rerank_score) OVER p AS hi FROM ranked WINDOW p AS (PARTITION BY query_id)),
  v AS (SELECT *, min(CASE WHEN hi > lo THEN (rerank_score - lo) / (hi - lo) ELSE 1.0e0 END) OVER (PARTITION BY query_id ORDER BY pos) AS r FROM w),
  u AS (SELECT *, CASE WHEN n < 2 THEN -pos ELSE round(r + CASE
  WHEN intent THEN 1.0e0 ELSE 0.1e0 END * pow(0.5e0, greatest(0.0e0, (1706745600.0e0 - t) / 86400.0e0) / CASE
  WHEN intent THEN 14.0e0 ELSE 90.0e0 END), 9) END AS s FROM v)
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, pos) AS pos FROM u""")
def r09(spark, sf_dir):
    x = rank.rerank(fused(spark, sf_dir), questions(spark, sf_dir)).withColumn("intent", F.col("query_id") % 2 == 0)
    return rank.recency(x, rank.Config()).select("query_id", "chunk_id", "pos")


INJECT = f"""rec AS (SELECT scope, chunk_id, source, title, category, row_number() OVER (PARTITION BY scope ORDER BY {TIME} DESC, source) AS pos
  FROM (SELECT DISTINCT scope FROM q), chunks WHERE chunk_ix = 0 AND {SCOPED}),
kp AS (SELECT *, scope <> 'notes' OR NOT {LIKE} AS keep FROM rec WHERE pos <= 48), gd AS (SELECT scope, chunk_id, row_number() OVER (PARTITION BY scope
  ORDER BY pos) AS pos FROM (SELECT *, max(keep) OVER (PARTITION BY scope) AS any_keep FROM kp) WHERE keep OR NOT any_keep),
pl AS (SELECT query_id, chunk_id, pos FROM hits WHERE pos <= 10 UNION ALL SELECT query_id, chunk_id, gd.pos + 1000000 FROM q JOIN gd USING (scope)
  WHERE gd.pos <= 12 AND regexp_matches(question, '{INTENT}', 'i') AND (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM hits WHERE pos <= 10))"""


@query("r10_inject_recent", f"""{N}, {BM25.replace(QUESTIONS_SQL, CUES_SQL.format(QUESTIONS_SQL))}, {SEARCH}, {INJECT} SELECT query_id, row_number()
  OVER (PARTITION BY query_id ORDER BY pos) AS pos, chunk_id FROM pl""")
def r10(spark, sf_dir):
    q, c = cue_questions(spark, sf_dir), stored(spark, sf_dir)
    pool = lexical.search(q, c, 10).join(q.select("query_id", "scope"), "query_id")
    return rank.inject_recent(pool, q, c, 12).select("query_id", "pos", "chunk_id")


@query("r11_cap", f"""{N}, {BM25}, {SEARCH}, d AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY pos) AS n FROM hits WHERE pos <= 30)
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS pos FROM d WHERE n <= 2""")
def r11(spark, sf_dir):
    return rank.cap_per_source(candidates(spark, sf_dir), 2).select("query_id", "chunk_id", "pos")


#: The pipeline of ``retrieve`` step by step over the questions with cues: ``wide`` are the expanded questions of both
#: legs; x1 to x9 are the lists after guard, fusion, injection, sibling order, rerank and recency.
WIDE_SQL = f"""SELECT query_id, CASE
  WHEN h = '' THEN regexp_replace(question, '^\\s+|\\s+$', '', 'g') ELSE concat(regexp_replace(question, '^\\s+|\\s+$', '', 'g'), ' ', h) END AS question, scope
  FROM (SELECT *, {hints_sql('question')} AS h FROM cue) z"""
PAYLOAD = "query_id, chunk_id, source, title, chunk, category, mtime, scope"
#: Chunks of each question's scope by the distance of their vectors.
NEAR = f"""{EMBED.format(key='chunk_id', text='chunk', src='chunks').replace('sl AS', 'csl AS').replace('nm AS', 'cnm AS').replace('FROM sl', 'FROM csl').strip()},
{EMBED.format(key='query_id', text='question', src='q').replace('sl AS', 'qsl AS').replace('nm AS', 'qnm AS').replace('FROM sl', 'FROM qsl').strip()},
dots AS (SELECT a.k AS query_id, b.k AS chunk_id, sum((a.n / an.norm) * (b.n / bn.norm)) AS dot FROM qsl a JOIN qnm an USING (k) JOIN csl b ON a.slot = b.slot JOIN cnm bn ON b.k = bn.k GROUP BY ALL),
near AS (SELECT {PAYLOAD}, row_number() OVER (PARTITION BY query_id ORDER BY round(CASE WHEN qn.norm IS NULL THEN 0.0e0 ELSE 1.0e0 END + CASE
  WHEN cn.norm IS NULL THEN 0.0e0 ELSE 1.0e0 END - 2 * coalesce(dot, 0.0e0), 6), chunk_id) AS pos
  FROM q JOIN chunks ON {SCOPED} LEFT JOIN dots USING (query_id, chunk_id) LEFT JOIN qnm qn ON qn.k = query_id LEFT JOIN cnm cn ON cn.k = chunk_id)"""


@query("v03_scoped_knn", f"{N}, q AS ({QUESTIONS_SQL}), {NEAR} SELECT query_id, pos, chunk_id FROM near WHERE pos <= 8")
def v03(spark, sf_dir):
    return scoped_neighbours(questions(spark, sf_dir), stored(spark, sf_dir), 8).select("query_id", "pos", "chunk_id")


RETRIEVE = f"""{N}, {CUES}, aq AS (SELECT query_id, lower(question) AS x FROM cue), {ANCHOR},
{BM25.replace(QUESTIONS_SQL, WIDE_SQL)}, {SEARCH},
{NEAR.replace("lower(question)", f"lower(concat('{rank.Config.prefix}', question))")},
v0 AS (SELECT * FROM near WHERE pos <= 60), w0 AS (SELECT {PAYLOAD}, pos FROM hits WHERE pos <= 60), {guard_sql('v0', 'v1')}, {guard_sql('w0', 'w1')},
legs AS (SELECT *, 0 AS leg FROM v1 WHERE pos <= 30 UNION ALL BY NAME SELECT *, 1 AS leg FROM w1 WHERE pos <= 30),
x0 AS (SELECT query_id, chunk_id, any_value(source) AS source, any_value(title) AS title, any_value(chunk) AS chunk, any_value(category) AS category, any_value(mtime) AS mtime, any_value(scope) AS scope,
  round(sum(1.0e0 / (60 + pos)), 9) AS rrf_score, min(leg * 1000 + pos) AS o FROM legs GROUP BY query_id, chunk_id),
x1 AS (SELECT * EXCLUDE (o) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, o) AS pos FROM x0) WHERE pos <= 30),
asks AS (SELECT query_id, scope, regexp_matches(question, '{INTENT}', 'i') AS intent, question FROM cue),
r0 AS (SELECT query_id, chunk_id, source, title, chunk, category, mtime, scope, row_number() OVER (PARTITION BY query_id ORDER BY {TIME} DESC, source) AS pos
  FROM asks, chunks WHERE intent AND chunk_ix = 0 AND {SCOPED}),
r1 AS (SELECT * FROM r0 WHERE pos <= 48), {guard_sql('r1', 'r2')},
x2 AS (SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY query_id ORDER BY pos) AS pos FROM (SELECT * FROM x1 UNION ALL BY NAME
  SELECT * EXCLUDE (pos), pos + 1000000 AS pos FROM r2 WHERE pos <= 12 AND (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM x1))),
{guard_sql('x2', 'x3')}, {siblings_sql('x3', 'x4', 'coalesce(rrf_score, 1.0e0 / (60 + pos))', 1.0)},
x5 AS (SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, pos) AS pos
  FROM (SELECT x4.*, CAST(len(list_intersect({WORDSET.format('question')}, {WORDSET.format('chunk')})) AS DOUBLE) AS rerank_score FROM x4
  JOIN asks USING (query_id))),
{siblings_sql('x5', 'x6', 'rerank_score', rank.RERANK_SCALE)},
x7 AS (SELECT x6.*, intent, {TIME} AS t, count(*) OVER p AS n, min(rerank_score) OVER p AS lo, max(rerank_score) OVER p AS hi FROM x6 JOIN asks USING (query_id) WINDOW p AS (PARTITION BY query_id)),
x8 AS (SELECT *, min(CASE WHEN hi > lo THEN (rerank_score - lo) / (hi - lo) ELSE 1.0e0 END) OVER (PARTITION BY query_id ORDER BY pos) AS r FROM x7),
x9 AS (SELECT *, CASE WHEN n < 2 THEN -CAST(pos AS DOUBLE) ELSE round(r + CASE
  WHEN intent THEN 1.0e0 ELSE 0.1e0 END * pow(0.5e0, greatest(0.0e0, (1706745600.0e0 - t) / 86400.0e0) / CASE
  WHEN intent THEN 14.0e0 ELSE 90.0e0 END), 9) END AS s FROM x8)"""


@query("r12_retrieve", f"""{RETRIEVE} SELECT query_id, pos, chunk_id, rrf_score, rerank_score FROM (SELECT query_id, chunk_id, rrf_score, rerank_score,
  row_number() OVER (PARTITION BY query_id ORDER BY s DESC, pos) AS pos FROM x9) WHERE pos <= 8""")
def r12(spark, sf_dir):
    """One chunk table, one index and one expanded question for both legs."""
    q, c = cue_questions(spark, sf_dir), stored(spark, sf_dir)
    leg = scoped_neighbours(rank.widened(q), c, 2 * rank.Config.pool, rank.Config.prefix)
    return rank.retrieve(q, c, leg, rank.Config(), lexical.index(c)).select("query_id", "pos", "chunk_id", "rrf_score", "rerank_score")
