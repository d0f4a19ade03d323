"""Fusion, reranking and re-ordering of candidate lists. A list is all rows of one query_id, in order of ``pos`` 1, 2, ..."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.operators import lexical
from loam.session import materialise

RRF_K = 60
ALPHA, BETA, GAMMA, RERANK_SCALE = 0.05, 0.04, 0.06, 20.0
#: What marks a path or a title as a chat.
CHAT_PATHS = ("05 ai chats/", "/ai chat links/", "ai chat links/")
CHAT_WORDS = ("transcript", "conversation", "imessage", "slack")
#: Fixed values: (all of these groups, each by any of its words; anchors) and the same with terms to append.
ANCHORS: list[tuple[list[list[str]], list[str]]] = [
    ([["course home"]], ["course home", "container", "docker", "data structure"]),
    ([["container"], ["wrong", "job", "reach"]], ["course home", "container", "docker", "data structure"]),
    ([["slide"], ["test", "exam", "before"]], ["slides", "exam", "slide", "school notes"]),
    ([["resume"], ["redo", "redid", "rebuild", "session"]], ["resume", "rebuild", "job hunt"]),
    ([["cleanup"], ["script", "handwritten", "deleted", "hand-written"]], ["cleanup", "hand-written", "handwritten", "pipeline", "chat memory", "clean_empty_chats", "recovered"]),
    ([["architecture"]], ["architecture"]),
    ([["portal"], ["city"]], ["architecture"]),
]
EXPANSIONS: list[tuple[list[list[list[str]]], str]] = [
    ([[["portal"], ["city", "open", "app"]]], "architecture application UI"),
    ([[["code"], ["read", "reading"], ["before", "chang"]]], "inspect existing implementation"),
    ([[["virtual environment", "venv"]], [["requirements"], ["pull", "install", "set up", "setup"]]], "virtualenv requirements.txt"),
    ([[["slide"], ["test", "exam", "before"]]], "slides exam studying"),
    ([[["container"], ["wrong", "job", "reach"]]], "data structure Course Home container"),
    ([[["cleanup"], ["script", "handwritten", "deleted"]]], "clean_empty_chats hand-written recovered"),
    ([[["resume"], ["redo", "redid", "rebuild", "session"]]], "Resume Rebuild Job Hunt"),
]
#: Fixed value: what asks for recent things.
RECENCY = (
    r"(?i)\b(latest|recent|recently|lately|newest|nowadays|currently|today|tonight|yesterday|"
    r"this (?:morning|afternoon|evening|week|month|year)|(?:last|past) (?:few |couple(?: of)? )?(?:day|days|night|week|weeks|month|months)|"
    r"what['’]?s new|anything new|new (?:stuff|things|ideas)|so far|right now|these days|been (?:working|doing|up to|thinking))\b"
)


@dataclass
class Config:
    """Depths and weights of ``retrieve``; days are half-lives, ``prefix`` stands before questions when they are embedded."""

    #: Fixed value: the instruction that the default model was trained with.
    prefix: str = "Represent this sentence for searching relevant passages: "
    k: int = 8
    pool: int = 30
    per_source: int = 0
    inject: int = 12
    weight: float = 0.1
    intent_weight: float = 1.0
    half_life: float = 90.0
    intent_half_life: float = 14.0
    now: float = 1706745600.0


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _all(text: Column, groups: list[list[str]]) -> Column:
    out = F.lit(True)
    for g in groups:
        out = out & _any(text, g)
    return out


def by_query(*order: Column) -> W:
    return W.partitionBy("query_id").orderBy(*order)


def renumber(df: DataFrame, *order: Column) -> DataFrame:
    """``pos`` anew, by ``order``, then by the old ``pos``."""
    return df.withColumn("pos", F.row_number().over(by_query(*order, F.col("pos"))))


def chat_like(source: Column, title: Column, category: Column) -> Column:
    s, t = F.lower(F.regexp_replace(F.coalesce(source, F.lit("")), r"\\", "/")), F.lower(F.coalesce(title, F.lit("")))
    return F.coalesce(category == "chat", F.lit(False)) | _any(s, list(CHAT_PATHS)) | _any(t, list(CHAT_WORDS)) | _any(s, list(CHAT_WORDS))


def guard(cands: DataFrame) -> DataFrame:
    """In scope ``notes`` chat-like candidates go, unless none would be left of the query's list."""
    keep = (F.col("scope") != "notes") | ~chat_like(F.col("source"), F.col("title"), F.col("category"))
    w = W.partitionBy("query_id")
    x = cands.withColumn("_keep", keep).withColumn("_any", F.max("_keep").over(w)).filter(F.col("_keep") | ~F.col("_any"))
    return renumber(x.drop("_keep", "_any"))


def rrf(legs: list[DataFrame], depth: int) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (60 + pos) over legs; payload of the first leg; ties by first appearance."""
    cols = ["query_id", "chunk_id", "source", "title", "chunk", "category", "mtime", "pos"]
    every = None
    for i, leg in enumerate(legs):
        x = leg.select(*cols).withColumn("leg", F.lit(i))
        every = x if every is None else every.unionByName(x)
    key = F.when(F.coalesce(F.col("chunk_id"), F.lit("")) == "", F.concat_ws("\x00", "source", "chunk")).otherwise(F.col("chunk_id"))
    g = every.withColumn("_key", key).groupBy("query_id", "_key").agg(
        F.sum(1.0 / (RRF_K + F.col("pos"))).alias("rrf_score"),
        F.min_by(F.struct("chunk_id", "source", "title", "chunk", "category", "mtime"), F.struct("leg", "pos")).alias("p"),
        F.min(F.struct("leg", "pos")).alias("f"),
    )
    g = g.withColumn("rrf_score", F.round("rrf_score", 9))
    w = by_query(F.desc("rrf_score"), F.col("f.leg"), F.col("f.pos"))
    return g.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= depth).select("query_id", "pos", "p.*", "rrf_score")


def overlap(question: Column, chunk: Column) -> Column:
    """The stand-in pair scorer: distinct words that a question and a chunk share."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))
    return F.size(F.filter(F.array_intersect(words(question), words(chunk)), lambda w: w != "")).cast("double")


def rerank(cands: DataFrame, queries: DataFrame, scorer=overlap) -> DataFrame:
    """Candidates by ``rerank_score`` descending, ties in order; ``scorer`` is a function of two columns, such as a pandas
    UDF. None leaves the order."""
    if scorer is None:
        return cands.withColumn("rerank_score", F.lit(None).cast("double"))
    x = cands.join(queries.select("query_id", "question"), "query_id").withColumn("rerank_score", scorer(F.col("question"), F.col("chunk"))).drop("question")
    return renumber(x, F.desc("rerank_score"))


def anchors(question: Column) -> Column:
    q = F.lower(F.coalesce(question, F.lit("")))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(*(F.when(_all(q, g), F.array(*map(F.lit, a))).otherwise(none) for g, a in ANCHORS))))


def siblings(cands: DataFrame, queries: DataFrame, score: str | None = None) -> DataFrame:
    """base + alpha * title hit + beta * path hit - gamma, the last for those that share a folder with exactly one hit.

    The base is ``score`` where given and not null, else the fused score, else 1 / (60 + pos). Queries without anchors
    keep their order. Adds nothing but a new order."""
    up = RERANK_SCALE if score == "rerank_score" else 1.0
    x = cands.join(queries.select("query_id", anchors(F.col("question")).alias("_a")), "query_id")
    path = F.lower(F.regexp_replace(F.coalesce("source", F.lit("")), r"\\", "/"))
    title = F.lower(F.coalesce("title", F.lit("")))
    base = F.coalesce(*([F.col(score).cast("double")] if score else []), *([F.col("rrf_score")] if "rrf_score" in cands.columns else []), 1.0 / (RRF_K + F.col("pos")))
    x = x.withColumns({"_t": F.exists("_a", lambda a: F.contains(title, a)), "_p": F.exists("_a", lambda a: F.contains(path, a)), "_f": F.regexp_extract(path, "^(.*)/[^/]*$", 1), "_b": base})
    w = W.partitionBy("query_id", "_f")
    hit = F.col("_t") | F.col("_p")
    x = x.withColumns({"_n": F.count("*").over(w), "_h": F.sum(hit.cast("int")).over(w)})
    lone = (F.col("_f") != "") & (F.col("_n") >= 2) & (F.col("_h") == 1) & ~hit
    s = F.col("_b") + F.when(F.col("_t"), ALPHA * up).otherwise(0.0) + F.when(F.col("_p"), BETA * up).otherwise(0.0) - F.when(lone, GAMMA * up).otherwise(0.0)
    x = x.withColumn("_s", F.when(F.size("_a") == 0, -F.col("pos").cast("double")).otherwise(F.round(s, 9)))
    return renumber(x, F.desc("_s")).drop("_a", "_t", "_p", "_f", "_b", "_n", "_h", "_s")


def has_recency_intent(question: Column) -> Column:
    return F.coalesce(question, F.lit("")).rlike(RECENCY)


def decay(time: Column, now: float, half_life: Column) -> Column:
    """0.5 ** (age / half-life): 0 without a time, 1 for the future."""
    return F.when(time.isNull() | (half_life <= 0), 0.0).otherwise(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), (now - time) / 86400.0) / half_life))


def recency(cands: DataFrame, cfg: Config) -> DataFrame:
    """Order by relevance + weight * decay; needs ``intent``. Relevance is the min-max rerank score, never above that of
    the row before, or else falls with the rank. Lists of one row, or without any time, stay as they are."""
    per, run = W.partitionBy("query_id"), by_query(F.col("pos")).rowsBetween(W.unboundedPreceding, 0)
    x = cands.withColumn("_when", lexical.note_time(F.col("source"), F.col("mtime")))
    x = x.withColumns({"_n": F.count("*").over(per), "_lo": F.min("rerank_score").over(per), "_hi": F.max("rerank_score").over(per), "_c": F.count("rerank_score").over(per), "_w": F.count("_when").over(per)})
    rel = F.when(F.col("_hi") > F.col("_lo"), (F.col("rerank_score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0)
    x = x.withColumn("_r", F.when(F.col("_c") == F.col("_n"), F.min(rel).over(run)).otherwise(1.0 - (F.col("pos") - 1) / (F.col("_n") - 1)))
    weight = F.when(F.col("intent"), cfg.intent_weight).otherwise(cfg.weight)
    s = F.round(F.col("_r") + weight * decay(F.col("_when"), cfg.now, F.when(F.col("intent"), cfg.intent_half_life).otherwise(cfg.half_life)), 9)
    x = x.withColumn("_s", F.when((F.col("_n") < 2) | (weight <= 0) | (F.col("_w") == 0), -F.col("pos").cast("double")).otherwise(s))
    return renumber(x, F.desc("_s")).drop("_when", "_n", "_lo", "_hi", "_c", "_w", "_r", "_s")


def inject_recent(pool: DataFrame, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Appends the ``k`` newest notes to the lists of queries that ask for recent things; chunks already there don't count
    anew. Over-fetches four times, as chat-like ones go first."""
    ask = queries.filter(has_recency_intent(F.col("question")))
    new = renumber(guard(lexical.recent(chunks, ask, 4 * k).select("query_id", "scope", "pos", "chunk_id", "source", "title", "chunk", "category", "mtime"))).filter(F.col("pos") <= k)
    new = new.join(pool.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("pos", F.col("pos") + 1_000_000)
    return renumber(pool.unionByName(new, allowMissingColumns=True))


def cap_per_source(cands: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` chunks a note, in order; 0 keeps all."""
    if cap <= 0:
        return cands
    w = W.partitionBy("query_id", "source").orderBy("pos")
    return renumber(cands.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).drop("_n"))


def expand(question: Column, rewrite: Column | None = None) -> Column:
    """The question with appended terms: of a rewrite if it's given and brings no chat words, and of the cue rules; two
    clauses and 20 words at most."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    q = trim(F.coalesce(question, F.lit("")))
    low = F.lower(q)
    piece = F.lit("")
    if rewrite is not None:
        piece = F.when(new_chat_words(q, rewrite), F.lit("")).otherwise(clean_rewrite(rewrite))
    hints = F.concat_ws(" ", *(F.when(_any_of(low, alts), F.lit(t)) for alts, t in EXPANSIONS))
    novel = F.array_join(F.filter(F.split(hints, " "), lambda t: (t != "") & ~F.contains(F.lower(piece), F.lower(t))), " ")
    both = clean_rewrite(F.array_join(F.filter(F.array(piece, novel), lambda x: x != ""), " "))
    clauses = F.filter(F.transform(F.split(both, r"[\n;|]+"), trim), lambda c: c != "")
    parts = F.filter(F.transform(F.split(F.element_at(clauses, 1), ","), trim), lambda c: c != "")
    short = (F.size(parts) > 0) & F.forall(parts, lambda p: F.size(F.split(p, r"\s+")) <= 6)
    clauses = F.when((F.size(clauses) == 1) & F.contains(F.element_at(clauses, 1), F.lit(",")) & short, parts).otherwise(clauses)
    cand = F.array_join(F.slice(F.filter(F.split(F.array_join(F.slice(clauses, 1, 2), " "), r"\s+"), lambda w: w != ""), 1, 20), " ")
    return F.when((cand == "") | (F.lower(cand) == low), q).otherwise(F.concat(q, F.lit(" "), cand))


def widened(queries: DataFrame) -> DataFrame:
    """``queries`` with the expanded question, which both legs of a retrieval ask."""
    return queries.withColumn("question", expand(F.col("question")))


def _any_of(text: Column, alternatives: list[list[list[str]]]) -> Column:
    out = F.lit(False)
    for a in alternatives:
        out = out | _all(text, a)
    return out


def clean_rewrite(text: Column) -> Column:
    """First line that isn't blank, without quotes and a leading label."""
    strip = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"^[\"']+|[\"']+$", "")
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), strip), lambda x: F.regexp_replace(x, r"\s", "") != "")
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    return strip(F.regexp_replace(first, r"(?i)^(?:rewritten(?:\s+query)?|query|output)\s*[:\-]\s*", ""))


def new_chat_words(question: Column, rewrite: Column) -> Column:
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\b(chat|thread|transcript|imessage|slack)\b"), F.lit(1))
    return F.size(F.array_except(words(rewrite), words(question))) > 0


def retrieve(queries: DataFrame, chunks: DataFrame, vector_leg: DataFrame, cfg: Config, idx: dict[str, DataFrame] | None = None, scorer=overlap) -> DataFrame:
    """Hybrid retrieval of every query (query_id, question, scope): ``query_id, pos, chunk_id, ...`` of at most ``cfg.k``.

    ``vector_leg`` is a ranked list of candidates of at least twice the pool, for the questions as ``widened`` gives them.
    Legs are guarded and cut before they are fused; intent, anchors and reranking read the question as asked."""
    q = queries.withColumns({"asked": F.col("question"), "intent": has_recency_intent(F.col("question"))})
    wide = widened(q)
    cols = ["query_id", "pos", "chunk_id", "source", "title", "chunk", "category", "mtime"]
    scoped = lambda d: d.select(*cols).join(q.select("query_id", "scope"), "query_id")
    cut = lambda d: guard(scoped(d)).filter(F.col("pos") <= cfg.pool)
    words = lexical.search(wide.select("query_id", "question", "scope"), chunks, 2 * cfg.pool, idx)
    pool = rrf([cut(vector_leg), cut(words)], cfg.pool).join(q.select("query_id", "scope"), "query_id")
    pool = materialise(inject_recent(pool, q, chunks, cfg.inject) if cfg.inject else pool, "pool")  # short lists from here on
    pool = siblings(guard(pool), q)
    pool = siblings(rerank(pool, q, scorer), q, "rerank_score")
    pool = recency(pool.join(q.select("query_id", "intent"), "query_id"), cfg)
    return cap_per_source(pool, cfg.per_source).filter(F.col("pos") <= cfg.k).drop("scope", "intent")
