"""Topic routing of chats and learning of keywords."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions.markdown import let, strip
from loam.functions.ranking import global_rank
from loam.operators import alike, vectors
from loam.session import materialise

#: What a broadcast may take, and bytes of a row of short texts there.
BROADCAST, ROW = 16 << 20, 120
ASSIGN, MARGIN, LEARN = 0.50, 0.04, 0.58
VOTE_FLOOR, VOTE_CONFIDENCE = 0.35, 0.75
PER_CHAT, PER_TOPIC, CANDIDATES = 3, 40, 25
INBOX = "chat-inbox"
#: Words that no phrase may hold.
STOP = [
    "the", "a", "an", "and", "or", "to", "for", "of", "in", "on", "my", "i", "you", "we", "is", "are", "was", "were", "be", "with", "how", "what",
    "can", "could", "would", "should", "this", "that", "it", "me", "im", "so", "uh", "um", "do", "does", "did", "from", "as", "at", "about", "into",
    "over", "under", "your", "any", "all", "not", "just", "like", "want", "need", "make", "use", "using", "file", "files", "user", "mentioned",
    "please", "thanks", "hello", "hey", "untitled", "session", "chat", "transcript", "effort", "following", "codex", "agent", "claude", "gemini",
    "gpt", "assistant", "true", "false", "null",
]
#: Words that say too little for a phrase.
WEAK = [
    "recently", "basically", "alright", "okay", "please", "thanks", "something", "anything", "everything", "notes", "project", "projects", "setup",
    "today", "tomorrow", "yesterday", "still", "maybe", "probably", "actually", "really", "because", "then", "these", "those", "them", "this", "that",
    "before", "after", "when", "where", "which", "than", "also", "into", "from", "with", "about", "year", "years", "ideas", "helps", "help", "steps",
    "step", "folder", "folders", "interrupted", "source", "here", "there", "very", "just", "such", "same", "each", "every", "main", "personal",
    "find", "open", "mode", "status", "scan", "browser", "automation", "cities", "designs", "usage", "token", "one", "two", "three", "four", "five",
    "six", "seven", "eight", "nine", "ten", "besides", "real", "read-only", "error", "issue", "work",
]
#: Phrases that are never taken up.
BLOCKED = [
    "review status", "student transtioning", "security scan", "semgrep scan", "semgrep security", "impeccable designs", "impeccable skill", "chrome browser",
    "browser automation", "in-app browser", "auto mode", "default mode", "voice mode", "these cities", "open data", "source audited", "into obsidian",
    "commit callender", "analyze this video", "five routes", "besides second", "work read-only", "error code", "code enoent", "real link", "github issue", "real vault",
]
#: Fixed value: file extensions that mark mashed words.
EXTENSION = "(pdf|docx?|xlsx?|pptx?|png|jpe?g|gif|zip|json|xml|html|csv|txt)"


def keyword_hit(text: Column, kw: Column) -> Column:
    """A keyword stands in a text: anywhere if it has a space, a hyphen or five characters, else as a word of its own.
    Both in lower case."""
    loose = F.contains(kw, F.lit(" ")) | F.contains(kw, F.lit("-")) | (F.char_length(kw) >= 5)
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), kw, F.lit(r"\E(?![\p{L}\p{N}_])"))
    return (kw != "") & F.contains(text, kw) & F.when(loose, True).otherwise(F.regexp_like(text, quoted))


def route_keywords(routes: DataFrame, column: str = "keywords") -> DataFrame:
    """``id, route_ix, kw_ix, kw, kw_len`` of routes (id, route_ix, keywords)."""
    return routes.select("id", "route_ix", F.posexplode(column).alias("kw_ix", "k")).select("id", "route_ix", "kw_ix", F.lower(strip(F.col("k"))).alias("kw")).withColumn("kw_len", F.char_length("kw")).filter("kw <> ''")


def _alone(text: str, at: int, end: int) -> bool:
    """No letter, digit or underscore stands beside ``text[at:end]``."""
    return not any(c == "_" or unicodedata.category(c)[0] in "LN" for c in text[max(at - 1, 0) : at] + text[end : end + 1])


#: Automata of a worker process.
_automata: dict[str, object] = {}


def _automaton(name: str, words: list[tuple[int, str]]):
    """The automaton of ``words`` (rank, keyword), built once a worker."""
    if name not in _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for r, w in words:
            a.add_word(w, (r, len(w), " " in w or "-" in w or len(w) >= 5))
        a.make_automaton()
        _automata[name] = a
    return _automata[name]


def first_keywords(texts: DataFrame, words: list[tuple[int, str]], key: str, text: str) -> DataFrame:
    """``key, rank``: the least rank of the ``words`` (rank, keyword) that stand in a text as ``keyword_hit`` has it; both in
    lower case. An automaton reads each text once, however many words there are."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton(name, words)
        for batch in batches:
            place, ranks = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                best = None
                for last, (r, n, loose) in a.iter(t):
                    if (best is None or r < best) and (loose or _alone(t, last + 1 - n, last + 1)):
                        best = r
                if best is not None:
                    place.append(i)
                    ranks.append(best)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), pa.array(ranks, pa.int64())], [key, "rank"])

    kind = dict(texts.dtypes)[key]
    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, rank long")


def match_routes(texts: DataFrame, routes: DataFrame, key: str = "doc_id", most_bytes: int = 16 << 20) -> DataFrame:
    """``key, topic, kw``: the route of the longest keyword that a text holds, of several the first; texts without a hit
    have no row. Keywords are ranked, then looked up by an automaton of ``most_bytes`` of keywords at most; more of them go
    in several passes over the texts."""
    best = F.struct((-F.col("kw_len")).alias("l"), "route_ix", "kw_ix", "id")
    kws = materialise(global_rank(route_keywords(routes).groupBy("kw").agg(F.min(best).alias("b")), "rank", F.col("b").asc()).select("rank", "kw", F.col("b.id").alias("topic")), "keywords")
    passes = max(1, -(-(kws.agg(F.sum(F.octet_length("kw") + 64)).first()[0] or 0) // most_bytes))
    low = texts.select(key, F.lower(F.coalesce("text", F.lit(""))).alias("_t"))
    found = None
    for i in range(passes):
        words = [(r["rank"], r["kw"]) for r in kws.filter(F.pmod(F.xxhash64("kw"), F.lit(passes)) == i).select("rank", "kw").collect()]  # bounded by most_bytes
        if words:
            part = first_keywords(low, words, key, "_t")
            found = part if found is None else found.unionByName(part)
    if found is None:
        return texts.select(key, F.lit("").alias("topic"), F.lit("").alias("kw")).limit(0)
    return found.groupBy(key).agg(F.min("rank").alias("rank")).join(kws, "rank").select(key, "topic", "kw")


def project_link(matched: DataFrame, routes: DataFrame, key: str = "doc_id") -> DataFrame:
    return matched.join(F.broadcast(routes.select(F.col("id").alias("topic"), "title")), "topic").select(key, F.concat(F.lit("[["), F.coalesce(F.nullif("title", F.lit("")), "topic"), F.lit("]]")).alias("project"))


def profiles(routes: DataFrame) -> DataFrame:
    """``id, route_ix, profile``: what a route says of itself."""
    parts = ["title", "id", "folder", "description"]
    words = [F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ") for c in ("keywords", "learned_keywords")]
    return routes.select("id", "route_ix", F.array_join(F.filter(F.array(*(F.coalesce(p, F.lit("")) for p in parts), *words), lambda x: x != ""), " | ").alias("profile"))


def decisions(texts: DataFrame, routes: DataFrame, key: str = "doc_id", load: Callable | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """``key, topic, best, second, reason`` by cosine of a text's first 2000 characters and the profiles: assigned,
    below_threshold or weak_margin. ``load`` as in ``vectors.embed``. The vectors of topics are broadcast up to ``most_bytes``;
    more go in blocks of that size."""
    q = vectors.embed(texts.withColumn("text", F.left("text", F.lit(2000))), key, "text", load=load)
    p = vectors.embed(profiles(routes), "id", "profile", load=load).join(routes.select("id", "route_ix"), "id")
    p = materialise(p.select(F.col("id").alias("_topic"), "route_ix", F.col("embedding").alias("p")), "topics")
    blocks = max(1, -(-(p.agg(F.sum(F.size("p") * 8 + 64)).first()[0] or 0) // most_bytes))
    if blocks > 1:
        q = materialise(q, "texts")
    part = lambda i: F.broadcast(p.filter(F.pmod(F.xxhash64("_topic"), F.lit(blocks)) == i) if blocks > 1 else p)
    c = reduce(DataFrame.unionByName, (q.join(part(i)).select(key, "_topic", "route_ix", F.round(vectors.cosine("embedding", "p"), 6).alias("cosine")) for i in range(blocks)))
    top = c.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "route_ix", "_topic"))), 1, 2).alias("t"))
    best, second = -F.col("t")[0]["c"], F.greatest(F.lit(0.0), F.coalesce(-F.get(F.col("t"), F.lit(1))["c"], F.lit(0.0)))
    x = top.select(key, F.col("t")[0]["_topic"].alias("nearest"), best.alias("best"), second.alias("second"))
    reason = F.when(F.col("best") < ASSIGN, "below_threshold").when(F.round(F.col("best") - F.col("second"), 6) < MARGIN, "weak_margin").otherwise("assigned")
    return x.withColumn("reason", reason).withColumn("topic", F.when(F.col("reason") == "assigned", F.col("nearest"))).drop("nearest")


def accepted_votes(votes: DataFrame, made: DataFrame, routes: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, topic, confidence``: votes (key, raw JSON) that count: the embedding is middling, the id known, the
    confidence high enough. Confidences above 1 are per cent."""
    v = votes.withColumn("v", F.from_json(F.regexp_extract("raw", r"(?s)\{.*\}", 0), "id string, route string, topic string, confidence double, score double"))
    conf = F.coalesce("v.confidence", "v.score", F.lit(0.0))
    conf = F.when((conf > 1) & (conf <= 100), conf / 100).otherwise(conf)
    v = v.select(key, F.lower(strip(F.coalesce(F.nullif("v.id", F.lit("")), F.nullif("v.route", F.lit("")), "v.topic"))).alias("vid"), conf.alias("confidence"))
    middling = made.filter(F.col("reason").isin("below_threshold", "weak_margin") & (F.col("best") >= VOTE_FLOOR)).select(key)
    known = routes.select(F.lower("id").alias("vid"), F.col("id").alias("topic"))
    return v.filter(F.col("confidence") >= VOTE_CONFIDENCE).join(middling, key, "left_semi").join(F.broadcast(known), "vid").select(key, "topic", "confidence")


def cascade(texts: DataFrame, routes: DataFrame, votes: DataFrame | None = None, key: str = "doc_id", load: Callable | None = None) -> DataFrame:
    """``key, topic, how, score``: keyword, else embedding, else vote, else inbox. Only texts without a keyword are
    embedded; both results are written once."""
    kw = materialise(match_routes(texts, routes, key), "matched")
    rest = texts.join(kw.select(key), key, "left_anti")
    emb = materialise(decisions(rest, routes, key, load), "decided")
    out = kw.select(key, "topic", F.lit("keyword").alias("how"), F.lit(1.0).alias("score"))
    out = out.unionByName(emb.filter("topic is not null").select(key, "topic", F.lit("embed").alias("how"), F.col("best").alias("score")))
    left = emb.filter("topic is null").select(key)
    if votes is not None:
        v = accepted_votes(votes, emb, routes, key).filter(F.col("topic") != INBOX)
        out = out.unionByName(v.select(key, "topic", F.lit("llm").alias("how"), F.col("confidence").alias("score")))
        left = left.join(v.select(key), key, "left_anti")
    return out.unionByName(left.select(key, F.lit(INBOX).alias("topic"), F.lit("inbox").alias("how"), F.lit(0.0).alias("score")))


def stubs(chats: DataFrame, routed: DataFrame, routes: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, path, body``: the note that files a chat (title, date, token, link, prompt) under its topic."""
    x = chats.join(routed.select(key, "topic"), key).join(F.broadcast(routes.select(F.col("id").alias("topic"), F.col("title").alias("topic_title"), "folder")), "topic")
    excerpt = F.left(F.regexp_replace(strip(F.col("prompt")), r"\s+", " "), F.lit(280))
    path = F.concat("folder", F.lit("/AI Chat Links/"), "date", F.lit(" - "), "title", F.lit(" - "), "token", F.lit(".md"))
    body = F.concat(F.lit("# "), "title", F.lit("\n\nTopic: [["), "topic_title", F.lit("]]\nTranscript: [["), "link", F.lit("]]\n\n> "), excerpt, F.lit("\n"))
    return x.select(key, path.alias("path"), body.alias("body"))


def noisy(tok: Column) -> Column:
    plain = ~F.contains(tok, F.lit("-"))
    n = F.char_length(tok)
    mash = plain & (n >= 8) & ((F.regexp_count(tok, F.lit(EXTENSION)) >= 2) | tok.rlike(f".{EXTENSION}$") | tok.rlike(f".{EXTENSION}."))
    return tok.isin(*STOP, *WEAK) | tok.rlike("users|download|onedrive") | tok.rlike("^[0-9]+$") | ((n >= 14) & plain) | (n >= 24) | mash | ((n >= 6) & plain & ~tok.rlike("[aeiou]"))


def candidate_phrases(text: Column) -> Column:
    """Two neighbouring words that are left after stop and noisy words go; distinct in order, the first 25."""
    ws = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z][a-z0-9\-]{3,}"), F.lit(0)), lambda w: ~noisy(w))
    pairs = let(ws, lambda x: F.zip_with(x, F.slice(x, 2, F.greatest(F.size(x), F.lit(1))), lambda a, b: F.when(b.isNotNull() & (a != b), F.concat(a, F.lit(" "), b))))
    ok = F.filter(F.array_distinct(F.array_compact(pairs)), lambda p: ~p.isin(*BLOCKED) & F.char_length(p).between(7, 40))
    return F.slice(ok, 1, CANDIDATES)


def near_duplicate(a: Column, b: Column) -> Column:
    """Two phrases are equal, have the same words, are two edits apart, or share a place and are two edits apart in the
    other."""
    near = lambda x, y: F.levenshtein(x, y, 2).between(0, 2)
    sa, sb = F.split(a, " "), F.split(b, " ")
    w = lambda s, i: F.get(s, F.lit(i))
    two = (F.size(sa) == 2) & (F.size(sb) == 2)
    place = ((w(sa, 0) == w(sb, 0)) & near(w(sa, 1), w(sb, 1))) | ((w(sa, 1) == w(sb, 1)) & near(w(sa, 0), w(sb, 0)))
    return (a == b) | (F.array_sort(F.array_distinct(sa)) == F.array_sort(F.array_distinct(sb))) | ((F.abs(F.char_length(a) - F.char_length(b)) <= 2) & near(a, b)) | (two & place)


def _by_shape(phrases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The distinct phrases in a written table, those of them that are two words, and the others, if there are any."""
    p = materialise(phrases.select("phrase").distinct(), "distinct")
    two = F.col("phrase").rlike(alike.TWO)
    odd = p.filter(~two)
    return p, p.filter(two), odd if odd.limit(1).count() else None


def _odd_pairs(odd: DataFrame, every: DataFrame) -> DataFrame:
    x = near_duplicates(every, odd).filter("a <> b")
    return x.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicate_pairs(phrases: DataFrame) -> DataFrame:
    """``a, b`` (a < b) of near duplicates among distinct phrases of seven characters or more."""
    every, two, odd = _by_shape(phrases)
    x = alike.compared(two).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return x if odd is None else x.unionByName(_odd_pairs(odd, every))


def near_duplicates(phrases: DataFrame, others: DataFrame) -> DataFrame:
    """``a, b`` of each phrase and those of the ``others`` (both: phrase) that are near duplicates of it; phrases have seven
    characters or more, others any number and should be the fewer.

    They meet by keys that near duplicates must share: their words in order, or what is left of both when two characters at
    most go. Few phrases share such a rest, however many begin with one word. A shared word beside one two edits off is two
    edits in all, so it needs no key. The others' keys are broadcast up to 16 MB; else neither side is, as plans don't see how many
    rests a phrase has."""
    p, o = phrases.select("phrase").distinct(), others.select("phrase").distinct()
    most = (o.agg(F.sum(F.char_length("phrase") * F.char_length("phrase"))).first()[0] or 0) * ROW // 2
    side = _side(most)
    words = F.array_join(F.array_sort(F.array_distinct(F.split("phrase", " "))), " ")
    exact = p.select(F.col("phrase").alias("a"), words.alias("k")).join(side(o.select(F.col("phrase").alias("b"), words.alias("k"))), "k").select("a", "b")
    close = rests(p, "a").join(side(rests(o, "b")), "rest").select("a", "b")
    return exact.unionByName(close).distinct().filter(near_duplicate(F.col("a"), F.col("b")))


def _side(most: int) -> Callable[[DataFrame], DataFrame]:
    """How a table of ``most`` bytes is joined: by broadcast up to ``BROADCAST``, else in a shuffle, whatever a plan takes its size to be; a plan goes by
    compressed files, which unfold in the driver."""
    return F.broadcast if most <= BROADCAST else lambda df: df.hint("merge")


def rests(phrases: DataFrame, name: str) -> DataFrame:
    """``name, rest``: a hash of each string that a phrase becomes when none, one or two of its characters go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(0).to_pylist()
            for i in range(0, len(every), 256):
                whose, left = [], []
                for s in every[i : i + 256]:
                    one = {s[:j] + s[j + 1 :] for j in range(len(s))}
                    some = {s} | one | {t[:j] + t[j + 1 :] for t in one for j in range(len(t))}
                    left += some
                    whose += [s] * len(some)
                yield pa.RecordBatch.from_arrays([pa.array(whose, pa.string()), pa.array(left, pa.string())], [name, "rest"])

    return phrases.select("phrase").filter("phrase is not null").mapInArrow(run, f"{name} string, rest string").select(name, F.xxhash64("rest").alias("rest"))


def near_duplicate_counts(phrases: DataFrame) -> DataFrame:
    """``phrase, n_near`` of every distinct phrase: its near duplicates on both sides, 0 for none. Pairs are counted where they are found."""
    every, two, odd = _by_shape(phrases)
    n = every.withColumn("n", F.lit(0).cast("long")).unionByName(alike.compared(two, counts=True))
    if odd is not None:
        n = n.unionByName(_odd_pairs(odd, every).select(F.explode(F.array("a", "b")).alias("phrase"), F.lit(1).cast("long").alias("n")))
    return n.groupBy("phrase").agg(F.sum("n").alias("n_near"))


def learn(texts: DataFrame, routed: DataFrame, routes: DataFrame, key: str = "doc_id", most_rounds: int = 500) -> DataFrame:
    """``topic, phrase, rank``: phrases that chats, in order of ``key``, add to their topics: three a chat, each with a word
    of the topic's profile, no near duplicate of a keyword of any topic or of a phrase taken up before, the latest 40 a topic.

    Routes and profiles are those the batch began with."""
    sure = materialise(routed.filter((F.col("score") >= LEARN) & (F.col("topic") != INBOX)).select(F.col(key).alias("k"), "topic"), "sure")
    c = texts.select(F.col(key).alias("k"), F.posexplode(candidate_phrases(F.col("text"))).alias("pos", "phrase")).join(_side(sure.count() * ROW)(sure), "k")
    prof = profiles(routes).select(F.col("id").alias("topic"), F.regexp_extract_all(F.lower("profile"), F.lit(r"[a-z][a-z0-9\-]{3,}"), F.lit(0)).alias("tokens"))
    c = materialise(c.join(prof, "topic").filter(F.arrays_overlap(F.split("phrase", " "), "tokens")).drop("tokens"), "phrases")
    known = route_keywords(routes).unionByName(route_keywords(routes, "learned_keywords")).select(F.col("kw").alias("phrase"))
    near = materialise(near_duplicates(c, known).select(F.col("a").alias("phrase")).distinct(), "near")
    c = c.join(_side(near.count() * ROW)(near), "phrase", "left_anti")
    taken = in_order(c.select("k", "pos", "topic", "phrase"), most_rounds)
    return taken.withColumn("rank", F.row_number().over(W.partitionBy("topic").orderBy(F.desc("k"), F.desc("pos")))).filter(F.col("rank") <= PER_TOPIC).select("topic", "phrase", "rank")


def in_order(cands: DataFrame, most_rounds: int = 500) -> DataFrame:
    """The rows of ``cands`` (k, pos, topic, phrase) that are taken up when they are gone through by ``k`` and ``pos``: three a ``k``, and none
    that is a near duplicate of one taken before it.

    Rounds give what one row after the other would: a row goes once an alike one before it is taken or its ``k`` has its
    three; it is taken once no alike row before it is open and those open before it in its ``k`` can't use up the three. Each
    round decides the first open row at least, mostly nearly all; only open rows are read again."""
    c = materialise(cands, "candidates")
    both = near_duplicate_pairs(c).select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    same = c.select(F.col("phrase").alias("a"), F.col("phrase").alias("b")).distinct()
    alike = materialise(both.unionByName(same), "alike")
    at = F.struct("k", "pos")
    done, left, n = [], c.withColumn("had", F.lit(0)), c.count()
    some = _side(c.select("phrase").distinct().count() * ROW)
    for _ in range(most_rounds):
        few = _side(n * ROW)
        first = left.groupBy("phrase").agg(F.min(at).alias("first"))
        before = alike.join(few(first.withColumnRenamed("phrase", "b")), "b").groupBy("a").agg(F.min("first").alias("first")).withColumnRenamed("a", "phrase")
        w = W.partitionBy("k").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
        x = left.join(some(before), "phrase").withColumn("open", F.count("*").over(w))
        x = materialise(x.withColumn("take", (F.col("first") == at) & (F.col("had") + F.col("open") < PER_CHAT)).drop("open", "first"), "round")
        new = x.filter("take")
        done.append(new.select("k", "pos", "topic", "phrase"))
        # what the new ones close: alike rows after them, and the rest of a k that has its three before
        hit = alike.join(few(new.select(F.col("phrase").alias("a"), at.alias("taken"))), "a").groupBy("b").agg(F.min("taken").alias("taken")).withColumnRenamed("b", "phrase")
        x = x.join(some(hit), "phrase", "left").withColumn("now", F.coalesce(F.sum(F.col("take").cast("int")).over(W.partitionBy("k").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        x = x.withColumn("had", (F.col("had") + F.col("now")).cast("int")).filter(~F.col("take") & (F.col("taken").isNull() | (at < F.col("taken"))) & (F.col("had") < PER_CHAT))
        left = materialise(x.select("k", "pos", "topic", "phrase", "had"), "open")
        n = left.count()
        if not n:
            return reduce(DataFrame.unionByName, done)
    raise RuntimeError(f"phrases are still open after {most_rounds} rounds")
