"""Queries of topic routing and keyword learning over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.operators import topics as t
from loam.plans.registry import query
from loam.session import texts

#: A rule table in the shape of the reference's: id, title, folder, description, keywords.
ROUTES = [
    ("licensing", "Licensing", "02 Projects/Licensing", "license notices and their terms", ["license", "licensed under", "general public license", "all rights reserved"]),
    ("manners", "Manners", "02 Projects/Manners", "rude words", ["idiot", "clown", "pathetic"]),
    ("german", "German", "03 School/German", "the articles der die das und ist", ["der", "und", "nicht"]),
    ("french", "French", "03 School/French", "le la les que dans pour avec", ["les", "que", "dans"]),
    ("secrets", "Secrets", "02 Projects/Secrets", "keys and tokens", ["token =", "api-key", "key"]),
    ("chat-inbox", "Chat Inbox", "02 Projects/Chat Inbox", "", []),
]


def routes(spark):
    rows = [(i, ti, fo, de, kw, [], ix) for ix, (i, ti, fo, de, kw) in enumerate(ROUTES)]
    return spark.createDataFrame(rows, "id string, title string, folder string, description string, keywords array<string>, learned_keywords array<string>, route_ix int")


def docs(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def hit(kw: str) -> str:
    if " " in kw or "-" in kw or len(kw) >= 5:
        return f"contains(lower(text), '{kw}')"
    return f"regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){kw}($|[^\\p{{L}}\\p{{N}}_])')"


MATCH = "k AS (" + " UNION ALL ".join(f"""SELECT doc_id, '{r[0]}' AS topic, '{kw}' AS kw, {ix} AS ix, {j} AS j FROM documents
  WHERE {hit(kw)}""" for ix, r in enumerate(ROUTES) for j, kw in enumerate(r[4])) + """),
  kw AS (SELECT doc_id, arg_min(topic, (-length(kw), ix, j)) AS topic, arg_min(kw, (-length(kw), ix, j)) AS kw FROM k GROUP BY doc_id)"""


@query("t01_keyword_route", f"WITH {MATCH} SELECT * FROM kw")
def t01(spark, sf_dir):
    return t.match_routes(docs(spark, sf_dir), routes(spark))


@query("c14_project_link", f"""WITH {MATCH} SELECT doc_id, concat('[[', CASE topic WHEN 'licensing' THEN 'Licensing' WHEN 'manners' THEN 'Manners'
  WHEN 'german' THEN 'German' WHEN 'french' THEN 'French' ELSE 'Secrets' END, ']]') AS project FROM kw""")
def c14(spark, sf_dir):
    return t.project_link(t.match_routes(docs(spark, sf_dir), routes(spark)), routes(spark))


PROFILE = "pr AS (" + " UNION ALL ".join(f"SELECT '{r[0]}' AS id, {ix} AS ix, '{' | '.join(x for x in (r[1], r[0], r[2], r[3], ' '.join(r[4])) if x)}' AS profile" for ix, r in enumerate(ROUTES)) + ")"
DECIDE = f"""{PROFILE}, src AS (SELECT CAST(doc_id AS VARCHAR) AS k, left(coalesce(text, ''), 2000) AS t FROM documents UNION ALL SELECT concat('p:', id), profile FROM pr),
sl AS (SELECT k, CAST(concat('0x', right(md5(w), 2)) AS INT) % 64 AS slot, CAST(count(*) AS DOUBLE) AS n
  FROM (SELECT k, unnest(regexp_extract_all(lower(t), '[a-z0-9_]+')) AS w FROM src) GROUP BY ALL),
nm AS (SELECT k, sqrt(sum(n * n)) AS norm FROM sl GROUP BY k), v AS (SELECT k, slot, n / norm AS n FROM sl JOIN nm USING (k)),
c AS (SELECT d.doc_id, p.id, p.ix, round(coalesce(s.c, 0), 6) AS cosine FROM documents d CROSS JOIN pr p LEFT JOIN (SELECT a.k, substr(b.k, 3) AS id,
  sum(a.n * b.n) AS c FROM v a JOIN v b USING (slot) WHERE NOT starts_with(a.k, 'p:') AND starts_with(b.k, 'p:')
  GROUP BY ALL) s ON s.k = CAST(d.doc_id AS VARCHAR) AND s.id = p.id),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, ix) AS n, lead(cosine) OVER (PARTITION BY doc_id ORDER BY cosine DESC, ix) AS second FROM c),
dec AS (SELECT doc_id, id, cosine AS best, second, CASE WHEN cosine < 0.5e0 THEN 'below_threshold'
  WHEN round(cosine - second, 6) < 0.04e0 THEN 'weak_margin' ELSE 'assigned' END AS reason FROM r WHERE n = 1)"""


@query("t02_profiles", f"WITH {PROFILE} SELECT id, ix AS route_ix, profile, (SELECT count(*) FROM documents WHERE contains(text, id)) AS n_docs FROM pr")
def t02(spark, sf_dir):
    p = t.profiles(routes(spark))
    hits = docs(spark, sf_dir).join(F.broadcast(p), F.contains("text", F.col("id"))).groupBy("id").agg(F.count("*").alias("n_docs"))
    return p.join(hits, "id", "left").select("id", "route_ix", "profile", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


@query("t03_embedding_decision", f"WITH {DECIDE} SELECT doc_id, reason, CASE WHEN reason = 'assigned' THEN id END AS topic, best, second FROM dec")
def t03(spark, sf_dir):
    return t.decisions(docs(spark, sf_dir), routes(spark)).select("doc_id", "reason", "topic", "best", "second")


def votes(spark, sf_dir):
    """Votes as a model would give them: some unsure, in per cent, or of unknown topics."""
    raw = F.concat(F.lit('Sure: {"id": "'), F.when(F.col("doc_id") % 4 == 0, "Manners").when(F.col("doc_id") % 4 == 1, "secrets").when(F.col("doc_id") % 4 == 2, "nowhere").otherwise("german"), F.lit('", "confidence": '), F.when(F.col("doc_id") % 3 == 0, "90").when(F.col("doc_id") % 3 == 1, "0.8").otherwise("0.5"), F.lit("}"))
    return docs(spark, sf_dir).select("doc_id", raw.alias("raw"))


VOTED = """vt AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'manners' WHEN 1 THEN 'secrets' ELSE 'german' END AS topic, CASE doc_id % 3
  WHEN 0 THEN 0.9e0 ELSE 0.8e0 END AS confidence FROM dec WHERE reason <> 'assigned' AND best >= 0.35e0 AND doc_id % 4 <> 2 AND doc_id % 3 <> 2)"""


@query("t04_votes", f"WITH {DECIDE}, {VOTED} SELECT * FROM vt")
def t04(spark, sf_dir):
    d = docs(spark, sf_dir)
    return t.accepted_votes(votes(spark, sf_dir), t.decisions(d, routes(spark)), routes(spark))


CASCADE = f"""{MATCH}, {DECIDE}, {VOTED}, cs AS (SELECT doc_id, coalesce(kw.topic, CASE WHEN reason = 'assigned' THEN dec.id END, vt.topic, 'chat-inbox') AS topic,
  CASE WHEN kw.topic IS NOT NULL THEN 'keyword' WHEN reason = 'assigned' THEN 'embed' WHEN vt.topic IS NOT NULL THEN 'llm' ELSE 'inbox' END AS how,
  CASE WHEN kw.topic IS NOT NULL THEN 1.0e0 WHEN reason = 'assigned' THEN best WHEN vt.topic IS NOT NULL THEN confidence ELSE 0.0e0 END AS score FROM documents
  LEFT JOIN kw USING (doc_id) JOIN dec USING (doc_id) LEFT JOIN vt USING (doc_id))"""


@query("t05_cascade", f"WITH {CASCADE} SELECT * FROM cs")
def t05(spark, sf_dir):
    return t.cascade(docs(spark, sf_dir), routes(spark), votes(spark, sf_dir))


NAMES = " ".join(f"WHEN '{r[0]}' THEN '{r[1]}'" for r in ROUTES)
STUBS = f"""SELECT doc_id,
  concat(CASE topic {' '.join(f"WHEN '{r[0]}' THEN '{r[2]}'" for r in ROUTES)} END, '/AI Chat Links/2024-01-01 - Chat ', CAST(doc_id AS VARCHAR), ' - ', left(md5(CAST(doc_id AS VARCHAR)), 12), '.md') AS path,
  concat('# Chat ', CAST(doc_id AS VARCHAR), chr(10), chr(10), 'Topic: [[', CASE topic {NAMES} END, ']]', chr(10), 'Transcript: [[05 AI Chats/x]]', chr(10), chr(10), '> ', left(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), 280), chr(10)) AS body
  FROM kw JOIN documents USING (doc_id)"""


@query("t06_stubs", f"WITH {MATCH} {STUBS}")
def t06(spark, sf_dir):
    d = docs(spark, sf_dir)
    chats = d.select("doc_id", F.concat(F.lit("Chat "), F.col("doc_id").cast("string")).alias("title"), F.lit("2024-01-01").alias("date"), F.left(F.md5(F.col("doc_id").cast("string")), F.lit(12)).alias("token"), F.lit("05 AI Chats/x").alias("link"), F.col("text").alias("prompt"))
    return t.stubs(chats, t.match_routes(d, routes(spark)), routes(spark))


NOISY = f"""(tok IN ({', '.join(f"'{x}'" for x in t.STOP + t.WEAK)}) OR regexp_matches(tok, 'users|download|onedrive') OR (length(tok) >= 14 AND NOT contains(tok, '-')) OR length(tok) >= 24
  OR (NOT contains(tok, '-') AND length(tok) >= 8 AND (len(regexp_extract_all(tok, '{t.EXTENSION}')) >= 2 OR regexp_matches(tok, '.{t.EXTENSION}$') OR regexp_matches(tok, '.{t.EXTENSION}.')))
  OR (length(tok) >= 6 AND NOT contains(tok, '-') AND NOT regexp_matches(tok, '[aeiou]')))"""
PHRASES = f"""tk AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS tok FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9\\-]{{3,}}') AS l FROM documents)),
kp AS (SELECT doc_id, i, tok, lead(tok) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM tk WHERE NOT {NOISY}),
ph AS (SELECT doc_id, concat(tok, ' ', nx) AS phrase, min(i) AS i FROM kp WHERE nx IS NOT NULL AND tok <> nx GROUP BY 1, 2),
cd AS (SELECT doc_id, phrase, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM ph
  WHERE phrase NOT IN ({', '.join(f"'{x}'" for x in t.BLOCKED)}) AND length(phrase) BETWEEN 7 AND 40)"""


@query("t07_candidates", f"WITH {PHRASES} SELECT doc_id, CAST(pos AS INT) AS pos, phrase FROM cd WHERE pos < {t.CANDIDATES}")
def t07(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(t.candidate_phrases(F.col("text"))).alias("pos", "phrase"))


@query("t08_noise", f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9\\-]{{3,}}')) AS tok FROM documents) SELECT tok FROM w WHERE {NOISY}")
def t08(spark, sf_dir):
    w = docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z][a-z0-9\-]{3,}"), F.lit(0))).alias("tok")).distinct()
    return w.filter(t.noisy(F.col("tok")))


@query("t09_near_duplicates")
def t09(spark, sf_dir):
    return t.near_duplicate_counts(docs(spark, sf_dir).select(F.explode_outer(t.candidate_phrases(F.col("text"))).alias("phrase")).filter("phrase is not null"))


#: Whether phrase and keyword are near duplicates.
ALIKE = """(phrase = kw OR list_sort(list_distinct(string_split(phrase, ' '))) = list_sort(list_distinct(string_split(kw, ' '))) OR (abs(length(phrase) - length(kw)) <= 2 AND levenshtein(phrase, kw) <= 2)
  OR (len(string_split(phrase, ' ')) = 2 AND len(string_split(kw, ' ')) = 2 AND ((split_part(phrase, ' ', 1) = split_part(kw, ' ', 1) AND levenshtein(split_part(phrase, ' ', 2), split_part(kw, ' ', 2)) <= 2)
  OR (split_part(phrase, ' ', 2) = split_part(kw, ' ', 2) AND levenshtein(split_part(phrase, ' ', 1), split_part(kw, ' ', 1)) <= 2))))"""
KEYWORDS = ", ".join(f"('{kw}')" for r in ROUTES for kw in r[4])


@query("t10_learned", f"""WITH RECURSIVE {MATCH}, {DECIDE}, {PHRASES}, cs AS (SELECT doc_id, coalesce(kw.topic, CASE
  WHEN reason = 'assigned' THEN dec.id END, 'chat-inbox') AS topic, CASE WHEN kw.topic IS NOT NULL THEN 1.0e0
  WHEN reason = 'assigned' THEN best ELSE 0.0e0 END AS score
  FROM documents LEFT JOIN kw USING (doc_id) JOIN dec USING (doc_id)), sure AS (SELECT * FROM cs WHERE score >= {t.LEARN}e0 AND topic <> 'chat-inbox'),
  tokens AS (SELECT id AS topic, regexp_extract_all(lower(profile), '[a-z][a-z0-9\\-]{{3,}}') AS tk FROM pr),
  own AS (SELECT doc_id, topic, phrase, pos FROM cd JOIN sure USING (doc_id) JOIN tokens USING (topic)
  WHERE pos < {t.CANDIDATES} AND list_has_any(string_split(phrase, ' '), tk)), known AS (SELECT * FROM (VALUES {KEYWORDS}) v(kw)),
  fresh AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) AS i FROM own WHERE NOT EXISTS (SELECT 1 FROM known WHERE {ALIKE})),
  go AS (
    SELECT 0::BIGINT AS i, -1::BIGINT AS k, 0 AS n, []::VARCHAR[] AS kept, NULL::VARCHAR AS topic, NULL::VARCHAR AS phrase, false AS take
    UNION ALL
    SELECT i, k, CASE WHEN take THEN n + 1 ELSE n END, CASE WHEN take THEN list_append(kept, phrase) ELSE kept END, topic, phrase, take FROM (
      SELECT f.i, f.doc_id AS k, CASE WHEN f.doc_id = g.k THEN g.n ELSE 0 END AS n, g.kept, f.topic, f.phrase,
        CASE WHEN f.doc_id = g.k THEN g.n ELSE 0 END < {t.PER_CHAT} AND len(list_filter(g.kept, lambda kw: {ALIKE.replace("phrase", "f.phrase")})) = 0 AS take
      FROM go g JOIN fresh f ON f.i = g.i + 1) z),
  rk AS (SELECT topic, phrase, row_number() OVER (PARTITION BY topic ORDER BY i DESC) AS rank FROM go WHERE take)
  SELECT topic, phrase, rank FROM rk WHERE rank <= {t.PER_TOPIC}""")
def t10(spark, sf_dir):
    d = docs(spark, sf_dir)
    return t.learn(d, t.cascade(d, routes(spark)), routes(spark))
