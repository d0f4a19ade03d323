"""Queries of chat archives. Session lines are made from ``conversations`` in the three vendors' shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.operators import chats as c
from loam.plans.notes import STRIP
from loam.plans.registry import query
from loam.session import table
from loam.sources import corpus

N = f"WITH notes AS ({corpus.NOTES_SQL})"


def lines(spark, sf_dir, vendor: str):
    """One line a turn: vendor a alternates strings and part lists and adds thinking to every third assistant turn."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").cast("int").alias("line_no"), "role", F.coalesce("text", F.lit("")).alias("text"))
    stamp = F.concat(F.lit("2024-01-"), F.lpad((F.col("file") % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00.000Z"))
    part = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    thought = F.struct(F.lit("thinking").alias("type"), F.concat(F.lit("about "), F.col("line_no").cast("string")).alias("thinking"))
    as_parts = F.when((F.col("role") == "assistant") & (F.col("line_no") % 3 == 0), F.concat(F.lit("["), F.to_json(thought), F.lit(","), F.to_json(part), F.lit("]"))).otherwise(F.concat(F.lit("["), F.to_json(part), F.lit("]")))
    content = F.when(F.col("line_no") % 2 == 0, as_parts).otherwise(F.to_json(F.struct(F.col("text").alias("c"))).substr(F.lit(6), F.char_length(F.to_json(F.struct(F.col("text").alias("c")))) - 6))
    if vendor == "a":
        line = F.concat(F.lit('{"type":"'), "role", F.lit('","timestamp":"'), stamp, F.lit('","message":{"role":"'), "role", F.lit('","content":'), content, F.lit("}}"))
    elif vendor == "b":
        line = F.concat(F.lit('{"timestamp":"'), stamp, F.lit('","payload":{"type":"message","role":"'), "role", F.lit('","content":'), content, F.lit("}}"))
    else:
        said = F.when(F.col("role") == "user", F.concat(F.lit("<USER_REQUEST>\n"), "text", F.lit("\n</USER_REQUEST> more"))).otherwise(F.col("text"))
        kind = F.when(F.col("role") == "user", "USER_INPUT").when(F.col("role") == "assistant", "PLANNER_RESPONSE").otherwise("SYSTEM")
        line = F.to_json(F.struct(kind.alias("type"), said.alias("content"), F.when((F.col("role") == "assistant") & (F.col("line_no") % 3 == 0), F.concat(F.lit("about "), F.col("line_no").cast("string"))).alias("thinking"), stamp.alias("created_at")))
    return t.select("file", "line_no", line.alias("line"))


def turn_sql(thinking: str) -> str:
    return f"""WITH t AS (SELECT conv_id AS file, CAST(turn AS INT) AS line_no, role, {STRIP.format("coalesce(text, '')")} AS text, CASE
  WHEN role = 'assistant' AND {thinking} THEN concat('about ', CAST(turn AS VARCHAR)) ELSE '' END AS thinking FROM conversations
  WHERE role IN ('user', 'assistant'))"""


AB = turn_sql("turn % 6 = 0")


def turns(df):
    return df.select("file", "line_no", "role", F.md5("text").alias("text_md5"), "thinking")


KEPT = " SELECT file, line_no, role, md5(text) AS text_md5, thinking FROM t WHERE text <> '' OR thinking <> ''"


@query("c01_turns_a", AB + KEPT)
def c01(spark, sf_dir):
    return turns(c.turns_a(lines(spark, sf_dir, "a")))


@query("c02_turns_b", AB + KEPT)
def c02(spark, sf_dir):
    return turns(c.turns_b(lines(spark, sf_dir, "b")))


@query("c03_turns_c", turn_sql("turn % 3 = 0") + KEPT)
def c03(spark, sf_dir):
    return turns(c.turns_c(lines(spark, sf_dir, "c")))


@query("s03_session_lines", "SELECT conv_id AS file, count(*) AS n_lines FROM conversations GROUP BY conv_id")
def s03(spark, sf_dir):
    return lines(spark, sf_dir, "a").filter(F.from_json("line", "map<string,string>").isNotNull()).groupBy("file").agg(F.count("*").alias("n_lines"))


@query("c04_transcripts", f"""{AB}, l AS (SELECT *, lag(role) OVER (PARTITION BY file ORDER BY line_no) AS before FROM t WHERE text <> '' OR thinking <> ''),
  p AS (SELECT file, line_no, CASE WHEN role = 'user' THEN concat('## 👤 User', chr(10), chr(10), text, chr(10), chr(10))
  WHEN thinking <> '' THEN concat('## 🤖 Claude', chr(10), chr(10), '<details>', chr(10), '<summary>💭 View Thinking Process</summary>', chr(10), chr(10), thinking, chr(10), chr(10), '</details>', chr(10), chr(10),
  CASE WHEN text <> '' THEN concat(text, chr(10), chr(10)) ELSE '' END)
  ELSE concat(CASE WHEN before = 'assistant' THEN '' ELSE concat('## 🤖 Claude', chr(10), chr(10)) END, text, chr(10), chr(10)) END AS part FROM l)
  SELECT file, md5(string_agg(part, '' ORDER BY line_no)) AS body_md5 FROM p GROUP BY file""")
def c04(spark, sf_dir):
    return c.transcripts(c.turns_a(lines(spark, sf_dir, "a")), "Claude").select("file", F.md5("body").alias("body_md5"))


def heads(spark, sf_dir):
    x = lines(spark, sf_dir, "a")
    d = F.from_json("line", "type string, timestamp string, message struct<role:string,content:string>")
    text = c._parts(d["message"]["content"], ["text", "input_text"])
    prompt = F.when((d["type"] == "user") & ~text.rlike("local-command|<command-name>"), text)
    return c.session_heads(x, F.from_json("line", "map<string,string>"), d["timestamp"], prompt)


HEADS = """hd AS (SELECT file, concat('2024-01-', lpad(CAST(file % 28 + 1 AS VARCHAR), 2, '0')) AS date, arg_min(text, line_no) AS prompt FROM t WHERE role = 'user' AND text <> '' GROUP BY file)"""


@query("c05_session_heads", f"{AB}, {HEADS} SELECT file, date, prompt FROM hd")
def c05(spark, sf_dir):
    return heads(spark, sf_dir)


@query("c06_titles", f"""{AB}, {HEADS}
  SELECT file, coalesce(nullif(regexp_replace(left(array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(prompt, '<[^>]+>', '', 'g'), '[^a-zA-Z0-9\\s_\\-]', '', 'g'), '\\s+'), lambda x: x <> '')[1:6], ' '), 60), '\\s+$', ''), ''), 'Untitled Session') AS title
  FROM hd""")
def c06(spark, sf_dir):
    return heads(spark, sf_dir).select("file", c.clean_title(F.col("prompt")).alias("title"))


@query("c07_categories", f"""{AB}, {HEADS} SELECT file, CASE
  WHEN regexp_matches(lower(prompt), '{"|".join(c.SCHOOL)}') THEN 'School' WHEN regexp_matches(lower(prompt), '{"|".join(c.PERSONAL)}') THEN 'Personal' ELSE 'Coding' END AS category FROM hd""")
def c07(spark, sf_dir):
    return heads(spark, sf_dir).select("file", c.category(F.col("prompt")).alias("category"))


RAW = "CASE WHEN doc_id % 3 = 0 THEN concat(left(md5(CAST(doc_id AS STRING)), 8), '-', md5(CAST(doc_id AS STRING))) WHEN doc_id % 3 = 1 THEN 'zz-yy' ELSE '' END"


@query("c08_tokens", f"""{N} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN left(concat(left(md5(CAST(doc_id AS VARCHAR)), 8), md5(CAST(doc_id AS VARCHAR))), 12)
  WHEN doc_id % 3 = 1 THEN 'zzyy' ELSE 'unknown' END AS token FROM notes""")
def c08(spark, sf_dir):
    return corpus.notes(spark, sf_dir).select("doc_id", c.session_token(F.expr(RAW)).alias("token"))


def exports(spark, sf_dir):
    """Chats as exports (hand-written every 70 ids) and as sessions: tokens long, of six characters, or unknown."""
    n = corpus.notes(spark, sf_dir).filter("category = 'chat'")
    e = n.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "path", "mtime", (F.col("doc_id") % 70 != 0).alias("generated"))
    full = F.left(F.md5(F.col("doc_id").cast("string")), F.lit(12))
    s = n.select(F.when(F.col("doc_id") % 15 == 0, F.left(full, F.lit(6))).when(F.col("doc_id") % 25 == 0, F.lit("000000000000")).otherwise(full).alias("session_id"), (F.col("mtime") + F.col("doc_id") % 4).alias("mtime"))
    return e, s


SESS = f"""{N}, s AS (SELECT doc_id, CASE WHEN doc_id % 15 = 0 THEN left(md5(CAST(doc_id AS VARCHAR)), 6)
  WHEN doc_id % 25 = 0 THEN '000000000000' ELSE left(md5(CAST(doc_id AS VARCHAR)), 12) END AS session_id, mtime + doc_id % 4 AS mtime FROM notes
  WHERE category = 'chat'),
e AS (SELECT regexp_extract(path, '([^/]*)$', 1) AS name, path, mtime, doc_id % 70 <> 0 AS generated, regexp_extract(path, ' - ([A-Za-z0-9]{{4,64}})\\.md$', 1) AS fid FROM notes WHERE category = 'chat'),
m AS (SELECT DISTINCT session_id, name, path, e.mtime, generated FROM s JOIN e ON fid = session_id OR fid = left(session_id, 6) OR (length(session_id) >= 6 AND starts_with(fid, session_id)))"""


@query("c09_export_matches", f"{SESS} SELECT session_id, name FROM m")
def c09(spark, sf_dir):
    return c.export_matches(*exports(spark, sf_dir)).select("session_id", "name")


@query("c10_export_actions", f"""{SESS}, g AS (SELECT session_id, count(*) AS n, max(mtime) FILTER (generated) AS newest FROM m GROUP BY session_id)
  SELECT session_id, CASE WHEN n IS NULL THEN 'new' WHEN newest IS NULL OR s.mtime <= newest + 2 THEN 'skip' ELSE 'refresh' END AS action, count(*) AS n FROM s
  LEFT JOIN g USING (session_id) GROUP BY ALL""")
def c10(spark, sf_dir):
    e, s = exports(spark, sf_dir)
    return c.export_actions(s, c.export_matches(e, s)).groupBy("session_id", "action").agg(F.count("*").alias("n"))


@query("c11_chat_index", f"""{N},
  i AS (SELECT string_split(path, '/')[2] AS source, regexp_extract(path, '([^/]*)$', 1) AS name, path, mtime, string_split(path, '/')[3] AS cat FROM notes
  WHERE category = 'chat')
  SELECT source, row_number() OVER (PARTITION BY source ORDER BY left(name, 10) DESC, mtime DESC, path) AS pos,
  concat('| ', left(name, 10), ' | [[', replace(path, '.md', ''), '|', regexp_extract(name, '^\\d{{4}}-\\d{{2}}-\\d{{2}} - (.*) - [a-f0-9]+\\.md', 1), ']] | ', lower(cat), ' |  |') AS row FROM i""")
def c11(spark, sf_dir):
    return c.chat_index(corpus.notes(spark, sf_dir).filter("category = 'chat'").select("path", "mtime"))


@query("s04_sessions", f"""{N}, s AS (SELECT doc_id % 50 AS session_id, min(path) AS path, arg_min(mtime, path) AS mtime FROM notes GROUP BY 1)
  SELECT session_id, path, row_number() OVER (ORDER BY mtime DESC, path) AS pos FROM s""")
def s04(spark, sf_dir):
    f = corpus.notes(spark, sf_dir).select((F.col("doc_id") % 50).alias("session_id"), "path", "mtime")
    return corpus.newest_sessions(f).select("session_id", "path", "pos")


@query("f07_empty_chats", f"{N} SELECT path, category = 'chat' AND NOT contains(content, '## 👤 User') AS empty FROM notes")
def f07(spark, sf_dir):
    return corpus.notes(spark, sf_dir).select("path", c.header_only(F.col("content")).alias("empty"))


@query("c13_backfill", f"""{N}, r AS (SELECT path, CASE WHEN contains(lower(content), 'license') THEN 'licenses' ELSE 'other' END AS topic FROM notes
  WHERE category = 'chat' AND contains(content, '## 👤 User'))
  SELECT topic, count(*) AS n FROM r GROUP BY topic UNION ALL SELECT '*scanned', count(*) FROM notes WHERE category = 'chat' UNION ALL SELECT '*matched', count(*) FROM r""")
def c13(spark, sf_dir):
    n = corpus.notes(spark, sf_dir).filter("category = 'chat'")
    routed = n.filter(~c.header_only(F.col("content"))).select("path", F.when(F.contains(F.lower("content"), F.lit("license")), "licenses").otherwise("other").alias("topic"))
    return c.backfill_summary(n, routed)
