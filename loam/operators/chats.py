"""Chat archives: turns of three vendors' session lines, transcripts, titles, session ids and export decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions.markdown import strip
from loam.functions.ranking import grouped_rank

#: Words that make a session School, then Personal; all others are Coding.
SCHOOL = ["essay", "thesis", "slave trade", "grading", "class", "homework", "math"]
PERSONAL = ["subscription", "charge", "refund", "law", "progressive", "weed", "tiktok"]
SESSION_ID, LEGACY_ID, SLACK = 12, 6, 2.0
PART = "array<struct<type:string,text:string,thinking:string>>"


def _parts(content: Column, kinds: list[str], field: str = "text", image: str | None = None) -> Column:
    """Text of a content that is a string or a JSON array of parts, joined by line feeds."""
    parts = F.from_json(content, PART)
    is_list = F.ltrim(content).startswith("[") & parts.isNotNull()
    text = lambda p: F.when(p["type"].isin(*kinds), F.coalesce(p[field], F.lit("")))
    pick = (lambda p: F.coalesce(text(p), F.when(p["type"] == "image", F.lit(image)))) if image else text
    joined = F.array_join(F.array_compact(F.transform(parts, pick)), "\n")
    plain = content if field == "text" else F.lit("")
    return strip(F.when(is_list, joined).otherwise(F.coalesce(plain, F.lit(""))))


def turns_a(lines: DataFrame) -> DataFrame:
    """``file, line_no, role, text, thinking`` of lines {type, message{role, content}}; lines that aren't JSON are skipped,
    user turns that a tool wrote too."""
    x = lines.withColumn("d", F.from_json("line", "type string, message struct<role:string,content:string>")).filter("d.type = d.message.role")
    user, c = F.col("d.type") == "user", F.col("d.message.content")
    text = F.when(user, _parts(c, ["text", "input_text"], image="*[Embedded Image]*")).otherwise(_parts(c, ["text"]))
    x = x.filter(F.col("d.type").isin("user", "assistant")).select("file", "line_no", F.col("d.type").alias("role"), text.alias("text"), F.when(user, "").otherwise(_parts(c, ["thinking"], "thinking")).alias("thinking"))
    # fixed values: marks of what a tool wrote
    tool = (F.col("role") == "user") & F.col("text").rlike("local-command-caveat|<command-name>|<task-notification>")
    return x.filter(~tool & ((F.col("text") != "") | (F.col("thinking") != "")))


def turns_b(lines: DataFrame) -> DataFrame:
    """The same of lines {payload{type: message, role, content}}; environment blocks are dropped."""
    x = lines.withColumn("p", F.from_json("line", "payload struct<type:string,role:string,content:string>")["payload"]).filter("p.type = 'message' and p.role in ('user', 'assistant') and p.content <> ''")
    c = F.col("p.content")
    x = x.select("file", "line_no", F.col("p.role").alias("role"), _parts(c, ["text", "input_text"]).alias("text"), F.when(F.col("p.role") == "user", "").otherwise(_parts(c, ["thinking"], "thinking")).alias("thinking"))
    # fixed values: marks of environment blocks
    return x.filter(~F.col("text").rlike("environment_context|local-command-caveat") & ((F.col("text") != "") | (F.col("thinking") != "")))


def turns_c(lines: DataFrame) -> DataFrame:
    """The same of lines {type, source, content, thinking}; a user's request may stand in a tag."""
    x = lines.withColumn("d", F.from_json("line", "type string, source string, content string, thinking string")).filter("d is not null")
    user = F.coalesce((F.col("d.type") == "USER_INPUT") | (F.col("d.source") == "USER_EXPLICIT"), F.lit(False))
    model = F.coalesce((F.col("d.type") == "PLANNER_RESPONSE") | (F.col("d.source") == "MODEL"), F.lit(False))
    tag = r"(?s)<USER_REQUEST>\n?(.*?)\n?</USER_REQUEST>"
    c = F.coalesce("d.content", F.lit(""))
    text = strip(F.when(user & c.rlike(tag), F.regexp_extract(c, tag, 1)).otherwise(c))
    x = x.filter(user | model).select("file", "line_no", F.when(user, "user").otherwise("assistant").alias("role"), text.alias("text"), F.when(user, "").otherwise(strip(F.coalesce("d.thinking", F.lit("")))).alias("thinking"))
    return x.filter("text <> '' or thinking <> ''")


def transcripts(turns: DataFrame, vendor: str, key: str = "file", order: str = "line_no") -> DataFrame:
    """``key, body``: consecutive assistant turns share a heading; user turns and thinking always print one."""
    before = F.lag("role").over(W.partitionBy(key).orderBy(order))
    # fixed values: headings of a transcript
    head = f"## 🤖 {vendor}\n\n"
    think = F.concat(F.lit(head + "<details>\n<summary>💭 View Thinking Process</summary>\n\n"), "thinking", F.lit("\n\n</details>\n\n"), F.when(F.col("text") != "", F.concat("text", F.lit("\n\n"))).otherwise(""))
    said = F.concat(F.when(before == "assistant", "").otherwise(head), "text", F.lit("\n\n"))
    part = F.when(F.col("role") == "user", F.concat(F.lit("## 👤 User\n\n"), "text", F.lit("\n\n"))).when(F.col("thinking") != "", think).otherwise(said)
    x = turns.filter(F.col("role").isin("user", "assistant")).select(key, order, part.alias("part"))
    return x.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "part"))), lambda p: p["part"]), "").alias("body"))


def session_heads(lines: DataFrame, parsed: Column, stamp: Column, prompt: Column, default: str = "2026-07-14") -> DataFrame:
    """``file, date, prompt``: the first time and the first usable prompt before a line that can't be parsed; sessions
    without a prompt go."""
    x = lines.select("file", "line_no", parsed.isNull().alias("bad"), stamp.alias("stamp"), prompt.alias("prompt"))
    stop = x.filter("bad").groupBy("file").agg(F.min("line_no").alias("stop"))
    x = x.join(stop, "file", "left").filter("stop is null or line_no < stop")
    h = x.groupBy("file").agg(F.min_by("stamp", F.when(F.col("stamp").isNotNull(), F.col("line_no"))).alias("stamp"), F.min_by("prompt", F.when(F.col("prompt") != "", F.col("line_no"))).alias("prompt"))
    return h.filter("prompt <> ''").select("file", F.coalesce(F.date_format(F.try_to_timestamp("stamp"), "yyyy-MM-dd"), F.lit(default)).alias("date"), "prompt")


def clean_title(text: Column, fallback: str = "Untitled Session") -> Column:
    t = F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"[^a-zA-Z0-9\s_\-]", "")
    w = F.slice(F.filter(F.split(t, r"\s+"), lambda x: x != ""), 1, 6)
    return F.coalesce(F.nullif(F.regexp_replace(F.left(F.array_join(w, " "), F.lit(60)), r"\s+$", ""), F.lit("")), F.lit(fallback))


def category(prompt: Column) -> Column:
    low = F.lower(prompt)
    return F.when(low.rlike("|".join(SCHOOL)), "School").when(low.rlike("|".join(PERSONAL)), "Personal").otherwise("Coding")


def session_token(raw: Column, length: int = SESSION_ID) -> Column:
    hexed = F.left(F.regexp_replace(F.coalesce(raw, F.lit("")), "[^0-9a-fA-F]", ""), F.lit(length))
    plain = F.left(F.regexp_replace(F.coalesce(raw, F.lit("")), "[^A-Za-z0-9]", ""), F.lit(length))
    return F.lower(F.coalesce(F.nullif(hexed, F.lit("")), F.nullif(plain, F.lit("")), F.lit("unknown")))


FILE_ID = r"(?i) - ([A-Za-z0-9]{4,64})\.md$"


def export_matches(exports: DataFrame, sessions: DataFrame) -> DataFrame:
    """``session_id, name, path, mtime, generated``: exports whose file name ends in the session's id, its first six
    characters, or an id that begins with it; names without an id match if they hold one of these.

    Names with an id meet sessions by the id's first characters, others by every run of up to six of theirs."""
    e = exports.withColumn("fid", F.lower(F.regexp_extract("name", FILE_ID, 1)))
    s = sessions.select("session_id").filter("session_id <> ''").distinct().withColumn("legacy", F.left("session_id", F.lit(LEGACY_ID)))
    with_id = e.filter("fid <> ''").withColumn("k", F.left("fid", F.lit(LEGACY_ID)))
    long = (F.col("fid") == F.col("session_id")) | (F.col("fid") == F.col("legacy")) | ((F.length("session_id") >= LEGACY_ID) & F.startswith(F.col("fid"), F.col("session_id")))
    a = with_id.join(s.withColumnRenamed("legacy", "k"), "k").withColumn("legacy", F.col("k")).filter(long)
    short = with_id.join(s.filter(F.length("session_id") < LEGACY_ID), F.col("fid") == F.col("session_id"))
    low = F.lower("name")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(LEGACY_ID)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(low) - n + 1, F.lit(1))), lambda i: F.substr(low, i, n))))
    b = e.filter("fid = ''").withColumn("legacy", F.explode(F.array_distinct(grams))).join(s, "legacy")
    cols = ["session_id", "name", "path", "mtime", "generated"]
    return a.select(*cols).unionByName(short.select(*cols)).unionByName(b.select(*cols)).distinct()


def export_actions(sessions: DataFrame, matches: DataFrame) -> DataFrame:
    """``session_id, action, path``: new without a match; skip if only hand-written notes match or the newest generated one
    is no more than two seconds older; else refresh that one."""
    g = F.when(F.col("generated"), F.struct("mtime", "path"))
    m = matches.groupBy("session_id").agg(F.count("*").alias("n"), F.max(g).alias("newest"))
    x = sessions.select("session_id", F.col("mtime").alias("src")).join(m, "session_id", "left")
    action = F.when(F.col("n").isNull(), "new").when(F.col("newest").isNull() | (F.col("src") <= F.col("newest.mtime") + SLACK), "skip").otherwise("refresh")
    return x.select("session_id", action.alias("action"), F.when(action == "refresh", F.col("newest.path")).alias("path"))


CHAT_NAME = r"^(\d{4}-\d{2}-\d{2}) - (.*) - ([a-f0-9]+)\.md"


def chat_index(chats: DataFrame, project: Column | None = None) -> DataFrame:
    """``source, pos, row``: index rows of chats (path, mtime) from their names, by date and time, newest first."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    part = lambda i: F.regexp_extract(name, CHAT_NAME, i)
    dirs = F.split("path", "/")
    x = chats.filter(name.rlike(CHAT_NAME) & F.get(dirs, F.lit(2)).isin("Coding", "School", "Personal", "General"))
    link = F.concat(F.lit("[["), F.regexp_replace("path", r"\.md$", ""), F.lit("|"), part(2), F.lit("]]"))
    row = F.concat_ws(" | ", F.concat(F.lit("| "), part(1)), link, F.lower(F.get(dirs, F.lit(2))), F.concat(project if project is not None else F.lit(""), F.lit(" |")))
    x = x.select(F.get(dirs, F.lit(1)).alias("source"), part(1).alias("date"), "mtime", "path", row.alias("row"))
    return grouped_rank(x, "pos", ["source"], F.desc("date"), F.desc("mtime"), F.col("path")).select("source", "pos", "row")


def header_only(content: Column) -> Column:
    """Blank, or a generated transcript without a user turn after its header; hand-written files never."""
    after = F.regexp_replace(content, r"(?s)\A.*?---", "")
    return F.when(~content.rlike(r"\S"), True).when(~F.regexp_replace(content, r"^\s+", "").startswith("# Chat Transcript:"), False).otherwise(~F.contains(after, F.lit("## 👤 User")))


def backfill_summary(chats: DataFrame, routed: DataFrame) -> DataFrame:
    """``topic, n``: routed chats (path, topic) by topic, most first; rows of scanned and matched counts under ``*``."""
    per = routed.groupBy("topic").agg(F.count("*").alias("n"))
    total = chats.agg(F.lit("*scanned").alias("topic"), F.count("*").alias("n")).unionByName(routed.agg(F.lit("*matched").alias("topic"), F.count("*").alias("n")))
    return per.unionByName(total).orderBy(F.desc("n"), "topic")
