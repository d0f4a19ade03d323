"""Sources: note files, chat session lines, question sets, and the notes that stand for a vault in tests and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.ranking import global_rank
from loam.operators.maintenance import status
from loam.session import materialise, texts

#: Path components that scans leave out; a component that starts with a full stop is left out always.
EXCLUDED = ("Templates", "Attachments", "node_modules", "dist", "build", "venv")

#: Notes, chats, links and tags made from ``documents``; valid in Spark and DuckDB alike.
NOTES_SQL = """
SELECT doc_id, path, title, category, mtime, content FROM (
SELECT doc_id, title, category, mtime,
  CASE WHEN category = 'chat'
       THEN concat('05 AI Chats/', ai, '/', sect, '/', title, '.md')
       ELSE concat(folder, '/', title, '.md') END AS path,
  CASE WHEN category = 'chat' AND doc_id % 35 = 0
       THEN concat('# Chat Transcript: ', title, chr(10), chr(10), '---', chr(10), chr(10))
       WHEN category = 'chat'
       THEN concat('# Chat Transcript: ', title, chr(10), chr(10), '---', chr(10), chr(10), '## 👤 User', chr(10), chr(10), text, chr(10))
       ELSE concat(
         CASE WHEN doc_id % 4 = 0 THEN concat('---', chr(10), 'tags: [', lang, ', ', source, ']', chr(10), '---', chr(10)) ELSE '' END,
         '# ', title, chr(10), text, chr(10), '## Links', chr(10),
         'See [[Note ', CAST(doc_id + 1 + doc_id % 7 AS STRING), ']] and [[Note ', CAST(doc_id * 3 % 97 AS STRING), '#Part|alias]]',
         CASE WHEN doc_id % 11 = 0 THEN concat(' [[Missing ', CAST(doc_id AS STRING), ']] [[#Links]]') ELSE '' END,
         CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), '#topic-', CAST(doc_id % 5 AS STRING)) ELSE '' END, chr(10)) END AS content
FROM (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CASE WHEN doc_id % 5 = 0 THEN 'chat' ELSE 'note' END AS category,
  CASE WHEN doc_id % 5 = 0
       THEN concat('2024-01-', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0'), ' - Chat ', CAST(doc_id AS STRING), ' - ', substr(md5(CAST(doc_id AS STRING)), 1, 12))
       WHEN doc_id % 13 = 0 THEN concat('Home ', CAST(doc_id AS STRING))
       ELSE concat('Note ', CAST(doc_id AS STRING)) END AS title,
  CASE doc_id % 3 WHEN 0 THEN 'Claude' WHEN 1 THEN 'Codex' ELSE 'Gemini' END AS ai,
  CASE doc_id % 4 WHEN 0 THEN 'Coding' WHEN 1 THEN 'School' WHEN 2 THEN 'Personal' ELSE 'General' END AS sect,
  CASE doc_id % 6 WHEN 0 THEN '02 Projects/Alpha' WHEN 1 THEN '02 Projects/Beta' WHEN 2 THEN '03 School/CS/Week 1' WHEN 3 THEN '02 Projects/Alpha/AI Chat Links' WHEN 4 THEN '00 Home' ELSE '01 Journal' END AS folder,
  CAST(1704067200 + (doc_id * 7919) % 2592000 AS DOUBLE) AS mtime
 FROM documents) a ) b
"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, path, title, category, mtime, content``: one note or chat for each document."""
    return spark.sql(NOTES_SQL.replace("FROM documents)", "FROM {documents})"), documents=texts(spark, sf_dir))


def later_notes(df: DataFrame) -> DataFrame:
    """A later state of ``notes``: every 17th is gone, every 10th from the third on has a newer time."""
    return df.filter("doc_id % 17 <> 0").withColumn("mtime", F.expr("CASE WHEN doc_id % 10 = 3 THEN mtime + 60.0e0 ELSE mtime END"))


LATER_SQL = "SELECT doc_id, path, title, category, CASE WHEN doc_id % 10 = 3 THEN mtime + 60.0e0 ELSE mtime END AS mtime, content FROM notes WHERE doc_id % 17 <> 0"


def basename(path: Column | str) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def eligible(path: Column, exclude: tuple[str, ...] = EXCLUDED, keep_index: bool = False) -> Column:
    """Whether a file is a note: ``.md``, no index or report by name, no excluded or hidden component."""
    parts = F.split(path, "/")
    name = basename(path)
    ok = name.endswith(".md") & ~F.exists(parts, lambda p: p.isin(*exclude) | p.startswith("."))
    return ok if keep_index else ok & ~name.contains("Index.md") & (name != "Vault Health Report.md")


def _listed(files: DataFrame, root: str, exclude: tuple[str, ...], keep_index: bool) -> DataFrame:
    """Eligible rows of note files, their paths below ``root``."""
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z][a-z0-9+.-]*:/*(?=/)", ""), r"^/*\Q" + base.lstrip("/") + r"\E/", "")
    return files.withColumn("path", path).filter(eligible(F.col("path"), exclude, keep_index)).withColumn("mtime", F.unix_micros("modificationTime") / 1e6)


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)


def _contents(listed: DataFrame) -> DataFrame:
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"\r\n?", "\n")
    return listed.select("path", *note_attributes(F.col("path")), "mtime", text.alias("content"))


def scan_notes(spark: SparkSession, root: str, exclude: tuple[str, ...] = EXCLUDED, keep_index: bool = False) -> DataFrame:
    """``path, title, category, mtime, content`` of every eligible file below ``root``; line ends become line feeds.

    Names are judged before contents are read."""
    return _contents(_listed(_files(spark, root), root, exclude, keep_index))


def list_notes(spark: SparkSession, root: str, exclude: tuple[str, ...] = EXCLUDED, keep_index: bool = False) -> DataFrame:
    """``path, title, category, mtime`` of every eligible file below ``root``: names and times, no content is read."""
    return _listed(_files(spark, root), root, exclude, keep_index).select("path", *note_attributes(F.col("path")), "mtime")


def scan_changed(spark: SparkSession, root: str, indexed: DataFrame, exclude: tuple[str, ...] = EXCLUDED, keep_index: bool = False) -> tuple[DataFrame, DataFrame]:
    """``source, status`` of all files below ``root`` against ``indexed`` (source, mtime), and the notes that are new or changed.

    The first phase joins names and times. The second reads the new and changed files alone: their names prune the listing,
    which the driver holds for any scan, so no other file is opened."""
    files = _files(spark, root).select("path", "modificationTime", F.col("_metadata.file_path").alias("file"))
    listed = materialise(_listed(files, root, exclude, keep_index).select("path", "mtime", "file"), "listing")
    states = materialise(status(listed.select("path", "mtime"), indexed), "states")
    fresh = listed.join(states.filter("status in ('new', 'changed')").select(F.col("source").alias("path")), "path", "left_semi")
    names = [r["file"] for r in fresh.select("file").collect()]
    return states, _contents(_listed(_files(spark, root).filter(F.col("_metadata.file_path").isin(names)), root, exclude, keep_index))


def note_attributes(path: Column) -> list[Column]:
    """Title (file name without its extension) and category (chat below the chat folder, else note)."""
    return [F.regexp_replace(basename(path), r"\.[^.]*$", "").alias("title"), F.when(path.contains("05 AI Chats"), "chat").otherwise("note").alias("category")]


def newest_sessions(files: DataFrame) -> DataFrame:
    """One row a session id of ``files`` (session_id, path, mtime): the first path wins; newest first by ``pos``."""
    one = files.groupBy("session_id").agg(F.min_by(F.struct("path", "mtime"), "path").alias("f")).select("session_id", "f.*")
    return global_rank(one, "pos", F.col("mtime").desc(), F.col("path").asc())


CASE_FIELDS = "question string, expected_sources array<string>, scope string"


def eval_cases(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid cases and rejects (line_no, reason) of ``lines`` (line_no, line): JSON objects with a question and a list of
    expected sources that aren't blank, and a known scope. Blank lines are skipped."""
    some = lines.filter(F.col("line").rlike(r"\S"))
    raw = F.from_json("line", "map<string,string>")
    p = some.withColumn("raw", raw).withColumn("c", F.from_json("line", CASE_FIELDS))
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    q, src = trimmed(F.col("c.question")), F.transform("c.expected_sources", trimmed)
    reason = (
        F.when(F.col("raw").isNull() | ~F.ltrim("line").startswith("{"), "not a JSON object")
        .when(F.coalesce(q, F.lit("")) == "", "question is missing or blank")
        .when(F.col("c.expected_sources").isNull() | (F.size("c.expected_sources") == 0), "expected_sources is missing or empty")
        .when(F.exists(src, lambda s: F.coalesce(s, F.lit("")) == ""), "an expected source is blank")
        .when(~F.coalesce("c.scope", F.lit("notes")).isin("notes", "chats", "all"), "unknown scope")
    )
    p = p.withColumn("reason", reason)
    good = p.filter("reason is null").select(F.col("line_no").alias("case_id"), q.alias("question"), src.alias("expected_sources"), F.coalesce("c.scope", F.lit("notes")).alias("scope"))
    return good, p.filter("reason is not null").select("line_no", "reason")
