"""Queries of secrets, ignore rules, printable output and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.operators import maintenance, screen
from loam.plans.registry import query
from loam.session import table, texts
from loam.sources import corpus

N = f"WITH notes AS ({corpus.NOTES_SQL})"
#: A pattern's look-ahead, which DuckDB's expressions don't have: of its alternatives only the first can begin a value.
AHEAD = r"(?!your|os\.|process\.|settings\.)"


def matches_sql(r: str, s: str) -> str:
    quoted = r.replace("'", "''")
    if AHEAD not in r:
        return f"regexp_matches({s}, '{quoted}')"
    head, tail = quoted.split(AHEAD)
    return f"len(list_filter(regexp_extract_all({s}, '{head}({tail})', 1), lambda v: NOT starts_with(lower(v), 'your'))) > 0"


def scan_sql(rows: str) -> str:
    """``path, name, line`` of the secrets in ``rows`` (path, l: list of lines)."""
    hits = ", ".join(f"CASE WHEN {matches_sql(r, 's')} THEN '{n}' END" for k, n, r in screen.SECRETS if k == "content")
    return f"SELECT path, unnest(list_filter([{hits}], lambda x: x IS NOT NULL)) AS name, line FROM (SELECT path, generate_subscripts(l, 1) AS line, unnest(l) AS s FROM ({rows}))"


@query("f09_secrets", scan_sql("SELECT doc_id AS path, string_split(text, chr(10)) AS l FROM documents"))
def f09(spark, sf_dir):
    return screen.scan(texts(spark, sf_dir), screen.SECRETS, "doc_id", "text").withColumnRenamed("doc_id", "path")


RULES = ["# kept at home", "01 Journal/", "*7.md", "02 Projects/Beta/note 1*", "\\03 School\\CS\\"]


def rules(spark):
    return screen.ignore_rules(spark.createDataFrame([(r,) for r in RULES], "rule string"))


IGN = "starts_with(lower(path), '01 journal/') OR regexp_matches(lower(path), '^.*7\\.md$') OR regexp_matches(lower(path), '^02 projects/beta/note 1.*$') OR starts_with(lower(path), '03 school/cs/')"


@query("f08_ignored", f"{N} SELECT path FROM notes WHERE {IGN}")
def f08(spark, sf_dir):
    return screen.ignored(corpus.notes(spark, sf_dir).select("path"), rules(spark))


FOUND = f"fd AS ({scan_sql(f'SELECT path, string_split(content, chr(10)) AS l FROM notes WHERE NOT ({IGN})')})"


@query("i10_sync_report", f"""{N}, {FOUND}, tl AS (SELECT path, least(count(*), 5) AS told FROM fd GROUP BY path), p AS (SELECT path, CASE
  WHEN {IGN} THEN 'ignored' WHEN path IN (SELECT path FROM fd) THEN 'refused' ELSE 'upload' END AS verdict FROM notes)
  SELECT verdict, count(*) AS n, CAST(coalesce(sum(told), 0) AS BIGINT) AS reasons FROM p LEFT JOIN tl USING (path) GROUP BY verdict""")
def i10(spark, sf_dir):
    plan, found = screen.mirror_plan(corpus.notes(spark, sf_dir).select("path", "content"), rules(spark))
    return maintenance.sync_report(plan, found)


@query("f10_output_guard", """WITH l AS (SELECT page_id, generate_subscripts(l, 1) AS line, unnest(l) AS s FROM (SELECT page_id, string_split(coalesce(html, ''), chr(10)) AS l FROM pages)),
  r AS (SELECT page_id, line, CASE WHEN NOT regexp_matches(s, '^[\\x20-\\x7e\\t\\r]*$') THEN 'not plain ASCII'
  WHEN contains(lower(s), '.md') THEN 'names a .md file' WHEN length(s) > 300 THEN 'longer than 300 characters'
  WHEN starts_with(trim(s, ' '), '{') THEN 'an unparseable JSON line' END AS reason FROM l) SELECT page_id, line, reason FROM r WHERE reason IS NOT NULL""")
def f10(spark, sf_dir):
    return screen.output_lines(table(spark, sf_dir, "pages"), "page_id", "html")


@query("f12_numbers", """WITH e AS (SELECT event_type, event_id, value, user_id FROM events) SELECT event_type, 'hit_rate' AS name, arg_max(value, event_id) AS value FROM e GROUP BY event_type
  UNION ALL SELECT event_type, 'checks', CAST(arg_max(user_id, event_id) AS DOUBLE) FROM e WHERE event_id % 2 = 0 GROUP BY event_type""")
def f12(spark, sf_dir):
    line = F.concat(F.lit('{"hit_rate": '), F.col("value").cast("string"), F.lit(', "note": "x", "passed": true, "checks": '), F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise('"n/a"'), F.lit("}"))
    e = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("line_no"), line.alias("line"))
    return screen.numbers(e, "event_type", ["hit_rate", "mrr", "cases", "errors", "checks", "passed", "failed", "ms_max"])
