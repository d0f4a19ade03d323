"""Queries of note attributes, sections, chunks, tags, links and excerpts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import markdown as md
from loam.plans.registry import query
from loam.sources import corpus

N = f"WITH notes AS ({corpus.NOTES_SQL})"
STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
NWORDS = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"


@query("s01_scan", f"{N} SELECT path FROM notes WHERE NOT contains(path, '/.') AND NOT contains(path, 'Index.md') AND NOT starts_with(path, '05 AI Chats/')")
def s01(spark, sf_dir):
    return corpus.notes(spark, sf_dir).filter(corpus.eligible(F.col("path"), (*corpus.EXCLUDED, "05 AI Chats"))).select("path")


@query("s02_attributes", f"{N} SELECT path, title, category FROM notes")
def s02(spark, sf_dir):
    return corpus.notes(spark, sf_dir).select("path", *corpus.note_attributes(F.col("path")))


#: Lines, their section numbers and the sections; these notes have no fences.
SECTIONS = f"""
ln AS (SELECT path, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT path, string_split(regexp_replace(content, '\\n$', ''), chr(10)) AS l FROM notes)),
nb AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^ {{0,3}}#{{1,6}}\\s+.*$') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS s FROM ln),
sec AS (SELECT path, s, string_agg(line, chr(10)
  ORDER BY i) AS text, {STRIP.format("max(CASE WHEN regexp_matches(line, '^ {0,3}#{1,6}\\s+.*$') THEN regexp_extract(line, '^ {0,3}#{1,6}\\s+(.*)$', 1) ELSE '' END)")} AS heading
  FROM nb GROUP BY path, s),
sections AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY s) - 1 AS ix, {NWORDS.format('text')} AS n FROM sec WHERE regexp_matches(text, '\\S'))"""


@query("m01_sections", f"{N}, {SECTIONS} SELECT path, CAST(ix AS INT) AS ix, heading, md5(text) AS text_md5 FROM sections")
def m01(spark, sf_dir):
    x = md.with_sections(corpus.notes(spark, sf_dir), "content")
    # outer, as the optimiser asks an inner one's array for its size in a filter of its own, which finds all sections once more
    return x.select("path", F.posexplode_outer("sections").alias("ix", "s")).filter("s is not null").select("path", "ix", "s.heading", F.md5("s.text").alias("text_md5"))


#: The merge of sections is a running fold, so the SQL is recursive.
CHUNKED = f"""{N}, {SECTIONS},
fold AS (WITH RECURSIVE r AS (
  SELECT path, ix, n, CASE WHEN n > 500 THEN 0 ELSE n END AS used, 0 AS grp, n > 500 AS big FROM sections WHERE ix = 0
  UNION ALL SELECT s.path, s.ix, s.n, CASE WHEN s.n > 500 THEN 0 WHEN NOT r.big AND r.used + s.n <= 500 THEN r.used + s.n ELSE s.n END,
    CASE WHEN s.n <= 500 AND NOT r.big AND r.used + s.n <= 500 THEN r.grp ELSE r.grp + 1 END, s.n > 500
  FROM r JOIN sections s ON s.path = r.path AND s.ix = r.ix + 1) SELECT * FROM r),
g AS (SELECT path, grp, any_value(big) AS big, string_agg(text, chr(10) ORDER BY f.ix) AS text, min_by(heading, f.ix) AS heading FROM fold f JOIN sections s USING (path, ix) GROUP BY path, grp),
p AS (SELECT path, grp, 0 AS k, text, heading FROM g WHERE NOT big
  UNION ALL SELECT path, grp, k, array_to_string(w[k * 450 + 1 : k * 450 + 500], ' '), heading
  FROM (SELECT path, grp, heading, w, unnest(range(0, CAST(ceil(len(w) / 450.0e0) AS BIGINT))) AS k
  FROM (SELECT path, grp, heading, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM g WHERE big) z) y),
chunked AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY grp, k) - 1 AS chunk_ix, heading, text FROM p)"""


@query("m02_chunks", f"{CHUNKED} SELECT concat(path, '_chunk_', CAST(chunk_ix AS VARCHAR)) AS chunk_id, heading, md5(text) AS text_md5 FROM chunked")
def m02(spark, sf_dir):
    return md.chunk_notes(corpus.notes(spark, sf_dir)).select("chunk_id", "heading", F.md5("chunk").alias("text_md5"))


@query("m03_windows", f"""{N}, w AS (SELECT path, list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '') AS w FROM notes),
  k AS (SELECT path, w, unnest(range(0, CAST(ceil(len(w) / 80.0e0) AS BIGINT))) AS k FROM w)
  SELECT path, CAST(k AS INT) AS k, md5(array_to_string(w[k * 80 + 1 : k * 80 + 100], ' ')) AS text_md5 FROM k""")
def m03(spark, sf_dir):
    n = corpus.notes(spark, sf_dir)
    return n.select("path", F.posexplode_outer(md.windows(md.words(F.col("content")), 100, 20)).alias("k", "t")).filter("t is not null").select("path", "k", F.md5("t").alias("text_md5"))


@query("m04_indexer_tags", f"""{N} SELECT path, CASE
  WHEN starts_with(content, '---') THEN regexp_replace(regexp_extract(content, 'tags: \\[([^\\]]+)\\]', 1), ',\\s*', ',') ELSE '' END AS tags FROM notes""")
def m04(spark, sf_dir):
    return corpus.notes(spark, sf_dir).select("path", F.array_join(md.indexer_tags(F.col("content")), ",").alias("tags"))


TAGS = """tg AS (SELECT path, unnest(regexp_extract_all(content, '(^|\\s)#([a-zA-Z_][a-zA-Z0-9_\\-/]*)', 2)) AS t FROM notes
  UNION SELECT path, trim(unnest(string_split(regexp_extract(content, 'tags: \\[([^\\]]+)\\]', 1), ','))) FROM notes WHERE starts_with(content, '---'))"""


@query("m05_health_tags", f"{N}, {TAGS} SELECT path, coalesce(string_agg(t, ',' ORDER BY t), '') AS tags FROM notes LEFT JOIN tg USING (path) GROUP BY path")
def m05(spark, sf_dir):
    return corpus.notes(spark, sf_dir).select("path", F.array_join(md.health_tags(F.col("content")), ",").alias("tags"))


LINKS = "lk AS (SELECT path, title, unnest(regexp_extract_all(content, '\\[\\[([^\\]\\|]+)(?:\\|[^\\]]+)?\\]\\]', 1)) AS target FROM notes)"


@query("m06_report_links", f"""{N}, {LINKS} SELECT path, trim(target) AS target, count(*) AS n FROM lk
  WHERE NOT starts_with(trim(target), 'http') AND NOT starts_with(trim(target), 'file:') GROUP BY ALL""")
def m06(spark, sf_dir):
    return corpus.notes(spark, sf_dir).select("path", F.explode(md.report_links(F.col("content"))).alias("target")).groupBy("path", "target").agg(F.count("*").alias("n"))


GLINKS = "gl AS (SELECT path, unnest(regexp_extract_all(content, '\\[\\[([^\\]|#]+)(?:[|#][^\\]]*)?\\]\\]', 1)) AS target FROM notes)"


@query("m07_graph_links", f"{N}, {GLINKS} SELECT path, trim(target) AS target, count(*) AS n FROM gl GROUP BY ALL")
def m07(spark, sf_dir):
    return corpus.notes(spark, sf_dir).select("path", F.explode(md.graph_links(F.col("content"))).alias("target")).groupBy("path", "target").agg(F.count("*").alias("n"))


def suggested(rules: dict[str, list[str]], text: str = "lower(concat(title, ' ', content))") -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, '{'|'.join(ws)}') THEN '{t}' END" for t, ws in rules.items()) + "], lambda x: x IS NOT NULL), ',')"


@query("m08_suggested_tags", f"{N} SELECT path, {suggested(md.SUGGESTIONS)} AS tags FROM notes")
def m08(spark, sf_dir):
    return corpus.notes(spark, sf_dir).select("path", F.array_join(md.suggest_tags(F.col("title"), F.col("content")), ",").alias("tags"))


@query("m09_path_tags", f"{N} SELECT path, coalesce(nullif({suggested(md.PATH_TAGS, 'lower(path)')}, ''), 'second-brain') AS tags FROM notes")
def m09(spark, sf_dir):
    return corpus.notes(spark, sf_dir).select("path", F.array_join(md.path_tags(F.col("path")), ",").alias("tags"))


SNIP = f"""sn AS (SELECT path, {STRIP.format("regexp_replace(coalesce(string_agg(regexp_replace(x, '^#{1,6}\\s+', ''), ' ' ORDER BY i), ''), '\\s+', ' ', 'g')")} AS snippet
  FROM (SELECT path, title, i, {STRIP.format('line')} AS x FROM (SELECT path, title, generate_subscripts(l, 1) AS i, unnest(l) AS line
  FROM (SELECT path, title, string_split(content, chr(10)) AS l FROM notes)))
  WHERE x <> '' AND x <> concat('# ', title) GROUP BY path)"""


@query("m10_snippet", f"{N}, {SNIP} SELECT path, md5(snippet) AS snippet_md5, left(snippet, 150) AS head FROM sn")
def m10(spark, sf_dir):
    x = corpus.notes(spark, sf_dir).withColumn("s", md.clean_snippet(F.col("content"), F.col("title")))
    return x.select("path", F.md5("s").alias("snippet_md5"), F.left("s", F.lit(150)).alias("head"))


#: Blocks of notes without fences: a heading is one, and so is a run of lines between headings and blank lines.
BLOCKS = f"""bl AS (SELECT path, title, i, line, {STRIP.format('line')} AS x FROM (SELECT path, title, generate_subscripts(l, 1) AS i, unnest(l) AS line
  FROM (SELECT path, title, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM notes))),
bk AS (SELECT *, CASE WHEN NOT regexp_matches(line, '\\S') THEN 'blank' WHEN regexp_matches(x, '^(#{{1,6}})\\s+(.*)$') THEN 'heading' ELSE 'paragraph' END AS kind FROM bl),
bg AS (SELECT *, sum(CASE WHEN kind = 'paragraph' THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY i) AS g FROM bk),
bb AS (SELECT path, any_value(title) AS title, kind, min(i) AS i, CASE
  WHEN kind = 'heading' THEN {STRIP.format("regexp_extract(any_value(x), '^(#{1,6})" + chr(92) + "s+(.*)$', 2)")} ELSE string_agg(line, chr(10)
  ORDER BY i) END AS text FROM bg WHERE kind <> 'blank' GROUP BY path, kind, g),
bn AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY i) AS n FROM bb), bf AS (SELECT * FROM bn WHERE NOT (n = 1 AND kind = 'heading' AND text = trim(title)))"""


@query("m11_blocks", f"{N}, {BLOCKS} SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS INT) AS pos, kind, md5(text) AS text_md5 FROM bf")
def m11(spark, sf_dir):
    x = corpus.notes(spark, sf_dir).select("path", F.posexplode_outer(md.note_blocks(F.col("content"), F.col("title"))).alias("pos", "b")).filter("b is not null")
    return x.select("path", "pos", "b.kind", F.md5("b.text").alias("text_md5"))


@query("m12_excerpt", f"""{N} SELECT path, CASE
  WHEN contains(content, '## 👤 User') THEN left(regexp_replace({STRIP.format("string_split(left(content, 8000), '## 👤 User')[2]")}, '\\s+', ' ', 'g'), 500) ELSE '' END AS excerpt
  FROM notes WHERE category = 'chat'""")
def m12(spark, sf_dir):
    return corpus.notes(spark, sf_dir).filter("category = 'chat'").select("path", md.transcript_excerpt(F.col("content")).alias("excerpt"))


@query("m13_indexed_text", f"""{CHUNKED} SELECT path AS source, md5(string_agg(text, concat(chr(10), chr(10)) ORDER BY chunk_ix)) AS text_md5
  FROM (SELECT path, text, min(chunk_ix) AS chunk_ix FROM chunked GROUP BY path, text) GROUP BY path""")
def m13(spark, sf_dir):
    x = md.indexed_text(md.chunk_notes(corpus.notes(spark, sf_dir)))
    return x.select("source", F.md5("text").alias("text_md5"))
