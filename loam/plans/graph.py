"""Queries of the link graph, hygiene lists and the map."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import markdown as md
from loam.operators import graph, vectors
from loam.plans.notes import GLINKS, LINKS, TAGS, suggested
from loam.plans.registry import query
from loam.session import table
from loam.sources import corpus

N = f"WITH notes AS ({corpus.NOTES_SQL})"
ALIAS = """al AS (SELECT alias, max(path) AS p FROM (SELECT lower(title) AS alias, path FROM notes UNION ALL SELECT lower(replace(path, '.md', '')), path
  FROM notes UNION ALL SELECT lower(path), path FROM notes) GROUP BY alias),
wide AS (SELECT alias, max(path) AS p FROM (SELECT lower(title) AS alias, path FROM notes UNION ALL SELECT lower(replace(path, '.md', '')), path FROM notes
  UNION ALL SELECT lower(path), path FROM notes
  UNION ALL SELECT lower(regexp_extract(replace(path, '.md', ''), '([^/]*)$', 1)), path FROM notes) GROUP BY alias)"""
RES = f"""{LINKS}, {GLINKS}, {ALIAS},
res AS (SELECT path AS source, title AS source_title, trim(target) AS target, p FROM lk LEFT
  JOIN al ON alias = regexp_extract(lower(trim(target)), '^([^#]*)', 1) WHERE NOT starts_with(trim(target), 'http')),
hres AS (SELECT gl.path AS source, n.title AS source_title, trim(target) AS target, p FROM gl JOIN notes n USING (path) LEFT JOIN wide ON alias = lower(trim(target)))"""


def notes(spark, sf_dir):
    return corpus.notes(spark, sf_dir)


@query("g01_nodes", f"{N} SELECT path AS id, title AS label FROM notes")
def g01(spark, sf_dir):
    return graph.nodes(md.chunk_notes(notes(spark, sf_dir))).select("id", "label")


@query("g02_aliases", f"{N}, {ALIAS} SELECT alias, p AS path FROM al")
def g02(spark, sf_dir):
    return graph.aliases(notes(spark, sf_dir))


EXPLICIT = f"""{GLINKS}, ti AS (SELECT lower(title) AS k, max(path) AS p FROM notes GROUP BY 1),
  ex AS (SELECT DISTINCT least(path, p) AS source, greatest(path, p) AS target FROM gl JOIN ti ON k = lower(trim(target)) WHERE p <> path)"""


@query("g03_edges", f"{N}, {EXPLICIT} SELECT * FROM ex")
def g03(spark, sf_dir):
    return graph.explicit_edges(notes(spark, sf_dir))


@query("g03b_directed", f"{N}, {RES} SELECT source, p AS target, count(*) AS n FROM res WHERE p IS NOT NULL GROUP BY ALL")
def g03b(spark, sf_dir):
    return graph.directed_edges(notes(spark, sf_dir)).groupBy("source", "target").agg(F.count("*").alias("n"))


@query("g04_ghost_edges", """WITH nn AS (SELECT *
  FROM (SELECT a.vec_id AS x, b.vec_id AS y, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) AS d,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(d, 6), b.vec_id) AS pos FROM embeddings a, embeddings b) WHERE pos <= 4 AND round(d, 6) <= 1.2)
  SELECT DISTINCT least(x % 100, y % 100) AS source, greatest(x % 100, y % 100) AS target FROM nn WHERE x % 100 <> y % 100 AND (least(x % 100, y % 100) + greatest(x % 100, y % 100)) % 7 <> 0""")
def g04(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    c = e.select(F.col("item_id").alias("chunk_id"), (F.col("item_id") % 100).alias("source"))  # a hundred sources
    s = c.select("source").distinct()
    known = s.join(s.select(F.col("source").alias("target")), (F.col("source") < F.col("target")) & ((F.col("source") + F.col("target")) % 7 == 0))
    return graph.ghost_edges(c, graph.neighbours(e), known)


@query("g05_broken", f"{N}, {RES} SELECT source, source_title, target, count(*) AS n FROM res WHERE p IS NULL AND NOT starts_with(target, '#') GROUP BY ALL")
def g05(spark, sf_dir):
    return graph.broken_links(notes(spark, sf_dir)).groupBy("source", "source_title", "target").agg(F.count("*").alias("n"))


@query("g05_hygiene_broken", f"{N}, {RES} SELECT DISTINCT source, source_title, target FROM hres WHERE p IS NULL AND target <> '' AND NOT starts_with(source, '05 AI Chats/')")
def g05h(spark, sf_dir):
    return graph.hygiene_broken(notes(spark, sf_dir))


ORPHAN = "orp AS (SELECT path, title FROM notes WHERE NOT contains(path, 'Home') AND NOT contains(path, 'Index.md') AND path NOT IN (SELECT p FROM res WHERE p IS NOT NULL))"


@query("g06_orphans", f"{N}, {RES}, {ORPHAN} SELECT * FROM orp")
def g06(spark, sf_dir):
    n = notes(spark, sf_dir)
    return graph.orphans(n, graph.directed_edges(n))


@query("g06_hygiene_orphans", f"""{N}, {RES} SELECT path, title FROM notes
  WHERE NOT starts_with(path, '05 AI Chats/') AND NOT contains(path, 'Home') AND NOT contains(path, 'Index.md') AND path NOT IN (SELECT p FROM hres
  WHERE p IS NOT NULL AND p <> source)""")
def g06h(spark, sf_dir):
    n = notes(spark, sf_dir)
    return graph.orphans(n.filter(~F.col("path").startswith("05 AI Chats/")), graph.hygiene_edges(n))


TAGLESS = f"tl AS (SELECT path, title, {suggested(md.SUGGESTIONS)} AS suggestions FROM notes WHERE path NOT IN (SELECT path FROM tg))"


@query("g07_tagless", f"{N}, {TAGS}, {TAGLESS} SELECT * FROM tl")
def g07(spark, sf_dir):
    return graph.tagless(notes(spark, sf_dir)).withColumn("suggestions", F.array_join("suggestions", ","))


@query("g08_statistics", f"""{N}, {LINKS} SELECT (SELECT count(*) FROM notes) AS total_notes, (SELECT count(*) FROM lk) AS total_links, round((SELECT count(*)
  FROM lk) / (SELECT CAST(count(*) AS DOUBLE) FROM notes), 6) AS avg_links""")
def g08(spark, sf_dir):
    return graph.statistics(notes(spark, sf_dir)).withColumn("avg_links", F.round("avg_links", 6))


KEYS = f"""{RES}, {TAGS}, {ORPHAN}, {TAGLESS}, ks AS (SELECT 'broken_links' AS category, concat(source, ' -> ', target) AS key FROM res WHERE p IS NULL AND NOT starts_with(target, '#')
  UNION ALL SELECT 'orphaned_notes', path FROM orp UNION ALL SELECT 'tagless_notes', path FROM tl)"""


def keys(n):
    return graph.issue_keys(graph.broken_links(n), graph.orphans(n, graph.directed_edges(n)), graph.tagless(n))


@query("g09_report", f"{N}, {KEYS} SELECT category, count(*) AS n FROM ks GROUP BY category")
def g09(spark, sf_dir):
    n = notes(spark, sf_dir)
    derived = graph.issue_keys(graph.hygiene_broken(n), graph.orphans(n, graph.hygiene_edges(n)), graph.tagless(n, md.SHORT_SUGGESTIONS, 4000))
    return graph.merged_report(keys(n), derived, n.agg(F.count("*").alias("total_notes"))).groupBy("category").agg(F.count("*").alias("n"))


@query("g10_digest", f"{N}, {KEYS} SELECT category, count(*) AS n_items, count(DISTINCT key) AS n_keys, 8.0e0 AS age_days, true AS stale FROM ks GROUP BY category")
def g10(spark, sf_dir):
    return graph.digest(keys(notes(spark, sf_dir)), F.lit(1706054400.0), 1706745600.0)


@query("g11_changes", f"""{N}, {KEYS.replace('ks AS', 'ks AS')},
  notes2 AS ({corpus.LATER_SQL}), {KEYS.replace('notes', 'notes2').replace('orphaned_notes2', 'orphaned_notes').replace('tagless_notes2', 'tagless_notes').replace('lk AS', 'lk2 AS').replace('FROM lk ', 'FROM lk2 ').replace('gl AS', 'gl2 AS').replace('FROM gl ', 'FROM gl2 ').replace('gl.path', 'gl2.path').replace('al AS', 'al2 AS').replace('JOIN al ', 'JOIN al2 ').replace('wide AS', 'wide2 AS').replace('JOIN wide ', 'JOIN wide2 ').replace('hres AS', 'hres2 AS').replace(', res AS', ', res2 AS').replace(chr(10) + 'res AS', chr(10) + 'res2 AS').replace('FROM res ', 'FROM res2 ').replace('tg AS', 'tg2 AS').replace('FROM tg)', 'FROM tg2)').replace('orp AS', 'orp2 AS').replace('FROM orp ', 'FROM orp2 ').replace('tl AS', 'tl2 AS').replace('FROM tl)', 'FROM tl2)').replace('ks AS', 'ks2 AS')}
  SELECT category, key, 'new' AS change FROM (SELECT * FROM ks2 EXCEPT SELECT * FROM ks) UNION ALL SELECT category, key, 'resolved' FROM (SELECT * FROM ks EXCEPT SELECT * FROM ks2)""")
def g11(spark, sf_dir):
    n = notes(spark, sf_dir)
    return graph.changes(keys(corpus.later_notes(n)), keys(n))


@query("g22_issues", f"""{N}, {RES}, {TAGS}, {ORPHAN}, {TAGLESS}, i AS (SELECT 0 AS o, 'broken-link' AS kind, source AS note_id,
  concat('Points at missing “', target, '”.') AS detail FROM res WHERE p IS NULL AND NOT starts_with(target, '#')
  UNION ALL SELECT 1, 'orphan', path, 'Zero backlinks · not cited by any hub.' FROM orp
  UNION ALL SELECT 2, 'tagless', path, CASE WHEN suggestions = '' THEN 'No tags.' ELSE concat('No tags. Suggested: ', array_to_string(string_split(suggestions, ',')[1:3], ' · '), '.') END FROM tl)
  SELECT kind, note_id, detail, row_number() OVER (ORDER BY o, note_id, detail) AS n FROM i""")
def g22(spark, sf_dir):
    n = notes(spark, sf_dir)
    x = graph.issue_list(graph.broken_links(n), graph.orphans(n, graph.directed_edges(n)), graph.tagless(n))
    return x.select("kind", "note_id", "detail", "n")


#: Chat copies are made by filing every third chat under a project too.
IDS = f"ids AS (SELECT path AS id, title AS label FROM notes UNION ALL SELECT concat('02 Projects/Alpha/AI Chat Links/', title, '.md'), title FROM notes WHERE category = 'chat' AND doc_id % 3 = 0)"
FOLD = """cp AS (SELECT id, c.chat, regexp_extract(id, '^(.*?)/?AI Chat Links/', 1) AS topic FROM ids JOIN
  (SELECT regexp_extract(id, '([^/]*)$', 1) AS name, arg_min(id, (len(id), id)) AS chat FROM ids WHERE starts_with(id, '05 AI Chats/') AND NOT contains(id, '/AI Chat Links/') GROUP BY 1) c
  ON c.name = regexp_extract(id, '([^/]*)$', 1) WHERE contains(id, '/AI Chat Links/')), sh AS (SELECT * FROM ids WHERE id NOT IN (SELECT id FROM cp))"""


def ids(spark, sf_dir):
    n = notes(spark, sf_dir)
    return n.select(F.col("path").alias("id"), F.col("title").alias("label")).unionByName(n.filter("category = 'chat' and doc_id % 3 = 0").select(F.concat(F.lit("02 Projects/Alpha/AI Chat Links/"), "title", F.lit(".md")).alias("id"), F.col("title").alias("label")))


@query("g13_copies", f"{N}, {IDS}, {FOLD} SELECT id, chat, topic FROM cp")
def g13(spark, sf_dir):
    return graph.folded(ids(spark, sf_dir).select("id"))


FOLDERS = """fo AS (SELECT DISTINCT array_to_string(p[1:k], '/') AS folder FROM (SELECT p, unnest(range(1, len(p))) AS k FROM (SELECT string_split(id, '/') AS p
  FROM sh UNION ALL SELECT string_split(concat(topic, '/x'), '/') FROM cp WHERE topic <> '') y) z)"""


@query("g14_folders", f"{N}, {IDS}, {FOLD}, {FOLDERS} SELECT folder FROM fo")
def g14(spark, sf_dir):
    return graph.folders(ids(spark, sf_dir).select("id"))


MAP = f"""{IDS}, {FOLD}, {FOLDERS}, {EXPLICIT}, r AS (SELECT coalesce(a.chat, source) AS s, coalesce(b.chat, target) AS t FROM ex LEFT JOIN cp a ON a.id = source LEFT JOIN cp b ON b.id = target),
ml AS (SELECT DISTINCT least(s, t) AS source, greatest(s, t) AS target, 'link' AS kind FROM r WHERE s <> t AND s IN (SELECT id FROM sh) AND t IN (SELECT id FROM sh)
  UNION ALL SELECT DISTINCT chat, concat('folder:', topic), 'topic' FROM cp WHERE topic <> ''
  UNION ALL SELECT id, concat('folder:', regexp_extract(id, '^(.*)/[^/]*$', 1)), 'tree' FROM sh
  UNION ALL SELECT concat('folder:', folder), concat('folder:', regexp_extract(folder, '^(.*)/[^/]*$', 1)), 'tree' FROM fo)"""


@query("g15_map_links", f"{N}, {MAP} SELECT * FROM ml")
def g15(spark, sf_dir):
    return graph.map_links(ids(spark, sf_dir).select("id"), graph.explicit_edges(notes(spark, sf_dir)))


MNODES = f"""{MAP}, dg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM ml WHERE kind = 'link' UNION ALL SELECT target FROM ml WHERE kind = 'link') GROUP BY id),
mn AS (SELECT id, CASE
  WHEN starts_with(id, '05 AI Chats/') THEN 'chat' ELSE 'note' END AS kind, regexp_replace(regexp_replace(label, '^\\d{{4}}-\\d{{2}}-\\d{{2}}\\s*-\\s*', ''), '\\s+-\\s+[0-9a-fA-F]{{4,64}}$', '') AS title, len(string_split(id, '/')) AS depth,
  CASE WHEN starts_with(id, '05 AI Chats/') THEN string_split(id, '/')[2] END AS ai, CASE
  WHEN starts_with(id, '05 AI Chats/') THEN 'Chats' ELSE regexp_replace(string_split(id, '/')[1], '^\\d+\\s+', '') END AS cluster,
  nullif(regexp_extract(regexp_extract(id, '([^/]*)$', 1), '^(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') AS date, coalesce(degree, 0) AS degree FROM sh LEFT JOIN dg USING (id))"""


def map_nodes(spark, sf_dir):
    i = ids(spark, sf_dir)
    return graph.map_nodes(i, graph.map_links(i.select("id"), graph.explicit_edges(notes(spark, sf_dir))))


@query("g16_map_nodes", f"{N}, {MNODES} SELECT * FROM mn")
def g16(spark, sf_dir):
    return map_nodes(spark, sf_dir)


@query("g17_age_rings", f"""{N}, {MNODES} SELECT id, greatest(0, datediff('day', CAST(date AS DATE), DATE '2024-02-01')) AS age_days, round(CASE
  WHEN date IS NULL THEN 840.0e0 ELSE 90 + 610 * sqrt(least(datediff('day', CAST(date AS DATE), DATE '2024-02-01'), 91) / 91.0e0) END, 6) AS radius FROM mn""")
def g17(spark, sf_dir):
    x = graph.age_rings(map_nodes(spark, sf_dir), F.lit("2024-02-01").cast("date"))
    return x.withColumn("age_days", F.coalesce("age_days", F.lit(0)))


@query("g18_subtrees", f"""{N}, {IDS}, {FOLD} SELECT folder, count(*) AS n FROM (SELECT '' AS folder FROM sh UNION ALL SELECT array_to_string(p[1:k], '/')
  FROM (SELECT p, unnest(range(1, len(p))) AS k FROM (SELECT string_split(id, '/') AS p FROM sh) y) z) GROUP BY folder""")
def g18(spark, sf_dir):
    i = ids(spark, sf_dir).select("id")
    return graph.subtree_counts(i.join(graph.folded(i).select("id"), "id", "left_anti"))


@query("g20_clusters", f"{N}, {MNODES} SELECT DISTINCT cluster FROM mn")
def g20(spark, sf_dir):
    return map_nodes(spark, sf_dir).select("cluster").distinct()


@query("f06_map_filter", f"{N}, {MNODES} SELECT id FROM mn WHERE kind <> 'chat' AND cluster = 'Projects' AND (contains(lower(title), 'note 1') OR contains(lower(id), 'note 1'))")
def f06(spark, sf_dir):
    return graph.shown(map_nodes(spark, sf_dir), "Projects", False, " Note 1").select("id")


@query("g21_structural", f"""{N} SELECT DISTINCT least(path, hub) AS source, greatest(path, hub) AS target FROM (SELECT path, CASE
  WHEN contains(path, '05 AI Chats/Claude') THEN '05 AI Chats/Claude/Claude Chat Index.md'
  WHEN contains(path, '03 School') THEN '03 School/School Notes Index.md' END AS hub FROM notes) WHERE hub IS NOT NULL""")
def g21(spark, sf_dir):
    return graph.structural_edges(notes(spark, sf_dir), [("05 AI Chats/Claude", "05 AI Chats/Claude/Claude Chat Index.md"), ("03 School", "03 School/School Notes Index.md")])
