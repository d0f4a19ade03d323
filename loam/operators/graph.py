"""Link graph, hygiene lists and the map: nodes, edges, folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import markdown as md
from loam.functions.ranking import global_rank
from loam.operators import neighbours as near

CHAT_ROOT, COPY_DIR = "05 AI Chats", "AI Chat Links"
#: Age rings in days, and radii of the map.
AGE_RINGS = [(7, "1 week"), (30, "1 month"), (91, "3 months"), (182, "6 months"), (365, "1 year"), (730, "2 years")]
INNER, OUTER, NO_DATE = 90.0, 700.0, 840.0


def nodes(chunks: DataFrame) -> DataFrame:
    """``id, label, tags``: each source with what its first chunk says."""
    tags = F.col("tags") if "tags" in chunks.columns else F.array().cast("array<string>")
    c = chunks.filter("source <> ''").groupBy("source").agg(F.min_by(F.struct(F.coalesce("title", "source").alias("label"), tags.alias("tags")), "chunk_ix").alias("f"))
    return c.select(F.col("source").alias("id"), "f.label", "f.tags")


def aliases(notes: DataFrame, wide: bool = False) -> DataFrame:
    """``alias, path``: title, path and path without ``.md``, and with ``wide`` the file's name, in lower case; of notes
    that share an alias the greatest path."""
    stem = F.regexp_replace("path", r"(?i)\.md$", "") if wide else F.replace("path", F.lit(".md"), F.lit(""))
    keys = [F.col("title"), stem, F.col("path"), *([F.regexp_extract(stem, "([^/]*)$", 1)] if wide else [])]
    return notes.select("path", F.explode(F.array(*keys)).alias("alias")).filter("alias <> ''").groupBy(F.lower("alias").alias("alias")).agg(F.max("path").alias("path"))


def links(notes: DataFrame, targets: Column) -> DataFrame:
    """``source, source_title, target, key``: each link of each note; key is the target in lower case up to ``#``."""
    x = notes.select(F.col("path").alias("source"), F.col("title").alias("source_title"), F.explode(targets).alias("target"))
    return x.withColumn("key", F.regexp_extract(F.lower("target"), "^([^#]*)", 1))


def resolved(ls: DataFrame, alias: DataFrame) -> DataFrame:
    """Adds ``path`` of the note that a link means, null if none. Popular targets are split by adaptive skew handling."""
    return ls.join(alias.withColumnRenamed("alias", "key"), "key", "left")


def explicit_edges(notes: DataFrame) -> DataFrame:
    """``source, target``: distinct undirected links by title, without self-links."""
    titles = notes.groupBy(F.lower("title").alias("key")).agg(F.max("path").alias("path"))
    x = links(notes, md.graph_links(F.col("content"))).join(titles, "key").filter("path <> source")
    return x.select(F.least("source", "path").alias("source"), F.greatest("source", "path").alias("target")).distinct()


def directed_edges(notes: DataFrame) -> DataFrame:
    """``source, target``: one row a link that resolves, repeats and self-links too."""
    return resolved(links(notes, md.report_links(F.col("content"))), aliases(notes)).filter("path is not null").select("source", F.col("path").alias("target"))


def broken_links(notes: DataFrame) -> DataFrame:
    """Links that mean no note and aren't to a section, repeats kept."""
    return resolved(links(notes, md.report_links(F.col("content"))), aliases(notes)).filter("path is null and not startswith(target, '#')").select("source", "source_title", "target")


def hygiene_broken(notes: DataFrame) -> DataFrame:
    """The same over the wider aliases: distinct, and from chats none."""
    x = resolved(links(notes, md.graph_links(F.col("content"))), aliases(notes, True))
    return x.filter("path is null and target <> '' and not startswith(source, '05 AI Chats/')").select("source", "source_title", "target").distinct()


def orphans(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """Notes without incoming edge, hubs left out by name."""
    hubs = F.contains("path", F.lit("Home")) | F.contains("path", F.lit("Index.md"))
    return notes.filter(~hubs).join(edges.select(F.col("target").alias("path")).distinct(), "path", "left_anti").select("path", "title")


def hygiene_edges(notes: DataFrame) -> DataFrame:
    x = resolved(links(notes, md.graph_links(F.col("content"))), aliases(notes, True))
    return x.filter("path is not null and path <> source").select("source", F.col("path").alias("target")).distinct()


def tagless(notes: DataFrame, rules: dict[str, list[str]] = md.SUGGESTIONS, most_chars: int | None = None) -> DataFrame:
    """Notes without tags, with suggestions from title and content."""
    text = F.left("content", F.lit(most_chars)) if most_chars else F.col("content")
    x = notes.filter(F.size(md.health_tags(F.col("content"))) == 0)
    return x.select("path", "title", md.suggest_tags(F.col("title"), text, rules).alias("suggestions"))


def statistics(notes: DataFrame) -> DataFrame:
    """One row: notes, links, links a note."""
    n = F.count("*").alias("total_notes"), F.coalesce(F.sum(F.size(md.report_links(F.col("content")))), F.lit(0)).alias("total_links")
    return notes.agg(*n).withColumn("avg_links", F.when(F.col("total_notes") > 0, F.col("total_links") / F.col("total_notes")).otherwise(0.0))


def issue_keys(broken: DataFrame, orphaned: DataFrame, untagged: DataFrame) -> DataFrame:
    """``category, key`` of every issue."""
    b = broken.select(F.lit("broken_links").alias("category"), F.concat_ws(" -> ", "source", "target").alias("key"))
    o = orphaned.select(F.lit("orphaned_notes").alias("category"), F.coalesce(F.nullif("path", F.lit("")), "title").alias("key"))
    return b.unionByName(o).unionByName(untagged.select(F.lit("tagless_notes").alias("category"), F.coalesce(F.nullif("path", F.lit("")), "title").alias("key")))


def merged_report(report: DataFrame, derived: DataFrame, total_notes: DataFrame) -> DataFrame:
    """Issue rows of the report if it saw any notes, else those derived from the store."""
    empty = total_notes.select((F.col("total_notes") == 0).alias("_empty"))
    return report.crossJoin(F.broadcast(empty)).filter(~F.col("_empty")).drop("_empty").unionByName(derived.crossJoin(F.broadcast(empty)).filter("_empty").drop("_empty"))


def digest(keys: DataFrame, scanned_at: Column, now: float, stale_days: float = 7.0) -> DataFrame:
    """``category, n_items, n_keys, age_days, stale``."""
    age = (F.lit(now) - scanned_at) / 86400.0
    x = keys.groupBy("category").agg(F.count("*").alias("n_items"), F.countDistinct("key").alias("n_keys"))
    return x.withColumn("age_days", F.round(age, 2)).withColumn("stale", F.coalesce(age > stale_days, F.lit(True)))


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """``category, key, change``: keys that are new, and keys that are resolved."""
    a, b = now.select("category", "key"), before.select("category", "key")
    return a.exceptAll(b).distinct().join(b, ["category", "key"], "left_anti").withColumn("change", F.lit("new")).unionByName(b.distinct().join(a, ["category", "key"], "left_anti").withColumn("change", F.lit("resolved")))


def issue_list(broken: DataFrame, orphaned: DataFrame, untagged: DataFrame) -> DataFrame:
    """``kind, note_id, title, detail, action, n``: one typed list, numbered by kind, note and detail."""
    s = F.array_join(F.slice("suggestions", 1, 3), " · ")

    def rows(df: DataFrame, order: int, kind: str, note_id: str, title: str, detail: Column, action: Column) -> DataFrame:
        return df.select(
            F.lit(order).alias("o"), F.lit(kind).alias("kind"), F.col(note_id).alias("note_id"), F.col(title).alias("title"),
            detail.alias("detail"), action.alias("action"),
        )

    points = F.concat(F.lit("Points at missing “"), "target", F.lit("”."))
    b = rows(broken, 0, "broken-link", "source", "source_title", points, F.lit("Retarget or create the target note"))
    o = rows(orphaned, 1, "orphan", "path", "title", F.lit("Zero backlinks · not cited by any hub."), F.lit("Link from a hub or MOC"))
    none = F.when(s != "", F.concat(F.lit("No tags. Suggested: "), s, F.lit("."))).otherwise("No tags.")
    t = rows(untagged, 2, "tagless", "path", "title", none, F.when(s != "", "Apply suggested tags").otherwise("Add tags"))
    return global_rank(b.unionByName(o).unionByName(t), "n", F.col("o"), F.col("note_id"), F.col("detail")).drop("o")


def ghost_edges(chunks: DataFrame, near: DataFrame, explicit: DataFrame, threshold: float = 1.2) -> DataFrame:
    """Distinct undirected pairs of sources whose chunks are neighbours (query_id, item_id, distance) within
    ``threshold`` and that no explicit edge joins."""
    c = chunks.select("chunk_id", "source")
    x = near.filter(F.col("distance") <= threshold).join(c.select(F.col("chunk_id").alias("query_id"), F.col("source").alias("a")), "query_id").join(c.select(F.col("chunk_id").alias("item_id"), F.col("source").alias("b")), "item_id")
    x = x.filter("a <> b").select(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target")).distinct()
    return x.join(explicit, ["source", "target"], "left_anti")


def neighbours(items: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` nearest items of every item, itself included, by pivots and triangle bounds."""
    return near.knn(items.withColumnRenamed("item_id", "query_id"), items, k)


# --- the map ---


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def is_chat(path: Column) -> Column:
    return path.startswith("05 AI Chats/") | F.contains(path, F.lit("/05 AI Chats/"))


def is_copy(path: Column) -> Column:
    return F.array_contains(F.split(path, "/"), COPY_DIR)


def folder_cluster(path: Column) -> Column:
    first = md.strip(F.regexp_replace(F.regexp_extract(path, "^([^/]*)/", 1), r"^\d+\s+", ""))
    return F.when(is_chat(path), "Chats").when(~F.contains(path, F.lit("/")) | (first == ""), "Vault").otherwise(first)


def ai_of(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when((F.get(parts, F.lit(0)) == CHAT_ROOT) & (F.size(parts) > 2), F.get(parts, F.lit(1)))


def date_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(base_name(path), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def clean_title(label: Column, path: Column) -> Column:
    raw = md.strip(F.coalesce(F.nullif(label, F.lit("")), F.regexp_replace(base_name(path), r"(?i)\.md$", "")))
    cleaned = md.strip(F.regexp_replace(F.regexp_replace(raw, r"^\d{4}-\d{2}-\d{2}\s*-\s*", ""), r"\s+-\s+[0-9a-fA-F]{4,64}$", ""))
    return F.coalesce(F.nullif(cleaned, F.lit("")), raw)


def folded(ids: DataFrame) -> DataFrame:
    """``id, chat, topic`` of each chat copy: the chat of the same file name outside copy folders (shortest path, then
    name), and the folder that the copy is filed under."""
    chats = ids.filter(is_chat(F.col("id")) & ~is_copy(F.col("id"))).groupBy(base_name(F.col("id")).alias("name")).agg(F.min_by("id", F.struct(F.length("id"), "id")).alias("chat"))
    topic = F.regexp_extract("id", rf"^(.*?)/?{COPY_DIR}/", 1)
    return ids.filter(is_copy(F.col("id"))).select("id", base_name(F.col("id")).alias("name"), topic.alias("topic")).join(chats, "name").select("id", "chat", "topic")


def ancestors(path: Column) -> Column:
    """Folders above a path, outermost first."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def folders(ids: DataFrame) -> DataFrame:
    """``folder``: every folder above a shown node or a topic, and the topics."""
    copies = folded(ids)
    shown = ids.join(copies.select("id"), "id", "left_anti")
    a = shown.select(F.explode(ancestors(F.col("id"))).alias("folder"))
    b = copies.filter("topic <> ''").select(F.explode(ancestors(F.concat("topic", F.lit("/x")))).alias("folder"))
    return a.unionByName(b).distinct()


def map_links(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``source, target, kind``: links between shown nodes with copies folded, topics of chats, and the tree."""
    copies = folded(ids)
    shown = ids.join(copies.select("id"), "id", "left_anti")
    to = copies.select("id", "chat")
    e = edges.select("source", "target")
    for c in ("source", "target"):
        e = e.join(to.withColumnRenamed("id", c), c, "left").withColumn(c, F.coalesce("chat", c)).drop("chat").join(shown.withColumnRenamed("id", c), c, "left_semi")
    link = e.filter("source <> target").select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct().withColumn("kind", F.lit("link"))
    topics = copies.filter("topic <> ''").select(F.col("chat").alias("source"), F.concat(F.lit("folder:"), "topic").alias("target")).distinct().withColumn("kind", F.lit("topic"))
    parent = lambda p: F.concat(F.lit("folder:"), F.regexp_extract(p, "^(.*)/[^/]*$", 1))
    tree = shown.select(F.col("id").alias("source"), parent("id").alias("target")).unionByName(folders(ids).select(F.concat(F.lit("folder:"), "folder").alias("source"), parent("folder").alias("target"))).withColumn("kind", F.lit("tree"))
    return link.unionByName(topics).unionByName(tree)


def map_nodes(labels: DataFrame, links_: DataFrame) -> DataFrame:
    """``id, kind, title, depth, ai, cluster, date, degree`` of each shown note and chat (id, label)."""
    ends = links_.filter("kind = 'link'").select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    shown = labels.join(folded(labels.select("id")).select("id"), "id", "left_anti").join(ends, "id", "left")
    p = F.col("id")
    return shown.select(
        "id", F.when(is_chat(p), "chat").otherwise("note").alias("kind"), clean_title(F.col("label"), p).alias("title"), F.size(F.split(p, "/")).alias("depth"),
        F.when(is_chat(p), ai_of(p)).alias("ai"), folder_cluster(p).alias("cluster"), date_of(p).alias("date"), F.coalesce("degree", F.lit(0)).alias("degree"),
    )


def subtree_counts(ids: DataFrame) -> DataFrame:
    """``folder, n``: notes and chats below each folder, the root ('') too."""
    return ids.select(F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("id")))).alias("folder")).groupBy("folder").agg(F.count("*").alias("n"))


def age_rings(map_nodes_: DataFrame, today: Column) -> DataFrame:
    """``id, age_days, radius``: age from the date in the name, 0 for the future; square-root scale up to the first ring
    that holds the oldest; a fixed radius without a date."""
    x = map_nodes_.withColumn("age_days", F.greatest(F.lit(0), F.datediff(today, F.to_date("date"))))
    most = x.agg(F.coalesce(F.max("age_days"), F.lit(0)).alias("oldest"))
    ring = F.coalesce(*(F.when(F.col("oldest") <= d, d) for d, _ in AGE_RINGS), F.lit(AGE_RINGS[-1][0]))
    x = x.crossJoin(F.broadcast(most.select(ring.alias("most"))))
    r = INNER + (OUTER - INNER) * F.sqrt(F.least("age_days", "most") / F.col("most"))
    return x.select("id", "age_days", F.round(F.when(F.col("date").isNull(), NO_DATE).otherwise(r), 6).alias("radius"))


def shown(map_nodes_: DataFrame, cluster: str = "all", include_chats: bool = True, text: str = "") -> DataFrame:
    x = map_nodes_ if include_chats else map_nodes_.filter("kind <> 'chat'")
    x = x if cluster == "all" else x.filter(F.col("cluster") == cluster)
    t = text.strip().lower()
    return x.filter(F.contains(F.lower("title"), F.lit(t)) | F.contains(F.lower("id"), F.lit(t))) if t else x


def structural_edges(paths: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Undirected edges from each path that holds a rule's folder to the rule's hub; the first rule that fits counts."""
    hub = F.coalesce(*(F.when(F.contains("path", F.lit(part)), F.lit(h)) for part, h in rules))
    x = paths.select("path", hub.alias("hub")).filter("hub is not null and hub <> path")
    return x.select(F.least("path", "hub").alias("source"), F.greatest("path", "hub").alias("target")).distinct()
