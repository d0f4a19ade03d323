"""Merkle manifest of a dataset: a tree of any arity over each group's rows, a tree over the groups, and proofs of rows.

Levels are made by sibling-shift self-joins: rows of slot zero compute the indices of their siblings (``index XOR 1`` in a binary
tree, else their own index plus the offset of each slot), one equijoin brings the digests, and slot zero emits the parent with
its run. Only digests are shuffled. Proofs come down the same runs, a run at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.ranking import in_groups
from loam.session import materialise, table

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def framed(value: Column) -> Column:
    """``-`` for null, else number of UTF-8 bytes, ``:`` and the value as text."""
    s = value.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(fields: list[str], **instead: Column) -> Column:
    """SHA-256 of the framed fields as 32 bytes; ``instead`` gives other values for some fields."""
    return F.unhex(F.sha2(F.concat(*(framed(instead.get(c, F.col(c))) for c in fields)), 256))


def _hex(b: Column) -> Column:
    return F.lower(F.hex(b))


def _runs(nodes: DataFrame, fan: int) -> DataFrame:
    """One row for each run of siblings of ``nodes`` (tree, idx, n, h): ``tree, idx, n`` of the parent, ``kids`` (the run's
    digests, 32 bytes each, left to right) and ``h``, the parent's digest. Trees of one node have no runs."""
    x = nodes.filter("n > 1")
    siblings = F.array(F.col("idx"), F.col("idx").bitwiseXOR(F.lit(1))) if fan == 2 else F.transform(F.sequence(F.lit(0), F.lit(fan - 1)), lambda k: F.col("idx") + k)
    zero = x.filter(F.col("idx") % fan == 0).select("tree", "n", F.col("idx").alias("zero"), F.explode(siblings).alias("idx")).filter("idx < n")
    run = zero.join(x.select("tree", "idx", "h"), ["tree", "idx"]).groupBy("tree", "zero").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "h"))).alias("run"))
    parent = run.select(
        "tree", F.expr(f"zero div {fan}").alias("idx"), F.expr(f"(n + {fan - 1}) div {fan}").alias("n"),
        F.aggregate("run", F.lit(b""), lambda a, s: F.concat(a, s["h"])).alias("kids"),
    )
    return parent.withColumn("h", F.unhex(F.sha2(_hex(F.col("kids")), 256)))


class Forest:
    """Trees over ``leaves`` (tree, idx, n, h; a written table): ``runs[k]`` are the runs of level k, ``tops`` each tree's top."""

    def __init__(self, leaves: DataFrame, fan: int):
        if fan < 2:
            raise ValueError("a node has two children at least")
        self.leaves, self.fan, self.runs = leaves, fan, []
        nodes = leaves.select("tree", "idx", "n", "h")
        single = [nodes.filter("n = 1")]
        most = nodes.agg(F.max("n")).first()[0] or 1
        while most > 1:
            self.runs.append(materialise(_runs(nodes, fan), "runs"))
            nodes = self.runs[-1].select("tree", "idx", "n", "h")
            single.append(nodes.filter("n = 1"))
            most = -(-most // fan)
        self.levels = single
        self.tops = materialise(reduce(DataFrame.unionByName, single).select("tree", "h"), "tops")

    def paths(self, above: DataFrame) -> DataFrame:
        """``tree, run, kids, steps, sub``: for each run of leaves what lies above it, where ``above`` (tree, steps, sub) says
        what lies above each tree. ``steps`` are siblings to the left and right, level by level. Trees of one leaf have a row
        with null kids. Only runs are joined, so rows get a sixteenth as many with each level."""
        up = None
        for k in range(len(self.runs), 0, -1):
            here = self.levels[k].join(above, "tree").select("tree", "idx", "steps", "sub")
            up = here if up is None else here.unionByName(up)
            up = self.runs[k - 1].select("tree", "idx", "kids").join(up, ["tree", "idx"])
            if k > 1:
                at = F.posexplode(F.sequence(F.lit(0), F.expr("length(kids) div 32 - 1"))).alias("_p", "slot")
                step = F.expr("struct(substring(kids, 1, slot * 32) as left, substring(kids, slot * 32 + 33) as right)")
                up = up.select("tree", "idx", "kids", "steps", "sub", at)
                up = materialise(up.select("tree", (F.col("idx") * self.fan + F.col("slot")).alias("idx"), F.concat(F.array(step), "steps").alias("steps"), "sub"), "paths")
        lone = self.levels[0].join(above, "tree").select("tree", F.lit(0).cast("long").alias("run"), F.lit(None).cast("binary").alias("kids"), "steps", "sub")
        return lone if up is None else up.select("tree", F.col("idx").alias("run"), "kids", "steps", "sub").unionByName(lone)


STEPS = "array<struct<left: binary, right: binary>>"


def indexed(docs: DataFrame, fields: list[str], by: str, key: str, **more: Column) -> DataFrame:
    """A written row for each row of ``docs``: ``key``, ``by``, ``h`` (leaf digest), the columns of ``more``, and ``tree``, ``idx``
    and ``n``: number of its group, place in it and size of it. Groups go in UTF-8 order, null first; rows of a group by
    ``key``, null first, then by digest."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(by).cast("string").alias("by"), leaf(fields).alias("h"), *(c.alias(n) for n, c in more.items()))
    rows = in_groups(materialise(rows, "leaves"), ["by"], [F.col("key").asc(), F.col("h").asc()])
    return materialise(rows.withColumnsRenamed({"_no": "tree", "_row": "idx", "_rows": "n"}), "indexed")


def manifest(docs: DataFrame, fields: list[str] | None = None, by: str = "source", key: str = "doc_id", fan: int = 16, **other: Column) -> DataFrame:
    """For each row of ``docs``: ``key``, ``leaf``, ``subroot`` (of its group's tree), ``root``, ``proof_sha256`` (hash of the
    siblings on the way up) and ``folded_root``, recomputed from ``other['other']`` (32 bytes; null or not given: the leaf) and
    the siblings.

    Nulls are framed as ``-`` and a null group is a group of its own, first of all. Empty texts are framed as ``0:``. Repeated
    rows are leaves of their own; rows of one key stand in the order of their digests. A group of one row is its own subroot,
    and a dataset of one group has its subroot as root. An empty table gives no row. Columns that aren't in ``fields`` count
    for nothing, whatever they are named."""
    leaves = indexed(docs, fields or FIELDS, by, key, other=other.get("other", F.lit(None).cast("binary")))
    trees = Forest(leaves, fan)
    groups = trees.tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees.tops.count()).cast("long").alias("n"), "h")
    upper = Forest(materialise(groups, "groups"), fan)
    root = upper.tops.first()
    root = F.lit(bytes(root["h"]) if root else None).cast("binary")
    none = upper.tops.select("tree", F.lit(None).cast(STEPS).alias("steps"), F.lit(None).cast("binary").alias("sub")).withColumn("steps", F.array().cast(STEPS))
    above = materialise(_rows_with_steps(upper.leaves, upper.paths(none), fan).select(F.col("idx").alias("tree"), "steps", F.col("h").alias("sub")), "above")
    rows = _rows_with_steps(leaves, trees.paths(above), fan)
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), "")
    fold = F.aggregate("steps", _hex(F.coalesce("other", "h")), lambda c, s: F.sha2(F.concat(_hex(s["left"]), c, _hex(s["right"])), 256))
    return rows.select(
        F.col("key").alias(key), _hex(F.col("h")).alias("leaf"), _hex(F.col("sub")).alias("subroot"), _hex(root).alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"), fold.alias("folded_root"),
    )


def _rows_with_steps(leaves: DataFrame, paths: DataFrame, fan: int) -> DataFrame:
    """``leaves`` with ``steps`` and ``sub``, from the rows of their runs; a run has ``fan`` leaves at most."""
    x = leaves.withColumns({"run": F.expr(f"idx div {fan}"), "slot": F.expr(f"cast(idx % {fan} as int)")}).join(paths, ["tree", "run"])
    step = F.expr("struct(substring(kids, 1, slot * 32) as left, substring(kids, slot * 32 + 33) as right)")
    return x.withColumn("steps", F.when(F.col("kids").isNull(), F.col("steps")).otherwise(F.concat(F.array(step), "steps"))).drop("kids", "run", "slot")


def write_manifest(docs: DataFrame, path: str, fields: list[str] | None = None, by: str = "source", key: str = "doc_id", fan: int = 16) -> str | None:
    """Writes ``path/leaves`` (key, by, h, tree, idx, n), ``path/tops`` (a subroot for each group) and ``path/root``; gives the
    root in hex, null for an empty table."""
    leaves = indexed(docs, fields or FIELDS, by, key)
    trees = Forest(leaves, fan)
    groups = trees.tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees.tops.count()).cast("long").alias("n"), "h")
    top = Forest(materialise(groups, "groups"), fan).tops
    leaves.write.parquet(f"{path}/leaves")
    leaves.filter("idx = 0").select("by", "tree", "n").join(trees.tops, "tree").write.parquet(f"{path}/tops")
    top.select(_hex(F.col("h")).alias("root")).write.parquet(f"{path}/root")
    row = top.first()
    return bytes(row["h"]).hex() if row else None


def changed(docs: DataFrame, path: str, fields: list[str] | None = None, by: str = "source", key: str = "doc_id", fan: int = 16) -> DataFrame:
    """``key, by, change`` (``new`` or ``gone``; a row whose content differs is both) of rows in which ``docs`` differ from the manifest at ``path``.

    Subroots are compared first; only rows of groups whose subroot differs are joined."""
    spark = docs.sparkSession
    now = indexed(docs, fields or FIELDS, by, key)
    trees = Forest(now, fan)
    tops = now.filter("idx = 0").select("by", "tree").join(trees.tops, "tree").select("by", "h", F.lit(True).alias("there"))
    old = spark.read.parquet(f"{path}/tops").select(F.col("by").alias("_by"), F.col("h").alias("_h"))
    differ = tops.join(old, F.col("by").eqNullSafe(F.col("_by")), "full").filter(~F.col("h").eqNullSafe(F.col("_h"))).select(F.coalesce("by", "_by").alias("_d"))
    differ = materialise(differ, "differ")
    size = F.broadcast(differ) if differ.count() <= 100_000 else differ
    was = spark.read.parquet(f"{path}/leaves").select("key", "by", "h").join(size, F.col("by").eqNullSafe(F.col("_d")), "left_semi")
    is_ = now.select("key", "by", "h").join(size, F.col("by").eqNullSafe(F.col("_d")), "left_semi")
    counts = is_.withColumn("_c", F.lit(1)).unionByName(was.withColumn("_c", F.lit(-1))).groupBy("key", "by", "h").agg(F.sum("_c").alias("_c")).filter("_c <> 0")
    return counts.select(F.col("key").alias(key), F.col("by").alias(by), F.when(F.col("_c") > 0, "new").otherwise("gone").alias("change"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every row of ``documents``, and the root folded after tampering with the texts (A-Z in lower
    case) of ids whose CRC-32 divides by five; edge cases as in manifest. A null id is never tampered with."""
    docs = table(spark, sf_dir, "documents").select(FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    x = manifest(docs, other=F.when(hit, leaf(FIELDS, text=F.translate("text", UPPER, LOWER))))
    return x.withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT range AS i, range::UBIGINT AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 5 = 0 AS hit
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), tab),
d AS (
  SELECT doc_id, source, coalesce(hit, false) AS hit,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') ||
    coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS body,
    coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low
  FROM documents LEFT JOIN crc USING (doc_id)),
leaves AS (
  SELECT doc_id, sha256(head || body) AS leaf, CASE WHEN hit THEN sha256(head || low) END AS other,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
up AS (
  SELECT 0 AS lv, tree, idx, n, leaf AS h FROM placed
  UNION ALL
  SELECT lv + 1, tree, idx // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY lv, tree, idx // 16),
subs AS (SELECT tree, h FROM up WHERE n = 1),
up2 AS (
  SELECT 0 AS lv, tree AS idx, (SELECT count(*) FROM subs) AS n, h FROM subs
  UNION ALL
  SELECT lv + 1, idx // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM up2 WHERE n > 1 GROUP BY lv, idx // 16),
nodes AS (SELECT lv, tree, idx, n, h FROM up UNION ALL SELECT lv, -1, idx, n, h FROM up2),
sibs AS (
  SELECT a.lv, a.tree, a.idx, any_value(a.n) AS n, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM nodes a LEFT JOIN nodes b ON b.lv = a.lv AND b.tree = a.tree AND b.idx // 16 = a.idx // 16 AND b.idx <> a.idx WHERE a.n > 1 GROUP BY a.lv, a.tree, a.idx),
walk AS (
  SELECT doc_id, leaf, coalesce(other, leaf) AS c, '' AS proof, 0 AS lv, tree, idx FROM placed
  UNION ALL
  SELECT w.doc_id, w.leaf, sha256(s.l || w.c || s.r), w.proof || s.l || s.r, w.lv + 1, w.tree, w.idx // 16 FROM walk w JOIN sibs s USING (lv, tree, idx)),
walk2 AS (
  SELECT doc_id, leaf, c, proof, 0 AS lv, tree, tree AS idx FROM walk WHERE (lv, tree, idx) IN (SELECT lv, tree, idx FROM up WHERE n = 1)
  UNION ALL
  SELECT w.doc_id, w.leaf, sha256(s.l || w.c || s.r), w.proof || s.l || s.r, w.lv + 1, w.tree, w.idx // 16 FROM walk2 w JOIN sibs s ON s.lv = w.lv AND s.tree = -1 AND s.idx = w.idx)
SELECT w.doc_id, w.leaf, s.h AS subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.c AS folded_root, w.c = r.h AS verified
FROM walk2 w JOIN subs s ON s.tree = w.tree JOIN (SELECT lv, h FROM up2 WHERE n = 1) r ON w.lv = r.lv
"""
