"""Trie of conversations' prefixes by fixed-length block hashing.

Conversations are grouped by successive digests of blocks of several turns. Only where blocks below one prefix differ are turn
boundaries refined; a block that all go through is a chain whose turns share its members. What a node needs of the nodes below
it is a sum over its members, so no level is walked: a conversation *owns* the nodes of which it is the smallest member, which
are the end of its path. Turns before that are saved once for it, and a childless node is counted by its owner."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.ranking import in_groups
from loam.llm.components import join_groups
from loam.session import materialise, table

#: Turns of a block, and members of one piece of a list that is hashed.
BLOCK, PIECE = 4, 10_000
#: Conversations share turns with the one whose id ends the last ``FAMILY``.
FAMILY, MOST_SHARED = 20, 3


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, size, digest, words`` of every turn: its place 1, 2, ... by turn (null first), ties by digest, the
    number of turns, 16 bytes of the SHA-256 of role and text (null: empty), and the words ``[^\\x20\\x09-\\x0D]+`` of its text.

    Rows without a conv_id belong to no conversation. Repeated rows are turns of their own."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), digest.alias("digest"), words.alias("words"))
    rows = in_groups(rows, ["conv_id"], [F.col("_turn").asc(), F.col("digest").asc()])
    return rows.select("conv_id", (F.col("_row") + 1).alias("pos"), F.col("_rows").alias("size"), "digest", "words")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns ``conv_id, pos, digest, words`` of the conversations that begin as their family's first does, and ``conv_id, size,
    length``: turns before and after. The first h turns, h the CRC-32 of the id modulo 4, are those of conversation
    ``c - c % 20`` (all of them where it has fewer), the others its own after its first h."""
    t = materialise(turns(conversations), "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)
    one = t.filter("pos = 1").select("conv_id", "size")
    first = one.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("first"), F.col("size").alias("there"))
    info = one.withColumns({"h": h, "first": F.col("conv_id") - F.col("conv_id") % FAMILY}).join(first, "first", "left")
    info = info.withColumn("got", F.least("h", F.coalesce("there", F.lit(0))))
    info = materialise(info.select("conv_id", "first", "size", "h", "got", (F.col("got") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length")), "info")
    shared = t.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") <= MOST_SHARED)).select(F.col("conv_id").alias("first"), "pos", "digest", "words")
    begin = info.select("conv_id", "first", "h").join(shared, "first").filter("pos <= h").select("conv_id", "pos", "digest", "words")
    own = t.filter(F.col("pos") > h).drop("size")
    gaps = info.filter("got < h").select("conv_id", (F.col("h") - F.col("got")).alias("gap"), F.col("size").alias("held"))
    own = join_groups(own, gaps, "conv_id", "held", own.count(), "left").select("conv_id", (F.col("pos") - F.coalesce("gap", F.lit(0))).alias("pos"), "digest", "words")
    return begin.unionByName(own), info.select("conv_id", "size", "length")


def _id(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def _prefix(i: Column, block: int) -> Column:
    """Node after ``i`` turns of a block: 128 bits of the prefix before it and the turns; the block's own where it is whole."""
    upto = F.transform(F.slice("turns", 1, i), lambda t: t["digest"])
    return F.when(i == 0, F.col("q")).when(i == block, F.col("p")).otherwise(_id(F.xxhash64("q.a", "q.b", upto), F.xxhash64(F.lit(7), "q.b", "q.a", upto)))


def blocks(turn_rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """A written row for each block of a conversation: ``conv_id, j``, the prefixes ``q`` before it and ``p`` after it, words
    ``before`` it and ``total`` after it, its ``turns`` and whether it is the ``last``.

    A prefix is the exclusive or of hashes of (place, digest) of its blocks, twice 64 bits, so that a conversation of any
    length is summed in parts."""
    rows = turn_rows.groupBy("conv_id", F.expr(f"(pos - 1) div {block}").alias("j")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("turns"))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""), 256)
    rows = rows.withColumns({"x": F.xxhash64("j", digest), "y": F.xxhash64(digest, F.lit(7), "j"), "w": F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["words"])})
    x = in_groups(rows, ["conv_id"], [F.col("j").asc()], {"p1": (F.bit_xor, F.col("x")), "p2": (F.bit_xor, F.col("y")), "total": (F.sum, F.col("w"))})
    p, q = _id(F.col("p1"), F.col("p2")), _id(F.col("p1").bitwiseXOR(F.col("x")), F.col("p2").bitwiseXOR(F.col("y")))
    return materialise(x.select("conv_id", "j", q.alias("q"), p.alias("p"), (F.col("total") - F.col("w")).alias("before"), "total", "turns", (F.col("_row") == F.col("_rows") - 1).alias("last")), "blocks")


def _refined(edges: DataFrame, block: int, **measures: Column) -> DataFrame:
    """Turn nodes of different blocks: ``id, up, depth, prior`` (words before its turn) and the measures.

    A block without a sibling gives its turns as they are; those of siblings are grouped, with partial sums in each task."""
    n = F.size("turns")
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        _prefix(i, block).alias("id"), _prefix(i - 1, block).alias("up"), (F.col("j") * block + i).alias("depth"),
        (F.col("before") + F.aggregate(F.slice("turns", 1, i - 1), F.lit(0).cast("long"), lambda a, t: a + t["words"])).alias("prior")))
    names = [c for c in edges.columns if c in ("members", "rep", "shared", "leaves")]
    x = edges.select("kids", *names, F.explode(each).alias("e")).select("kids", *names, "e.*")
    alone = x.filter("kids = 1").drop("kids")
    rest = x.filter("kids > 1").groupBy("id").agg(*(F.first(c).alias(c) for c in ("up", "depth", "prior")), *(c.alias(k) for k, c in measures.items()))
    return alone.select(rest.columns).unionByName(rest)


def trie(turn_rows: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of all prefixes of ``turn_rows`` (conv_id, pos, digest, words), among ``convs`` (conv_id, size, length): ``conv_id``
    (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Conversations without turns are members of the root alone. No conversations give no row. Equal conversations share all
    nodes. Groups of any size are summed in tasks first; a prefix with very many children is joined by broadcast."""
    root = _id(F.lit(0).cast("long"), F.lit(0).cast("long"))
    b = blocks(turn_rows, block)
    edges = b.groupBy("q", "p").agg(F.count("*").alias("members"), F.min("conv_id").alias("rep"), *(F.first(c).alias(c) for c in ("j", "before", "turns")))
    edges = materialise(edges, "edges")
    kids = materialise(edges.groupBy("q").agg(F.count("*").alias("kids")), "kids")
    edges = materialise(join_groups(edges, kids, "q", "kids", edges.count()), "edges")
    none = F.lit(None).cast("struct<a: bigint, b: bigint>")
    top = convs.agg(F.count("*").alias("members"), F.min("conv_id").alias("rep")).filter("members > 0").select(root.alias("id"), none.alias("up"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("prior"), "members", "rep")
    nodes = _refined(edges.select("q", "p", "j", "before", "turns", "kids", "members", "rep"), block, members=F.sum("members"), rep=F.min("rep")).unionByName(top)
    nodes = materialise(nodes, "nodes")
    below = nodes.filter("up is not null").groupBy(F.col("up").alias("id")).agg(F.count("*").alias("n_children"))
    nodes = materialise(nodes.join(below, "id", "left").fillna(0, ["n_children"]), "nodes")
    parents = nodes.filter("n_children > 0").select(F.col("id").alias("up"), F.col("rep").alias("up_rep"), F.col("n_children").alias("held"))
    linked = join_groups(nodes.filter("up is not null"), parents, "up", "held", nodes.count()).drop("held")
    nodes = materialise(linked.unionByName(nodes.filter("up is null").withColumn("up_rep", F.lit(None).cast("long"))), "linked")
    # what each conversation shares with smaller ones, and whether it owns a childless node
    owned = nodes.filter("up_rep is null or up_rep <> rep").select(F.col("rep").alias("conv_id"), F.col("prior").alias("shared"))
    leaf = nodes.filter("n_children = 0").select(F.col("rep").alias("conv_id"), F.lit(1).cast("long").alias("leaves"))
    total = b.filter("last").select("conv_id", "total")
    each = convs.join(total, "conv_id", "left").join(owned, "conv_id", "left").join(leaf, "conv_id", "left")
    each = materialise(each.select("conv_id", F.expr(f"(length + {block - 1}) div {block}").alias("held"), F.coalesce("shared", "total", F.lit(0)).alias("shared"), F.coalesce("leaves", F.lit(0)).alias("leaves")), "shares")
    sums = join_groups(b.select("conv_id", "p"), each, "conv_id", "held", b.count())
    sums = sums.groupBy("p").agg(F.sum("shared").alias("shared"), F.sum("leaves").alias("leaves"), F.min(F.struct("conv_id", "shared")).alias("rep"))
    below = _refined(
        edges.drop("rep", "members").join(sums, "p"), block,
        shared=F.sum("shared"), leaves=F.sum("leaves"), rep=F.min("rep"),
    ).select("id", "shared", "leaves", F.col("rep.shared").alias("rep_shared"))
    at_root = each.agg(F.sum("shared").alias("shared"), F.sum("leaves").alias("leaves"), F.lit(0).cast("long").alias("rep_shared")).filter("shared is not null").select(root.alias("id"), "shared", "leaves", "rep_shared")
    ends = b.filter("last").select(_prefix(F.size("turns"), block).alias("id"), "conv_id").unionByName(convs.filter("length = 0").select(root.alias("id"), "conv_id"))
    out = nodes.join(below.unionByName(at_root), "id").join(list_hashes(ends), "id", "left")
    return out.select(
        F.col("rep").alias("conv_id"), "depth", F.col("up_rep").alias("parent_conv_id"), F.col("members").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"),
        (F.col("shared") - F.col("rep_shared") - (F.col("members") - 1) * F.col("prior")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def list_hashes(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """``id, ends_sha256``: SHA-256 of the conv_ids of each id, ascending, comma-joined.

    Lists are joined in pieces of ``piece`` members; those of several pieces are fed to the hash one piece after another."""
    x = in_groups(ends, ["id"], [F.col("conv_id").asc()])
    x = x.groupBy("id", F.expr(f"_row div {piece}").alias("piece")).agg(F.max("_rows").alias("n"), F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    x = materialise(x, "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h = None, None
        for b in batches:
            for i, ids in zip(b.column("id").to_pylist(), b.column("ids").to_pylist()):
                i = (i["a"], i["b"])
                if i != at:
                    if h:
                        yield row(at, h)
                    at, h = i, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
        if h:
            yield row(at, h)

    def row(at, h):
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([h.hexdigest()])], ["a", "b", "ends_sha256"])

    long = x.filter(F.col("n") > piece).select("id", "piece", "ids").repartition("id").sortWithinPartitions("id", "piece").select("id", "ids").mapInArrow(run, "a long, b long, ends_sha256 string")
    return x.filter(F.col("n") <= piece).select("id", F.sha2("ids", 256).alias("ends_sha256")).unionByName(long.select(_id(F.col("a"), F.col("b")).alias("id"), "ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, each rebuilt with its family's first turns; edge cases as in turns and trie."""
    return trie(*rebuilt(table(spark, sf_dir, "conversations")))


OP11_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT range AS i, range::UBIGINT AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
t AS (
  SELECT conv_id, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS g,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w, turn
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, g, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS pos FROM t),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS f, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 4)::BIGINT AS h
  FROM (SELECT DISTINCT conv_id FROM p), tab),
r0 AS (
  SELECT c.conv_id, pos, g, w FROM c JOIN p ON p.conv_id = c.f AND pos <= h
  UNION ALL
  SELECT c.conv_id, pos, g, w FROM c JOIN p ON p.conv_id = c.conv_id AND pos > h),
r1 AS (SELECT conv_id, g, w, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS d FROM r0),
r AS (
  SELECT conv_id, d, w, sha256(string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM r1
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM c),
long AS (SELECT conv_id, max(d) AS n FROM r GROUP BY 1),
node AS (SELECT k, any_value(d) AS d, any_value(w) AS w, min(conv_id) AS rep, count(*) AS m FROM r GROUP BY k),
up AS (SELECT DISTINCT a.k, b.k AS pk FROM r a JOIN r b ON b.conv_id = a.conv_id AND b.d = a.d - 1),
kids AS (SELECT pk AS k, count(*) AS n FROM up GROUP BY 1),
below AS (SELECT b.k, a.k AS dk FROM node JOIN r a ON a.k = node.k AND a.conv_id = node.rep JOIN r b ON b.conv_id = a.conv_id AND b.d <= a.d),
sums AS (
  SELECT below.k, sum((m - 1) * w)::BIGINT AS saved_tokens, count(*) FILTER (kids.n IS NULL) AS n_leaves
  FROM below JOIN node ON node.k = below.dk LEFT JOIN kids ON kids.k = below.dk GROUP BY 1),
ends AS (SELECT k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS e FROM r JOIN long USING (conv_id) WHERE d = n GROUP BY 1)
SELECT node.rep AS conv_id, node.d AS depth, q.rep AS parent_conv_id, node.m AS n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM node JOIN sums USING (k) LEFT JOIN kids USING (k) LEFT JOIN up USING (k) LEFT JOIN node q ON q.k = up.pk LEFT JOIN ends ON ends.k = node.k
"""
