"""Prefix trie, Merkle manifest and HyperMinHash against plain versions, on small tables with nulls, blanks, ties and copies."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tests.oracle import connect, rows
from pyspark.sql import functions as F

from loam.functions.ranking import in_groups
from loam.llm import hyperminhash, merkle, prefix_trie
from loam.llm.queries import ORACLE_SQL, QUERIES


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_merkle_manifest", "op13_hyperminhash"])
def test_queries_equal_their_sql(spark, sf, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(connect(sf).execute(ORACLE_SQL[name]).df())


def test_places_and_sums_in_groups_over_parts(spark):
    data = [(None if i % 7 == 0 else f"g{i % 3}", i * 31 % 101, i) for i in range(200)]
    df = spark.createDataFrame(data, "k string, o int, v long").repartition(3)
    got = in_groups(df, ["k"], [F.col("o").asc(), F.col("v").asc()], {"s": (F.sum, F.col("v")), "x": (F.bit_xor, F.col("v"))}, parts=5).collect()
    groups = sorted({d[0] for d in data}, key=lambda k: (k is not None, k or ""))
    want = {}
    for no, k in enumerate(groups):
        s = x = 0
        of = sorted((o, v) for kk, o, v in data if kk == k)
        for i, (_, v) in enumerate(of):
            s, x = s + v, x ^ v
            want[v] = (no, i, len(of), s, x)
    assert {r["v"]: (r["_no"], r["_row"], r["_rows"], r["s"], r["x"]) for r in got} == want


# ---- prefix trie


def plain_trie(data):
    convs = defaultdict(list)
    for c, t, role, text in data:
        if c is not None:
            role, text = role or "", text or ""
            d = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            convs[c].append(((t is not None, t or 0), d, role, text))
    convs = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    full = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        full[c] = convs.get(first, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves = sum(out[x][6] for x in kids[k]) or 1
        saved = own + sum(out[x][7] for x in kids[k])
        ends = ",".join(str(c) for c in sorted(members[k]) if len(full[c]) == len(k))
        out[k] = (min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), sha(ends), leaves, saved)
    return sorted(map(str, out.values()))


def trie_rows(df):
    return sorted(str((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["ends_sha256"], r["n_leaves"], r["saved_tokens"])) for r in df.collect())


def random_conversations(seed):
    rng = random.Random(seed)
    out = []
    for c in [*range(-25, 75), 10**12, 10**12 + 3]:
        if rng.random() < 0.1:
            continue
        for t in range(rng.choice([1, 1, 2, 3, 5, 9, 14])):
            role = rng.choice(["user", "user", None, ""])
            text = rng.choice(["a b", "a  b c\n", "", None, "é ü", "x" * 3000]) if rng.random() < 0.35 else "same words here"
            out.append((c, t if rng.random() < 0.9 else rng.choice([None, 0]), role, text))
    return out


@pytest.mark.parametrize("block", [1, 2, 4])
def test_trie_equals_plain_version(spark, block):
    data = random_conversations(block)
    data += [(None, 0, "user", "belongs to none"), data[0]]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit(1), "digest": F.lit("x"), "q": F.lit(2)}).repartition(3)
    assert trie_rows(prefix_trie.trie(*prefix_trie.rebuilt(df), block=block)) == plain_trie(data)


def test_trie_of_turnless_conversations_and_of_none(spark):
    schema = "conv_id long, turn long, role string, text string"
    few = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 2)
    data = [(few, 0, "user", "gone")]  # its first turns would be those of conversation 0, which isn't there
    got = prefix_trie.trie(*prefix_trie.rebuilt(spark.createDataFrame(data, schema)))
    assert trie_rows(got) == plain_trie(data) and got.count() == 1
    assert prefix_trie.trie(*prefix_trie.rebuilt(spark.createDataFrame([], schema))).count() == 0


def test_one_long_conversation_and_many_equal_ones(spark):
    data = [(7, t, "user", f"turn {t}") for t in range(120)] + [(c, t, "user", f"same {t}") for c in range(1000, 1100) for t in range(3)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    assert trie_rows(prefix_trie.trie(*prefix_trie.rebuilt(df))) == plain_trie(data)


def test_lists_of_several_pieces(spark):
    ends = spark.range(95).select(F.struct((F.col("id") % 2).alias("a"), F.lit(5).cast("long").alias("b")).alias("id"), (F.col("id") * 37 % 95).alias("conv_id"))
    got = {r["id"]["a"]: r["ends_sha256"] for r in prefix_trie.list_hashes(ends, piece=10).collect()}
    assert got == {k: sha(",".join(map(str, sorted(i * 37 % 95 for i in range(95) if i % 2 == k)))) for k in (0, 1)}


# ---- Merkle manifest


def frame(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_manifest(data, fan, other=None):
    """Rows of (key, leaf, subroot, root, proof, folded)."""
    groups = defaultdict(list)
    for i, r in enumerate(data):
        groups[r[1]].append((r[0] is not None, r[0] or 0, sha("".join(map(frame, r[:5]))), i))

    def climb(hashes):
        """Steps (left, right) of each leaf and the top."""
        steps, at = [[] for _ in hashes], list(range(len(hashes)))
        while len(hashes) > 1:
            for leaf, p in enumerate(at):
                run = hashes[p // fan * fan : p // fan * fan + fan]
                steps[leaf].append(("".join(run[: p % fan]), "".join(run[p % fan + 1 :])))
            hashes = [sha("".join(hashes[i : i + fan])) for i in range(0, len(hashes), fan)]
            at = [p // fan for p in at]
        return steps, hashes[0]

    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s])]) for s in order}
    upper, root = climb([trees[s][1] for s in order])
    out = []
    for s, up in zip(order, upper):
        for (_, _, leaf, i), steps in zip(sorted(groups[s]), trees[s][0]):
            c = (other or {}).get(i, leaf)
            for left, right in steps + up:
                c = sha(left + c + right)
            out.append((data[i][0], leaf, trees[s][1], root, sha("".join(a + b for a, b in steps + up)), c))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree long, h string, idx int"


def documents(n):
    rng = random.Random(n)
    src = [None, "", "b", "é", "a", "a", "a"]
    out = [(i * 7 % n, rng.choice(src), rng.choice(["en", None]), i, rng.choice(["Some Text", "", None, "ÄB", "q" * 9000]), 1, "h", 2) for i in range(n)]
    return out + ([out[0], (None, "a", None, None, None, 1, "h", 2), (3, "a", "en", 1, "tie", 1, "h", 2)] if n > 1 else [])


@pytest.mark.parametrize("n,fan", [(70, 2), (90, 3), (300, 16), (1, 16)])
def test_manifest_equals_plain_version(spark, n, fan):
    data = documents(n)
    got = merkle.manifest(spark.createDataFrame(data, SCHEMA).repartition(3), fan=fan).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(data, fan)


def test_tampered_rows_fold_to_another_root(spark):
    data = documents(60)
    df = spark.createDataFrame(data, SCHEMA)
    other = F.when(F.col("doc_id") % 5 == 0, merkle.leaf(merkle.FIELDS, text=F.translate("text", merkle.UPPER, merkle.LOWER)))
    low = str.maketrans(merkle.UPPER, merkle.LOWER)
    changed = {i: sha("".join(map(frame, (*r[:4], r[4] and r[4].translate(low))))) for i, r in enumerate(data) if r[0] is not None and r[0] % 5 == 0}
    got = merkle.manifest(df, fan=4, other=other).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(data, 4, changed)
    assert 0 < sum(r["folded_root"] != r["root"] for r in got) < len(got)


def test_manifest_of_an_empty_table_and_one_of_files(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(empty).count() == 0
    data = documents(50)
    df = spark.createDataFrame(data, SCHEMA)
    path = f"file://{tmp_path}/m"
    root = merkle.write_manifest(df, path, fan=4)
    assert root == plain_manifest(data, 4)[0][3] and merkle.changed(df, path, fan=4).count() == 0
    other = df.withColumn("text", F.when(F.col("doc_id") == 7, F.lit("new")).otherwise(F.col("text"))).filter("doc_id is null or doc_id <> 9")
    got = {(r["doc_id"], r["change"]) for r in merkle.changed(other, path, fan=4).collect()}
    assert got == {(7, "new"), (7, "gone"), (9, "gone")}
    assert merkle.write_manifest(empty, path + "0") is None
    with pytest.raises(ValueError):
        merkle.manifest(df, fan=1)


# ---- HyperMinHash


def plain_sets(text, size=2):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(merkle.UPPER, merkle.LOWER)))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1)))


def plain_components(data, percent=80):
    sets = [plain_sets(t) for _, t in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(data):
        k = find(i)
        least[k] = min(least.get(k, (True, 0)), (d is None, d or 0))
    out = []
    for i, (d, _) in enumerate(data):
        none, c = least[find(i)]
        c = None if none else c
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def near_data(seed, n=240):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    out = []
    for g in range(n // 12):
        base = [word() for _ in range(rng.choice([3, 5, 6, 8, 20, 60, 250]))]
        for _ in range(12):
            ws = list(base)
            for _ in range(rng.randrange(0, max(2, len(ws) // 8))):
                ws[rng.randrange(len(ws))] = word()
            out.append(" ".join(ws))
    rng.shuffle(out)
    return [*enumerate(out)] + [(1000, None), (1001, ""), (1002, " \n"), (1003, "One"), (1004, "one"), (1005, "A b"), (1006, "a B"), (1006, "a B"), (None, "a b"), (1007, "ünï \x1cq"), (1008, "x " * 30000)]


@pytest.mark.parametrize("bounds", [{}, {"most_sets": 4}, {"most_sets": 2, "broadcast_bytes": 0}])
def test_near_groups_equal_brute_force(spark, bounds):
    data = near_data(5)
    df = spark.createDataFrame([(d, t, 1, "s", b"r") for d, t in data], "doc_id long, text string, n long, sig string, reg binary").repartition(3)
    got = hyperminhash.near_groups(df, **bounds).collect()
    assert sorted(map(tuple, got), key=str) == plain_components(data)


def test_large_buckets_are_clusters_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(hyperminhash, "MOST_IN_BUCKET", 3)
    data = near_data(9, 120)
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(map(tuple, hyperminhash.near_groups(df, most_sets=6).collect()), key=str) == plain_components(data)


def test_near_dedup_keeps_one_row_a_group(spark):
    data = near_data(3, 60)
    df = spark.createDataFrame([(d, t, 5) for d, t in data], "doc_id long, text string, row_id int")
    kept = hyperminhash.near_dedup(df)
    assert kept.columns == df.columns
    want = {r[2] for r in plain_components(data)}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.count() == len(want)
    none = hyperminhash.near_groups(spark.createDataFrame([], "doc_id long, text string"))
    assert none.count() == 0 and none.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_estimates_are_near_the_similarity_and_corrected_for_chance():
    rng = np.random.default_rng(1)
    for j in (0.0, 0.5, 0.8):
        est = []
        for _ in range(60):
            u = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) << np.uint64(1)
            both, half = int(3000 * j), (3000 - int(3000 * j)) // 2
            a, b = np.unique(u[: both + half]), np.unique(np.r_[u[:both], u[both + half :]])
            est.append(hyperminhash.estimates(hyperminhash.registers(a)[None], np.array([len(a)]), hyperminhash.registers(b), len(b))[0][0])
        assert abs(np.mean(est) - j) < 0.02, (j, np.mean(est))
    # registers hold leading zeros and ten bits after the leading one
    r = hyperminhash.registers(np.array([1 << 56 | 1 << 55, (3 << 57) | 5 << 20], np.uint64))
    assert r[0] == 1 << 9 and r[3] == (56 - 22) << 10 | 1 << 8 and (r == hyperminhash.EMPTY).sum() == 126


def test_bands_meet_for_linked_sets_of_all_sizes():
    rng = np.random.default_rng(2)
    missed = 0
    for n in (5, 6, 10, 40, 200, 1000):
        for _ in range(200):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1))
            b = np.unique(a[: -max(1, n // 5)])
            x, y = (hyperminhash.dense(hyperminhash.registers(s)).view(np.uint64) for s in (a, b))
            missed += not (x == y).any()
    assert missed == 0


# ---- token store: chunk borders of a batch


def test_chunk_borders_of_a_batch_are_those_of_each_document():
    import numpy as np

    from loam.llm import store

    r = np.random.default_rng(7)
    streams = [r.integers(0, 50_000, n).astype("<u2") for n in (0, 1, 15, 63, 64, 65, 700, 9000, 0, 40_000, 300)] + [np.full(9000, 7, "<u2")]
    for batch in (1, 500, 10_000, 1 << 18):
        assert list(store.cuts_of(streams, batch)) == [store.cuts(s) for s in streams]
    assert list(store.cuts_of([])) == []


def test_words_of_a_batch_are_encoded_as_whole_texts():
    from loam.llm.tokens import Encoder, default_vocabulary

    enc = Encoder(default_vocabulary())
    odd = [None, "", "\n", " ", "a\n\n b", " x ", "é z\tq\r\n w", "Ab, it's <|x|> 12,5.", "漢字 x", "\x00 a b", "one " * 3000, "w" * 5000]
    assert enc.encode(odd) == [enc._whole(t or "") for t in odd]
    assert enc.encode([]) == [] and enc.encode([None, None]) == [b"", b""]
