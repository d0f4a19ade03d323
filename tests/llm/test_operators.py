"""Each operator against a plain version, on small tables with nulls, blanks, copies, ties and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import decontaminate, exact_dedup, language, lengths, licenses, packing, privacy, quality, simhash, store
from loam.llm.components import components
from loam.llm.tokens import TRIAL, default_vocabulary, encoder

VOCAB = default_vocabulary()
LONG = " ".join(f"word{i % 997} and" for i in range(6000))
TEXTS = [
    None, "", " \n\t", "one", "One  two three four five", "one two three four five", "one two three four six", "Ünï cödé, <|endoftext|> don't 'S 123 #x\x1cy z ﬁn", LONG, LONG, LONG + " end",
    "mail a@b.com_x@y.z to 1.2.3.4.5.6.7.8 or 4111 1111 1111 1111, +1 (202) 555-0133", "one two three four five", "🙂🙂 🙂", "a" * 5000, "1 " * 3000,
]


@pytest.fixture(scope="module")
def docs(spark):
    """Ids repeat (the last two rows) and are null once; extra columns clash with names that operators use."""
    ids = [*range(len(TEXTS) - 2), 3, None]
    rows = [(i, t, "en", "src", 0, 7, 7, 7) for i, t in zip(ids, TEXTS)] + [(3, TEXTS[3], "en", "src", 0, 7, 7, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row_id long, kept long, score long").coalesce(2)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def ids_of(text, end):
    return encoder(VOCAB).tok.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def key(x):
    return tuple((v is None, v if v is not None else 0) for v in x)


def test_encoder_equals_the_tokenizer():
    e = encoder(VOCAB)
    assert e.by_words
    odd = [*TRIAL, "<|startoftext|>a <|ENDOFTEXT|> b", "ΑΣ Σ ǅ İ", "a²b ×÷ ªº µ", "é ́x", "x\ty\r\nz", "'s 't don't'll 'RE", "  \x85q", *[t or "" for t in TEXTS]]
    for t, raw in zip(odd, e.encode(odd)):
        assert list(np.frombuffer(raw, e.type)) == e.tok.encode(t, add_special_tokens=False).ids, t


def test_store_round_trip(spark, docs, rows, tmp_path):
    path = f"file://{tmp_path}/s"
    store.write_store(docs, path, VOCAB, 2, parts=3)
    assert store.verify(spark, path)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    want, at = [], 0
    for i in order:
        x = ids_of(rows[i][1], 2)
        want.append((rows[i][0], at, len(x), crc(x), True))
        at += len(x)
    got = [tuple(r) for r in store.digests(spark, path, 2).orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32", "intact").collect()]
    assert got == want
    whole = {r["start"]: b"".join(r["ids"]) for r in store.read_store(spark, path).collect()}
    assert [crc(np.frombuffer(whole[w[1]], "<u2")) for w in want] == [w[3] for w in want]
    n = spark.read.parquet(f"{path}/chunks").agg(F.count("*"), F.countDistinct("hash")).first()
    assert n[0] == n[1] and sorted(p.name for p in (tmp_path / "s").iterdir()) == ["chunks", "manifest", "nodes", "parts", "recipes"]
    # beyond the broadcast bound the same chunks are kept
    store.write_store(docs, path + "2", VOCAB, 2, parts=2, broadcast_bytes=0)
    assert spark.read.parquet(f"{path}2/chunks").exceptAll(spark.read.parquet(f"{path}/chunks")).count() == 0


def test_store_finds_damage(spark, docs, tmp_path):
    path = f"file://{tmp_path}/s"
    store.write_store(docs, path, VOCAB)
    c = spark.read.parquet(f"{path}/chunks")
    bad = c.orderBy("hash").limit(1)
    c.exceptAll(bad).unionByName(bad.withColumn("ids", F.concat("ids", F.lit(b"\x01\x00")))).write.parquet(f"{path}/new")
    moved = str(tmp_path / "s")
    import os

    os.rename(moved + "/chunks", moved + "/old")
    os.rename(moved + "/new", moved + "/chunks")
    assert not store.verify(spark, path)


def test_tree_of_bounded_nodes(spark, tmp_path, monkeypatch):
    """Nodes fold FAN children at most, on as many levels as it takes; any changed root shows at the top."""
    monkeypatch.setattr(store, "FAN", 4)
    roots = [(p, i, hashlib.sha256(f"{p}/{i}".encode()).hexdigest()) for p, n in ((0, 70), (1, 3), (5, 1)) for i in range(n)]
    d = spark.createDataFrame(roots, "part long, place long, root string")
    got = {(r["part"], r["level"], r["place"]): r["root"] for r in store.tree(d).collect()}
    fold = lambda xs: hashlib.sha256("".join(xs).encode()).hexdigest()
    for p in (0, 1, 5):
        level, k = [r for q, _, r in roots if q == p], 0
        while k < 4:
            level, k = [fold(level[i : i + 4]) for i in range(0, len(level), 4)], k + 1
            assert [got[p, k, i] for i in range(len(level))] == level
    assert len(got) == 18 + 5 + 2 + 1 + 4 + 4 and {r["part"]: r["root"] for r in store._tops(store.tree(d)).collect()}[0] == got[0, 4, 0]


def test_cuts_are_local():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 49000, 9000), rng.integers(0, 49000, 500)
    ends = store.cuts(a)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(a) and sizes[:-1].min() >= store.LEAST and sizes.max() <= store.MOST
    chunks = lambda x: {x[s:e].tobytes() for s, e in zip([0, *store.cuts(x)], store.cuts(x))}
    both = np.concatenate([b, a])
    assert len(chunks(a) & chunks(both)) >= len(ends) - 3
    assert store.cuts(np.zeros(10000, int))[-1] == 10000 and store.cuts(np.zeros(0, int)) == []


def test_crc_of_parts():
    rng = np.random.default_rng(1)
    parts = [rng.bytes(n) for n in (0, 1, 7, 100000, 3)]
    after = np.array([sum(map(len, parts[i + 1 :])) for i in range(len(parts))])
    x = store.shifted(np.array([zlib.crc32(p) for p in parts], np.uint32), after)
    assert int(np.bitwise_xor.reduce(x)) == zlib.crc32(b"".join(parts))


def test_store_of_an_empty_table(spark, docs, tmp_path):
    path = f"file://{tmp_path}/e"
    store.write_store(docs.limit(0), path, VOCAB)
    assert store.digests(spark, path, 2).count() == 0
    m = spark.read.parquet(f"{path}/manifest").first()
    assert (m["n_docs"], m["n_tokens"]) == (0, 0)


def test_fill_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(60):
        cap = int(rng.integers(8, 40))
        items = rng.integers(1, cap, int(rng.integers(1, 9))).tolist()
        counts = [0] * cap
        for n in items:
            counts[n] += 1
        first = max(items)
        sums = {first}
        rest = items.copy()
        rest.remove(first)
        for n in rest:
            sums |= {s + n for s in sums if s + n <= cap}
        got = packing.fill(counts, cap, first)
        assert sum(n * c for n, c in got.items()) == max(sums) and got[first] >= 1
        assert all(c <= counts[n] for n, c in got.items())


def check_pieces(pieces, rows, capacity=2048):
    want = Counter((d, crc(ids_of(t, 1))) for d, t in rows)
    texts = {crc(ids_of(t, 1)): np.array(ids_of(t, 1), "<u4") for _, t in rows}
    seqs = {}
    for p in pieces:
        seqs.setdefault(p["sequence_id"], []).append(p)
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] >= 1
            at += p["length"]
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
    assert sum(p["length"] for p in pieces) == sum(len(texts[c]) * n for (_, c), n in want.items())
    by = Counter()
    for p in pieces:
        fits = [c for c, x in texts.items() if len(x) == p["doc_tokens"] and zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]]
        assert fits
        by[p["doc_id"]] += p["length"]
    total = Counter()
    for (d, c), n in want.items():
        total[d] += len(texts[c]) * n
    assert by == total


@pytest.mark.parametrize("group", [4_000_000, 500])
def test_packing(spark, docs, rows, group):
    pieces = packing.pack(docs, VOCAB, 2048, 1, group).collect()
    check_pieces(pieces, rows)
    assert packing.pack(docs.limit(0), VOCAB).count() == 0


def test_length_histogram(spark, docs, rows):
    n = [len(ids_of(t, 0)) - 1 for _, t in rows]
    h = lengths.length_histogram(lengths.encoded_lengths(docs, VOCAB))
    for r in h.collect():
        x = r["length"]
        assert r["n_docs"] == n.count(x) and r["docs_ge"] == sum(v >= x for v in n) and r["tokens_ge"] == sum(v for v in n if v >= x)
        assert r["docs_lt"] == sum(v < x for v in n) and r["tokens_lt"] == sum(v for v in n if v < x) and r["truncated_total"] == sum(min(v, x) for v in n)
    assert h.count() == len(set(n)) and lengths.length_histogram(lengths.encoded_lengths(docs.limit(0), VOCAB)).count() == 0
    ask = [0, 1, 2, 3, 1000, 1024, 2047, 2048, 5000, max(n) - 1, max(n), max(n) + 1, 10**6]
    t = lengths.truncated_totals(h, spark.createDataFrame([(x,) for x in [*ask, 3, None]], "limit long")).orderBy("limit").collect()
    assert [(r["limit"], r["total"], r["left"], r["cut_docs"]) for r in t] == [(x, sum(n), sum(min(v, x) for v in n), sum(v > x for v in n)) for x in sorted(set(ask))]
    none = lengths.truncated_totals(h.limit(0), spark.createDataFrame([(3,)], "limit long")).collect()
    assert [tuple(r) for r in none] == [(3, 0, 0, 0)]
    assert lengths.length_quantile(h, 0.5).first()["length"] == sorted(n)[(len(n) + 1) // 2 - 1]


def plain_scan(text, items, size=13):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall(low(text))
    hit, found = set(), set()
    for k, t in items:
        x = word.findall(low(t))
        for i in range(max(1, len(x) - size + 1)) if x else []:
            win = x[i : i + size]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit.update(range(j, j + len(win)))
                    found.add(str(k))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark):
    import random

    rng = random.Random(3)
    voc = ["a", "b", "É", "x1"]
    items = [(i, " ".join(rng.choices(voc, k=rng.choice([0, 1, 2, 5, 13, 14, 20])))) for i in range(12)] + [(50, None), (51, "A-b É")]
    texts = [" ".join(rng.choices([*voc, "zz"], k=rng.choice([0, 3, 30, 120]))) for _ in range(20)] + [items[4][1] + " tail", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for some in (items, [x for x in items if x[1] and len(x[1].split()) >= 5], []):
        b = spark.createDataFrame(some, "item_id long, text string")
        for shard in (10**6, 8):
            got = {r["doc_id"]: r for r in decontaminate.judged(decontaminate.scan(d, b, block_words=shard)).collect()}
            for i, t in enumerate(texts):
                n, hit, found = plain_scan(t, some)
                assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (n, hit, found)
                assert got[i]["contaminated"] == (hit > 0 and 20 * hit >= n)
            bad = {i for i in got if got[i]["contaminated"]}
            kept = {r["doc_id"] for r in decontaminate.clean(d, b, block_words=shard).collect()}
            assert kept == set(got) - bad


def test_items_without_an_id_and_repeated_row_ids(spark):
    item = " ".join(f"q{i}" for i in range(15))
    d = spark.createDataFrame([(1, "a clean text"), (1, "start " + item + " end"), (None, "x " + item + " y " + item), (3, None), (4, "")], "doc_id long, text string")
    b = spark.createDataFrame([(None, item), ("b1", item), ("a1", "clean"), ("z", None)], "item_id string, text string")
    for block in (10**6, 8):
        got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.judged(decontaminate.scan(d, b, block_words=block)).collect()), key=key)
        assert got == sorted([(1, 3, 1, ["a1"]), (1, 17, 15, ["", "b1"]), (None, 32, 30, ["", "b1"]), (3, 0, 0, []), (4, 0, 0, [])], key=key)
        assert decontaminate.scan(d.limit(0), b, block_words=block).count() == decontaminate.clean(d.limit(0), b, block_words=block).count() == 0
    long = d.filter("text like 'start%' or text like 'x %'").withColumn("text", F.concat("text", F.lit(" w" * 700)))
    assert sorted(r["text"][:8].strip() for r in decontaminate.remove_spans(long, b).collect()) == ["start  e", "x  y  w"]


def test_spans_are_cut(spark):
    item = " ".join(f"q{i}" for i in range(15))
    text = "start " + " ".join(f"f{i}" for i in range(400)) + " Q0, " + item[3:] + " end é"
    d = spark.createDataFrame([(1, text, 5), (2, item, 5), (3, "clean", 5)], "doc_id long, text string, _spans int")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(d, b).collect()}
    assert set(got) == {1, 3} and got[1] == "start " + " ".join(f"f{i}" for i in range(400)) + "  end é"
    assert {r["doc_id"] for r in decontaminate.remove_spans(d, b, most_words=10).collect()} == {3}


def test_exact_groups(spark, docs, rows):
    want = {}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for i, (d, t) in enumerate(rows):
        want.setdefault(norm(t), []).append((-len(t or ""), d is None, d or 0, i))
    for limit in (64 << 20, 0):
        got = exact_dedup.exact_groups(docs, broadcast_bytes=limit).collect()
        assert len(got) == len(rows)
        for k, g in want.items():
            h = hashlib.sha256(k.encode()).hexdigest()
            own = [r for r in got if r["text_sha256"] == h]
            best = min(g)
            assert len(own) == len(g) and all(r["group_size"] == len(g) for r in own)
            assert {r["keep_id"] for r in own} == {None if best[1] else best[2]} and sum(r["kept"] for r in own) == 1
    for limit in (64 << 20, 0):
        out = exact_dedup.exact_dedup(docs, limit)
        assert out.columns == docs.columns and out.count() == len(want)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_texts_are_never_shuffled(spark, tmp_path):
    """Beyond the broadcast bounds too, and with Spark's own broadcasts off, no exchange carries a text."""
    path = f"file://{tmp_path}/d"
    spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 3000).cast("string")).alias("text"), F.lit("x").alias("lang")).repartition(3).write.parquet(path)
    d = spark.read.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for limit in (64 << 20, 0):
            out = exact_dedup.exact_dedup(d, limit)
            assert out.count() == 3000
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x], plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_are_dropped_in_ranges(spark):
    from loam.llm.components import drop_rows, numbered

    rows = numbered(spark.range(200_000, numPartitions=5).withColumn("_block", F.lit("own")), "n")
    gone = rows.filter("id % 3 = 0").select("n")
    for limit in (1 << 20, 8192, 0):
        got = drop_rows(rows, gone, "n", limit)
        assert got.columns == rows.columns and got.count() == 133_333 and got.filter("id % 3 = 0").count() == 0


def test_repetitive_items_take_linear_time():
    import time

    t = time.time()
    auto = decontaminate.Automaton([("a", [b"w"] * 300_000)], 13)
    n, spans, items, best = decontaminate.matches(auto, "w " * 300_000)
    assert (n, spans, items, best) == (300_000, [[0, 300_000]], {"a"}, 300_000) and time.time() - t < 30


def test_filter_never_misses(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2500).cast("string").alias("key"))
    f = exact_dedup.flagged(d, "key", 1 << 20).collect()
    assert all(r["maybe"] for r in f if r["doc_id"] % 2500 < 500)
    assert sum(r["maybe"] for r in f) < 1000 + 300


def plain_fingerprint(t):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash(spark, docs, rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    got = simhash.near_groups(docs).collect()
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((d, f"{f:016x}") for (d, _), f in zip(rows, fps))
    near = lambda a, b: (a ^ b).bit_count() <= 4
    for r in got:
        f = int(r["fingerprint"], 16)
        reach, todo = set(), [f]
        while todo:
            x = todo.pop()
            if x not in reach:
                reach.add(x)
                todo += [y for y in fps if near(x, y)]
        ids = [d for (d, _), y in zip(rows, fps) if y in reach and d is not None]
        assert r["component_id"] == (min(ids) if ids else None)
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_stages_drop_rows_not_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(300)), " ".join(f"b{i}" for i in range(300))
    rows = [(1, a, 0), (2, a, 1), (2, b, 2), (1, a, 3), (None, a, 4), (None, "c d e f g", 5), (None, "c d e f g", 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _row_id int").coalesce(1)
    kept = simhash.near_dedup(d)
    assert kept.columns == d.columns and sorted(r["_row_id"] for r in kept.collect()) == [0, 2, 5]
    items = spark.createDataFrame([(1, "c d e f g"), (2, a)], "item_id long, text string")
    for shard in (10**6, 8):
        assert [r["_row_id"] for r in decontaminate.clean(d, items, block_words=shard).collect()] == [2]
    assert [r["_row_id"] for r in decontaminate.remove_spans(d, items).collect()] == [2]


@pytest.mark.parametrize("layout_rows", [1000, 1 << 40])
def test_trie_join_finds_every_link(spark, layout_rows, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:20]:
        for _ in range(30):
            x = int(b)
            for k in rng.choice(64, int(rng.integers(0, 7)), replace=False):
                x ^= 1 << int(k)
            fps.add(x)
    fps = sorted(fps)
    whole = simhash.layouts
    monkeypatch.setattr(simhash, "layouts", lambda n, d: whole(layout_rows, d))
    monkeypatch.setattr(simhash, "LARGE", 20)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    d = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash.links(d)).collect()}
    par = list(range(len(fps)))

    def root(i):
        while par[i] != i:
            i = par[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 4:
                par[root(i)] = root(j)
    mine = {}
    for i, s in enumerate(signed):
        mine.setdefault(root(i), set()).add(s)
    theirs = {}
    for s in signed:
        theirs.setdefault(got.get(s, s), set()).add(s)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_trie_forest_of_a_dense_ball():
    v = np.array(sorted({0} | {1 << i | 1 << j for i in range(64) for j in range(64)}), np.uint64)
    t = simhash.Trie(v, 4)
    t.join(np.array([[0], [len(v)], [0], [len(v)], [0]]), 0)
    a, b = t.forest()
    assert len(a) == len(v) - 1 and set(a.tolist()) == {0}


def test_components_of_chains(spark):
    n = 200
    e = [(i, i + 1) for i in range(n)] + [(1000, 1000), (2000, 2001), (2001, 2000)] + [(5000, 5000 + i) for i in range(1, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and got[2001] == 2000 and all(got[5000 + i] == 5000 for i in range(300))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    def ok(k, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[k]

    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, t or "") if ok(k, m[0])]


def test_private_values(spark, docs, rows):
    import random

    rng = random.Random(7)
    more = ["".join(rng.choices("ab1234.@-_+ ()%é🙂", k=60)) for _ in range(300)] + ["001.02.3.0004 256.1.1.1 1.2.3.99999999999999999999", "4111-1111-1111-1111-1", "a" * 3000 + "@", "+1" + "(" * 3000]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    for r in privacy.found(d).collect():
        assert [(s["kind"], s["s"], s["e"]) for s in r["base"]] == plain_spans(r["text"]), r["text"][:200]


def wilson(k, n, z=1.645):
    p = k / n
    return (p + z * z / 2 / n - z * (p * (1 - p) / n + z * z / 4 / n / n) ** 0.5) / (1 + z * z / n)


def test_revealing_terms(spark):
    rows = [(i, f"{'Zorblax ' if i < 12 else ''}w{i} a@b.com is here\nplain line {i}") for i in range(16)] + [(i, f"filler text {i} is here") for i in range(16, 90)] + [(90, "zorblax without value"), (91, None), (92, rows0(0)), (93, rows0(0))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    x = privacy.private_spans(d)
    got = {r["doc_id"]: [(t["kind"], t["s"], t["e"]) for t in r["terms"]] for r in x.collect()}
    share = np.log(wilson(12, 13) / (16 / 92)) / -np.log(16 / 92)  # the copies are no further texts
    assert share >= 0.5 and got[0] == got[92] == [("term_removed" if share >= 0.8 else "term_email", 0, 7)] and got[13] == [] and got[90] == [] and got[91] == [] and len(got) == 94
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitised(x).collect()}
    assert clean[0] == ("" if share >= 0.8 else "[term_email]") + " w0 [email] is here\nplain line 0" and clean[91] == "" and clean[20] == "filler text 20 is here"
    every = privacy.materialise(privacy.found(d), "found")
    once = privacy.different(every)
    assert once.count() == 92 and sorted(r["doc_id"] for r in every.select("doc_id").subtract(once.select("doc_id")).collect()) == [92, 93]
    got = {(r["term"], r["value"]): r["share"] for r in privacy.revealing_terms(once, once.filter(F.size("base") > 0), threshold=-9).collect()}
    assert got["zorblax", "a@b.com"] == pytest.approx(share)
    assert privacy.private_spans(d, broadcast_bytes=0).filter("size(terms) > 0").count() == 14
    assert privacy.private_spans(d.limit(0)).count() == 0


def rows0(i):
    return f"Zorblax w{i} a@b.com is here\nplain line {i}"


def test_planted_associations_are_found_and_chance_is_not(spark):
    """A word that stands near one address in 20 texts is found whole; words of one or two contexts are not, nor is anything once
    the values are dealt over the rows that hold some."""
    import random

    rng = random.Random(4)
    voc = [f"v{i}" for i in range(3000)]
    line = lambda k=12: " ".join(rng.choices(voc, k=k))
    values = [f"u{i % 25}@dom{i % 5}.org" for i in range(150)]
    rows = [f"{line()} {'Planted' if i < 20 else ''} {{}} {line()}\n{line(60)}" for i in range(150)]
    own = ["boss@corp.net" if i < 20 else values[i] for i in range(150)]
    rest = [line(80) for _ in range(300)] + ["once near quux@lone.com here", "quux again"]

    def terms(vs):
        texts = [r.format(v) for r, v in zip(rows, vs)] + rest
        x = privacy.private_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), every_row=True)
        return Counter(t["value"] for r in x.collect() for t in r["terms"])

    got = terms(own)
    assert got["planted"] == 20 and sum(got.values()) <= 21
    rng.shuffle(own)
    assert sum(terms(own).values()) <= 1


def test_terms_in_every_row(spark):
    rows = [(i, f"{'Zorblax ' if i < 12 else ''}w{i} a@b.com is here") for i in range(14)] + [(i, f"filler text {i} is here") for i in range(14, 90)]
    rows += [(90, "zorblax without value"), (91, "Quux is at c@d.org here"), (92, "quux once more"), (93, "+1 202 555 0133 is text")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (64 << 20, 0):
        got = {r["doc_id"]: [r["text"][t["s"] : t["e"]] for t in r["terms"]] for r in privacy.private_spans(d, broadcast_bytes=limit, every_row=True).collect()}
        assert got[0] == ["Zorblax"] and got[90] == ["zorblax"]
        assert got[91] == got[92] == got[13] == got[20] == got[93] == [] and len(got) == 94  # one context is no estimate


def test_language_held_out(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    f = language.learn(d)
    p = language.identify(d, f).join(d.select("doc_id", "lang"), "doc_id").filter(quality.remainder() == 2).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in p) >= 0.95 * len(p) and all(0 <= r["score"] <= 1 for r in p)


def test_language_edges(spark, docs):
    f = language.learn(docs)
    got = language.identify(docs, f).collect()
    assert len(got) == docs.count() and {r["lang_pred"] for r in got} == {"en", "und"}
    none = language.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}


def test_language_filter_is_bit_sliced():
    g = {k: np.unique(language.grams(t)) for k, t in (("x", "abcd efgh"), ("y", "efgh ijkl"))}
    f = language.Filters(g)
    both = np.intersect1d(g["x"], g["y"])
    assert f.counts(both).tolist() == pytest.approx([len(both)] * 2, rel=0.01)
    assert f.counts(np.setdiff1d(g["x"], g["y"]))[1] < 1


def test_more_than_64_languages(spark):
    word = lambda i: "".join(chr(0x4E00 + 20 * i + j) for j in range(12))
    d = spark.createDataFrame([(20 * i + j, word(i), f"l{i:03}") for i in range(150) for j in range(12)], "doc_id long, text string, lang string")
    got = language.identify(d, language.learn(d)).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1800 and all(r["lang"] == r["lang_pred"] for r in got)


def test_quality_held_out(spark, sf):
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    s = quality.scored(d.select("doc_id", "text"), quality.train(d, lab)).join(lab, "doc_id").filter(quality.remainder() == 2).collect()
    good = sum((r["score"] >= 0.7) == (r["quality"] == 1) for r in s)
    assert good >= 0.9 * len(s) and all(0 <= r["score"] <= 1 for r in s)


def test_quality_edges(spark, docs):
    lab = spark.createDataFrame([(i, i % 2) for i in range(14)] + [(None, 1), (1, None)], "doc_id long, quality int")
    m = quality.train(docs, lab)
    got = quality.scored(docs, m).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.train(docs, lab.limit(0)).score("x") == 0.5 and quality.train(docs, lab.filter("quality = 1")).score(None) == 1.0
    assert quality.accepted(docs, lab).columns == docs.columns


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    y = np.where(np.arange(80) % 2, 1, -1)
    x = [np.unique(np.r_[rng.integers(10, 400, 20), 1 if s > 0 else 2]).astype(np.int32) for s in y]
    r = quality._ratio(x, y)
    w, b = quality._fit(x, y, r, 1.0, 20, 0)
    assert all(s * (float(w[i] @ quality._scaled(i, r)) + b) > 0 for i, s in zip(x, y))


def test_licenses(spark):
    rows = [(1, "text\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache Licence, Version 2.0"), (3, "my driving license expired on monday"), (4, None), (None, "All rights reserved."), (5, "x " * 4000 + "Licensed under CC BY-NC 4.0. " + "y " * 4000), (6, "This work is licensed under the GNU General Public License, version 3.")]
    got = licenses.license_blocks(spark.createDataFrame(rows, "doc_id long, text string"))
    by = {r["doc_id"]: (r["license"], r["verdict"]) for r in got.collect()}
    assert by[1] == ("MIT", "exact") and by[2] == ("Apache-2.0", "modified") and by[3][1] == "rejected" and by[None][0].endswith("All-Rights-Reserved")
    assert by[5] == ("CC-BY-NC-4.0", "exact") and by[6] == ("GPL-3.0", "exact") and 4 not in by
    r = got.filter("doc_id = 1").first()
    assert rows[0][1][r["start"] : r["end"]] == "Released under the MIT License." and r["conditional_bytes"] < r["plain_bytes"]
    assert {r["doc_id"]: r["licenses"] for r in licenses.licenses(got).collect()}[1] == ["MIT"]


MIT_TEXT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD_TEXT = """Copyright (c) 2020, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice."""
APACHE_TEXT = """# Copyright 2020 Some One
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at"""


def test_wrapped_licenses():
    got = lambda t: {(r[2], r[7]) for r in licenses.notices(t) if r[7] != "rejected"}
    assert got(MIT_TEXT) == {("MIT", "exact"), ("MIT", "modified")} and got(MIT_TEXT.split("\n", 1)[1]) == {("MIT", "modified")}
    assert ("BSD-2-Clause", "exact") in got(BSD_TEXT) and ("BSD-3-Clause", "exact") not in got(BSD_TEXT)
    assert ("BSD-3-Clause", "exact") in got(BSD_TEXT + "\n3. Neither the name of the holder nor the names of its contributors may be used.")
    assert got(APACHE_TEXT) == {("Apache-2.0", "exact")}
    assert got("// SPDX-License-Identifier: MIT") == {("MIT", "exact")}
    assert got("SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) OR EPL-2.0") == {("GPL-2.0", "exact"), ("EPL-2.0", "exact")}
    four = ["Released under the MIT License.", "Licensed under the BSD 3-Clause License.", "Licensed under CC BY 4.0.", "Licensed under the Apache Licence, Version 2.0"]
    text = "\n".join(four)
    assert got(text) == {("MIT", "exact"), ("BSD-3-Clause", "exact"), ("CC-BY-4.0", "exact"), ("Apache-2.0", "modified")}
    assert [text[r[0] : r[1]] for r in licenses.notices(text)] == four


def _verdicts(text):
    return {(r[2], r[7]) for r in licenses.notices(text) if r[7] != "rejected"}


def test_versions_and_shared_wordings():
    gnu = lambda what, name, v, stop=";": f"# This {what} is free software{stop} you can redistribute it and/or modify\n# it under the terms of the {name} as published by\n# the Free Software Foundation; either version {v} of the License, or\n# (at your option) any later version."
    cases = [(gnu("program", "GNU General Public License", "2"), "GPL-2.0"), (gnu("program", "GNU General Public License", "3", ":"), "GPL-3.0"),
             (gnu("library", "GNU Lesser General Public License", "2.1"), "LGPL-2.1"), (gnu("library", "GNU Lesser General Public License", "3", ":"), "LGPL-3.0"),
             (gnu("program", "GNU Affero General Public License", "3", ":"), "AGPL-3.0")]
    for text, name in cases:
        assert _verdicts(text) == {(name, "exact")}, text
        assert _verdicts(text.replace("redistribute it", "share it")) == {(name, "modified")}, text
    assert _verdicts(gnu("program", "GNU General Public License", "1")) == set()
    assert _verdicts("Licensed under the Apache License, Version 1.1") == set()
    assert _verdicts("Licensed under CC BY-SA 3.0.") == set()
    assert _verdicts(licenses.GRANT) == {("0BSD OR ISC", "exact")} and _verdicts(licenses.BSD) == {("BSD-1-Clause OR BSD-2-Clause OR BSD-3-Clause", "exact")}
    isc = licenses.GRANT[:-1] + licenses.ISC_TERMS + licenses.AS_IS_ISC
    assert _verdicts(isc) == {("ISC", "exact")} and _verdicts(licenses.GRANT + licenses.AS_IS_ISC) == {("0BSD", "exact")}
    assert _verdicts(licenses.BSD + licenses.BSD_1 + licenses.BSD_2) == {("BSD-2-Clause", "exact")}
    assert _verdicts(licenses.BSD + licenses.BSD_1 + licenses.BSD_2 + licenses.BSD_3) == {("BSD-3-Clause", "exact")}


def test_whole_license_texts_in_comments():
    """Every whole text, wrapped in a comment between other lines, is found as itself and nothing else."""
    import textwrap

    for name, t in licenses.TEMPLATES[licenses.TEMPLATES.index(("Apache-2.0", licenses.APACHE)) :]:
        lines = "\n".join(" * " + x for p in t.split("\n") for x in textwrap.wrap(p, 70))
        text = "int before;\n" * 200 + "/*\n" + lines + "\n */\n" + "int after;\n" * 200
        assert _verdicts(text) == {(name, "exact")}, name


def test_licenses_against_plain_compression():
    """Of wordings with a few words changed, the row's sizes are those of plain zstandard with the template as raw
    dictionary, and no template that the word check admits for the same span reduces it more."""
    import random

    import zstandard as z

    def plain(text, template=None):
        d = z.ZstdCompressionDict(template.encode(), dict_type=z.DICT_TYPE_RAWCONTENT) if template else None
        return len(z.ZstdCompressor(level=19, write_content_size=False, **({"dict_data": d, "write_dict_id": False} if d else {})).compress(text.encode()))

    rng, n = random.Random(11), 0
    for name, t in licenses.TEMPLATES:
        w = t.split()
        for k in sorted(rng.sample(range(len(w)), max(1, len(w) // 12))):
            if not any(c.isdigit() for c in w[k]) and licenses.WORDS.findall(w[k].lower()) and not set(licenses.WORDS.findall(w[k].lower())) & licenses.TELLING:
                w[k] = "changed"
        text = "Some notes come first\n" + " ".join(w) + "\nlicense and more"
        for r in licenses.notices(text):
            a, b, i = r[0], r[1], r[3]
            if i >= 0 and i < len(licenses.TEMPLATES):
                assert (r[4], r[5]) == (plain(text[a:b]), plain(text[a:b], licenses.TEMPLATES[i][1])) and r[6] == pytest.approx((r[4] - r[5]) / r[4])
            if r[7] == "modified":
                n += 1
                have = [x.lower() for x in licenses.WORDS.findall(text[a:b])]
                for j, (_, other) in enumerate(licenses.TEMPLATES):
                    want = [x.lower() for x in licenses.WORDS.findall(other)]
                    d = licenses._difference(want, have)
                    if d[0] == "modified" and d[3] == (0, len(have)) and not licenses._VERSIONS[j] & set(d[1]) and not licenses.TELLING & {*d[1], *d[2]}:
                        assert r[6] >= (r[4] - plain(text[a:b], other)) / r[4]
    assert n > 20


def test_language_against_sets_of_grams(spark):
    """Learning and prediction by plain sets of n-grams (the filters' false positives aside)."""
    import random

    rng = random.Random(4)
    alphabets = {"x": "abcdefgh", "y": "efghijkl", "z": "klmnopqé", "w": "жзийклмн"}
    text = lambda a: " ".join("".join(rng.choices(a, k=rng.randint(1, 7))) for _ in range(rng.randint(3, 30)))
    rows = [(i, text(alphabets[k]) if i % 11 else None, k if i % 7 else None) for i, k in enumerate(rng.choices("xyzw", k=160))]
    rows += [(500, "12 34 !!", "x"), (501, "", "y"), (502, "\U00030001\U00030002", None), (None, "abc", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def plain(t):
        s = " ".join("".join(c if c.isalpha() else " " for c in (t or "").lower()).split())
        s = f" {s} " if s else ""
        return [s[i : i + n] for n in language.LENGTHS for i in range(len(s) - n + 1) if s[i : i + n] != " "]

    known = {}
    for i, t, k in rows:
        if i is not None and t is not None and k is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            known.setdefault(k, set()).update(plain(t))
    got = {r["doc_id"]: r for r in language.identify(d, language.learn(d, grams_each=10**6)).collect()}
    for i, t, _ in rows:
        g = plain(t)
        n = {k: sum(x in known[k] for x in g) for k in sorted(known)}
        if not g:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
        elif sum(n.values()):
            top = max(n.values())
            assert n[got[i]["lang_pred"]] >= top - 0.5 and got[i]["score"] == pytest.approx(top / sum(n.values()), abs=0.02)
        else:
            assert got[i]["lang_pred"] in known  # letters that no language has


def test_language_of_an_empty_table(spark, docs):
    assert language.identify(docs.limit(0), language.learn(docs)).count() == 0
    assert licenses.license_blocks(docs.limit(0)).count() == 0


def test_quality_features_by_hand():
    """The n-grams of a text, by strings."""
    for t in ["Ab c. Ab Ab ab é\n#1", "x", "  ", "one one one two", "Z9,!|%&*$ 🙂"]:
        cls = "".join(f"{quality.MARKS.get(c, 0 if c.isspace() else 3 if c.isupper() else 2 if c.isalpha() else 4 if c.isdigit() else 14 if ord(c) < 128 else 15):x}" for c in t)
        cls = re.sub(r"(.)\1+", r"\1", cls)
        shapes = {cls[i : i + n] for n in range(1, quality.SHAPES + 1) for i in range(len(cls) - n + 1)}
        w = t.lower().split()
        same = "".join("1" if a == b else "0" for a, b in zip(w, w[1:]))
        runs = {same[i : i + n] for n in range(1, quality.REPEATS + 1) for i in range(len(same) - n + 1)}
        at = {quality._SHAPE_AT[len(x) - 1] + int(x, 16) for x in shapes} | {quality._REPEAT_AT + (1 << len(x)) + int(x, 2) for x in runs}
        words = {quality._WORD_AT + zlib.crc32(x.encode()) % (1 << quality.WORD_BITS) for x in w}
        f = set(quality.features(t).tolist())
        assert at | words <= f and len(f - at - words) <= len(set(zip(w, w[1:])))
        assert all(x >= quality._WORD_AT + (1 << quality.WORD_BITS) for x in f - at - words)


def test_quality_model_is_the_optimum():
    """Ratios by plain counting, and a duality gap of almost nothing: primal and dual objective meet only at the optimum."""
    rng = np.random.default_rng(6)
    y = np.where(np.arange(60) % 3 > 0, 1, -1)
    x = [np.unique(rng.integers(0, 60 if s > 0 else 80, 15)).astype(np.int32) for s in y]
    r = quality._ratio(x, y)
    has = lambda k, s: 1 + sum(k in i for i, t in zip(x, y) if t == s)
    sums = {s: sum(has(k, s) for k in range(80)) + quality.SIZE - 80 for s in (1, -1)}
    for k in range(80):
        want = np.log(has(k, 1) / sums[1]) - np.log(has(k, -1) / sums[-1]) if has(k, 1) + has(k, -1) > 3 else 0
        assert r[k] == pytest.approx(want, abs=1e-5)
    cost = 1.0
    w, b = quality._fit(x, y, r, cost, 400, 0)
    caps = np.array([cost * 0.5 / (y == s).mean() for s in y])
    v = np.zeros((60, 80))
    for i, k in enumerate(x):
        v[i, k] = quality._scaled(k, r)
    m = y * (v @ w[:80] + b)
    primal = 0.5 * (float(w @ w) + b * b) + float((caps * np.maximum(0, 1 - m)).sum())
    # the dual variables follow from w only up to ties, so bound from below by projected descent on the same problem
    q = (v * y[:, None]) @ (v * y[:, None]).T + np.outer(y, y)
    a = np.zeros(60)
    for _ in range(20000):
        a = np.clip(a + (1 - q @ a) / np.linalg.norm(q, 2), 0, caps)
    assert primal == pytest.approx(float(a.sum() - 0.5 * a @ q @ a), rel=2e-3)
    model = quality.Model(r, w, b, 1.0, 0.0)
    plain = lambda t: 1 / (1 + np.exp(-(sum(w[k] * s for k, s in zip(quality.features(t), quality._scaled(quality.features(t), r))) + b)))
    for t in ("one two one", "", None, "x" * 300):
        assert model.score(t) == pytest.approx(plain(t), abs=1e-6)


def test_private_spans_against_plain_counting(spark):
    """Terms and the query's ``spans`` string by plain Python: words near values, document frequencies, the three conditions."""
    import math
    import random

    rng = random.Random(9)
    voc = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"] + ["Ünï", "İz", "x1", "77"]
    names = ["zora", "Quill", "blem", "Tarn", "Üve", "okto", "plim", "sarn"]
    values = ["z@acme.org", "q@acme.org", "b@home.net", "10.1.2.3", "10.1.9.9", "+1 202 555 0133", "4111 1111 1111 1111", "4111-1111-1111-1112"]
    texts = []
    for _ in range(200):
        line = lambda: " ".join(rng.choices(voc, k=rng.randint(3, 12)))
        t = [line() for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.5:
            v = rng.randrange(len(values))
            t[0] = f"{line()} {names[v] if rng.random() < 0.8 else ''} {values[v]} {line()} {rng.choice(values) if rng.random() < 0.2 else ''}"
        if rng.random() < 0.05:
            t.append(rng.choice(names) + " alone")
        texts.append("\n".join(t))
    texts += [None, "", texts[0], texts[0]]
    word = re.compile(r"(?<![^\W_])[^\W_]+")
    words = lambda t: [(m.start(), m.end(), m[0].lower()) for m in word.finditer(t or "") if any(c.isalpha() for c in m[0])]

    def ents(k, v):
        d = re.sub("[^0-9]", "", v)
        own = f"{k}:{d}" if k in ("card", "phone") else v.lower()
        wide = {"email": "@" + v.lower().split("@")[-1], "ip": ".".join(v.split(".")[:2]) + ".*", "card": "issuer:" + d[:6], "phone": "exchange:" + d[:-4]}[k]
        return [(own, False), (wide, True)]

    both, ctx, rows_of, df, kind_of = {}, {}, {}, Counter(), {}
    for i, t in enumerate(dict.fromkeys(t or "" for t in texts)):
        df.update({w for _, _, w in words(t)})
        for k, p in BASE.items():
            every = [(m.start(), m.end()) for m in re.finditer(p, t or "")]
            ok = {(s, e) for q, s, e in plain_spans(t) if q == k}
            for j, (s, e) in enumerate(every):
                if (s, e) in ok:
                    lo = max(every[j - 1][1] if j else 0, t.rfind("\n", 0, s) + 1)
                    hi = min(every[j + 1][0] if j + 1 < len(every) else len(t), t.find("\n", e) if "\n" in t[e:] else len(t))
                    near = [w for _, _, w in words(t[lo:s])][-8:] + [w for _, _, w in words(t[e:hi])][:8]
                    near = tuple(dict.fromkeys(near))
                    for ent, wide in ents(k, t[s:e]):
                        kind_of[ent] = k
                        rows_of.setdefault(ent, set()).add(i)
                        for w in near:
                            both.setdefault((ent, w), set()).add(i)
                            ctx.setdefault((ent, w), set()).add(near)
    n, best = len(set(t or "" for t in texts)), {}
    for (ent, w), r in both.items():
        p = len(rows_of[ent]) / n
        sure = wilson(len(r), df[w])
        share = math.log(sure / p) / math.log(1 / p)
        if len(ctx[ent, w]) >= 3 and sure >= 0.5 and share >= 0.5:
            best[w] = max(best.get(w, (0, "")), (share, kind_of[ent]))
    assert {"zora", "quill"} & set(best) and len(best) < 40
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit in (64 << 20, 0):
        for r in privacy.private_spans(d, broadcast_bytes=limit, every_row=True).collect():
            base = plain_spans(texts[r["doc_id"]])
            want = [(s, e, w, "term_removed" if best[w][0] >= 0.8 else "term_" + best[w][1]) for s, e, w in words(texts[r["doc_id"]]) if w in best and not any(a < e and s < b for _, a, b in base)]
            assert [(t["s"], t["e"], t["value"], t["kind"]) for t in r["terms"]] == want


def test_many_notices_take_linear_time():
    import time

    t = time.time()
    assert len(licenses.notices("All rights reserved.\n" * 100_000)) == 100_000 and time.time() - t < 30
