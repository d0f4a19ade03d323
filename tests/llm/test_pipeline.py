"""The registered queries against their SQL, and the pipeline against a plain version of its stages."""

import hashlib
import re

import pytest

import corpus_pipeline
from loam.llm import quality
from loam.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_operators import check_pieces, crc, ids_of, plain_fingerprint, plain_scan, plain_spans
from tests.oracle import connect, rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        assert rows(got) == rows(connect(sf).execute(ORACLE_SQL[name]).df())


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def sha(xs):
    return hashlib.sha256(",".join(xs).encode()).hexdigest()


def test_token_output_rows(spark, sf, texts):
    want, at = [], 0
    for d in sorted(texts):
        x = ids_of(texts[d], 2)
        want.append((d, at, len(x), crc(x), True))
        at += len(x)
    got = QUERIES["op1_token_output"](spark, sf)
    assert got.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert [tuple(r)[:5] for r in got.orderBy("doc_id").collect()] == want


def test_decontamination_rows(spark, sf, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op2_decontamination"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        n, hit, found = plain_scan(t, items)
        assert tuple(got[d])[:6] == (d, n, hit, len(found), sha(found), hit > 0 and 20 * hit >= n)


def test_private_data_rows(spark, sf, texts):
    got = {r["doc_id"]: r for r in QUERIES["op5_private_data"](spark, sf).collect()}
    for d, t in texts.items():
        base = plain_spans(t)
        named = [f"{k}:{s}:{e}" for k, s, e in base]
        r = got[d]
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(b[0] == k for b in base) for k in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == sha(named) and r["n_values"] == len(base)
        own = r["spans"].split(",") if r["spans"] else []
        assert own[: len(named)] == named and len(own) == len(named) + r["n_terms"]
        for x in own[len(named) :]:
            kind, s, e = x.split(":")
            assert kind.split("_")[0] == "term" and t[int(s) : int(e)].isalnum() and not any(b[1] < int(e) and int(s) < b[2] for b in base)


def test_length_rows(spark, sf, texts):
    n = [len(ids_of(t, 0)) - 1 for t in texts.values()]
    got = QUERIES["op6_token_counts"](spark, sf).collect()
    assert {r["length"]: (r["n_docs"], r["docs_ge"], r["tokens_ge"]) for r in got} == {x: (n.count(x), sum(v >= x for v in n), sum(v for v in n if v >= x)) for x in n}


def test_simhash_rows(spark, sf, texts):
    fp = {d: plain_fingerprint(t) for d, t in texts.items()}
    comp = {d: d for d in texts}
    while True:
        new = {d: min(comp[e] for e in texts if (fp[d] ^ fp[e]).bit_count() <= 4) for d in texts}
        if new == comp:
            break
        comp = new
    got = QUERIES["op8_simhash"](spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{fp[d]:016x}", comp[d]) for d in texts} and len(got) == len(texts)


def test_packing_rows(spark, sf, texts):
    check_pieces(QUERIES["op10_packing"](spark, sf).collect(), list(texts.items()))


def test_held_out_rows(spark, sf, texts):
    """The columns of the two learners, and that neither reads labels, language, source or id of a row it predicts."""
    import zlib

    for name, cols in (("op4_language", {"doc_id", "held_out", "lang_pred", "score"}), ("op9_quality", {"doc_id", "held_out", "score", "predicted"})):
        got = {r["doc_id"]: r for r in QUERIES[name](spark, sf).collect()}
        assert got.keys() == texts.keys() and cols <= set(next(iter(got.values())).asDict())
        assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for d, r in got.items())
        if name == "op9_quality":
            assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_stages_of_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    left = [d for d, t in text.items() if model.score(t) >= 0.7]
    best = {}
    for d in left:
        k = re.sub(r"[\x20\x09-\x0D]", "", text[d])
        if k not in best or (len(text[d]), -d) > (len(text[best[k]]), -best[k]):
            best[k] = d
    left = sorted(best.values())
    fp = {d: plain_fingerprint(text[d]) for d in left}
    comp = {d: d for d in left}
    for _ in left:
        new = {d: min(comp[e] for e in left if (fp[d] ^ fp[e]).bit_count() <= 4) for d in left}
        if new == comp:
            break
        comp = new
    left = [d for d in left if comp[d] == d]
    kept = []
    for d in left:
        n, hit, _ = plain_scan(text[d], items)
        if not hit or 20 * hit < n:
            kept.append(d)
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {p["doc_id"] for p in pieces} == set(kept)
    check_pieces(pieces, [(d, text[d]) for d in kept])
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
