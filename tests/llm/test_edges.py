"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names; and brute force."""

import hashlib
import zlib

import duckdb
import pytest

import corpus_pipeline
from wideleaf.llm import queries, similar

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, row string, spans string, kept boolean, _shard int"
WORDS = " ".join(f"w{k}" for k in range(80))
ROWS = [
    (1, WORDS, "en", "a"), (2, WORDS, "en", "a"), (2, WORDS, "en", "a"), (None, WORDS, None, None), (3, None, "en", "b"), (4, "", "en", "b"), (5, " \n\t ", "en", "b"),
    (6, "one two", "en", "b"), (7, "one two", "de", "b"), (8, WORDS + " extra", "en", "c"), (9, " ".join(f"x{k % 9000}" for k in range(30_000)), "en", "c"), (10, "áé 日本 🙂 token = \"abcdefgh1\"", "fr", "c"),
]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for name, rows in (("odd", ROWS), ("none", [])):
        d = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 7, "r", "s", True, 1) for r in rows], SCHEMA).coalesce(1).write.parquet(f"{d}/documents.parquet")
        html = [(k, "http://h/x" if k else None, t and f"<article><p>{t}</p></article>", 1) for k, t, *_ in rows]
        spark.createDataFrame(html, "page_id long, url string, html string, payload long").coalesce(1).write.parquet(f"{d}/pages.parquet")
        items = [(1, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"), (2, "one two"), (3, ""), (4, None), (None, "w20 w21 w22 w23 w24 w25 w26 w27 w28 w29")] if rows else []
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        out[name] = d
    return out


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_odd_tables(spark, folders, name):
    query = queries.queries()[name]
    assert query(spark, folders["none"]).count() == 0
    got = query(spark, folders["odd"])
    assert got.count() == len(ROWS)
    key = "page_id" if "page_id" in got.columns else "doc_id"
    assert sorted(str(r[0]) for r in got.select(key).collect()) == sorted(str(r[0]) for r in ROWS)


def test_pipeline(spark, folders):
    assert corpus_pipeline.run(spark, folders["none"]).count() == 0
    docs = spark.read.parquet(f"{folders['odd']}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        assert stage(spark, docs, folders["odd"]).columns == docs.columns, k
    one = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, folders["odd"]).collect()}
    assert one == {1, 3, 4, 5, 6, 9, 10}
    clean = {r.doc_id: r.text for r in corpus_pipeline.decontamination(spark, docs, folders["odd"]).collect()}
    assert " w5 " not in clean[1] and " w25 " not in clean[1] and " w14 " in clean[1] and 6 not in clean and clean[4] == ""
    masked = {r.doc_id: r.text for r in corpus_pipeline.secret_redaction(spark, docs, folders["odd"]).collect()}
    assert masked[10] == "áé 日本 🙂 [SECRET]\"" and masked[3] is None


def test_digests(spark, folders):
    rows = {r.doc_id: r for r in queries.op6_byte_bpe(spark, folders["odd"]).collect()}
    texts = {k: t or "" for k, t, *_ in ROWS}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[k].encode()).hexdigest() for k, r in rows.items())
    shards = queries.op2_sharding(spark, SF).collect()
    docs = dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall())
    assert all(r.size == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in shards)
    for s in range(8):
        assert sorted(r.slot for r in shards if r.shard == s) == list(range(sum(r.shard == s for r in shards)))
    sizes = [sum(r.size for r in shards if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in shards)


def test_scores(spark):
    rows = queries.op10_lm_scoring(spark, SF).collect()
    docs = dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall())
    import collections
    import math
    import re

    low = lambda t: t.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).decode()
    tokens = {k: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), ""] for k, t in docs.items()}
    train = [k for k in docs if zlib.crc32(str(k).encode()) % 10]
    count = collections.Counter(w for k in train for w in tokens[k])
    n, v = sum(count.values()), len(count)
    for r in rows:
        assert r.held_out == (r.doc_id not in set(train)) and r.train_tokens == n and r.n_tokens == len(tokens[r.doc_id])
        assert r.n_known == sum(count[w] > 0 for w in tokens[r.doc_id])
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[r.doc_id]))
    assert sum(r.score for r in rows if r.held_out) > sum(-math.log10(256) * (len(docs[r.doc_id].encode()) + 1) for r in rows if r.held_out) / 2


def test_similar(spark):
    docs = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    sets = {k: set(similar.shingles(t).tolist()) for k, t in docs.items()}
    links = {k: sum(j != k and sets[k] and 5 * len(sets[k] & s) >= 4 * len(sets[k] | s) for j, s in sets.items()) for k in docs}
    assert {r.doc_id: r.n_links for r in queries.op1_ngram_jaccard(spark, SF).collect()} == links
