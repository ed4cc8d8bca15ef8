"""That operators do the whole job: what a cut would leave out."""

import base64
import bz2
import collections
import gzip
import lzma
import zlib

import duckdb
import numpy as np
import pytest

from wideleaf.llm import licenses, lm, secrets, wrappers

SF = "/root/testdata/sf0.001"


def test_every_context_scores(spark, monkeypatch):
    """Rare contexts are nodes too: scores against the model of all contexts in memory, with few looked up and many joined."""
    monkeypatch.setattr(lm, "GRAMS", 1 << 9)
    docs = dict(duckdb.sql(f"select doc_id, left(coalesce(text, ''), 1500) from '{SF}/documents.parquet' order by doc_id limit 60").fetchall())
    got = {r.doc_id: r.score for r in lm.report(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    code, _ = lm._grams([lm._bytes(t) for k, t in docs.items() if zlib.crc32(str(k).encode()) % 10])
    tables = []
    for d in range(lm.DEPTH + 1):
        count = collections.Counter((code & np.uint64((1 << 8 * (d + 1)) - 1)).tolist())
        contexts = np.array(sorted({k >> 8 for k in count}), np.uint64)
        table = np.zeros((len(contexts), 256))
        for k, n in count.items():
            table[np.searchsorted(contexts, np.uint64(k >> 8)), k & 255] = n
        tables.append((contexts, table))
    third, fourth = (model := lm.weigh(tables)).tables()
    for k, text in docs.items():
        c = lm._grams([lm._bytes(text)])[0].astype(np.int64)
        leaf = fourth[third[c >> 8 & 0xFFFFFF].astype(np.int64) * 256 + (c >> 32)]
        assert got[k] == pytest.approx(model.rows[leaf, c & 255].astype(float).sum(), rel=1e-4), k


def test_short_license_notice():
    scanner = licenses.Scanner(licenses.TEMPLATES | {"two": "No warranty"})
    found = licenses._scan([licenses.words(t) for t in ("some text here. All rights reserved.", "All rights reserved", "no rights, no warranty", "all rights")], scanner)
    assert [[(x["license"], x["first_word"], x["last_word"]) for x in f] for f in found] == [[("rights-reserved-notice", 3, 5)], [("rights-reserved-notice", 0, 2)], [("two", 2, 3)], []]
    with pytest.raises(ValueError):
        licenses.Scanner({"none": "..."})


@pytest.mark.parametrize("name", sorted(k for k, t in licenses.TEMPLATES.items() if len(licenses.words(t)) >= licenses.WORDS))
def test_every_copy_of_a_license(name):
    own, scanner = licenses.words(licenses.TEMPLATES[name]), licenses.Scanner()
    for at in range(0, 70, 3):
        for n in (2, 3, 5):
            text = [b"x%d" % k for k in range(at)] + own * n + [b"y"]
            spans = [(x["first_word"], x["last_word"], x["containment"]) for x in licenses._scan([text], scanner)[0] if x["license"] == name]
            assert spans == [(at + k * len(own), at + (k + 1) * len(own) - 1, 1.0) for k in range(n)]
    if len(own) > 30:  # copies that lack different words
        text = own[:12] + [b"z"] + own[13:] + own[:22] + [b"z"] + own[23:]
        assert [(x["first_word"], x["last_word"]) for x in licenses._scan([text], scanner)[0] if x["license"] == name] == [(0, len(own) - 1), (len(own), 2 * len(own) - 1)]


SECRET = 'my password="hunter2hunter2" here'


def encoded(data: str | bytes) -> str:
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode().rstrip("=")


@pytest.mark.parametrize("before", ["https://h.example/cb/", "id_", "data-", "x/", "abc", "some_word-", ""])
@pytest.mark.parametrize("after", ["", "/rest", "-x", "_tail", "\nnext line"])
@pytest.mark.parametrize("payload", [SECRET, SECRET + "\0", "\0\1" + SECRET, zlib.compress(SECRET.encode()), gzip.compress(SECRET.encode())])
def test_base64_that_touches_others(before, after, payload):
    text = f"zz {before}{encoded(payload)}{after} yy"
    covered = {i for _, a, b in secrets.scan(text)[1] for i in range(a, b)}
    at = text.index(encoded(payload))
    assert covered >= set(range(at + 8, at + len(encoded(payload)) - 8)) and not covered & {0, 1, len(text) - 1}


@pytest.mark.parametrize("wrap", ["\n", "\r\n", "\n   "])
def test_wrapped_base64(wrap):
    blob = encoded(lzma.compress(SECRET.encode() * 3))
    lines = [blob[i : i + 30] for i in range(0, len(blob), 30)]
    text = f"key:\n\n{wrap.join(lines)} yy"
    assert [x for x in secrets.scan(text)[1] if x[0] == "assign"] == [("assign", 6, len(text) - 3)]


def test_equal_blobs_at_two_places():
    blob = encoded(SECRET)
    assert secrets.scan(f"{blob} {blob}")[1] == [("assign", 0, len(blob)), ("assign", len(blob) + 1, 2 * len(blob) + 1)]


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zlib.compress])
def test_further_compressed_members(pack):
    blob = encoded(pack(b"nothing here ") + pack(b"the pass") + pack(b"word=hunter2hunter2"))
    assert secrets.scan(f"zz {blob}")[1] == [("assign", 3, 3 + len(blob))]


def test_deeply_packed():
    data = SECRET.encode()
    for _ in range(100):
        data = zlib.compress(data, 0)
    blob = encoded(data)
    assert ("assign", 0, len(blob)) in secrets.scan(blob)[1]
    assert secrets.scan(blob, 500)[1][0][0] == "packed"


def test_constant_texts_in_articles(spark):
    """What stands on every page of a host goes, also in an article and among its paragraphs; what differs, or is most of a page, stays."""
    note = "Read our other stories, " + "every day. " * 10
    lead = lambda k: f"<p>{note[:95]} number {k}</p>"
    page = lambda k: f'<body><article><h1>Title {k}</h1>{lead(k)}<p>{"text of page %d " % k * 20}</p><p>{note}</p>{"<p>more</p>" * (k % 3)}<div class="x"><p>Same box</p></div></article></body>'
    rows = [(k, "http://many.example/", page(k)) for k in range(8)] + [(20 + k, "http://few.example/", page(k)) for k in range(4)] + [(40 + k, "http://one.example/", page(0)) for k in range(9)]
    rows += [(60 + k, "http://near.example/", f"<article><p>{note}</p><p>{k}</p></article>") for k in range(9)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(8):
        assert got[k].split("\n") == [f"Title {k}", f"{note[:95]} number {k}", ("text of page %d " % k * 20).strip(), *["more"] * (k % 3)]
    assert all(note.strip() in got[k] and "Same box" in got[k] for k in (*range(20, 24), *range(40, 49)))
    assert all(note.strip() in got[k] for k in range(60, 69))


def test_heading_beside_the_container():
    page = '<body><h1>Title</h1><p class="lead">Lead</p><div class="content"><p>%s</p></div><div class="menu"><a href=x>m</a></div></body>' % ("long text " * 40)
    assert wrappers.text_of(page, set(wrappers.main_paths(wrappers.wrapper_of(wrappers.blocks(page))))).split("\n") == ["Title", "Lead", ("long text " * 40).strip()]
