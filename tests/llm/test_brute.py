"""Operators against plain definitions: brute force over small tables, and what must hold whatever the data."""

import collections
import random
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from wideleaf.llm import bpe, common, decontaminate, licenses, queries, secrets, shards, similar, warc, wrappers

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
@pytest.mark.parametrize("most", [0, 10**6])
def test_attach(spark, how, most):
    """Keys of any weight meet alike, whether the right side is broadcast or not; null keys meet nothing."""
    rows = [(k, i) for k, n in (("hot", 9000), ("warm", 40), ("cold", 1), (None, 3), ("absent", 2)) for i in range(n)]
    left = spark.createDataFrame(rows, "k string, i int")
    right = spark.createDataFrame([(k, n, k.upper()) for k, n in (("hot", 9000), ("warm", 40), ("cold", 1), ("other", 0))] + [(f"f{i}", 1, "F") for i in range(9)], "k string, n long, v string")
    got = common.attach(left, right, ["k"], how, most=most)
    want = left.join(right, "k", how)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_no_shared_folder_on_a_cluster(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077", "applicationId": "a"})()

    with pytest.raises(RuntimeError):
        common.shared_dir(Cluster())


@pytest.mark.parametrize("n", [2, 3, 8])
def test_borders_of_shards(spark, n):
    """Every border stands between two rows, one row at most from its goal, by a sum over all sorted keys; a hot text is parted only there."""
    texts = ["same"] * 60 + [f"{k} " * (k % 17) for k in range(90)] + [None, "", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC).coalesce(3)
    keys = docs.select(shards._number(F.col("text")).alias("_k1"), shards._number(F.col("doc_id").cast("string")).alias("_k2"), (common.text_bytes(F.col("text")) + 1).alias("size"))
    rows = sorted((r._k1, r._k2, r["size"]) for r in keys.collect())
    total = sum(r[2] for r in rows)
    places = [0]
    for r in rows:
        places.append(places[-1] + r[2])
    for k, border in enumerate(shards.splitters(keys, n, 0.0)):
        below, goal = sum(size for a, b, size in rows if (a, b) < border), total * (k + 1) / n
        assert below in places and abs(below - goal) <= max(r[2] for r in rows)
    found = shards.shard(docs, n, narrow=True).select("doc_id", "_shard.*").collect()
    assert sorted(r.doc_id for r in found) == list(range(len(texts)))
    for s in range(n):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    split = {t for t, k in collections.Counter((texts[r.doc_id], r.shard) for r in found)}
    parted = [t for t in split if len({r.shard for r in found if texts[r.doc_id] == t}) > 1]
    assert len(parted) <= n - 1


def expression(nodes, letters):
    """A wrapper as a regular expression over one letter for each path."""
    out = ""
    for x in nodes:
        if x[0] == "text":
            out += letters[x[1]]
        else:
            out += f"(?:{expression(x[1], letters)})" + {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[tuple(x[2:])]
    return out


PATHS = {c: c for c in "abcdefghi"}


def page_of(word):
    return [wrappers.Block((c,), f"{c}{i}", 0, False, False) for i, c in enumerate(word)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abcd", max_size=14), min_size=1, max_size=6))
def test_wrappers_accept_their_pages(pages):
    """Aligning only widens: the wrapper is a regular expression that every page matches, whatever the order of merging."""
    made = [(1, [], wrappers.wrapper_of(page_of(p))) for p in pages]
    chain, tree = made[0], list(made)
    for x in made[1:]:
        chain = wrappers.merge(chain, x)
    made = [(1, [], wrappers.wrapper_of(page_of(p))) for p in pages]
    tree = made
    while len(tree) > 1:
        tree = [wrappers.merge(*tree[k : k + 2]) if k + 1 < len(tree) else tree[k] for k in range(0, len(tree), 2)]
    for merged in (chain, tree[0]):
        pattern = re.compile(expression(merged[2], PATHS))
        assert all(pattern.fullmatch(p) for p in pages)
        votes = collections.Counter()
        for x in wrappers._texts(merged[2]):
            votes[x[1]] += x[2][0]
        assert votes == collections.Counter("".join(pages))


def test_folds_nest():
    # rows of "abb" fold inside and outside: one group that repeats, with a group in it
    (group,) = wrappers.wrapper_of(page_of("abbabbbab"[:6] * 2))
    assert group[0] == "group" and group[3] == 1 and [x[0] for x in group[1]] == ["text", "group"]
    assert len(wrappers.wrapper_of(page_of("abcd" * 5))) == 1 and len(wrappers.wrapper_of(page_of("abcdefghi" * 5))) == 1


def test_wrappers_decide(spark):
    """Without its wrapper a page has no text; a host without articles keeps what varies and isn't mostly links; classes are evidence by path."""
    body = lambda k: f'<html><body><div class="top"><a href="/">Home</a> <a href="/x">Section {k}</a></div><div class="story"><h2>Head {k}</h2><p>{"words of %d " % k * 9}</p><p>Read on below</p></div><div class="sidebar">Latest {k}</div></body></html>'
    rows = [(k, "http://plain.example/p", body(k)) for k in range(7)] + [(50, None, "<main><p>m</p></main>"), (51, "no host", "<main><p>n</p></main><p>beside</p>"), (52, "http://x/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract(pages).collect()}
    for k in range(7):
        assert got[k] == f"Head {k}\n" + ("words of %d " % k * 9).strip()
        assert wrappers.text_of(rows[k][2], set()) == ""
    assert (got[50], got[51], got[52]) == ("m", "n", "")


def plain_hits(text, items, window=decontaminate.WINDOW):
    """The words of a text that lie in a window of an item, and the items."""
    own, hit, found = decontaminate.words(text), set(), set()
    at = collections.defaultdict(list)
    for n in {min(window, len(decontaminate.words(t))) for _, t in items} - {0}:
        for i in range(len(own) - n + 1):
            at[tuple(own[i : i + n])].append(i)
    for name, t in items:
        w = decontaminate.words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            for j in at.get(tuple(w[i : i + n]), ()):
                hit.update(range(j, j + n))
                found.add(name)
    return len(own), len(hit), {x for x in found if x is not None}


@pytest.mark.parametrize("block_words", [20, 60, 100_000])
def test_decontamination_by_definition(spark, block_words):
    """Whole tables against windows compared one by one; few words a block cut items and merge the hits of many blocks."""
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice("ab cd ef gh ij kl mn op".split()) for _ in range(n))
    items = [("i1", text(12)), ("i2", text(90)), ("i2", text(15)), (None, text(11)), ("short", text(3)), ("none", ""), ("null", None), ("p", "zz yy xx ww vv uu tt ss rr qq pp")]
    docs = [(k, text(rnd.randrange(0, 120))) for k in range(40)] + [(90, items[1][1] + " " + text(4)), (91, f"a {items[7][1]} b {items[3][1]}"), (92, None), (93, ""), (93, items[0][1])]
    found = decontaminate.report(spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(items, "item_id string, text string"), block_words=block_words).collect()
    want = sorted((k, n, h, len(s), decontaminate.digest(sorted(s)), h > 0) for k, t in docs for n, h, s in [plain_hits(t, items)])
    assert sorted(tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in found) == want
    cleaned = {r.doc_id: r.text for r in decontaminate.clean(spark.createDataFrame(docs[-5:], DOC), spark.createDataFrame(items, "item_id string, text string"), block_words=block_words, max_coverage=1.0).collect()}
    assert cleaned[91].split()[0] == "a" and "zz" not in cleaned[91] and cleaned[92] is None


def test_licenses_by_definition():
    """Every window that holds enough of a template has a match of it over it, or a fuller one of another."""
    rnd, scanner = random.Random(8), licenses.Scanner()
    sets = {name: set(licenses.shingles(licenses.words(t)).tolist()) for name, t in licenses.TEMPLATES.items() if len(licenses.words(t)) >= licenses.WORDS}
    texts = []
    for name, t in licenses.TEMPLATES.items():
        own = licenses.words(t)
        for edits in (0, 1, 2):
            mutated = list(own)
            for _ in range(edits):
                mutated[rnd.randrange(len(own))] = b"changed"
            noise = [b"n%d" % rnd.randrange(999) for _ in range(rnd.randrange(90))]
            texts.append(noise + mutated + [b"tail"] * rnd.randrange(3))
    for text, found in zip(texts, licenses._scan(texts, scanner)):
        h = licenses.shingles(text).tolist()
        for name, own in sets.items():
            n = len(licenses.words(licenses.TEMPLATES[name])) - licenses.WORDS + 1
            windows = [len(own & set(h[i : i + n])) / len(own) for i in range(max(1, len(h) - n + 1))]
            best = max(windows, default=0)
            if best >= licenses.CONTAINED:
                at = windows.index(best)
                over = [x for x in found if x["first_word"] < at + n and x["last_word"] >= at]
                assert any(x["license"] == name or x["containment"] > best for x in over), (name, best, found)
        for x in found:
            if x["license"] in sets:
                part = set(licenses.shingles(text[x["first_word"] : x["last_word"] + 1]).tolist())
                assert len(sets[x["license"]] & part) >= licenses.CONTAINED * len(sets[x["license"]])


def test_close_licenses():
    text = licenses.words(licenses.TEMPLATES["AGPL-3.0-header"])
    assert [x["license"] for x in licenses._scan([text], licenses.Scanner())[0]] == ["AGPL-3.0-header"]


def test_secrets_of_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op9_secret_scans(spark, SF).collect()}
    for r in docs.select("doc_id", "text").collect():
        base, every = secrets.scan(r.text or "")
        assert rows[r.doc_id].spans == secrets.listed(every) and set(base) <= set(every)
        assert rows[r.doc_id].n_hex == len([m for m in re.findall("[0-9a-f]+", r.text or "") if len(m) >= 24])


@pytest.mark.parametrize("text, spans", [
    ("%ff%74%6f%6b%65%6e=abcdefgh", "assign:3:27"), ("\\U00999999\\u0074oken: abcdefgh", "assign:10:30"), ("\\ud800 \\u0074oken: abcdefgh", "assign:7:27"), ("%c3%28%41KIAABCDEFGHIJKLMNOP", "access:6:28"),
])
def test_escapes_that_are_no_text(text, spans):
    assert secrets.listed(secrets.scan(text)[1]) == spans


def test_bare_deflate_and_wide_text():
    import base64
    import zlib

    inner = b'my password="hunter2hunter2" is here, ' * 3
    machine = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = machine.compress(inner) + machine.flush()
    for data in (raw, inner.decode().encode("utf-16-le"), inner.decode().encode("utf-16-be"), b"\x00\x01" + inner.decode().encode("utf-16")):
        blob = base64.b64encode(data).decode()
        assert any(k == "assign" for k, _, _ in secrets.scan(f"zz {blob} yy")[1]), data[:9]


def test_ties_in_archives(spark):
    """Equal payloads under equal and null ids: one response each, the first by id, nulls last; short ones are no revisits."""
    long_, rows = "x" * 200, []
    rows += [(k, None, long_) for k in (None, 7, 7, 9, None)] + [(1, "u", "short"), (2, "u", "short"), (3, None, None), (4, None, "")]
    out = [(r.page_id, r.record_type, r.refers_to) for r in warc.report(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()]
    assert sorted(out, key=str) == sorted([(7, "response", None), (7, "revisit", 7), (9, "revisit", 7), (None, "revisit", 7), (None, "revisit", 7), (1, "response", None), (2, "response", None), (3, "response", None), (4, "response", None)], key=str)


def test_fences_of_small_groups(spark, tmp_path):
    """Groups on both sides of the least size, by the SQL: a group of its own, its language, or all."""
    rnd, rows = random.Random(1), []
    word = lambda n: "".join(rnd.choice("abcdef") for _ in range(n))
    for lang, source, n, size in (("en", "a", 100, 4), ("en", "b", 99, 9), ("en", None, 20, 5), ("de", "a", 60, 12), (None, "a", 45, 6)):
        for _ in range(n):
            text = " ".join(word(rnd.randrange(size - 2, size + 3)) for _ in range(rnd.randrange(50, 70)))
            rows.append((len(rows), text + rnd.choice(["", "", "\nsame line here\nsame line here", " # & | $ % *", " " + " ".join(text.split()[:9])]), lang, source))
    rows += [(len(rows), None, "en", "a"), (len(rows) + 1, "few words", "en", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = {tuple(r) for r in queries.op4_quality_rules(spark, str(tmp_path)).collect()}
    assert got == set(con.execute(queries.OP4_SQL).fetchall()) and {r[7] for r in got if not r[6]} == {True, False}


def test_similar_pairs_at_the_limit(spark):
    """Pairs of a similarity of just 0.8 and just below it: all links of the former, none of the latter; and none of a hot text lost."""
    rnd, rows, want = random.Random(2), [], collections.Counter()
    for k in range(150):
        words = [f"w{rnd.randrange(10**9)}" for _ in range(94)]  # 90 shingles
        other = words[: 94 - 10] + [f"z{rnd.randrange(10**9)}" for _ in range(10)]  # 80 in common of 100
        less = words[: 94 - 11] + [f"y{rnd.randrange(10**9)}" for _ in range(11)]  # 79 of 101 with the first
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(other)), (3 * k + 2, " ".join(less))]
    sets = {k: set(similar.shingles(t).tolist()) for k, t in rows}
    rows += [(1000 + k, "one hot text that stands in many rows " * 3) for k in range(400)]
    for k in range(150):
        for a, b in ((0, 1), (0, 2), (1, 2)):
            x, y = sets[3 * k + a], sets[3 * k + b]
            if 5 * len(x & y) >= 4 * len(x | y):
                want[3 * k + a] += 1
                want[3 * k + b] += 1
    got = {r.doc_id: (r.n_links, r.class_id, r.class_size) for r in similar.report(spark.createDataFrame(rows, DOC).repartition(5)).collect()}
    assert sum(want.values()) >= 300 and {k: v[0] for k, v in got.items() if k < 1000 and v[0]} == dict(want)
    assert all(got[1000 + k] == (399, 1000, 400) for k in range(400))


def test_components_of_long_chains(spark):
    """Any shape of graph, as one plan a round and with the centres apart: the smallest node of each component."""
    edges = [(k, k + 1) for k in range(100, 400)] + [(k, 7) for k in range(500, 900)] + [(5000, 5001), (5001, 5002), (5002, 5000), (9, 9)]
    frame = spark.createDataFrame(edges, "a long, b long")
    want = {k: 100 for k in range(100, 401)} | {k: 7 for k in [7, *range(500, 900)]} | {k: 5000 for k in (5000, 5001, 5002)}
    for plain in (0, 10**6):
        assert {r.node: r.label for r in similar.components(frame, plain=plain).collect()} == want


def test_rows_keep_their_ids(spark, tmp_path):
    """Classes don't depend on how later readings of the documents are split: what is read twice is read from one written table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shuffled = docs.repartition(7)  # its rows may come in another order each time it is computed
    want = {r.doc_id: (r.class_id, r.class_size, r.n_links) for r in similar.report(docs).collect()}
    assert {r.doc_id: (r.class_id, r.class_size, r.n_links) for r in similar.report(shuffled).collect()} == want
    kept = similar.keep_one(shuffled)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _, _ in want.values()})


def test_whole_pipeline(spark):
    """What comes out are the documents' columns and ids that decode to the text; nothing that was spooled on the way is left."""
    before = list(common._spooled)
    out = corpus_pipeline.run(spark, SF)
    assert common._spooled == before and set(out.columns) >= {"doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens", "ids_sha256", "decoded_sha256"}
    import hashlib

    import public_tokenizers

    rows = out.collect()
    back = {r.doc_id: r.text for r in bpe.decode(out.select("doc_id", "ids"), public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN).collect()}
    assert rows and all(back[r.doc_id] == r.text and len(r.ids) == r.n_tokens and r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in rows)
