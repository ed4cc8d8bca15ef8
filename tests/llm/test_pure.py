"""Parts that need no Spark, against plain definitions."""

import base64
import collections
import gzip
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from wideleaf.llm import bpe, decontaminate, licenses, lm, secrets, similar, warc, wrappers

RANKS = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
CODEC = bpe.codec(RANKS, public_tokenizers.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(RANKS), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abehtnrs é日🙂 　 \t\n'12.,$"), max_size=80))
def test_bpe(text):
    assert CODEC.encode(text) == REFERENCE.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text


@given(st.lists(st.binary(max_size=6), max_size=6))
def test_bpe_stream(chunks):
    got = [t for part in CODEC.transducer.stream(chunks) for t in part]
    assert got == (CODEC.transducer.merge(b"".join(chunks)) if any(chunks) else [])


@given(st.binary(max_size=40), st.integers(1, 5))
def test_utf8(data, size):
    machine = bpe.Utf8Machine()
    got = "".join(machine.feed(data[k : k + size]) for k in range(0, len(data), size)) + machine.feed(b"", last=True)
    assert got == data.decode("utf-8", "replace")


@settings(deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5), st.lists(st.sampled_from("abc"), max_size=40))
def test_automaton(items, text):
    automaton = decontaminate.SuffixAutomaton(4)
    for k, item in enumerate(items):
        automaton.add(str(k), decontaminate.words(" ".join(item)))
    hit, found = set(), set()
    for k, item in enumerate(items):
        n = min(4, len(item))
        windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
        for p in range(len(text) - n + 1):
            if tuple(text[p : p + n]) in windows:
                hit.update(range(p, p + n))
                found.add(str(k))
    spans, own = automaton.seal().scan(decontaminate.words(" ".join(text)))
    assert {i for a, b in spans for i in range(a, b)} == hit
    assert own == {i for i, n in enumerate(automaton.names) if n in found}


def test_cut():
    assert decontaminate.cut("a b, c. D e!", [(1, 3)]) == "a . D e!"


def test_secret_layers():
    inner = 'x token = "abcdef123456" '
    packed = base64.b64encode(zlib.compress(inner.encode())).decode()
    twice = base64.b64encode(packed.encode()).decode()
    assert secrets.scan(inner)[0] == [("assign", 2, 23)]
    assert secrets.scan(f"zz {twice} yy") == ([], [("assign", 3, 3 + len(twice))])
    assert secrets.scan("".join(f"%{b:02x}" for b in inner.encode()))[1] == [("assign", 6, 69)]
    assert secrets.scan("\\ud83d\\ude00 \\u0074oken: abcdefgh")[1] == [("assign", 13, 33)]
    assert secrets.scan("pass\\u0077ord=letmein")[1] == [("assign", 0, 21)]
    assert secrets.scan("secret=token: abcdefgh") == ([], [])
    assert secrets.scan("") == ([], [])


@given(st.text(alphabet=st.sampled_from("secrtokn=: 'AKI0123456789abf"), max_size=120))
def test_secrets_base(text):
    want = [("assign", *m.span()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    assert sorted(secrets.scan(text)[0]) == sorted(want)


def test_licenses():
    rnd, scanner = random.Random(5), licenses.Scanner()
    for name, text in licenses.TEMPLATES.items():
        noise = lambda n: " ".join(str(rnd.randrange(10**6)) for _ in range(n))
        for at in (0, 1, 7, 333):
            found = licenses._scan([licenses.words(f"{noise(at)} {text} {noise(50)}")], scanner)[0]
            hit = next(x for x in found if x["license"] == name)
            assert (hit["first_word"], hit["last_word"], hit["containment"]) == (at, at + len(licenses.words(text)) - 1, 1.0)
    assert licenses._scan([[], licenses.words("nothing of the kind is here at all")], scanner) == [[], []]


def test_context_trees():
    """The leaf tables against the definition: weights by recursion over all nodes, in plain code."""
    data = [b"abracadabra", b"abacus abra", b""] * 3
    code, starts = lm._grams(data)
    assert len(code) == sum(len(d) + 1 for d in data) and list(starts[:2]) == [0, 12]
    tables = []
    for d in range(lm.DEPTH + 1):
        count = collections.Counter(int(c) & ((1 << 8 * (d + 1)) - 1) for c in code)
        contexts = np.array(sorted({k >> 8 for k in count}), np.uint64)
        table = np.zeros((len(contexts), 256))
        for k, n in count.items():
            table[np.searchsorted(contexts, k >> 8), k & 255] = n
        tables.append((contexts, table))
    third, fourth = (model := lm.weigh(tables)).tables()
    total = 10.0 ** model.rows.astype(float)
    assert np.allclose(total.sum(1), 1, atol=1e-4)
    from math import exp, lgamma, log

    def evidence(a, b):
        return lgamma(a + 0.5) + lgamma(b + 0.5) - 2 * lgamma(0.5) - lgamma(a + b + 1)

    seen = [int(c) for c in code]

    def bit_counts(context, d, node):
        level = node.bit_length() - 1
        out = [0, 0]
        for c in seen:
            if (c >> 8) & ((1 << 8 * d) - 1) == context and ((c & 255) | 256) >> (8 - level) == node:
                out[(c >> (7 - level)) & 1] += 1
        return out

    def weighted(context, d, node):
        own = evidence(*bit_counts(context, d, node))
        if d == lm.DEPTH:
            return own
        children = {(c >> 8) & ((1 << 8 * (d + 1)) - 1) for c in seen if (c >> 8) & ((1 << 8 * d) - 1) == context}
        below = sum(weighted(x, d + 1, node) for x in children)
        top = max(own, below)
        return top + log(0.5 * exp(own - top) + 0.5 * exp(below - top))

    def predict(past, d, node):
        context = past & ((1 << 8 * d) - 1)
        a, b = bit_counts(context, d, node)
        own = (b + 0.5) / (a + b + 1)
        if d == lm.DEPTH:
            return own
        w = 0.5 * exp(evidence(a, b) - weighted(context, d, node))
        return w * own + (1 - w) * predict(past, d + 1, node)

    for c in seen[:4]:
        past, byte, want = c >> 8, c & 255, 0.0
        for level in range(8):
            node, bit = ((byte | 256) >> (8 - level)), byte >> (7 - level) & 1
            q = predict(past, 0, node)
            want += log(q if bit else 1 - q)
        leaf = fourth[int(third[past & 0xFFFFFF]) * 256 + (past >> 24)]
        assert model.rows[leaf, byte] == pytest.approx(want / log(10), rel=1e-4)


@pytest.mark.parametrize("split", [1, 7, 100, 10**6])
def test_warc_ranges(split):
    """Every record is owned by one range, also with magic bytes inside members and between ranges."""
    records = [warc._record("response", k, "http://h/", "d", 3, None, bytes([31, 139, 8]) * k + bytes(random.Random(k).randbytes(300))) for k in range(20)]
    data = b"".join(map(warc._member, records))
    assert gzip.decompress(data) == b"".join(records)
    if split == 1:
        data, records = data[: len(b"".join(map(warc._member, records[:2])))], records[:2]
    got = [r for a in range(0, len(data), split) for r in warc.scan_range(io.BytesIO(data), len(data), a, min(a + split, len(data)))]
    assert [r for _, r in got] == records


def test_extraction():
    page = '<html><body><header>H</header><nav><a>m</a></nav><div class="cookie-notice">c</div><article><h1>T &amp; t</h1><p>a <b>b\n c<br><p>d</p><div class="comments"><p>no</p></div><form>f</form></article><aside>s</aside><footer>x'
    own = lambda html: set(wrappers.main_paths(wrappers.wrapper_of(wrappers.blocks(html))))
    assert wrappers.text_of(page, own(page)) == "T & t\na b c\nd"
    assert wrappers.text_of(page, set()) == wrappers.text_of(None, own(None)) == wrappers.text_of("", set()) == ""
    plain = '<div id="menu"><a href=x>one</a></div><div class="content"><p>first text of this page</p><p>second</p></div><div>by <a href=y>someone else</a></div>'
    wrapper = wrappers.wrapper_of(wrappers.blocks(plain))
    both = wrappers.align(wrapper, wrappers.wrapper_of(wrappers.blocks(plain.replace("<p>second</p>", "<p>2</p><p>3</p>"))))
    assert wrappers.text_of(plain, set(wrappers.main_paths(both))) == "first text of this page\nsecond"
    assert [(x[0], x[2:]) for x in both if x[0] == "group"] == [("group", [0, 1])]


@given(st.lists(st.integers(0, 6), max_size=30), st.lists(st.integers(0, 6), max_size=30))
def test_shingles(a, b):
    text = lambda xs: " ".join(map(str, xs))
    plain = lambda xs: {tuple(xs[i : i + 5]) for i in range(max(1, len(xs) - 4))} if xs else set()
    x, y = similar.shingles(text(a)), similar.shingles(text(b))
    assert len(x) == len(plain(a)) and len(np.intersect1d(x, y)) == len(plain(a) & plain(b))
