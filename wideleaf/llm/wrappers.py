"""HTML extraction with wrappers: union-free regular expressions of a host's pages.

Each page becomes a stream of structure tokens: block containers with their classes, and texts.  Inside a page,
equal neighbouring groups, of any length and nested, fold into repeated groups.  The wrappers of a host are then aligned in
turn: what both have stays, texts that differ become slots, what only one has becomes an optional group, and equal
neighbours fold again.  So a wrapper has no alternatives, merging wrappers is the same step as adding a page, and a wrapper
accepts every page it was made of.  A task merges its own pages first, so a host of any size reaches the shuffle as
one wrapper a task; these are merged in ``salts`` parts, and the parts at last.

The wrapper decides what is main text.  Each text node gathers, over all pages of its host, how many texts stand there, how
long they are, how much of them is link text, how many stand in elements that are boilerplate by element, role or
class, how many in an article or main element, and how many beside one.  Slots of a path are main text unless most of its texts are
boilerplate by these marks, or stand beside an article, or its text is mostly links outside of one.  Texts that stand on all
pages of a host that has ``PAGES`` different ones or more aren't slots: they are left out, unless they are more than half of a page's
main text.  A page is then read by its host's wrapper only.

Defined results: a null or empty html has an empty text; a null url, or one without a host, is of the host ''; equal
pages are extracted separately and alike; broken markup (unclosed or wrongly nested elements) is read as a browser would
close it; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import difflib
import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wideleaf.llm.common import attach, map_batches, spool

PAGES = 5
#: Wrappers' decisions of up to as many characters are broadcast.
BROADCAST = 32 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""")
_RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes")
_DROPPED = {"nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "head", "svg", "figure-ad", *_RAW}
_BLOCKS = {"html", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "header", "hr", "fieldset", "details", "summary", "center", *_DROPPED}
_VOID = {"hr", "br", "img", "meta", "link", "input", "source", "wbr", "col", "area", "base", "embed", "track", "param"}
_TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th"}
_BAD = re.compile(r"(?:^|[-_ ])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|sidebar|side|menu|nav(?:bar|igation)?|breadcrumbs?|footer|header|masthead|cookies?|consent|notice|popup|modal|newsletter|subscribe|signup|login|search|share|social|related|recommended|comments?|replies|reply|respond|disqus|pagination|pager|widget|toolbar|skip|hidden)(?:$|[-_ ])", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "menu", "menubar", "alert"}
_SPACE = re.compile(r"\s+")


class Block:
    """A text block of a page: its container path, its text, how much of it is in links, and whether it is boilerplate by rule."""

    __slots__ = ("path", "text", "linked", "bad", "inside")

    def __init__(self, path: tuple[str, ...], text: str, linked: int, bad: bool, inside: bool):
        self.path, self.text, self.linked, self.bad, self.inside = path, text, linked, bad, inside


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order, white space joined, character references decoded."""
    out: list[Block] = []
    #: open block elements: (tag, name on the path, boilerplate from here on, in an article from here on)
    stack: list[tuple[str, str, bool, bool]] = []
    parts: list[str] = []
    links, linked, at = 0, 0, 0
    page = page or ""

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            bad, inside = (stack[-1][2], stack[-1][3]) if stack else (False, False)
            out.append(Block(tuple(x[1] for x in stack), text, min(linked, len(text)), bad, inside))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw)
            parts.append(text)
            linked += len(text) * bool(links)

    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if not m[1]:
            continue
        tag, closing = m[1].lower(), m[0].startswith("</")
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag not in _BLOCKS:
            if tag == "img":
                parts.append(" ")
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    links = 0
                    break
                if tag in _TEXTUAL and stack[k][0] in ("table", "ul", "ol", "article", "main"):
                    break
            continue
        if tag == "hr":
            continue
        if stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or stack and stack[-1][0] == tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
            stack.pop()
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(m[2])}
        label = " ".join(filter(None, (attributes.get("class"), attributes.get("id"))))
        above = stack[-1] if stack else ("", "", False, False)
        page_head = tag == "header" and not above[3]
        marked = tag not in ("html", "body", "article", "main") and label and _BAD.search(label)
        comment = tag == "article" and label and re.search(r"(?:^|[-_ ])comments?(?:$|[-_ ])", label, re.I)
        bad = bool(above[2] or tag in _DROPPED or page_head or marked or comment or attributes.get("role", "").lower() in _ROLES or "hidden" in m[2].split())
        # What marks an element as boilerplate is part of its name, so that marked and unmarked ones are different nodes.
        marks = [f"#{re.sub(r'[0-9]+', '', attributes['id'])}"] if _BAD.search(attributes.get("id", "")) else []
        marks += [f"[{attributes['role'].lower()}]"] if attributes.get("role") else []
        marks += ["[hidden]"] if "hidden" in m[2].split() else []
        name = tag + "".join(sorted(f".{c}" for c in re.sub(r"\d+", "", attributes.get("class", "")).split())) + "".join(marks)
        stack.append((tag, name, bad, above[3] or tag in ("article", "main")))
    add(page[at:])
    flush()
    return out


# A wrapper is a list of nodes: ["text", path, votes, hashes of texts on every page] and ["group", nodes, optional, repeated].
# Votes: texts, characters, linked characters, texts that are boilerplate by rule, in an article, beside one.


def _shape(node: list) -> str:
    return node[1] if node[0] == "text" else _inner(node) + "\1"


def _inner(node: list) -> str:
    """The shape that aligns, whatever the flags: a single text meets a group of the same inside."""
    return "\0" + "\0".join(map(_shape, node[1])) if node[0] == "group" else "\0" + node[1]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 11


def _absorb(a: list, b: list, across: bool = False) -> list:
    """Two nodes of the same shape as one, ``a`` being used up: votes add up; of two in the same pages the texts of both
    stay, of two ``across`` pages only the common ones, the others become a slot."""
    if a[0] == "text":
        if across:
            other = set(b[3])
            common = [x for x in dict.fromkeys(a[3]) if x in other]
        else:
            common = a[3]
            common.extend(b[3])
        return ["text", a[1], [x + y for x, y in zip(a[2], b[2])], common]
    return ["group", [_absorb(x, y, across) for x, y in zip(a[1], b[1])], a[2] | b[2], a[3] | b[3]]


def _varied(node: list) -> list:
    """A node that other pages lack."""
    return [*node[:3], []] if node[0] == "text" else ["group", [_varied(x) for x in node[1]], *node[2:]]


def fold(nodes: list) -> list:
    """Equal neighbouring groups of nodes as one repeated group."""
    out: list = []
    shapes: list[str] = []

    def replace(n: int, node: list) -> None:
        del out[-n:], shapes[-n:]
        out.append(node)
        shapes.append(_shape(node))

    def step() -> bool:
        n = len(out)
        if n > 1 and out[-1][0] == out[-2][0] == "group" and shapes[-1] == shapes[-2]:
            made = _absorb(out[-2], out[-1])
            replace(2, [*made[:3], 1])
            return True
        for k in range(1, n):
            before = out[n - 1 - k]
            if before[0] == "group" and len(before[1]) == k and _inner(before) == "\0" + "\0".join(shapes[n - k :]):
                replace(k + 1, ["group", [_absorb(x, y) for x, y in zip(before[1], out[n - k :])], before[2], 1])
                return True
            if shapes[n - 1 - k] == shapes[-1] and 2 * k <= n and shapes[n - 2 * k : n - k] == shapes[n - k :]:
                replace(2 * k, ["group", [_absorb(x, y) for x, y in zip(out[n - 2 * k : n - k], out[n - k :])], 0, 1])
                return True
        return False

    for node in nodes:
        out.append(node)
        shapes.append(_shape(node))
        while step():
            pass
    return out


def wrapper_of(found: list[Block]) -> list:
    """The wrapper of one page."""
    has = any(b.inside and not b.bad for b in found)
    return fold([["text", "/".join(b.path), [1, len(b.text), b.linked, int(b.bad), int(b.inside), int(has and not b.inside)], [_hash(b.text)]] for b in found])


def align(a: list, b: list) -> list:
    """One wrapper for what ``a`` or ``b`` describe."""
    left, right = [_inner(x) for x in a], [_inner(x) for x in b]
    out: list = []
    for op, i, j, k, n in difflib.SequenceMatcher(None, left, right, False).get_opcodes():
        if op == "equal":
            for x, y in zip(a[i:j], b[k:n]):
                xs, ys = (z[1] if z[0] == "group" else [z] for z in (x, y))
                merged = [_absorb(p, q, True) for p, q in zip(xs, ys)]
                flags = [z[2:] for z in (x, y) if z[0] == "group"]
                out += [["group", merged, max(f[0] for f in flags), max(f[1] for f in flags)]] if flags else merged
            continue
        for part in (a[i:j], b[k:n]):
            out += [["group", [x], 1, 0] if x[0] == "text" else ["group", x[1], 1, x[3]] for x in map(_varied, part)]
    return fold(out)


def _texts(nodes: list) -> Iterator[list]:
    for x in nodes:
        if x[0] == "text":
            yield x
        else:
            yield from _texts(x[1])


def main_paths(wrapper: list) -> list[str]:
    """The paths whose texts are main text, by the votes of the wrapper's nodes."""
    votes: dict[str, list[int]] = {}
    for node in _texts(wrapper):
        votes[node[1]] = [x + y for x, y in zip(votes.get(node[1], [0] * 6), node[2])]
    out = []
    for path, (texts, chars, linked, bad, inside, beside) in votes.items():
        if 2 * bad <= texts and 2 * beside <= texts and (2 * inside > texts or 2 * linked <= chars):
            out.append(path)
    return sorted(out)


def constants(wrapper: list) -> list[str]:
    """Paths and hashes of the texts that stand on every page."""
    return sorted({f"{h} {x[1]}" for x in _texts(wrapper) for h in x[3]})


def text_of(page: str | None, paths: set[str], fixed: set[str] | None = None) -> str:
    """The main text of a page, given the main paths of its host's wrapper and the texts that stand on all its pages."""
    found = [b for b in blocks(page) if "/".join(b.path) in paths]
    if fixed:
        kept = [b for b in found if f"{_hash(b.text)} {'/'.join(b.path)}" not in fixed]
        if 2 * sum(len(b.text) for b in kept) >= sum(len(b.text) for b in found):
            found = kept
    return "\n".join(b.text for b in found)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


#: What is merged: pages, hashes of the first ``PAGES`` different ones (by hash), nodes.
Merged = tuple[int, list[int], list]


def merge(a: Merged, b: Merged) -> Merged:
    return a[0] + b[0], sorted({*a[1], *b[1]})[:PAGES], align(a[2], b[2])


def _first(most: int = 1 << 25):
    """The wrappers of each host's pages in a task; what is held is bounded by ``most`` characters of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Merged] = {}
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(map(json.dumps, held.values()), pa.string())], ["host", "wrapper"])

        for rows in batches:
            for host, page in zip(rows.column("host").to_pylist(), rows.column("html").to_pylist()):
                one = (1, [_hash(page or "")], wrapper_of(blocks(page)))
                held[host] = merge(held[host], one) if host in held else one
                size += len(page or "")
            if size > most:
                yield batch()
                held, size = {}, 0
        if held:
            yield batch()

    return run


def _merging(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, merged, kinds = None, None, []
        names = [*keys, "wrapper"]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*now, json.dumps(merged)), kinds)], names)

        for rows in batches:
            kinds = [rows.schema.field(c).type for c in names]
            for *key, text in zip(*(rows.column(c).to_pylist() for c in names)):
                if key != now:
                    if now is not None:
                        yield batch()
                    now, merged = key, json.loads(text)
                else:
                    merged = merge(merged, json.loads(text))
        if now is not None:
            yield batch()

    return run


def infer(pages: DataFrame, *, salts: int = 64) -> DataFrame:
    """host and its wrapper (as JSON: pages, hashes of some, nodes)."""
    keyed = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    parts = map_batches(keyed, _first(), "host string, wrapper string").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)).cast("int"))
    parts = map_batches(parts.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper"), _merging(["host", "salt"]), "host string, salt int, wrapper string").drop("salt")
    return map_batches(parts.repartition("host").sortWithinPartitions("host", "wrapper"), _merging(["host"]), "host string, wrapper string")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars, a row per page."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def choosing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json.loads(w) for w in batch.column("wrapper").to_pylist()]
            lists = [main_paths(w) for _, _, w in found], [constants(w) if len(some) >= PAGES else [] for _, some, w in found]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([n for n, _, _ in found], pa.int64()), *(pa.array(x, pa.list_(pa.string())) for x in lists)], ["host", "n", "paths", "fixed"])

    chosen = spool(map_batches(infer(pages), choosing, "host string, n long, paths array<string>, fixed array<string>"), "wrappers")
    width = F.length(F.array_join("paths", "")) + F.length(F.array_join("fixed", "")) + 64
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    rows = attach(rows, chosen, ["host"], cost=width, most=BROADCAST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(h, set(p or ()), set(f or ())) for h, p, f in zip(*(batch.column(c).to_pylist() for c in ("html", "paths", "fixed")))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(rows.select("page_id", "url", "html", "paths", "fixed"), run, f"page_id {kind}, url string, text string, n_chars long")
