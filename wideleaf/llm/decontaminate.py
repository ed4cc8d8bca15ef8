"""Benchmark decontamination with a generalised suffix automaton over words.

The test items are a stated query set.  Tasks cut them into blocks of at most ``block_words`` words and build an automaton of
each (an item that is longer goes to several blocks, in parts that overlap by a window less one word); the driver only
passes a finished block on, whose size the block size bounds.  Each document streams through the automaton once, tracking the
length of the longest suffix that occurs in some item; wherever that length reaches the window, its words are hit.  With
one block, that is one pass without a shuffle.  With more, documents get ids and are written once, each block lists the hits it
finds in them, and only these are shuffled and merged by document.

Defined results: a null or empty text has no words and no hits; an item without words matches
nothing; an item with fewer words than the window is one window; rows of equal text are judged
alike and separately; a null ``item_id`` still marks words but names no item; an empty benchmark
leaves every document clean; further columns of either table are ignored (or carried, when rows
are cleaned).
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wideleaf.llm.common import attach, map_batches, merge_spans, row_id, spool

WINDOW = 10
#: A-Z to a-z; every other ASCII byte that is no letter or digit becomes a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def words(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """All substrings of several word sequences; sequences never run into each other."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.names: list[str | None] = []
        self.sequences: list[tuple[int, list[bytes]]] = []

    def _grow(self, last: int, word: int) -> int:
        step, link, length = self.step, self.link, self.length
        known = step[last].get(word)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is None:
            new = self._state({}, length[last] + 1)
            at = last
            while at != -1 and word not in step[at]:
                step[at][word] = new
                at = link[at]
            if at == -1:
                link[new] = 0
                return new
            known = step[at][word]
            if length[known] == length[at] + 1:
                link[new] = known
                return new
            link[new] = self._split(at, word, known)
            return new
        return self._split(last, word, known)

    def _split(self, at: int, word: int, known: int) -> int:
        twin = self._state(dict(self.step[known]), self.length[at] + 1)
        self.link[twin] = self.link[known]
        self.link[known] = twin
        while at != -1 and self.step[at].get(word) == known:
            self.step[at][word] = twin
            at = self.link[at]
        return twin

    def _state(self, step: dict[int, int], length: int) -> int:
        self.step.append(step)
        self.link.append(0)
        self.length.append(length)
        return len(self.step) - 1

    def add(self, name: str | None, sequence: list[bytes]) -> None:
        if not sequence:
            return
        item, last = len(self.names), 0
        self.names.append(name)
        for w in sequence:
            last = self._grow(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
        self.sequences.append((item, sequence))

    def seal(self) -> Matcher:
        """After the last ``add``: the automaton in flat arrays."""
        return Matcher(self)


_SEVERAL = -2


class Matcher:
    """A finished automaton.  Most states have one transition, which stands in two arrays; those of the others are in one
    dictionary.  States are numbered along the tree of suffix links too, so that the items below a state are a range."""

    def __init__(self, made: SuffixAutomaton):
        self.window, self.vocabulary, self.names = made.window, made.vocabulary, made.names
        size = len(made.step)
        self.link, self.length = array("i", made.link), array("i", made.length)
        self.word, self.next = array("i", [-1]) * size, array("i", [-1]) * size
        self.several: dict[int, int] = {}
        for s, step in enumerate(made.step):
            if len(step) == 1:
                ((self.word[s], self.next[s]),) = step.items()
            elif step:
                self.word[s] = _SEVERAL
                self.several.update((s << 32 | w, t) for w, t in step.items())
        children: dict[int, list[int]] = {}
        for s in range(1, size):
            children.setdefault(made.link[s], []).append(s)
        #: For each state its place in the tree and the end of the range of those below it.
        self.place, self.end = array("i", [0]) * size, array("i", [0]) * size
        todo, count = [0], 0
        while todo:
            s = todo.pop()
            if s < 0:
                self.end[~s] = count
                continue
            self.place[s] = count
            count += 1
            todo.append(~s)
            todo += children.get(s, ())
        #: Of items under the window: length and item, at the state where they end.
        self.short: dict[int, list[tuple[int, int]]] = {}
        ends = []
        for item, sequence in made.sequences:
            at = 0
            for w in sequence:
                at = made.step[at][self.vocabulary[w]]
                ends.append((self.place[at], item))
            if len(sequence) < self.window:
                self.short.setdefault(at, []).append((len(sequence), item))
        ends.sort()
        self.end_place, self.end_item = array("i", [p for p, _ in ends]), array("i", [i for _, i in ends])
        #: The nearest state up the links, from each state on, at which a short item ends, or -1; and the shortest of all up there.
        self.above, self.shortest = array("i", [-1]) * size, array("i", [2**31 - 1]) * size
        for s in sorted(range(1, size), key=made.length.__getitem__):
            up = made.link[s]
            self.above[s] = s if s in self.short else self.above[up]
            self.shortest[s] = min([self.shortest[up], *(k for k, _ in self.short.get(s, ()))])
        self._items: dict[int, frozenset[int]] = {}

    @staticmethod
    def loaded(data: bytes) -> Matcher:
        """From its pickled form.  The arrays that scanning goes through become lists, which are read faster."""
        made: Matcher = pickle.loads(data)
        for name in ("link", "length", "word", "next", "shortest", "above"):
            setattr(made, name, getattr(made, name).tolist())
        return made

    def items(self, state: int) -> frozenset[int]:
        """The items that hold the substrings of ``state``."""
        if state not in self._items:
            a, b = bisect_left(self.end_place, self.place[state]), bisect_left(self.end_place, self.end[state])
            self._items[state] = frozenset(self.end_item[a:b])
        return self._items[state]

    def scan(self, sequence: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """The merged spans of words that lie in an occurring window, and the items these windows come from."""
        word, following, several, link, length, shortest, window = self.word, self.next, self.several, self.link, self.length, self.shortest, self.window
        spans: list[list[int]] = []
        states: set[int] = set()
        items: set[int] = set()
        s = n = 0
        for i, w in enumerate(map(self.vocabulary.get, sequence)):
            if w is None:
                s = n = 0
                continue
            while True:
                t = following[s] if (x := word[s]) == w else several.get(s << 32 | w) if x == _SEVERAL else None
                if t is not None or not s:
                    break
                s = link[s]
                n = length[s]
            if t is None:
                n = 0
                continue
            s = t
            n += 1
            if n >= window:
                reach = n
                u = s
                while length[link[u]] >= window:
                    u = link[u]
                states.add(u)
            elif n >= shortest[s]:
                reach = 0
            else:
                continue
            u = self.above[s]
            while u > 0:
                for k, item in self.short[u]:
                    if k <= n:
                        items.add(item)
                        reach = max(reach, k)
                u = self.above[link[u]]
            if reach:
                start = i + 1 - reach
                while spans and start <= spans[-1][1]:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        for u in states:
            items |= self.items(u)
        return [(a, b) for a, b in spans], items


def _pieces(sequence: list[bytes], window: int, block_words: int) -> Iterator[list[bytes]]:
    """``sequence``, cut so that every window lies in a piece of at most ``block_words`` words."""
    if len(sequence) <= block_words:
        yield sequence
        return
    for k in range(0, len(sequence) - window + 1, block_words - window + 1):
        yield sequence[k : k + block_words]


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = 100_000) -> DataFrame:
    """block and data, a row per finished automaton of at most ``block_words`` words, spooled."""
    block_words = max(block_words, 2 * window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, made, size = TaskContext.get().partitionId() << 32, SuffixAutomaton(window), 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pickle.dumps(made.seal(), 5)], pa.binary())], ["block", "data"])

        for rows in batches:
            for name, text in zip(rows.column("name").to_pylist(), rows.column("text").to_pylist()):
                for piece in _pieces(words(text), window, block_words):
                    if size and size + len(piece) > block_words:
                        yield batch()
                        number, made, size = number + 1, SuffixAutomaton(window), 0
                    made.add(name, piece)
                    size += len(piece)
        if size:
            yield batch()

    items = benchmark.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("string").alias("text"))
    volume = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = math.ceil(volume / 6 / block_words)
    return spool(map_batches(items.repartition(parts) if parts > 1 else items.coalesce(1), run, "block long, data binary"), "automata")


_HIT = "spans array<struct<a:long,b:long>>, items array<string>"
_FOUND = f"{_HIT}, n_words long"
_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _scanned(matcher: Matcher, sequence: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
    hit, items = matcher.scan(sequence)
    return hit, sorted({matcher.names[i] for i in items} - {None})


def _batch(rows: pa.Array, texts: pa.Array, spans: list, names: list, counts: list[int]) -> pa.RecordBatch:
    found = [pa.array([[{"a": a, "b": b} for a, b in x] for x in spans], _SPANS), pa.array(names, pa.list_(pa.string())), pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays([rows, texts, *found], ["row", "text", "spans", "items", "n_words"])


def _finder(shared):
    """All that is found in each document, for a benchmark of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher.loaded(shared.value)
        for batch in batches:
            sequences = [words(t) for t in batch.column("text").to_pylist()]
            found = [_scanned(matcher, x) for x in sequences]
            yield _batch(batch.column("row"), batch.column("text"), [x for x, _ in found], [x for _, x in found], [len(x) for x in sequences])

    return run


def _lister(shared):
    """The hits of one of several blocks: rid, spans and items of the documents that have some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher.loaded(shared.value)
        for batch in batches:
            found = [(rid, *_scanned(matcher, words(t))) for rid, t in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist())]
            found = [x for x in found if x[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([[{"a": a, "b": b} for a, b in x[1]] for x in found], _SPANS), pa.array([x[2] for x in found], pa.list_(pa.string()))], ["rid", "spans", "items"])

    return run


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [merge_spans([(x["a"], x["b"]) for x in found or ()]) for found in batch.column("spans").to_pylist()]
        names = [sorted(set(found or ())) for found in batch.column("items").to_pylist()]
        yield _batch(batch.column("row"), batch.column("text"), spans, names, [len(words(t)) for t in batch.column("text").to_pylist()])


_Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _chain(first: _Batches, second: _Batches) -> _Batches:
    return lambda batches: second(first(batches))


def find(docs: DataFrame, benchmark: DataFrame, *, columns: list[str] | None = None, window: int = WINDOW, block_words: int = 100_000, then: tuple[_Batches, str] | None = None) -> DataFrame:
    """Per document: ``row`` (its columns, or those named), ``text``, hit word ``spans``, ``items`` found and ``n_words``.

    ``then`` (a function on these batches, and what it returns beside ``row``) follows in the same Python worker, so a
    task needs one of them, not two."""
    context = docs.sparkSession.sparkContext
    built = automata(benchmark, window, block_words)
    blocks = sorted(r.block for r in built.select("block").collect())
    # A finished block passes through the driver, one at a time.
    shared = [context.broadcast(bytes(built.where(F.col("block") == k).first().data)) for k in blocks] or [context.broadcast(pickle.dumps(SuffixAutomaton(window).seal(), 5))]
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    kind = df.schema["row"].dataType.simpleString()
    if len(shared) == 1:
        last = _finder(shared[0])
    else:
        df = spool(df.withColumn("rid", row_id()), "decontaminate")
        hits = reduce(DataFrame.unionByName, [map_batches(df.select("rid", "text"), _lister(x), f"rid long, {_HIT}") for x in shared])
        merged = spool(hits.groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"), F.lit(1).alias("one")), "hits")
        df, last = attach(df, merged, ["rid"], weight="one").select("row", "text", "spans", "items"), _merger
    return map_batches(df, _chain(last, then[0]), f"row {kind}, {then[1]}") if then else map_batches(df, last, f"row {kind}, text string, {_FOUND}")


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, a row per document."""
    found = find(docs, benchmark, columns=["doc_id"], **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words in ``spans`` and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def clean(docs: DataFrame, benchmark: DataFrame, *, max_span: int = 0, max_coverage: float = 0.5, **options) -> DataFrame:
    """``docs`` without test items: hit spans of more than ``max_span`` words are cut out of ``text``; a document
    of which more than ``max_coverage`` of the words are hit goes whole.  ``n_chars``, if there, follows the text."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts = [], []
            for text, spans, n in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "n_words")), strict=True):
                spans = [(x["a"], x["b"]) for x in spans]
                keep.append(sum(b - a for a, b in spans) <= max_coverage * n)
                long = [(a, b) for a, b in spans if b - a > max_span]
                texts.append(cut(text, long) if long and keep[-1] else text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"]).filter(pa.array(keep, pa.bool_()))

    done = find(docs, benchmark, then=(rewrite, "text string"), **options)
    columns = [F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return done.select(*columns)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
