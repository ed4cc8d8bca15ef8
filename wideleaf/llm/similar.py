"""Near-duplicate join: word shingles with Jaccard similarity of ``SIMILAR`` or more, by chosen paths.

1. Rows get an id and are written once with their sketch; all that follows reads that table, so ids stay whatever is
   recomputed.  Documents of the same shingle set form one node (whatever their number).
2. Each run splits the nodes recursively: at a tree node, positions of the sketch are chosen by a hash of the path,
   at least one; a document goes on to a child for each chosen position and its value there.  Buckets of at
   most ``SMALL`` nodes end; at ``DEEPEST`` all end, and larger ones are dealt in pairs of blocks.  A pair at the limit
   shares each choice with its similarity, so a run finds it with SIMILAR ** depth at least; runs repeat until
   the target recall is met at the greatest depth.
3. Bucket mates whose sketches agree in ``NEAR`` of their positions are joined to coarse components.  Of 128 positions a pair
   at the limit agrees in 80 or more with a probability above 1 - 10**-6, so this step takes nothing off the target recall.
4. Inside coarse components, the Jaccard similarity is taken exactly from the shingle sets, block against block: every
   similar pair counts as a link; classes are the components of these links.  Pairs are never emitted, only counts
   and a link of each node to the smallest it is joined with in its block.

Joins on paths, components, shingle sets and classes go through ``attach``: keys that hold many rows never meet in one task.

Words are runs of anything but space and tab to carriage return, A-Z lowered.  Defined results: a text of one to four
words is one shingle; a null or empty text, or one without words, is a class of its own without links; equal texts are
links of each other; null ids take part, a class of null ids only has a null class id; an empty table gives an empty
result; further columns are ignored (or carried, when rows are dropped).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wideleaf.llm.common import LOWER_ASCII, attach, map_batches, row_id, spool, unspool

WORDS, SIMILAR, POSITIONS = 5, 0.8, 128
NEAR, SMALL, DEEPEST, BLOCK, RECALL = 0.62, 128, 3, 256, 0.999
#: Runs that find a pair at the limit with the target recall, if all its buckets are large down to the deepest.
RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - SIMILAR**DEEPEST))
BRANCHES = 1.25  # children of a tree node that are chosen on average, besides the one that always is

_U64 = np.uint64
_rng = np.random.default_rng(20240101)
_FACTORS = _rng.integers(0, 1 << 32, POSITIONS, np.uint32) | np.uint32(1)
_ADDENDS = _rng.integers(0, 1 << 32, POSITIONS, np.uint32)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(31))) * _U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U64(29))) * _U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U64(32))


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``k`` words; of the whole text, if it has fewer."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split() if text else []
    if not words:
        return np.zeros(0, _U64)
    h = np.fromiter(map(_hashes.__getitem__, words), _U64, len(words))
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, _U64)
    for i in range(k):
        out = out * _U64(0xD6E8FEB86659FD93) + h[i : len(h) - k + 1 + i]
    return np.unique(_mix(out))


def sketch(found: np.ndarray) -> np.ndarray:
    x = (found >> _U64(32)).astype(np.uint32)
    out = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 2048):
        out = np.minimum(out, (_FACTORS[:, None] * x[None, a : a + 2048] + _ADDENDS[:, None]).min(1))
    return out


def _sketching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signs, sketches = [], []
        for text in pc.struct_field(batch.column("row"), "text").to_pylist():
            found = shingles(text)
            signs.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            sketches.append(sketch(found).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("row"), pa.array(signs, pa.binary()), pa.array(sketches, pa.binary())], ["rid", "row", "sign", "sketch"])


def _chosen(path: np.ndarray) -> np.ndarray:
    """Which positions are chosen at each path: (paths, POSITIONS) booleans."""
    h = _mix(path[:, None] + np.arange(1, POSITIONS + 1, dtype=_U64) * _U64(0xA0761D6478BD642F))
    out = h < _U64(int(BRANCHES / POSITIONS * 2**64))
    out[np.arange(len(path)), h.argmin(1)] = True
    return out


def _splitting(level: int):
    """Children of (node, path, sketch); at the root, of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = _mix(np.arange(1, RUNS + 1, dtype=_U64) * _U64(0xE7037ED1A0B428DB))
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            values = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(n, POSITIONS)
            nodes = batch.column("node").to_numpy()
            if level == 0:
                picks = _chosen(roots)
                which = [(r, i) for r in range(RUNS) for i in np.flatnonzero(picks[r])]
                path = np.concatenate([_mix(roots[r] ^ (values[:, i].astype(_U64) + _U64(i << 32))) for r, i in which])
                node = np.tile(nodes, len(which))
            else:
                own = batch.column("path").to_numpy().view(_U64)
                row, i = np.nonzero(_chosen(own))
                path = _mix(own[row] ^ (values[row, i].astype(_U64) + (i.astype(_U64) << _U64(32))))
                node = nodes[row]
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(node)], ["path", "node"])

    return run


def _local_components(same: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the smallest row it is connected with."""
    label = np.arange(len(same))
    todo = np.ones(len(same), bool)
    for i in range(len(same)):
        if not todo[i]:
            continue
        front, seen = np.array([i]), np.zeros(len(same), bool)
        seen[i] = True
        while len(front):
            reach = same[front].any(0) & ~seen
            seen |= reach
            front = np.flatnonzero(reach)
        label[seen], todo[seen] = i, False
    return label


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of one key after another; ``batches`` are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < len(keys):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for group in _groups(batches, "path"):
        if len(group) > 1:
            node = group.column("node").to_numpy()
            values = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint32).reshape(len(node), POSITIONS)
            same = np.stack([(values == v).sum(1) >= NEAR * POSITIONS for v in values])
            label = _local_components(same)
            low = np.full(len(node), np.iinfo(np.int64).max)
            np.minimum.at(low, label, node)
            joined = low[label]
            a += node[node != joined].tolist()
            b += joined[node != joined].tolist()
        if len(a) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _in_blocks(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows (key, n, node, ...) dealt so that any two nodes of a key meet: with n <= size in one group, else in groups
    for each pair of blocks.  Columns ``path``, the group, and ``side``: 0 or 1 in a pair of different blocks, else null."""
    blocks = F.ceil(F.col("n") / size).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    dealt = df.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    path = F.when(F.col("blocks") == 1, F.xxhash64(key)).otherwise(F.xxhash64(key, low, high, F.lit(1)))
    side = F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1)
    return dealt.select(path.alias("path"), side.alias("side"), *[c for c in df.columns if c not in (key, "n")])


def components(links: DataFrame, *, plain: int = 16_384) -> DataFrame:
    """(node, label) of all nodes in ``links`` (a, b): label is the smallest node connected.  Alternates large and small stars
    until nothing changes, which takes a number of rounds that grows with the logarithm of the nodes.

    Up to ``plain`` edges a round is one plan; beyond, the centres of large stars are joined apart from the others."""

    def starred(edges: DataFrame, ends: DataFrame, many: bool) -> DataFrame:
        low = ends.withColumn("n", F.lit(1)).groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.sum("n").alias("n"))
        return attach(ends, spool(low, "stars"), ["a"], "inner") if many else ends.join(low, "a")

    edges = spool(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state, size = None, edges.count()
    for _ in itertools.count():
        many = size > plain
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        large = starred(edges, both, many).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = spool(large, "links") if many else large
        joined = starred(large, large, many)
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        following = spool(small, "links")
        seen = following.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        unspool(edges)
        unspool(large)
        edges, size = following, seen[0]
        if seen == state or not size:
            break
        state = seen
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())


def _coarse(nodes: DataFrame) -> DataFrame:
    """(node, label): components of nodes that chosen paths bring together and whose sketches are near."""
    level = spool(map_batches(nodes.select("node", "sketch"), _splitting(0), "path long, node long"), "paths")
    parts, spent = [], [level]
    for depth in range(1, DEEPEST + 1):
        sizes = spool(level.groupBy("path").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1"), "sizes")
        ended = sizes if depth == DEEPEST else sizes.where(F.col("n") <= SMALL)
        # Many buckets, of all runs, have the same members; one of them will do.
        one = spool(ended.groupBy("n", "x", "y").agg(F.min("path").alias("path")).drop("x", "y"), "sizes")
        parts.append(attach(level, one, ["path"], "inner").select("path", "n", "node"))
        spent += [sizes, one]
        if depth < DEEPEST:
            large = attach(level, sizes.where(F.col("n") > SMALL).select("path", "n"), ["path"], "left_semi").join(nodes.select("node", "sketch").hint("merge"), "node")
            level = spool(map_batches(large, _splitting(depth), "path long, node long"), "paths")
            spent.append(level)
    buckets = parts[0]
    for p in parts[1:]:
        buckets = buckets.union(p)
    buckets = spool(buckets, "buckets")
    # Sketches are joined before rows are copied to their pairs of blocks, so the join has a row per bucket and node.
    dealt = _in_blocks(buckets.join(nodes.select("node", "sketch").hint("merge"), "node").withColumnRenamed("path", "bucket"), "bucket", 2 * BLOCK)
    links = map_batches(dealt.select("path", "node", "sketch").repartition("path").sortWithinPartitions("path"), _bucket_links, "a long, b long")
    found = components(links)
    for x in (*spent, buckets):
        unspool(x)
    return found


def _exact_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[list] = [[], [], []]

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["node", "links", "low"])
        for x in out:
            x.clear()
        return made

    for group in _groups(batches, "path"):
        node, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
        side = group.column("side").to_pylist()
        sets = [shingles(t) for t in group.column("text").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        tokens, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        shared = seen[at] > 1
        row, at = row[shared], np.unique(at[shared], return_inverse=True)[1]
        common = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        for a in range(0, int(at[-1]) + 1 if len(at) else 0, 8192):
            i, j = np.searchsorted(at, (a, a + 8192))
            part = np.zeros((len(sets), 8192), np.float32)
            part[row[i:j], at[i:j] - a] = 1
            common += part @ part.T
        union = sizes[:, None] + sizes[None, :] - common
        same = 5 * common >= 4 * union
        np.fill_diagonal(same, False)
        if side[0] is not None:
            s = np.array(side)
            same &= s[:, None] != s[None, :]
        label = _local_components(same)
        low = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(low, label, node)
        out[0] += node.tolist()
        out[1] += (same @ copies).tolist()
        out[2] += low[label].tolist()
        if len(out[0]) > 20_000:
            yield batch()
    yield batch()


@dataclass
class Classes:
    """``rows``: rid, row (the columns asked for) and sign, a row per document; ``signs``: for each sign its ``copies``, the
    ``first`` document of its class (by id, nulls last, then row), the class's ``size``, and the ``links`` of each copy."""

    rows: DataFrame
    signs: DataFrame


def classes(docs: DataFrame, columns: list[str]) -> Classes:
    text = F.col("text").cast("string").alias("text")
    ids = docs.select(row_id().alias("rid"), F.struct(*[text if c == "text" else F.col(f"`{c}`") for c in columns]).alias("row"))
    kind = ids.schema["row"].dataType.simpleString()
    sketched = spool(map_batches(ids, _sketching, f"rid long, row {kind}, sign binary, sketch binary"), "sketches")
    doc = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), "rid")
    nodes = spool(sketched.where("sign is not null").groupBy("sign").agg(F.min("rid").alias("node"), F.count("*").alias("copies"), F.any_value("sketch").alias("sketch"), F.min(doc).alias("first")), "nodes")
    coarse = spool(_coarse(nodes), "coarse")
    sizes = spool(coarse.groupBy("label").agg(F.count("*").alias("n")), "sizes")
    members = spool(attach(coarse, sizes, ["label"], "inner").join(nodes.select("node", "copies").hint("merge"), "node").withColumn("one", F.lit(1)), "members")
    texts = attach(sketched.select(F.col("rid").alias("node"), F.col("row.text").alias("text")), members, ["node"], "inner", weight="one")
    dealt = _in_blocks(texts.select("label", "n", "node", "copies", "text"), "label", BLOCK)
    counted = spool(map_batches(dealt.repartition("path").sortWithinPartitions("path"), _exact_links, "node long, links long, low long"), "counted")
    linked = counted.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(counted.select(F.col("node").alias("a"), F.col("low").alias("b")))
    per_node = nodes.select("sign", "node", "copies", "first").join(linked.hint("merge"), "node", "left").join(joined.hint("merge"), "node", "left")
    own = spool(per_node.select("sign", "copies", "first", F.coalesce("label", "node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links")), "signs")
    whole = spool(own.groupBy("class").agg(F.min("first").alias("of_class"), F.sum("copies").alias("size"), F.count("*").alias("n")), "classes")
    signs = spool(attach(own, whole, ["class"], "inner").select("sign", "copies", "links", F.col("of_class").alias("first"), "size"), "signs")
    for x in (nodes, coarse, sizes, members, counted, own, whole):
        unspool(x)
    return Classes(sketched.select("rid", "row", "sign"), signs)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), class_size and n_links, a row per document."""
    found = classes(docs, ["doc_id", "text"])
    joined = attach(found.rows.select(F.col("row.doc_id").alias("doc_id"), "sign"), found.signs, ["sign"], weight="copies")
    alone = F.col("size").isNull()
    return joined.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), F.coalesce("size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, that of the smallest id."""
    found = classes(docs, docs.columns)
    # Documents whose class is themselves alone need no join.
    several = found.signs.where("size > 1").select("sign", "copies", F.col("first.rid").alias("first"))
    kept = attach(found.rows, several, ["sign"], weight="copies").where("first is null or rid = first")
    return kept.select(*[F.col(f"row.`{c}`").cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
