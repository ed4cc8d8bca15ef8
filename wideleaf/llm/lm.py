"""Language-model scores: context-tree weighting over bytes, beside a smoothed unigram base.

Training counts come from all documents whose crc32(doc_id as text) mod 10 is not 0.  Every byte (A-Z lowered, one
end mark 0xFF) is cut into eight binary decisions; each of the 255 decision nodes has its own context tree over the
bytes before, to depth ``DEPTH``.  A node of a tree estimates by Krichevsky and Trofimov; its weighted probability
is half its own estimate's and half the product of its children's, so all depths are mixed.  Every context of the
training bytes is a node, however rare.  The nodes are a table: those that share the last two bytes of their contexts
are weighed in one task, and only the sums by last byte (at most 256 * 255 rows) reach the driver.  Held-out documents
add what they hold with a count of 0, so the table has a probability for every context and byte that is scored.

Words as frequent as 1/``WORDS`` of the tokens (at most ``WORDS`` of them) and contexts with a byte as frequent as
1/``GRAMS`` of the bytes (at most ``GRAMS``) are looked up in each task; all others are joined with the whole table,
so both scores are exact.

Defined results: a null or empty text is one end token; a null doc_id counts as the text '' (held out); equal rows
are scored separately and alike; without training rows N and V are 0, the base is that of V = 0 and all estimates
are one half; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wideleaf.llm.common import LOWER_ASCII, map_batches, spool, unspool

DEPTH, GRAMS, WORDS, LONG_WORD = 4, 1 << 22, 1 << 17, 64
END = 255


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(LOWER_ASCII) if text else b""


def _grams(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and end mark of the texts: context and byte as one number (DEPTH + 1 bytes, the byte lowest); text starts."""
    pad = bytes([END]) * DEPTH
    joined = np.frombuffer(b"".join([x for d in data for x in (pad, d, b"\xff")]), np.uint8)
    code = np.zeros(len(joined) - DEPTH, np.uint64)
    for k in range(DEPTH + 1):
        code = (code << np.uint64(8)) | joined[k : len(joined) - DEPTH + k]
    sizes = np.array([len(d) + 1 for d in data])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    keep = np.repeat(np.arange(len(data)) * DEPTH, sizes) + np.arange(sizes.sum())
    return code[keep], starts


def _nearest_first(code: np.ndarray) -> np.ndarray:
    """Codes of ``_grams`` with the context turned round, the byte before highest: so each shorter context is a prefix."""
    return (code >> np.uint64(8)).astype(np.uint32).byteswap().astype(np.uint64) << np.uint64(8) | code & np.uint64(255)


def _counting(most: int = 1_000_000):
    def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        every, at = np.unique(np.concatenate(codes), return_inverse=True)
        return every, np.bincount(at, np.concatenate(counts), len(every)).astype(np.int64)

    def batch_of(word: list | None, code: np.ndarray | None, n) -> pa.RecordBatch:
        size = len(n)
        return pa.RecordBatch.from_arrays([pa.array(word, pa.binary()) if word else pa.nulls(size, pa.binary()), pa.array(code.astype(np.int64)) if code is not None else pa.nulls(size, pa.int64()), pa.array(n, pa.int64())], ["word", "code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        codes, counts, held = [], [], 0
        for batch in batches:
            texts: dict[bool, list[bytes]] = {False: [], True: []}
            for t, out in zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist()):
                texts[out].append(_bytes(t))
            for d in texts[False]:
                words.update(d.split())
            if texts[False]:
                words[b""] += len(texts[False])
            for out, data in texts.items():
                if data:
                    code, n = np.unique(_nearest_first(_grams(data)[0]), return_counts=True)
                    codes.append(code)
                    counts.append(n * (not out))
                    held += len(code)
            if held > 4 * most:
                code, n = merged(codes, counts)
                codes, counts, held = [code], [n], len(code)
                if held > 2 * most:
                    yield batch_of(None, code, n)
                    codes, counts, held = [], [], 0
            if len(words) > most:
                yield batch_of(list(words), None, list(words.values()))
                words = Counter()
        if words:
            yield batch_of(list(words), None, list(words.values()))
        if codes:
            yield batch_of(None, *merged(codes, counts))

    return run


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after shifting small arguments up."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        shift[small] += np.log(y[small])
        y[small] += 1
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _decisions(counts: np.ndarray) -> np.ndarray:
    """(contexts, 256 bytes) counts to (contexts, 256 nodes, 2): node 1 decides on the top bit, 2n and 2n+1 follow node n."""
    sums = np.zeros((len(counts), 512))
    sums[:, 256:] = counts
    for node in range(255, 0, -1):
        sums[:, node] = sums[:, 2 * node] + sums[:, 2 * node + 1]
    nodes = np.zeros((len(counts), 256, 2))
    nodes[:, 1:, 0], nodes[:, 1:, 1] = sums[:, 2::2], sums[:, 3::2]
    return nodes


def _estimate(n: np.ndarray) -> np.ndarray:
    return (n[..., 1] + 0.5) / (n.sum(-1) + 1)


def _evidence(n: np.ndarray) -> np.ndarray:
    return _log_gamma(n[..., 0] + 0.5) + _log_gamma(n[..., 1] + 0.5) - 2 * math.lgamma(0.5) - _log_gamma(n.sum(-1) + 1)


@dataclass
class Model:
    """``rows``: log10 of the probability of each byte, for each leaf.  ``third``: leaf by the three bytes before, given
    by depth; ``fourth``: (leaf, byte four before) to leaf."""

    contexts: list[np.ndarray]
    rows: np.ndarray
    base: list[int]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        third = np.zeros((256, 256, 256), np.int32)
        for d, codes in enumerate(self.contexts[:4]):
            row = self.base[d] + np.arange(len(codes), dtype=np.int32)
            c = codes.astype(np.int64)
            if d == 1:
                third[:, :, c] = row
            elif d == 2:
                third[:, c >> 8, c & 255] = row
            elif d == 3:
                third[c >> 16, c >> 8 & 255, c & 255] = row
        third = third.reshape(-1)
        fourth = np.repeat(np.arange(len(self.rows), dtype=np.int32), 256)
        c = self.contexts[4].astype(np.int64)
        if len(c):
            fourth[third[c & 0xFFFFFF].astype(np.int64) * 256 + (c >> 24)] = self.base[4] + np.arange(len(c), dtype=np.int32)
        return third, fourth


def weigh(tables: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of counts that fit in memory: for each depth, sorted contexts and their (contexts, 256) counts.

    ``weighed`` is the same over a table of any size; tests hold it against this."""
    decided = [_decisions(counts) for _, counts in tables]
    contexts = [c for c, _ in tables]
    parents = [None, *(np.searchsorted(contexts[d - 1], contexts[d] & np.uint64((1 << 8 * (d - 1)) - 1)) for d in range(1, DEPTH + 1))]
    weighted: list[np.ndarray | None] = [None] * (DEPTH + 1)
    own: list[np.ndarray | None] = [None] * (DEPTH + 1)
    rest: list[np.ndarray | None] = [None] * (DEPTH + 1)
    for d in range(DEPTH, -1, -1):
        evidence = _evidence(decided[d])
        if d == DEPTH:
            weighted[d], own[d] = evidence, np.ones_like(evidence)
            continue
        rest[d] = decided[d].copy()
        np.subtract.at(rest[d], parents[d + 1], decided[d + 1])
        below = _evidence(rest[d])
        np.add.at(below, parents[d + 1], weighted[d + 1])
        weighted[d] = np.logaddexp(evidence, below) - math.log(2)
        own[d] = np.exp(evidence - math.log(2) - weighted[d])
    mixed, left, rows, base = None, None, [], []
    for d in range(DEPTH + 1):
        before = (0.0, 1.0) if d == 0 else (mixed[parents[d]], left[parents[d]])
        mixed = before[0] + before[1] * own[d] * _estimate(decided[d])
        left = before[1] * (1 - own[d])
        q = mixed if d == DEPTH else mixed + left * _estimate(rest[d])
        q = np.clip(q, 1e-300, 1 - 1e-16)
        logs = np.zeros((len(q), 1))
        for level in range(8):
            node = q[:, 1 << level : 2 << level]
            logs = np.stack((logs + np.log10(1 - node), logs + np.log10(node)), -1).reshape(len(q), 2 << level)
        base.append(sum(map(len, rows)))
        rows.append(logs.astype(np.float32))
    return Model(contexts, np.concatenate(rows), base)


@dataclass
class _Level:
    """One of the eight decisions over sorted codes: ``at[d]`` leads from the nodes of depth d + 1 to those of depth d (``at[4]``
    from the codes to the nodes of depth 4); ``n[d]`` and ``weighted[d]`` are by node, ``keys`` those of depth 2."""

    bit: np.ndarray
    keys: np.ndarray
    at: dict[int, np.ndarray]
    n: dict[int, np.ndarray]
    evidence: dict[int, np.ndarray]
    weighted: dict[int, np.ndarray]


def _levels(code: np.ndarray, n: np.ndarray) -> Iterator[_Level]:
    """The weights from depth 4 to 2 of all codes of some two-byte contexts."""
    for level in range(8):
        bit = (code >> np.uint64(7 - level) & np.uint64(1)).astype(np.int64)
        prefix = (code & np.uint64(255)) >> np.uint64(8 - level)
        contexts, keys, at, counts, evidence, weighted = code >> np.uint64(8), None, {}, {}, {}, {}
        for d in (4, 3, 2):
            keys, first, at[d] = np.unique(contexts << np.uint64(level) | prefix, return_index=True, return_inverse=True)
            if d == 4:
                counts[d] = np.bincount(2 * at[d] + bit, n, 2 * len(keys)).reshape(-1, 2)
            else:
                counts[d] = np.stack([np.bincount(at[d], counts[d + 1][:, k], len(keys)) for k in (0, 1)], -1)
            evidence[d] = _evidence(counts[d])
            weighted[d] = evidence[d] if d == DEPTH else np.logaddexp(evidence[d], np.bincount(at[d], weighted[d + 1], len(keys))) - math.log(2)
            contexts, prefix = contexts[first] >> np.uint64(8), prefix[first]
        yield _Level(bit, (keys >> np.uint64(level)) << np.uint64(8) | np.uint64(1 << level) | prefix, at, counts, evidence, weighted)


def _by_pair(fn: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], least: int = 100_000):
    """``fn`` over sorted codes and their counts; the codes of one two-byte context are never parted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, held = [], [], 0
        for batch in batches:
            if not len(batch):
                continue
            codes.append(batch.column("code").to_numpy().astype(np.uint64))
            counts.append(batch.column("n").to_numpy())
            held += len(batch)
            if held >= least and codes[-1][-1] >> np.uint64(24) != codes[0][0] >> np.uint64(24):
                code, n = np.concatenate(codes), np.concatenate(counts)
                cut = int(np.searchsorted(code >> np.uint64(24), code[-1] >> np.uint64(24)))
                yield fn(code[:cut], n[:cut])
                codes, counts, held = [code[cut:]], [n[cut:]], len(code) - cut
        if held:
            yield fn(np.concatenate(codes), np.concatenate(counts))

    return run


def _sums(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    levels = list(_levels(code, n))
    key, zero, one, weight = (np.concatenate(x) for x in zip(*((x.keys, x.n[2][:, 0], x.n[2][:, 1], x.weighted[2]) for x in levels)))
    node = (key >> np.uint64(16) << np.uint64(8) | key & np.uint64(255)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(zero.astype(np.int64)), pa.array(one.astype(np.int64)), pa.array(weight)], ["node", "zero", "one", "below"])


def _top(sums: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """What depths 0 and 1 give of each decision after each byte, and the weight they leave to the depths below: (256 bytes, 256 nodes) each."""
    node, zero, one, under = (sums.column(k).to_numpy() for k in range(4))
    n, below = np.zeros((256, 256, 2)), np.zeros((256, 256))
    n[node >> 8, node & 255, 0], n[node >> 8, node & 255, 1], below[node >> 8, node & 255] = zero, one, under
    all_n, evidence = n.sum(0), _evidence(n)
    weighted = np.logaddexp(evidence, below) - math.log(2)
    own = np.exp(evidence - math.log(2) - weighted)
    all_evidence = _evidence(all_n)
    all_own = np.exp(all_evidence - np.logaddexp(all_evidence, weighted.sum(0)))
    return all_own * _estimate(all_n) + (1 - all_own) * own * _estimate(n), (1 - all_own) * (1 - own)


def _probabilities(shared):
    def run(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        mixed_above, left_above = shared.value
        logs = np.zeros(len(code))
        for x in _levels(code, n):
            at = (x.keys >> np.uint64(16)).astype(int), (x.keys & np.uint64(255)).astype(int)
            mixed, left = mixed_above[at], left_above[at]
            for d in (2, 3):
                own = np.exp(x.evidence[d] - math.log(2) - x.weighted[d])
                mixed, left = mixed + left * own * _estimate(x.n[d]), left * (1 - own)
                mixed, left = mixed[x.at[d]], left[x.at[d]]
            q = np.clip(mixed + left * _estimate(x.n[4]), 1e-300, 1 - 1e-16)[x.at[4]]
            logs += np.log10(np.where(x.bit == 1, q, 1 - q))
        return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n), pa.array(logs.astype(np.float32))], ["code", "n", "p"])

    return run


def weighed(counts: DataFrame) -> DataFrame:
    """code (nearest byte first), n and the log10 of the probability that the context tree gives, for each code counted."""
    grams = counts.where("code is not null").select("code", "n").repartition(F.shiftright("code", 24)).sortWithinPartitions("code")
    sums = map_batches(grams, _by_pair(_sums), "node long, zero long, one long, below double").groupBy("node").agg(F.sum("zero"), F.sum("one"), F.sum("below")).toArrow()
    shared = counts.sparkSession.sparkContext.broadcast(_top(sums))
    return map_batches(grams, _by_pair(_probabilities(shared)), "code long, n long, p float")


class Lookup:
    """Values of codes in tables of one slot a hash: a code whose slot is taken by one before it is in a further table."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.tables = []
        random = np.random.default_rng(10)
        while len(codes):
            bits = max(8, (2 * len(codes) - 1).bit_length())
            factor, shift = np.uint64(int(random.integers(1 << 62, 1 << 63)) | 1), np.uint64(64 - bits)
            slot, first = np.unique((codes * factor) >> shift, return_index=True)
            keys, held = np.full(1 << bits, (1 << 64) - 1, np.uint64), np.zeros(1 << bits, np.float32)
            keys[slot], held[slot] = codes[first], values[first]
            self.tables.append((factor, shift, keys, held))
            rest = np.ones(len(codes), bool)
            rest[first] = False
            codes, values = codes[rest], values[rest]

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each code, 0 where it is not held; and the places of those not held."""
        out, missing = np.zeros(len(codes), np.float32), np.arange(len(codes))
        for factor, shift, keys, held in self.tables:
            slot = ((codes * factor) >> shift).astype(np.int64)
            hit = keys[slot] == codes
            out[missing[hit]] = held[slot[hit]]
            missing, codes = missing[~hit], codes[~hit]
        return out, missing


@dataclass
class Trained:
    counts: DataFrame
    grams: DataFrame
    frequent_grams: tuple[np.ndarray, np.ndarray]
    least_gram: float
    frequent: dict[bytes, int]
    least: float
    tokens: int
    types: int


def train(docs: DataFrame) -> Trained:
    """Count the training documents (all but the held-out ones) and weigh the trees, also for what the held-out ones hold."""
    rows = docs.select(F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    parts = map_batches(rows, _counting(), "word binary, code long, n long")
    counts = spool(parts.groupBy("word", "code").agg(F.sum("n").alias("n")), "lm-counts")
    n, types = counts.where("word is not null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = n / WORDS
    often = counts.where((F.col("n") >= least) & (F.octet_length("word") <= LONG_WORD)).select("word", "n").toArrow()
    frequent = dict(zip(often.column(0).to_pylist(), often.column(1).to_pylist()))
    grams = spool(weighed(counts), "lm-grams")
    least_gram = max(1, (grams.agg(F.sum("n")).first()[0] or 0) / GRAMS)
    top = grams.where(F.col("n") >= least_gram).select("code", "p", "n").toArrow()
    order = np.argsort(-top.column(2).to_numpy(), kind="stable")
    frequent_grams = top.column(0).to_numpy().astype(np.uint64)[order], top.column(1).to_numpy()[order]
    return Trained(counts, grams, frequent_grams, least_gram, frequent, least, n, types)


_tables: dict[int, tuple] = {}


def _keys(code: np.ndarray) -> pa.Array:
    """Codes as keys beside words: a line feed, which no word holds, and five bytes."""
    out = np.full((len(code), 6), 10, np.uint8)
    out[:, 1:] = code.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(6), len(code), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())


_PARTS = ["rid", "word", "n", "base", "known", "tokens", "size", "score", "doc_id"]


def _scoring(shared, key: str):
    """For each document a row of its own, with its id, and one for each word and context that isn't looked up here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, frequent, tokens, types = shared.value
        if key not in _tables:
            _tables.clear()
            norm = math.log10(tokens + 0.1 * (types + 1))
            _tables[key] = (Lookup(*grams), {w: math.log10(c + 0.1) - norm for w, c in frequent.items()})
        lookup, logs = _tables[key]
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            rids = batch.column("rid").to_pylist()
            data = [_bytes(t) for t in batch.column("text").to_pylist()]
            if not data:
                continue
            scores = np.zeros(len(data))
            first = 0
            while first < len(data):  # some megabytes at a time
                last, size = first, 0
                while last < len(data) and (last == first or size + len(data[last]) < 1 << 21):
                    size += len(data[last]) + 1
                    last += 1
                code, starts = _grams(data[first:last])
                code = _nearest_first(code)
                found, missing = lookup.find(code)
                scores[first:last] = np.add.reduceat(found.astype(np.float64), starts)
                if len(missing):
                    own = np.searchsorted(starts, missing, "right") - 1
                    pairs, n = np.unique(own.astype(np.uint64) << np.uint64(40) | code[missing], return_counts=True)
                    row, size = np.array(rids[first:last])[(pairs >> np.uint64(40)).astype(np.int64)], len(pairs)
                    arrays = [pa.array(row, pa.int64()), _keys(pairs & np.uint64((1 << 40) - 1)), pa.array(n, pa.int64()), pa.array(np.zeros(size)), *[pa.array(np.zeros(size, np.int64))] * 3, pa.array(np.zeros(size)), pa.nulls(size, kind)]
                    yield pa.RecordBatch.from_arrays(arrays, _PARTS)
                first = last
            out: dict[str, list] = {k: [] for k in ("rid", "word", "n", "base", "known", "tokens", "size", "doc")}
            for rid, d, doc in zip(rids, data, batch.column("doc_id").to_pylist()):
                found = Counter(d.split())
                found[b""] = 1
                total = sum(found.values())
                sums, known, rare = 0.0, 0, 0
                for w, n in found.items():
                    if (x := logs.get(w)) is not None:
                        sums += n * x
                        known += n
                    else:
                        out["word"].append(w)
                        out["n"].append(n)
                        rare += 1
                out["rid"] += [rid] * (rare + 1)
                out["word"].append(b" %d" % rid)  # no word holds a blank: the document's own row, matched by nothing
                out["n"].append(0)
                out["base"] += [0.0] * rare + [sums]
                out["known"] += [0] * rare + [known]
                out["tokens"] += [0] * rare + [total]
                out["size"] += [0] * rare + [len(d) + 1]
                out["doc"] += [None] * rare + [doc]
            score = np.zeros(len(out["rid"]))
            score[np.flatnonzero(np.array(out["n"]) == 0)] = scores
            arrays = [pa.array(out["rid"], pa.int64()), pa.array(out["word"], pa.binary()), pa.array(out["n"], pa.int64()), pa.array(out["base"], pa.float64()), pa.array(out["known"], pa.int64()), pa.array(out["tokens"], pa.int64()), pa.array(out["size"], pa.int64()), pa.array(score), pa.array(out["doc"], kind)]
            yield pa.RecordBatch.from_arrays(arrays, _PARTS)

    return run


def score(docs: DataFrame, trained: Trained) -> DataFrame:
    """For the documents that ``trained`` is of: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte, a row per document."""
    spark = docs.sparkSession
    ids = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("text").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast((trained.frequent_grams, trained.frequent, trained.tokens, trained.types))
    key = f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id() if shared._jbroadcast else id(shared)}"
    kind = ids.schema["doc_id"].dataType.simpleString()
    parts = map_batches(ids, _scoring(shared, key), f"rid long, word binary, n long, base double, known long, tokens long, size long, score double, doc_id {kind}")
    rare = trained.counts.where((F.col("n") < trained.least) | (F.octet_length("word") > LONG_WORD)).where("word is not null").select("word", F.col("n").alias("c"), F.lit(None).cast("float").alias("p"))
    mark = F.lit("\n").cast("binary")
    deep = trained.grams.where(F.col("n") < trained.least_gram).select(F.concat(mark, F.unhex(F.lpad(F.hex("code"), 10, "0"))).alias("word"), F.lit(None).cast("long").alias("c"), "p")
    norm = math.log10(trained.tokens + 0.1 * (trained.types + 1))
    c, is_word = F.coalesce(F.col("c"), F.lit(0)), ~F.col("word").startswith(mark)
    joined = parts.join(rare.unionByName(deep), "word", "left").groupBy("rid").agg(
        F.sum(F.when(is_word, F.col("base") + F.col("n") * (F.log10(c + F.lit(0.1)) - norm)).otherwise(0)).alias("base_score"), F.sum(F.col("known") + F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.max("doc_id").alias("doc_id"), F.sum("size").alias("size"), F.sum("tokens").alias("n_tokens"), F.sum(F.col("score") + F.when(is_word, 0).otherwise(F.col("n") * F.col("p"))).alias("score"),
    )
    bits = -F.col("score") * math.log2(10) / F.col("size")
    return joined.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(trained.tokens).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))


def report(docs: DataFrame) -> DataFrame:
    return score(docs, train(docs))


def forget(trained: Trained) -> None:
    """Delete the spooled tables, once no result of ``score`` is read any more."""
    unspool(trained.counts)
    unspool(trained.grams)
