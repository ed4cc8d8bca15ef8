"""Byte-level BPE: a lazily determinised transducer encodes, a UTF-8 state machine decodes.

Encoding a piece left to right, the last token of the encoding of each prefix is unique: the one
token that ends there, starts where a shorter prefix ends, and may follow that prefix's own last
token.  A state of the transducer holds, for every position at which a token that isn't complete may
still start (an open position), the bytes since as a node of the vocabulary's trie, and the last token
before.  States and transitions are made when first reached.  Tokens up to the last cut that the
encodings up to all open positions share are final, so the lookahead is bounded by the longest token.

Defined results: a null or empty text has no tokens (both digests are those of an empty string);
rows of equal text are encoded separately and alike; further columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wideleaf.llm.common import map_batches


#: Pieces go through the transducer in chunks of as many bytes.
CHUNK = 256

#: Fixed value: the published split pattern of this vocabulary, for which texts may be cut before single blanks.
GPT2_LIKE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_RUNS = re.compile(r"[\t\n\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file: base64 token, blank, rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Transducer:
    """Encodes pieces by merge ranks.  ``max_states`` bounds the memory: beyond it, states are forgotten and remade."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000):
        self.ranks = ranks
        self.token = {r: b for b, r in ranks.items()}
        #: The tokens as a trie: (node * 256 + byte) to node, the token that ends at a node, whether more follows it.
        self.child: dict[int, int] = {}
        self.ending, self.more = [-1], bytearray(1)
        for data, rank in ranks.items():
            node = 0
            for byte in data:
                self.more[node] = 1
                at = node << 8 | byte
                if (node := self.child.get(at, 0)) == 0:
                    self.child[at] = node = len(self.ending)
                    self.ending.append(-1)
                    self.more.append(0)
            self.ending[node] = rank
        self.max_states = max_states
        self._depths: list[int] = []
        self._pairs: dict[int, bool] = {}
        self._chains: dict[int, tuple | None] = {}
        self._forget()

    def _forget(self) -> None:
        #: A state: for each open position, the trie node of the bytes since, and the last token before it (-1: none), as
        #: one number.  The last open position is the current one; its token is the last of the encoding so far.
        self.keys = [(0,)]
        self.number = {self.keys[0]: 0}
        self.last, self.size = [-1], [0]
        self.step: dict[int, int] = {}

    def merge(self, data: bytes) -> list[int]:
        """The plain definition: join the adjacent pair of lowest rank, leftmost first, until none is known."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _edges(self, token: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]] | None:
        """What stands at the left and at the right edge of ``token`` while its bytes merge: each token, and the
        rank of the merge that ends it.  None if its bytes don't merge to this token."""
        if token in self._chains:
            return self._chains[token]
        data, never = self.token[token], 1 << 60
        left, right = [], []
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[k] + parts[k + 1], never), k) for k in range(len(parts) - 1))
            if rank == never:
                break
            if at == 0:
                left.append((self.ranks[parts[0]], rank))
            if at == len(parts) - 2:
                right.append((self.ranks[parts[-1]], rank))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self._chains[token] = made = ([*left, (token, never)], [*right, (token, never)]) if len(parts) == 1 else None
        return made

    def follows(self, a: int, b: int) -> bool:
        """Whether ``b`` right after ``a`` can stand in an encoding: at no time may the two tokens at their border
        merge before either is merged within its own side.  Of equal ranks, the leftmost merges first."""
        if (known := self._pairs.get(a << 32 | b)) is not None:
            return known
        if len(self._pairs) > 300_000:
            self._pairs.clear()
        if self._edges(b) is None:
            self._pairs[a << 32 | b] = False
            return False
        xs, ys = self._edges(a)[1], self._edges(b)[0]
        i = j = 0
        never, rank, token = 1 << 60, self.ranks, self.token
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            r = rank.get(token[x] + token[y], never)
            if r < x_ends and r <= y_ends and r < never:
                good = False
                break
            if x_ends == never and y_ends == never:
                good = True
                break
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1
        self._pairs[a << 32 | b] = good
        return good

    def _make(self, state: int, byte: int) -> int:
        live, lead = [], -1
        for packed in self.keys[state]:
            last = (packed & 0xFFFFFFFF) - 1
            node = self.child.get(packed >> 32 << 8 | byte)
            if node is None:
                continue
            if lead < 0 and (t := self.ending[node]) >= 0 and (self.follows(last, t) if last >= 0 else self._edges(t)):
                lead = t
            if self.more[node]:
                live.append(node << 32 | last + 1)
        if lead < 0:
            raise ValueError("these ranks hold no token for a byte, or no proper merges")
        key = (*live, lead + 1)
        number = self.number.get(key)
        if number is None:
            self.number[key] = number = len(self.keys)
            self.keys.append(key)
            self.last.append(lead)
            self.size.append(len(self.token[lead]))
        self.step[state << 8 | byte] = number
        return number

    def run(self, state: int, data: bytes) -> list[int]:
        """The states after each byte of ``data``."""
        get, make, out = self.step.get, self._make, []
        for byte in data:
            following = get(state << 8 | byte)
            state = make(state, byte) if following is None else following
            out.append(state)
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.keys) > self.max_states:
            self._forget()
        if len(piece) <= CHUNK:  # one chunk: nothing can leave before its end
            return self._back(states := self.run(0, piece), len(states))
        return [t for part in self.stream(piece[k : k + CHUNK] for k in range(0, len(piece), CHUNK)) for t in part]

    def stream(self, chunks: Iterable[bytes]) -> Iterator[list[int]]:
        """The tokens of one piece that arrives in chunks, each as soon as no byte to come can change it: the
        encodings up to all open positions agree on it.  What waits is bounded by the longest token and a chunk."""
        state, waiting = 0, []
        for chunk in chunks:
            if waiting:
                # Back from each open position by whole tokens; all agree from the last cut that they share.
                shared = None
                for packed in self.keys[state]:
                    at, cuts = len(waiting) - self._depth(packed >> 32), []
                    while at > 0:
                        cuts.append(at)
                        at -= self.size[waiting[at - 1]]
                    shared = set(cuts) if shared is None else shared & set(cuts)
                if shared:
                    yield self._back(waiting, max(shared))
                    del waiting[: max(shared)]
            states = self.run(state, chunk)
            if states:
                state = states[-1]
                waiting += states
        if waiting:
            yield self._back(waiting, len(waiting))

    def _back(self, states: list[int], at: int) -> list[int]:
        out, last, size = [], self.last, self.size
        while at > 0:
            state = states[at - 1]
            out.append(last[state])
            at -= size[state]
        out.reverse()
        return out

    def _depth(self, node: int) -> int:
        if not self._depths:
            self._depths = [0] * len(self.ending)
            for at, child in self.child.items():
                self._depths[child] = self._depths[at >> 8] + 1
        return self._depths[node]


class Utf8Machine:
    """Incremental UTF-8: ``feed`` returns the text that is complete so far; at most three bytes wait."""

    #: Lead byte to the allowed ranges of the bytes that follow it.
    AFTER = {
        **{b: ((0x80, 0xBF),) for b in range(0xC2, 0xE0)},
        **{b: ((0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF), (0x80, 0xBF)) for b in range(0xE0, 0xF0)},
        **{b: ((0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF), (0x80, 0xBF), (0x80, 0xBF)) for b in range(0xF0, 0xF5)},
    }

    def __init__(self, errors: str = "replace"):
        self.errors, self.waiting = errors, b""

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.waiting + data
        end = len(data)
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if 0x80 <= b < 0xC0:
                continue
            ranges = self.AFTER.get(b, ())
            tail = data[len(data) - back + 1 :]
            if len(tail) < len(ranges) and all(lo <= x <= hi for x, (lo, hi) in zip(tail, ranges)):
                end = len(data) - back
            break
        end = len(data) if last else end
        self.waiting = data[end:]
        return data[:end].decode("utf-8", self.errors)


class Codec:
    """Texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 300_000):
        self.transducer, self.pattern = Transducer(ranks), regex.compile(pattern)
        self.splits = pattern == GPT2_LIKE
        self.bytes_of = {str(r): b for b, r in ranks.items()}
        class Memo(dict):
            """The ids of pieces as decimals.  When full, it becomes the older half, and what is asked for again moves over:
            so frequent pieces stay, and twice ``memo`` entries bound it."""

            def __init__(self, encode):
                super().__init__()
                self.encode, self.older = encode, {}

            def __missing__(self, piece: str) -> str:
                if len(self) >= memo:
                    self.older = dict(self)
                    self.clear()
                if (ids := self.older.get(piece)) is None:
                    ids = self.encode(piece)
                self[piece] = ids
                return ids

        def one(piece: str) -> str:
            return " ".join(map(str, self.transducer.encode_piece(piece.encode("utf-8", "surrogatepass"))))

        def several(word: str) -> str:
            pieces = self.pattern.findall(" " + word)
            return one(pieces[0]) if len(pieces) == 1 else " ".join(map(self.memo.__getitem__, pieces))

        self.memo = Memo(one)
        #: The same for what stands between single blanks, each with the blank before it.
        self.words = Memo(several)

    def encode_decimal(self, text: str) -> str:
        """The ids in decimal, joined by one space.

        A piece never runs from a character that is no white space into a blank.  So, where no blank follows
        white space, the text may be cut before every blank."""
        if self.splits and "  " not in text and not _RUNS.search(text):
            first, *rest = text.split(" ")
            out = [*map(self.memo.__getitem__, self.pattern.findall(first)), *map(self.words.__getitem__, rest)]
            if rest and not rest[-1]:
                return " ".join(map(self.memo.__getitem__, self.pattern.findall(text)))
            return " ".join(out)
        return " ".join(map(self.memo.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_decimal(text).split()]

    def decode_chunks(self, ids: Iterable[str], size: int = 50_000) -> Iterator[bytes]:
        ids = ids if isinstance(ids, list) else list(ids)
        for k in range(0, len(ids), size):
            yield b"".join(map(self.bytes_of.__getitem__, ids[k : k + size]))

    def decode(self, ids: Iterable[int]) -> str:
        machine = Utf8Machine()
        return "".join([*(machine.feed(x) for x in self.decode_chunks([str(i) for i in ids])), machine.feed(b"", last=True)])


_codecs: dict[str, Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """One codec per vocabulary in each worker process."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(parse_ranks(data), pattern)
    return _codecs[key]


def _vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str, pattern: str, *, with_ids: bool = False, columns: list[str] = ()) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids and further ``columns`` of ``docs``
    (those of other names than these).

    ``vocabulary`` is the path of a rank file on the driver; its bytes (a bounded size) are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        gc.disable()  # the memos hold millions of objects without cycles; walking them again and again costs more than the work
        try:
            yield from encoded(own, batches)
        finally:
            _codecs.clear()  # an idle worker should not hold states and memos; a codec is made in a tenth of a second
            gc.enable()

    def encoded(own: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, decoded, kept, sizes = [], [], [], [], [0]
            for text in batch.column("text").to_pylist():
                joined = own.encode_decimal(text) if text else ""
                ids = joined.split()
                back = hashlib.sha256()
                machine = Utf8Machine("strict")
                for chunk in own.decode_chunks(ids):
                    back.update(machine.feed(chunk).encode())
                back.update(machine.feed(b"", last=True).encode())
                counts.append(len(ids))
                hashes.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(back.hexdigest())
                if with_ids:
                    kept.append(np.fromstring(joined, np.int32, sep=" ") if joined else np.zeros(0, np.int32))
                    sizes.append(sizes[-1] + len(ids))
            arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *kept]))))
                names.append("ids")
            if carried:
                arrays.append(batch.column("row"))
                names.append("row")
            yield pa.RecordBatch.from_arrays(arrays, names)

    made = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    carried = [c for c in columns if c not in ("doc_id", *made)]
    row = [F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row")] if carried else []
    df = docs.select("doc_id", F.col("text").cast("string").alias("text"), *row)
    schema = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out = map_batches(df, run, schema + (f", row {df.schema['row'].dataType.simpleString()}" if carried else ""))
    return out.select("doc_id", *made, *[F.col(f"row.`{c}`").alias(c) for c in carried])


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and text from doc_id and ids; a null list of ids is a null text, bytes that are no UTF-8 become U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            texts = [None if ids is None else own.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    df = encoded.select("doc_id", "ids")
    return map_batches(df, run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, text string")
