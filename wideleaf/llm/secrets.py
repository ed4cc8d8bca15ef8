"""Secret scans with a worklist of decoded layers.

Every text is scanned as it stands; then URL escapes, backslash escapes, base64 blobs and compressed
data in it are unwrapped, each into a further layer, which is scanned and unwrapped in turn until no new
layer appears.  A layer seen before at the same place is not taken up again, so cycles end.  Each
character of a layer knows the span of the original text it comes from.

The shortest secret has 12 characters (``token:`` and six more) and no encoding is shorter than what it encodes, so
blobs of under 16 characters and stretches of under 12 can't hold one.

A base64 blob may touch other characters of its alphabet (a path, a word before a hyphen) and may be wrapped over lines:
lines are joined, and each run is decoded from its first four characters on, as every group of four stands for
itself.  In what is decoded, stretches of text (also of two bytes a character) and compressed members (gzip, zlib, bzip2, xz) are
looked for wherever they begin, a bare deflate stream at the start; members that follow one another are one layer.

Defined results: a null or empty text holds no secrets; rows of equal text are scanned separately and
alike; further columns are ignored (or carried, when rows are redacted).  ``max_unpacked`` bounds
what compressed members that follow one another may grow to, and 64 times that all layers of such a chain together;
what goes beyond is reported whole, as kind ``packed``.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wideleaf.llm.common import map_batches, merge_spans

KINDS = ("assign", "access", "hex", "packed")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_KEYS = (b"passw", b"secret", b"token", b"key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
_ESCAPED = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
_BLOB = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_ENDS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
#: Text of as many bytes as the shortest secret has.
_STRETCH = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}")
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\0")
#: The same as text of two bytes a character, low or high byte first.
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){12,}|(?:\0[\t\n\r\x20-\x7e]){12,}")
_ODD = re.compile(r"[^\x09\x0a\x0d\x20-\x7e\x80-\U0010ffff]|[\x80-\x9f�]")

Span = tuple[str, int, int]


def scan_layer(text: str) -> list[Span]:
    """The base secrets of one text: leftmost, non-overlapping per kind; matches that are too short are dropped."""
    low = text.encode("utf-8", "surrogatepass").lower()
    found = []
    if any(k in low for k in _KEYS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def _substituted(text: str, pattern: re.Pattern, decode) -> tuple[str, list[int], list[int]] | None:
    """``text`` with the matches decoded, and for each character the start and end it comes from."""
    out, starts, ends, last, changed = [], [], [], 0, False
    for m in pattern.finditer(text):
        changed = True
        plain, widths = decode(m[0])
        out += [text[last : m.start()], plain]
        cuts = list(accumulate(widths, initial=m.start()))
        starts += [*range(last, m.start()), *cuts[:-1]]
        ends += [*range(last + 1, m.start() + 1), *cuts[1:]]
        last = m.end()
    if not changed:
        return None
    return "".join([*out, text[last:]]), [*starts, *range(last, len(text))], [*ends, *range(last + 1, len(text) + 1)]


def _from_url(run: str) -> tuple[str, list[int]]:
    """The decoded text, and of how many characters of the run each of its characters is made; a byte that is no UTF-8 stays one
    character, a lone surrogate."""
    plain = bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape")
    return plain, [3 if 0xDC80 <= ord(c) <= 0xDCFF else 3 * len(c.encode("utf-8", "surrogatepass")) for c in plain]


def _from_escapes(run: str) -> tuple[str, list[int]]:
    """The same for backslash escapes: two of a surrogate pair are one character, numbers beyond Unicode are U+FFFD."""
    out, widths = [], []
    for m in _ESCAPED.finditer(run):
        code = int(m[1] or m[2] or m[3], 16)
        if out and 0xDC00 <= code < 0xE000 and 0xD800 <= out[-1] < 0xDC00:
            out[-1] = 0x10000 + (out[-1] - 0xD800 << 10) + (code - 0xDC00)
            widths[-1] += len(m[0])
        else:
            out.append(code if code < 0x110000 else 0xFFFD)
            widths.append(len(m[0]))
    return "".join(map(chr, out)), widths


def _unpack(data: memoryview, most: int) -> tuple[bytes, int | None] | None:
    """Decompressed data of one member and where it ends (None if it is cut off); None if it is not compressed; OverflowError if
    it exceeds ``most``."""
    if data[:2] == b"\x1f\x8b":
        machine = zlib.decompressobj(31)
    elif data[:1] == b"\x78":
        machine = zlib.decompressobj()
    elif data[:3] == b"BZh":
        machine = bz2.BZ2Decompressor()
    else:
        machine = lzma.LZMADecompressor()
    try:
        out = machine.decompress(data, most + 1)
    except (zlib.error, OSError, lzma.LZMAError, EOFError):
        return None
    if len(out) > most:
        raise OverflowError
    return out, len(data) - len(machine.unused_data) if machine.eof else None


def _members(data: bytes, most: int) -> Iterator[tuple[bytes | None, int, int]]:
    """The compressed members in ``data`` and where they stand; None instead of what exceeds ``most``.

    Members that follow one another, at most padded with zeros, come as one."""
    view, chain, begin, end = memoryview(data), [], 0, 0
    for m in _MAGIC.finditer(data):
        at = m.start()
        if at < end:
            continue
        if chain and data[end:at].strip(b"\0"):
            yield b"".join(chain), begin, end
            chain = []
        try:
            found = _unpack(view[at:], most - sum(map(len, chain)))
        except OverflowError:
            yield None, begin if chain else at, len(data)
            return
        if not found:
            continue
        if found[1] is None:  # cut off, or no member at all: what is behind it is looked at too
            if found[0]:
                yield b"".join([*chain, found[0]]), begin if chain else at, len(data)
            continue
        begin = begin if chain else at
        chain.append(found[0])
        end = at + found[1]
    if chain:
        yield b"".join(chain), begin, end
    elif data and not data.isascii():
        # A bare deflate stream has no magic: one that begins the data and comes to its proper end is taken for one.
        machine = zlib.decompressobj(-15)
        try:
            made = machine.decompress(data, most + 1)
        except zlib.error:
            return
        if machine.eof and len(made) >= 12:
            yield (made if len(made) <= most else None), 0, len(data) - len(machine.unused_data)
        elif len(made) > most:
            yield None, 0, len(data)


def _plain(data: bytes) -> str | None:
    """The text in ``data``, if it is text."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return None if not text or _ODD.search(text) else text


def _stretches(data: bytes) -> Iterator[tuple[str, int, int]]:
    """The texts in ``data`` and where they stand."""
    if (text := _plain(data)) is not None:
        yield text, 0, len(data)
        return
    for m in _STRETCH.finditer(data):
        yield m[0].decode("utf-8", "replace"), *m.span()
    if b"\0" in data:
        for m in _WIDE.finditer(data):
            yield m[0].replace(b"\0", b"").decode("ascii"), *m.span()


def _joined(layer: str) -> tuple[str, list[int], list[int]]:
    """``layer`` without the line breaks inside wrapped runs; where in it these were, and how much all up to each took."""
    if "\n" not in layer:
        return layer, [], []
    parts, cuts, taken, last, at, gone = [], [], [], 0, 0, 0
    lines = layer.split("\n")
    for line, after in zip(lines, lines[1:]):
        at += len(line) + 1
        left, right = line.rstrip(" \t\r"), after.lstrip(" \t")
        if left and right and left[-1] in _ENDS and right[0] in _ENDS:
            a, b = at - 1 - len(line) + len(left), at + len(after) - len(right)
            parts.append(layer[last:a])
            cuts.append(a - gone)
            gone += b - a
            taken.append(gone)
            last = b
    return ("".join([*parts, layer[last:]]) if parts else layer), cuts, taken


def _blobs(layer: str) -> Iterator[tuple[bytes, Callable[[int, int], tuple[int, int]]]]:
    """What the base64 runs of ``layer`` decode to from each of their first four characters, and a function from a span of it to one of ``layer``."""
    text, cuts, taken = _joined(layer)

    def place(i: int) -> int:
        k = bisect_right(cuts, i)
        return i + taken[k - 1] if k else i

    for m in _BLOB.finditer(text):
        body = m[0].rstrip("=").replace("-", "+").replace("_", "/")
        for shift in range(4):
            groups = body[shift : len(body) - ((len(body) - shift) % 4 == 1)]
            data = binascii.a2b_base64(groups + "=" * (-len(groups) % 4))

            def span(a: int, b: int, first=m.start() + shift, size=len(data), end=m.end()) -> tuple[int, int]:
                return place(first + a // 3 * 4), place((end if b == size else min(end, first - (-b // 3) * 4)) - 1) + 1

            yield data, span


def scan(text: str, max_unpacked: int = 1 << 26) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans with those found in decoded layers, both in order."""
    base = sorted(scan_layer(text), key=_order)
    every, seen = set(base), {(str, hash(text))}
    #: layers: the text or bytes, the start and end each character comes from (or all come from), and bytes unpacked so far
    work: list[tuple[str | bytes, list[int] | int, list[int] | int, int]] = [(text, [], [], 0)]
    while work:
        layer, starts, ends, grown = work.pop()
        top = layer is text

        def origin(a: int, b: int, top=top, starts=starts, ends=ends) -> tuple[int, int]:
            if top:
                return a, b
            return (starts, ends) if isinstance(starts, int) else (min(starts[a:b]), max(ends[a:b]))

        further = []

        def decoded(data: bytes, span: Callable[[int, int], tuple[int, int]], grown=grown, further=further) -> None:
            further.extend((plain, *span(a, b), grown) for plain, a, b in _stretches(data))
            for made, a, b in _members(data, max_unpacked):
                if made is None or grown + len(made) > 64 * max_unpacked:
                    every.add(("packed", *span(a, b)))
                else:
                    further.append((made, *span(a, b), grown + len(made)))

        if isinstance(layer, bytes):
            decoded(layer, origin)
        else:
            if not top:
                every.update((kind, *origin(a, b)) for kind, a, b in scan_layer(layer))
            for mark, pattern, decode in (("%", _URL, _from_url), ("\\", _ESCAPE, _from_escapes)):
                if mark in layer and (made := _substituted(layer, pattern, decode)) and made[0]:
                    further.append((made[0], [origin(a, b)[0] for a, b in zip(made[1], made[2])], [origin(a, b)[1] for a, b in zip(made[1], made[2])], grown))
            for data, span in _blobs(layer):
                decoded(data, lambda a, b, span=span: origin(*span(a, b)))
        for item in further:
            key = (type(item[0]), hash(item[0])) + (item[1:3] if isinstance(item[1], int) else ())
            if item[0] and key not in seen:
                seen.add(key)
                work.append(item)
    return base, sorted(every, key=_order)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans, a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS[:3]}
            hashes, spans = [], []
            for text in batch.column("text").to_pylist():
                base, every = scan(text) if text else ([], [])
                for k in counts:
                    counts[k].append(sum(x[0] == k for x in base))
                hashes.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(every))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in counts.values()), pa.array(hashes, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    df = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_batches(df, run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span that holds a secret replaced by ``mask``; ``n_chars``, if there, follows the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column("text").to_pylist():
                for a, b in reversed(merge_spans([(a, b) for _, a, b in scan(text)[1]])) if text else ():
                    text = text[:a] + mask + text[b:]
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    done = map_batches(df, run, f"row {df.schema['row'].dataType.simpleString()}, text string")
    return done.select(*[F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
