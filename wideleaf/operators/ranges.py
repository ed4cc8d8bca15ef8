"""Ranges of row keys: half-open, with None for no end; and the predicates that Parquet can prune by."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wideleaf.errors import InvalidArgument

Range = tuple[bytes, bytes | None]
EVERYTHING: list[Range] = [(b"", None)]


def successor(key: bytes) -> bytes:
    """The smallest key after ``key``."""
    return key + b"\0"


def prefix_end(prefix: bytes) -> bytes | None:
    """The smallest key after all keys with this prefix; None if there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes((kept[-1] + 1,)) if kept else None


def point(key: bytes) -> Range:
    return key, successor(key)


def prefix(p: bytes) -> Range:
    return p, prefix_end(p)


def between(start: bytes = b"", end: bytes | None = None, *, start_open: bool = False, end_closed: bool = False) -> Range:
    """A range from open or closed bounds.  An empty end is no end."""
    low = successor(start) if start_open else start
    high = None if not end else successor(end) if end_closed else end
    if high is not None and low > high:
        raise InvalidArgument("the start of a row range is after its end")
    return low, high


def normalise(ranges: list[Range]) -> list[Range]:
    """Sorted, not empty, not overlapping or touching."""
    out: list[Range] = []
    for low, high in sorted(((a, b) for a, b in ranges if b is None or a < b), key=lambda r: r[0]):
        if out and (out[-1][1] is None or low <= out[-1][1]):
            last = out[-1]
            out[-1] = (last[0], None if last[1] is None or high is None else max(last[1], high))
        else:
            out.append((low, high))
    return out


def intersect(xs: list[Range], ys: list[Range]) -> list[Range]:
    out = []
    for a, b in normalise(xs):
        for c, d in normalise(ys):
            high = d if b is None else b if d is None else min(b, d)
            if high is None or max(a, c) < high:
                out.append((max(a, c), high))
    return normalise(out)


def predicate(ranges: list[Range], column: str = "row_key") -> Column:
    """Whether the key lies in one of the ranges: comparisons only, for they reach the Parquet scan."""
    key = F.col(column)
    parts = []
    for low, high in normalise(ranges):
        if high == successor(low):
            parts.append(key == F.lit(bytearray(low)))
        elif high is None:
            parts.append(key >= F.lit(bytearray(low)) if low else key.isNotNull())
        else:
            parts.append((key >= F.lit(bytearray(low))) & (key < F.lit(bytearray(high))))
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)
