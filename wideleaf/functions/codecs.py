"""What built-in functions can't express, as Arrow-batched pandas UDFs: vectors, base 32, JSON texts, searches from a position."""

from __future__ import annotations

import base64
import json
import re
from decimal import Context, Decimal
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideleaf.errors import InvalidArgument
from wideleaf.functions import patterns

TEXT, BYTES, INT, TEXTS = T.StringType(), T.BinaryType(), T.LongType(), T.ArrayType(T.StringType())


def _vector(kind: str, element: T.DataType):
    @F.pandas_udf(T.ArrayType(element))
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None or len(b) % np.dtype(kind).itemsize else np.frombuffer(b, dtype=kind).astype(kind[1:]))

    return decode


def _number(kind: str, result: T.DataType):
    @F.pandas_udf(result)
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None or len(b) != np.dtype(kind).itemsize else float(np.frombuffer(b, dtype=kind)[0])).astype("object")

    return decode


#: BYTES of big-endian IEEE numbers; null for a wrong length.
vector32, vector64 = _vector(">f4", T.FloatType()), _vector(">f8", T.DoubleType())
float32, float64 = _number(">f4", T.FloatType()), _number(">f8", T.DoubleType())


@F.pandas_udf(TEXT)
def to_base32(s: pd.Series) -> pd.Series:
    return s.map(lambda b: None if b is None else base64.b32encode(bytes(b)).decode())


@F.pandas_udf(BYTES)
def from_base32(s: pd.Series) -> pd.Series:
    def one(t):
        try:
            return None if t is None else base64.b32decode(t)
        except ValueError:
            return None

    return s.map(one)


@F.pandas_udf(TEXT)
def initcap(s: pd.Series, delimiters: pd.Series) -> pd.Series:
    """Capitals at the start and after each delimiter, small letters elsewhere."""

    def one(t, d):
        if t is None or d is None:
            return None
        starts = [k == 0 or t[k - 1] in d for k in range(len(t))]
        return "".join(c.upper() if up else c.lower() for c, up in zip(t, starts))

    return pd.Series([one(t, d) for t, d in zip(s, delimiters)], dtype="object")


@F.pandas_udf(INT)
def instr(s: pd.Series, sub: pd.Series, position: pd.Series, occurrence: pd.Series) -> pd.Series:
    """Position from 1 of the n-th occurrence, overlapping ones counted; from the end for negative positions."""

    def one(t, w, p, n):
        if t is None or w is None or pd.isna(p) or pd.isna(n):
            return None
        p, n = int(p), int(n)
        at = p - 1 if p > 0 else len(t) + p
        while n and at >= 0:
            at = t.find(w, at) if p > 0 else t.rfind(w, 0, at + len(w))
            n -= 1
            if at < 0:
                return 0
            if n:
                at += 1 if p > 0 else -1
        return at + 1 if at >= 0 else 0

    return pd.Series([one(*r) for r in zip(s, sub, position, occurrence)], dtype="object")


def regexp_nth(pattern: str, result: str):
    """A UDF of text, position and occurrence: the match (``text``), its start (``start``) or its end (``end``), from 1."""
    found = regex.compile(patterns.python(pattern))

    def one(t, p, n):
        if t is None or pd.isna(p) or pd.isna(n):
            return None
        for k, m in enumerate(found.finditer(t, int(p) - 1), 1):
            if k == int(n):
                g = 1 if found.groups else 0
                return m[g] if result == "text" else (m.start(g) if result == "start" else m.end(g)) + 1
        return None if result == "text" else 0

    @F.pandas_udf(TEXT if result == "text" else INT)
    def udf(s: pd.Series, position: pd.Series, occurrence: pd.Series) -> pd.Series:
        return pd.Series([one(*r) for r in zip(s, position, occurrence)], dtype="object")

    return udf


@lru_cache(maxsize=2000)
def _compiled(pattern: str):
    """A pattern that comes with a row; None if it is none."""
    try:
        return regex.compile(patterns.python(patterns.translate(pattern)[0]))
    except (InvalidArgument, regex.error):
        return None


@F.pandas_udf(T.LongType())
def pattern_groups(p: pd.Series) -> pd.Series:
    """How many groups a pattern captures; -1 if it is none."""
    return pd.Series([None if x is None else -1 if (c := _compiled(x)) is None else c.groups for x in p], dtype="Int64")


def regexp_by_row(kind: str):
    """A UDF of text and pattern (and replacement): whether it is found (``contains``), the first match or its group (``extract``),
    all of them (``all``), or the text with them replaced (``replace``)."""

    def one(t, p, *to):
        found = None if t is None or p is None or None in to else _compiled(p)
        if found is None:
            return None
        if kind == "contains":
            return found.search(t) is not None
        if kind == "extract":
            m = found.search(t)
            return m and m[1 if found.groups else 0]
        if kind == "all":
            return [m[1 if found.groups else 0] or "" for m in found.finditer(t)]
        made = re.sub(r"\\(\\|\d)", lambda m: "\0" if m[1] == "\\" else f"\1{m[1]}", to[0])
        pieces = re.split("\1(\\d)", made)
        return found.sub(lambda m: "".join((m[int(x)] or "") if k % 2 else x for k, x in enumerate(pieces)).replace("\0", "\\"), t)

    if kind == "replace":

        @F.pandas_udf(TEXT)
        def udf(s: pd.Series, p: pd.Series, to: pd.Series) -> pd.Series:
            return pd.Series([one(*r) for r in zip(s, p, to)], dtype="object")

    else:

        @F.pandas_udf({"contains": T.BooleanType(), "extract": TEXT, "all": TEXTS}[kind])
        def udf(s: pd.Series, p: pd.Series) -> pd.Series:
            return pd.Series([one(*r) for r in zip(s, p)], dtype="object")

    return udf


def rounded(how: str):
    """A UDF of a double and digits, which may differ by row."""

    @F.pandas_udf(T.DoubleType())
    def udf(x: pd.Series, n: pd.Series) -> pd.Series:
        def one(v, d):
            if pd.isna(d) or v is None:
                return None
            if v != v or v in (float("inf"), float("-inf")) or d > 340:
                return v
            return float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-int(d)), how, Context(prec=1000))) if d > -340 else 0.0

        return pd.Series([one(*r) for r in zip(x, n)], dtype="float64")

    return udf


_STEP = re.compile(r"""\.([A-Za-z_]\w*)|\[(\d+)\]|\[(?:'([^']*)'|"([^"]*)")\]|\.(?:'([^']*)'|"([^"]*)")""")


def json_path(path: str) -> list | None:
    """The steps of ``$.a[0]['b']``; None for a path that isn't one."""
    if not path.startswith("$"):
        return None
    steps, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if m is None:
            return None
        steps.append(int(m[2]) if m[2] is not None else next(g for g in m.groups() if g is not None))
        at = m.end()
    return steps


#: A singleton: what is sent to workers must stay the same object there.
_MISSING = ...


class _Digits(float):
    """A number that is written as it was read."""

    def __new__(cls, text):
        made = super().__new__(cls, text)
        made.text = text
        return made

    def __repr__(self):
        return self.text


def _reach(text: str, steps: list):
    try:
        x = json.loads(text, parse_float=_Digits)
    except ValueError:
        return _MISSING
    for s in steps:
        fits = isinstance(x, list) and s < len(x) if isinstance(s, int) else isinstance(x, dict) and s in x
        if not fits:
            return _MISSING
        x = x[s]
    return x


def _write(x) -> str:
    if isinstance(x, _Digits):
        return x.text
    if isinstance(x, list):
        return "[" + ",".join(map(_write, x)) + "]"
    if isinstance(x, dict):
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + _write(v) for k, v in x.items()) + "}"
    return json.dumps(x, ensure_ascii=False)


def _scalar(x) -> str | None:
    return None if x is None else x if isinstance(x, str) else _write(x)


def json_function(kind: str, steps: list):
    """A UDF: ``query`` (JSON text), ``scalar`` (its text), ``array`` (texts of elements) or ``scalars`` (of scalar elements)."""

    def one(text):
        x = _MISSING if text is None else _reach(text, steps)
        if x is _MISSING:
            return None
        if kind == "query":
            return _write(x)
        if kind == "scalar":
            return None if isinstance(x, (list, dict)) else _scalar(x)
        if not isinstance(x, list):
            return None
        if kind == "array":
            return [_write(e) for e in x]
        return None if any(isinstance(e, (list, dict)) for e in x) else [_scalar(e) for e in x]

    @F.pandas_udf(TEXT if kind in ("query", "scalar") else TEXTS)
    def udf(s: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in s], dtype="object")

    return udf


def bits(symbol: str):
    """A UDF of two BYTES of one length, bit by bit; null for other lengths."""
    f = {"&": np.bitwise_and, "|": np.bitwise_or, "^": np.bitwise_xor}[symbol]

    def one(a, b):
        if a is None or b is None or len(a) != len(b):
            return None
        return f(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)).tobytes()

    @F.pandas_udf(BYTES)
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(*r) for r in zip(a, b)], dtype="object")

    return udf


@F.pandas_udf(BYTES)
def invert(a: pd.Series) -> pd.Series:
    return a.map(lambda x: None if x is None else np.invert(np.frombuffer(x, np.uint8)).tobytes())


@F.pandas_udf(BYTES)
def shift_bytes(a: pd.Series, left: pd.Series) -> pd.Series:
    """BYTES as one number, moved left (right for negative amounts) within its length."""

    def one(x, n):
        if x is None or pd.isna(n):
            return None
        n, whole = max(-8 * len(x), min(int(n), 8 * len(x))), int.from_bytes(x, "big")
        moved = whole << n if n >= 0 else whole >> -n
        return (moved & ((1 << 8 * len(x)) - 1)).to_bytes(len(x), "big")

    return pd.Series([one(*r) for r in zip(a, left)], dtype="object")


@F.pandas_udf(T.BinaryType())
def to_float_bytes(s: pd.Series) -> pd.Series:
    """Eight bytes of a double, most significant first."""
    return pd.Series([None if pd.isna(x) and not isinstance(x, float) else np.array(x, ">f8").tobytes() for x in s], dtype="object")
