"""Ordered row keys of several fields: bytes whose order is that of the fields.

Fields are joined by 00 01; within a field 00 becomes 00 FF; an empty field is 00 00, and empty fields at the end are left out.  An
integer takes n bytes, the fewest for which its 7n - 1 low bits hold it: n ones, a zero and those bits; a negative integer is the
complement of the code of its complement.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideleaf.errors import InvalidArgument

_SEPARATOR, _EMPTY = b"\0\1", b"\0\0"


def encode_int(v: int) -> bytes:
    size = ~v if v < 0 else v
    n = size.bit_length() // 7 + 1
    code = (((1 << n) - 1) << 7 * n) + size
    return ((1 << 8 * n) - 1 - code if v < 0 else code).to_bytes(n, "big")


def decode_int(b: bytes) -> int:
    """The integer of which ``b`` is the code; ValueError if there is none."""
    n = len(b)
    code = int.from_bytes(b, "big")
    negative = n > 0 and b[0] < 0x80
    if negative:
        code = (1 << 8 * n) - 1 - code
    size = code - (((1 << n) - 1) << 7 * n)
    v = ~size if negative else size
    if not n or size < 0 or not -(2**63) <= v < 2**63 or encode_int(v) != b:
        raise ValueError("not the code of an integer")
    return v


def join(fields: list[bytes]) -> bytes:
    kept = list(fields)
    while kept and not kept[-1]:
        kept.pop()
    return _SEPARATOR.join(f.replace(b"\0", b"\0\xff") or _EMPTY for f in kept) or _EMPTY


def split(key: bytes, n: int) -> list[bytes]:
    """The fields of a key, n in all; ValueError if it isn't one."""
    parts = [] if key in (b"", _EMPTY) else key.split(_SEPARATOR)
    fields = [b"" if p == _EMPTY else p.replace(b"\0\xff", b"\0") for p in parts]
    if len(fields) > n or join(fields) != (key or _EMPTY):
        raise ValueError("not a key of these fields")
    return fields + [b""] * (n - len(fields))


def encode_field(v, kind: str) -> bytes:
    return encode_int(int(v)) if kind in ("INT64", "TIMESTAMP") else v.encode() if kind == "STRING" else bytes(v)


def encoder(kinds: list[str]):
    """A UDF of as many columns as kinds (``TIMESTAMP`` in microseconds): the key, null if a field is."""
    if bad := set(kinds) - {"STRING", "BYTES", "INT64", "TIMESTAMP"}:
        raise InvalidArgument(f"keys don't take {', '.join(sorted(bad))}")

    def rows(*columns):
        return pd.Series([None if any(v is None or v is pd.NA or v != v for v in r) else join([encode_field(v, k) for v, k in zip(r, kinds)]) for r in zip(*columns)], dtype="object")

    # integers travel as text, for a column of them with nulls would come as floats
    udf = _scalar(rows)
    return lambda *cols: udf(*[c.cast("string") if k in ("INT64", "TIMESTAMP") else c for c, k in zip(cols, kinds)])


def _scalar(rows):
    def one(batches):
        for columns in batches:
            yield rows(*(columns if isinstance(columns, tuple) else (columns,)))

    one.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return F.pandas_udf(one, T.BinaryType())


def decoder(kinds: list[str]):
    """A UDF of the key: a struct f0.. of its fields (``TIMESTAMP`` in microseconds), null where it isn't such a key."""
    types = {"STRING": T.StringType(), "BYTES": T.BinaryType(), "INT64": T.LongType(), "TIMESTAMP": T.LongType()}
    schema = T.StructType([T.StructField(f"f{i}", types[k]) for i, k in enumerate(kinds)] + [T.StructField("ok", T.BooleanType())])

    def one(key) -> dict:
        nothing = dict.fromkeys(schema.names)
        try:
            fields = split(bytes(key), len(kinds))
            return {f"f{i}": decode_int(b) if k in ("INT64", "TIMESTAMP") else b.decode() if k == "STRING" else b for i, (b, k) in enumerate(zip(fields, kinds))} | {"ok": True}
        except ValueError:
            return nothing | {"ok": False}

    @F.pandas_udf(schema)
    def udf(keys: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(k) for k in keys], columns=schema.names, dtype="object")

    return udf
