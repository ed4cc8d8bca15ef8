"""Sketches that count distinct values, as bytes: an HLL sketch of Spark's, and behind it the hashes of all values as long as they are few.

While the hashes are there a count is exact, but for equal hashes of 63 bits; beyond, or after merging with a sketch that has none, it is
that of the HLL sketch.  Spark reads the HLL sketch and leaves alone what follows it, so its functions take these bytes too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The hashes are kept up to 2**(precision + 3), and up to 2**18 of them (2 MiB).
_MORE, _MOST = 3, 18
#: What ends a sketch that has its hashes: their length in bytes, and this.
_MARK = b"\xfeKMV"


def _hashes(x: Column) -> Column:
    """The part with the hashes (a theta sketch), null where there is none."""
    length = F.conv(F.hex(F.substring(x, -8, 4)), 16, 10).cast("int")
    return F.when(F.substring(x, -4, 4) == F.lit(_MARK), F.substr(x, -8 - length, length))


def _all(hashes: Column) -> Column:
    """Whether a theta sketch has all hashes: then its preamble is shorter than three longs."""
    return F.conv(F.hex(F.substring(hashes, 1, 1)), 16, 10).cast("int").bitwiseAND(63) < 3


def _joined(hll: Column, hashes: Column) -> Column:
    return F.when(_all(hashes), F.concat(hll, hashes, F.unhex(F.lpad(F.hex(F.octet_length(hashes)), 8, "0")), F.lit(_MARK))).otherwise(hll)


def _merged(x: Column) -> tuple[Column, Column]:
    hashes = _hashes(x)
    return F.hll_union_agg(x, F.lit(True)), F.when(F.count(x) == F.count(hashes), F.theta_union_agg(hashes, F.lit(_MOST)))


def sketch(x: Column, kind: T.DataType, precision: int) -> Column:
    """An aggregate: the sketch of BIGINT, STRING or BINARY values."""
    # Spark's sketches leave out empty texts.
    value = x if isinstance(kind, T.LongType) else F.concat(F.lit(b"\0"), x.cast("binary"))
    return _joined(F.hll_sketch_agg(x, F.lit(precision)), F.theta_sketch_agg(value, F.lit(min(precision + _MORE, _MOST))))


def merge(x: Column) -> Column:
    """An aggregate: sketches merged, at the least of their precisions."""
    return _joined(*_merged(x))


def merged_count(x: Column) -> Column:
    """An aggregate: the count of the merged sketches."""
    hll, hashes = _merged(x)
    return F.when(_all(hashes), F.theta_sketch_estimate(hashes)).otherwise(F.hll_sketch_estimate(hll))


def count(x: Column) -> Column:
    """The count of a sketch; null for null."""
    hashes = _hashes(x)
    return F.when(hashes.isNotNull(), F.theta_sketch_estimate(hashes)).otherwise(F.hll_sketch_estimate(x))
