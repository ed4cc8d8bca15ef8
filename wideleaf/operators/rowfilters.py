"""The filter algebra over cells: a filter turns cells into cells, with labels and duplicates.

Cells under a filter have two more columns: ``labels`` and ``ord``, which tells duplicates apart in a stable order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wideleaf.errors import InvalidArgument
from wideleaf.functions import patterns

DEEPEST = 20


def output_order() -> list:
    """How the cells of a row are put out."""
    return ["fam_order", "family", "qualifier", F.desc("ts"), "ord"]


class Filter:
    """Base of all filters."""


@dataclass(frozen=True)
class Chain(Filter):
    filters: tuple


@dataclass(frozen=True)
class Interleave(Filter):
    filters: tuple


@dataclass(frozen=True)
class Condition(Filter):
    """Rows of which ``predicate`` leaves a cell go through ``true``, the others through ``false``; None drops them."""

    predicate: Filter
    true: Filter | None = None
    false: Filter | None = None


@dataclass(frozen=True)
class Sink(Filter):
    """Cells go straight to the output and not on in the chain."""


@dataclass(frozen=True)
class PassAll(Filter):
    pass


@dataclass(frozen=True)
class BlockAll(Filter):
    pass


@dataclass(frozen=True)
class RowKeyRegex(Filter):
    pattern: bytes


@dataclass(frozen=True)
class RowSample(Filter):
    """Each row with probability ``p``, decided by a hash of its key."""

    p: float
    seed: int = 0


@dataclass(frozen=True)
class FamilyRegex(Filter):
    pattern: bytes


@dataclass(frozen=True)
class QualifierRegex(Filter):
    pattern: bytes


@dataclass(frozen=True)
class ValueRegex(Filter):
    pattern: bytes


@dataclass(frozen=True)
class ColumnRange(Filter):
    family: str
    start: bytes | None = None
    end: bytes | None = None
    start_open: bool = False
    end_open: bool = False


@dataclass(frozen=True)
class ValueRange(Filter):
    start: bytes | None = None
    end: bytes | None = None
    start_open: bool = False
    end_open: bool = False


@dataclass(frozen=True)
class TimestampRange(Filter):
    """From ``start`` to before ``end``; an end of 0 is none.  Both in microseconds, whole milliseconds."""

    start: int = 0
    end: int = 0


@dataclass(frozen=True)
class ValueBitmask(Filter):
    mask: bytes


@dataclass(frozen=True)
class CellsPerColumn(Filter):
    n: int


@dataclass(frozen=True)
class CellsPerRow(Filter):
    n: int


@dataclass(frozen=True)
class CellsPerRowOffset(Filter):
    n: int


@dataclass(frozen=True)
class Label(Filter):
    name: str


@dataclass(frozen=True)
class StripValue(Filter):
    pass


def _labels(f: Filter) -> int:
    return isinstance(f, Label) + sum(_labels(x) for x in getattr(f, "filters", ()))


def check(f: Filter, depth: int = 1, conditional: bool = False) -> None:
    """Reject filters that can never be served."""
    if depth > DEEPEST:
        raise InvalidArgument(f"filters nest deeper than {DEEPEST}")
    if isinstance(f, Chain | Interleave):
        if len(f.filters) < 2:
            raise InvalidArgument(f"{type(f).__name__} needs two filters at least")
        if isinstance(f, Chain) and sum(map(_labels, f.filters)) > 1:
            raise InvalidArgument("a chain can apply one label only")
        for x in f.filters:
            check(x, depth + 1, conditional)
    elif isinstance(f, Condition):
        for x in (f.predicate, f.true, f.false):
            if x is not None:
                check(x, depth + 1, True)
    elif isinstance(f, Sink) and conditional:
        raise InvalidArgument("a sink can't stand in a condition")
    elif isinstance(f, RowSample) and not 0 < f.p < 1:
        raise InvalidArgument("a sample's probability lies between 0 and 1")
    elif isinstance(f, TimestampRange) and (f.start % 1000 or f.end % 1000 or f.end and f.end < f.start):
        raise InvalidArgument("a timestamp range has whole milliseconds and doesn't end before it starts")
    elif isinstance(f, CellsPerColumn | CellsPerRow | CellsPerRowOffset) and f.n < (0 if isinstance(f, CellsPerRowOffset) else 1):
        raise InvalidArgument("a limit must be positive")
    elif isinstance(f, RowKeyRegex | FamilyRegex | QualifierRegex | ValueRegex):
        _java(f.pattern)


def _java(pattern: bytes) -> str:
    """The pattern for Java, over bytes seen as Latin-1, for the whole of a value."""
    return f"\\A(?:{patterns.translate(pattern.decode('latin-1'))[0]})\\z"


def matches(column: Column, pattern: bytes) -> Column:
    """Whether all of a BINARY matches a byte pattern."""
    return F.decode(column, "ISO-8859-1").rlike(_java(pattern))


def _bounds(column: Column, f) -> Column:
    out = F.lit(True)
    if f.start is not None:
        low = F.lit(bytearray(f.start))
        out = out & ((column > low) if f.start_open else (column >= low))
    if f.end is not None:
        high = F.lit(bytearray(f.end))
        out = out & ((column < high) if f.end_open else (column <= high))
    return out


def _masked(mask: bytes) -> Column:
    """(value & mask) == mask, byte by byte, for values as long as the mask."""
    tests = [F.octet_length("value") == len(mask)]
    for i, b in enumerate(mask):
        if b:
            byte = F.conv(F.hex(F.substring(F.col("value"), i + 1, 1)), 16, 10).cast("int")
            tests.append(byte.bitwiseAND(b) == b)
    return reduce(lambda a, b: a & b, tests)


def _cellwise(f: Filter) -> Column | None:
    """What a filter that looks at single cells keeps."""
    if isinstance(f, PassAll):
        return F.lit(True)
    if isinstance(f, BlockAll):
        return F.lit(False)
    if isinstance(f, RowKeyRegex):
        return matches(F.col("row_key"), f.pattern)
    if isinstance(f, FamilyRegex):
        return matches(F.col("family").cast("binary"), f.pattern)
    if isinstance(f, QualifierRegex):
        return matches(F.col("qualifier"), f.pattern)
    if isinstance(f, ValueRegex):
        return matches(F.col("value"), f.pattern)
    if isinstance(f, ColumnRange):
        return (F.col("family") == f.family) & _bounds(F.col("qualifier"), f)
    if isinstance(f, ValueRange):
        return _bounds(F.col("value"), f)
    if isinstance(f, TimestampRange):
        return (F.col("ts") >= f.start) & (F.col("ts") < f.end if f.end else F.lit(True))
    if isinstance(f, ValueBitmask):
        return _masked(f.mask)
    if isinstance(f, RowSample):
        return F.pmod(F.xxhash64("row_key", F.lit(f.seed)), F.lit(1 << 30)) < int(f.p * (1 << 30))
    return None


def _run(cells: DataFrame, f: Filter, sunk: list[DataFrame]) -> DataFrame:
    if (kept := _cellwise(f)) is not None:
        return cells.where(kept)
    if isinstance(f, Chain):
        for x in f.filters:
            cells = _run(cells, x, sunk)
        return cells
    if isinstance(f, Interleave):
        parts = [_run(cells.withColumn("ord", F.concat("ord", F.lit(f"{k:04d}"))), x, sunk) for k, x in enumerate(f.filters)]
        return reduce(DataFrame.unionByName, parts)
    if isinstance(f, Condition):
        # Rows are told by a semi-join on the keys that the predicate leaves; a predicate on single cells needs no join.
        if (test := _cellwise(f.predicate)) is not None:
            hit = F.max(test.cast("int")).over(Window.partitionBy("row_key")) == 1
            marked = cells.withColumn("_hit", hit)
            yes, no = marked.where("_hit").drop("_hit"), marked.where("not _hit").drop("_hit")
        else:
            keys = _run(cells, f.predicate, []).select("row_key").distinct()
            yes, no = cells.join(keys, "row_key", "left_semi"), cells.join(keys, "row_key", "left_anti")
        parts = [_run(part, x, sunk) for part, x in ((yes, f.true), (no, f.false)) if x is not None]
        return reduce(DataFrame.unionByName, parts) if parts else cells.where(F.lit(False))
    if isinstance(f, Sink):
        sunk.append(cells)
        return cells.where(F.lit(False))
    if isinstance(f, CellsPerColumn):
        w = Window.partitionBy("row_key", "family", "qualifier").orderBy(F.desc("ts"), "ord")
        return cells.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= f.n).drop("_n")
    if isinstance(f, CellsPerRow | CellsPerRowOffset):
        n = F.row_number().over(Window.partitionBy("row_key").orderBy(*output_order()))
        return cells.withColumn("_n", n).where(F.col("_n") <= f.n if isinstance(f, CellsPerRow) else F.col("_n") > f.n).drop("_n")
    if isinstance(f, Label):
        return cells.withColumn("labels", F.array(F.lit(f.name)))
    if isinstance(f, StripValue):
        return cells.withColumn("value", F.lit(bytearray()))
    raise InvalidArgument(f"no filter: {f!r}")


def apply(cells: DataFrame, f: Filter) -> DataFrame:
    """The cells that ``f`` lets out."""
    check(f)
    sunk: list[DataFrame] = []
    start = cells.withColumn("labels", F.array().cast("array<string>")).withColumn("ord", F.lit(""))
    return reduce(DataFrame.unionByName, [_run(start, f, sunk), *sunk])
