"""Reads in time: bounds on cell timestamps, newest versions, and unpacking of versions into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wideleaf.errors import InvalidArgument
from wideleaf.sources.cells import newest


def visible(cells: DataFrame, *, as_of: int | None = None, after: int | None = None, after_or_equal: int | None = None, before: int | None = None, latest_n: int | None = None) -> DataFrame:
    """Cells in the given time: ``as_of`` and ``after_or_equal`` include their bound, ``after`` and ``before`` don't.
    ``latest_n`` keeps the newest versions of each column in it."""
    if as_of is not None and (after is not None or after_or_equal is not None or before is not None):
        raise InvalidArgument("as_of can't be combined with after, after_or_equal or before")
    if after is not None and after_or_equal is not None:
        raise InvalidArgument("after can't be combined with after_or_equal")
    if latest_n is not None and latest_n < 1:
        raise InvalidArgument("latest_n must be positive")
    ts = F.col("ts")
    if as_of is not None:
        cells = cells.where(ts <= as_of)
    if after is not None:
        cells = cells.where(ts > after)
    if after_or_equal is not None:
        cells = cells.where(ts >= after_or_equal)
    if before is not None:
        cells = cells.where(ts < before)
    if latest_n == 1:
        return newest(cells)
    if latest_n is not None:
        w = Window.partitionBy("row_key", "family", "qualifier").orderBy(F.desc("ts"), F.desc("seq"))
        cells = cells.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= latest_n).drop("_n")
    return cells


def unpack(cells: DataFrame, family: str, qualifiers: list[str]) -> DataFrame:
    """A row for each key and distinct timestamp: _timestamp, and what each qualifier held at just that time, as text."""
    part = cells.where(F.col("family") == family)
    wanted = [F.max_by(F.when(F.col("qualifier") == F.lit(bytearray(q.encode())), F.col("value")), F.when(F.col("qualifier") == F.lit(bytearray(q.encode())), F.col("seq"))).cast("string").alias(q) for q in qualifiers]
    return part.groupBy("row_key", F.timestamp_micros("ts").alias("_timestamp")).agg(*wanted)
