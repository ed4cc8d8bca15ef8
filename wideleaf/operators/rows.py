"""Reading rows: row sets, limits, direction, samples of keys, and authorised parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wideleaf.errors import InvalidArgument
from wideleaf.operators import ranges, rowfilters

SAMPLE_BYTES = 512 << 10


def read_rows(cells: DataFrame, *, keys: list[bytes] = (), row_ranges: list[ranges.Range] = (), row_filter: rowfilters.Filter | None = None, limit: int = 0, reversed: bool = False) -> DataFrame:
    """The cells of the rows in the set (all rows, if no set is given) that the filter lets out, of the first ``limit``
    rows that still have cells; of the last ones, if ``reversed``."""
    wanted = [*map(ranges.point, keys), *row_ranges] or ranges.EVERYTHING
    out = rowfilters.apply(cells.where(ranges.predicate(wanted)), row_filter or rowfilters.PassAll())
    if limit < 0:
        raise InvalidArgument("a limit can't be negative")
    if limit:
        out = out.join(out.select("row_key").distinct().orderBy(F.desc("row_key") if reversed else F.asc("row_key")).limit(limit), "row_key", "left_semi")
    return out


def in_order(cells: DataFrame, *, reversed: bool = False) -> DataFrame:
    """Cells in the order in which they are read; rows from the last key on, if ``reversed``."""
    return cells.orderBy(F.desc("row_key") if reversed else F.asc("row_key"), *rowfilters.output_order())


def row_sizes(cells: DataFrame) -> DataFrame:
    size = F.octet_length("row_key") + F.octet_length("qualifier") + F.octet_length("value") + 8
    return cells.groupBy("row_key").agg(F.sum(size).alias("size"))


def sample_keys(cells: DataFrame, every: int = SAMPLE_BYTES) -> DataFrame:
    """row_key and offset_bytes: the row with which each further ``every`` bytes are full.

    Offsets are summed in two steps, so that no window has to take all rows: in ranges of keys, then over the ranges."""
    sizes = row_sizes(cells)
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = sizes.repartitionByRange(parts, "row_key").withColumn("part", F.spark_partition_id())
    inside = dealt.withColumn("inside", F.sum("size").over(Window.partitionBy("part").orderBy("row_key")))
    totals = dealt.groupBy("part").agg(F.sum("size").alias("total"))  # one row per partition
    before = totals.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
    placed = inside.join(F.broadcast(before), "part").withColumn("offset_bytes", F.col("before") + F.col("inside"))
    full = F.expr(f"offset_bytes div {every}") > F.expr(f"(offset_bytes - size) div {every}")
    return placed.where(full).select("row_key", "offset_bytes")


def restrict(cells: DataFrame, prefixes: list[bytes], subsets: dict[str, tuple[list[bytes], list[bytes]]]) -> DataFrame:
    """An authorised part: rows with one of the prefixes, and in the named families the given qualifiers and prefixes of such."""
    kept = F.lit(False)
    for family, (qualifiers, starts) in subsets.items():
        rs = [*map(ranges.point, qualifiers), *map(ranges.prefix, starts)]
        kept = kept | ((F.col("family") == family) & ranges.predicate(rs, "qualifier"))
    return cells.where(ranges.predicate([ranges.prefix(p) for p in prefixes] or ranges.EVERYTHING) & kept)


def nested(cells: DataFrame) -> DataFrame:
    """A row for each key: its families in order, in them columns, in them cells (newest first) with their labels."""
    if "labels" not in cells.columns:
        cells = cells.withColumn("labels", F.array().cast("array<string>")).withColumn("ord", F.lit(""))
    one = F.struct((-F.col("ts")).alias("down"), "ord", "ts", "value", "labels")
    columns = cells.groupBy("row_key", "family", "fam_order", "qualifier").agg(F.array_sort(F.collect_list(one)).alias("c"))
    plain = F.transform("c", lambda x: F.struct(x["ts"].alias("ts"), x["value"].alias("value"), x["labels"].alias("labels")))
    families = columns.groupBy("row_key", "family", "fam_order").agg(F.array_sort(F.collect_list(F.struct("qualifier", plain.alias("cells")))).alias("columns"))
    rows = families.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("fam_order", "family", "columns"))).alias("f"))
    return rows.select("row_key", F.transform("f", lambda x: F.struct(x["family"].alias("family"), x["columns"].alias("columns"))).alias("families"))


def statistics(cells: DataFrame, **asked) -> DataFrame:
    """What a read of ``read_rows`` looks at and returns: rows_seen, cells_seen, rows_returned, cells_returned."""
    wanted = [*map(ranges.point, asked.get("keys", ())), *asked.get("row_ranges", ())] or ranges.EVERYTHING
    count = lambda df: df.groupBy("row_key").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    both = count(cells.where(ranges.predicate(wanted))).select(F.lit(1).alias("s"), F.col("n").alias("sn"), zero.alias("r"), zero.alias("rn")).unionByName(count(read_rows(cells, **asked)).select(F.lit(0).alias("s"), zero.alias("sn"), F.lit(1).alias("r"), F.col("n").alias("rn")))
    return both.agg(*[F.coalesce(F.sum(a), F.lit(0)).cast("long").alias(b) for a, b in (("s", "rows_seen"), ("sn", "cells_seen"), ("r", "rows_returned"), ("rn", "cells_returned"))])
