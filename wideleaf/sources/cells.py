"""Cells: the long form of a wide table, and adapters that derive it from relational tables.

A cell is a row (row_key BINARY, family STRING, fam_order INT, qualifier BINARY, ts BIGINT in microseconds, value BINARY,
seq BIGINT).  Of cells with the same key, family, qualifier and ts the one of the greatest seq holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("row_key", "family", "fam_order", "qualifier", "ts", "value", "seq")
CELL = ["row_key", "family", "qualifier", "ts"]


def as_bytes(c: Column) -> Column:
    return c.cast("string").cast("binary")


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp; wall times are taken as UTC, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def from_columns(df: DataFrame, key: Column, family: str, columns: dict[str, Column], ts: Column, *, fam_order: int = 0) -> DataFrame:
    """Cells of one family, a qualifier per column; null values make no cell."""
    pairs = F.array(*[F.struct(F.lit(q).cast("binary").alias("qualifier"), as_bytes(c).alias("value")) for q, c in columns.items()])
    rows = df.select(as_bytes(key).alias("row_key"), ts.cast("long").alias("ts"), F.explode(pairs).alias("c"))
    return rows.where("c.value is not null").select("row_key", F.lit(family).alias("family"), F.lit(fam_order).alias("fam_order"), F.col("c.qualifier").alias("qualifier"), "ts", F.col("c.value").alias("value"), F.lit(0).cast("long").alias("seq"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key ``u%06d``, family ``ev``, qualifier the event type, value the text of the value: many versions a column."""
    df = _events(spark, sf_dir)
    key = F.format_string("u%06d", "user_id")
    return df.select(as_bytes(key).alias("row_key"), F.lit("ev").alias("family"), F.lit(0).alias("fam_order"), as_bytes(F.col("event_type")).alias("qualifier"), micros(F.col("ts")).alias("ts"), as_bytes(F.format_string("%d", F.round(F.col("value") * 100).cast("long"))).alias("value"), F.col("event_id").cast("long").alias("seq"))


def events_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key ``u%06d#%08d`` of user and event, family ``cf``: type, cents and props."""
    df = _events(spark, sf_dir)
    columns = {"type": F.col("event_type"), "cents": F.round(F.col("value") * 100).cast("long"), "props": F.col("props")}
    return from_columns(df, F.format_string("u%06d#%08d", "user_id", "event_id"), "cf", columns, micros(F.col("ts")))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key ``c%06d#%08d`` of customer and order, family ``o``: status, cents, priority and date."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    columns = {"status": F.col("o_orderstatus"), "cents": F.round(F.col("o_totalprice") * 100).cast("long"), "priority": F.col("o_orderpriority"), "date": F.date_format("o_orderdate", "yyyy-MM-dd")}
    return from_columns(df, F.format_string("c%06d#%08d", "o_custkey", "o_orderkey"), "o", columns, micros(F.col("o_orderdate")))


def settle(cells: DataFrame) -> DataFrame:
    """One cell per key, family, qualifier and ts: the last written."""
    return cells.groupBy(*CELL).agg(F.max_by("fam_order", "seq").alias("fam_order"), F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq")).select(*COLUMNS)


def newest(cells: DataFrame) -> DataFrame:
    """The newest cell of each column."""
    at = F.struct("ts", "seq")
    return cells.groupBy("row_key", "family", "qualifier").agg(F.max_by("fam_order", at).alias("fam_order"), F.max("ts").alias("ts"), F.max_by("value", at).alias("value"), F.max_by("seq", at).alias("seq")).select(*COLUMNS)


def pick(cells: DataFrame, family: str, qualifiers: list[str]) -> DataFrame:
    """row_key and the newest value of each named qualifier, as text.  Only these cells are read, and shuffled once."""
    wanted = [q.encode() for q in qualifiers]
    part = cells.where((F.col("family") == family) & F.col("qualifier").isin([F.lit(bytearray(q)) for q in wanted]))
    at = F.struct("ts", "seq")
    return part.groupBy("row_key").agg(*[F.max_by(F.when(F.col("qualifier") == F.lit(bytearray(q)), F.col("value")), F.when(F.col("qualifier") == F.lit(bytearray(q)), at)).cast("string").alias(name) for name, q in zip(qualifiers, wanted)])


def pivot(cells: DataFrame, families: list[str]) -> DataFrame:
    """row_key and a MAP<BINARY, BINARY> of the newest values per family, sorted by qualifier; null for a family without cells."""
    latest = newest(cells)
    entry = F.struct(F.col("qualifier").alias("key"), "value")
    maps = [F.array_sort(F.collect_list(F.when(F.col("family") == f, entry))).alias(f"_{k}") for k, f in enumerate(families)]
    rows = latest.groupBy("row_key").agg(*maps)
    return rows.select("row_key", *[F.when(F.size(f"_{k}") > 0, F.map_from_entries(f"_{k}")).alias(f) for k, f in enumerate(families)])


def history(cells: DataFrame, family: str, latest_n: int | None = None) -> DataFrame:
    """row_key and a MAP<BINARY, ARRAY<STRUCT<timestamp, value>>> of all versions, newest first, at most ``latest_n``."""
    versions = F.sort_array(F.collect_list(F.struct("ts", "value")), asc=False)
    versions = F.slice(versions, 1, latest_n) if latest_n else versions
    columns = settle(cells.where(F.col("family") == family)).groupBy("row_key", "qualifier").agg(versions.alias("v"))
    entry = F.struct(F.col("qualifier").alias("key"), F.transform("v", lambda x: F.struct(F.timestamp_micros(x["ts"]).alias("timestamp"), x["value"].alias("value"))).alias("v"))
    return columns.groupBy("row_key").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(family))
