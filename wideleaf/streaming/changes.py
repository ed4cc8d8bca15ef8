"""The change log: an append-only table with one record for each row and commit, read in batches or as a stream.

Records are stored by day of their commit, so retention deletes whole folders.  Ids are a total order over the log: a batch is sorted
by time, key and type, and each record gets the place after the greatest id there was.  One writer appends at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wideleaf.errors import InvalidArgument, OutOfRange
from wideleaf.functions import folders
from wideleaf.operators import collect, ranges

_MUTATIONS = "array<struct<op:string,family:string,qualifier:binary,ts:long,start_ts:long,end_ts:long,value:binary>>"
SCHEMA = f"id long, row_key binary, type string, commit_us long, mutations {_MUTATIONS}, day int"
_DAY = 86_400_000_000
#: What a poll delivers at most; fixed values: the shortest and longest retention.
BATCH, SHORTEST, LONGEST = 500, _DAY, 7 * _DAY


def _mutation(op, **fields):
    kinds = {"family": "string", "qualifier": "binary", "ts": "long", "start_ts": "long", "end_ts": "long", "value": "binary"}
    return F.struct(op.alias("op"), *[fields.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def _records(parts: DataFrame, kind: str) -> DataFrame:
    """Records of rows (row_key, commit_us, at, m): one per row and commit, its mutations in the order of ``at``."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda x: x["m"])
    return parts.groupBy("row_key", "commit_us").agg(listed.alias("mutations")).select("row_key", F.lit(kind).alias("type"), "commit_us", "mutations")


def of_cells(cells: DataFrame) -> DataFrame:
    """A record per row and time: the cells that were written then."""
    made = _mutation(F.lit("set"), family=F.col("family"), qualifier=F.col("qualifier"), ts=F.col("ts"), value=F.col("value"))
    return _records(cells.select("row_key", F.col("ts").alias("commit_us"), F.struct("fam_order", "family", "qualifier", "seq").alias("at"), made.alias("m")), "USER")


def of_mutations(mutations: DataFrame, before: DataFrame, commit_us: int) -> DataFrame:
    """A record per row that ``mutations`` touch.  The delete of a row is told as one delete for each family that holds data, before
    or by an earlier mutation of the batch."""
    is_row = F.col("op") == "del_row"
    named = _mutation(F.col("op"), family=F.col("family"), qualifier=F.col("qualifier"), ts=F.when(F.col("op") == "set", F.col("start_ts")), start_ts=F.when(F.col("op") != "set", F.col("start_ts")), end_ts=F.col("end_ts"), value=F.col("value"))
    plain = mutations.where(~is_row).select("row_key", F.struct("seq", F.col("family").alias("f")).alias("at"), named.alias("m"))
    deletes = mutations.where(is_row).select("row_key", F.col("seq").alias("s"))
    held = before.join(deletes.select("row_key"), "row_key", "left_semi").select("row_key", "family", F.lit(-1).cast("long").alias("since")).unionByName(mutations.where("op = 'set'").select("row_key", "family", F.col("seq").alias("since")))
    expanded = deletes.join(held, "row_key").where("since < s").select("row_key", "s", "family").distinct()
    expanded = expanded.select("row_key", F.struct(F.col("s").alias("seq"), F.col("family").alias("f")).alias("at"), _mutation(F.lit("del_family"), family=F.col("family")).alias("m"))
    return _records(plain.unionByName(expanded).withColumn("commit_us", F.lit(commit_us)), "USER")


def of_dropped(dropped: DataFrame, commit_us: int) -> DataFrame:
    """Records of dropped rows: a delete for each family (row_key, family) that held data."""
    return _records(dropped.select("row_key", F.lit(commit_us).alias("commit_us"), F.struct("family").alias("at"), _mutation(F.lit("del_family"), family=F.col("family")).alias("m")), "USER")


def of_collected(cells: DataFrame, rules: dict[str, collect.Rule], now: int) -> DataFrame:
    """Records of what garbage collection takes at ``now``: for each row the deletes of its cells' times."""
    gone = collect.collected(cells, rules, now)
    made = _mutation(F.lit("del_column"), family=F.col("family"), qualifier=F.col("qualifier"), start_ts=F.col("ts"), end_ts=F.col("ts") + 1)
    return _records(gone.select("row_key", F.lit(now).alias("commit_us"), F.struct("fam_order", "family", "qualifier", "ts").alias("at"), made.alias("m")), "GARBAGE_COLLECTION")


def numbered(changes: DataFrame, after: int = 0) -> DataFrame:
    """Records with their ids: greater than ``after``, in the order of time, key and type."""
    order = ["commit_us", "row_key", "type"]
    placed = changes.repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.withColumn("id", F.monotonically_increasing_id() + (after + 1)).withColumn("day", F.expr(f"cast(commit_us div {_DAY} as int)"))


def last_id(spark: SparkSession, path: str) -> int:
    """The greatest id in the log; 0 if it is empty or isn't there."""
    return (_stored(spark, path).agg(F.max("id")).first()[0] or 0) if folders.exists(spark, path) else 0


def append(changes: DataFrame, path: str) -> None:
    spark = changes.sparkSession
    columns = ["id", "row_key", "type", "commit_us", "mutations", "day"]
    numbered(changes, last_id(spark, path)).select(*columns).write.partitionBy("day").mode("append").parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def initial_partitions() -> list[ranges.Range]:
    """The ranges of keys that a reader of the whole log starts with."""
    return list(ranges.EVERYTHING)


def read(spark: SparkSession, path: str, *, tokens: list[int] = (), start_us: int | None = None, end_us: int | None = None, row_ranges: list[ranges.Range] = (), now: int | None = None, retention: int = LONGEST) -> DataFrame:
    """Records in the order of their ids: after the earliest of the tokens (ids already delivered), or from a start, which must be kept
    still and not be in the future; to an end (included); of the given keys."""
    if tokens and start_us is not None:
        raise InvalidArgument("a reader starts at a time or after tokens, not both")
    if start_us is not None and now is not None and start_us > now:
        raise InvalidArgument("a start in the future")
    if start_us is not None and now is not None and start_us < now - retention:
        raise OutOfRange("a start before what is kept")
    if start_us is not None and end_us is not None and end_us < start_us:
        raise InvalidArgument("an end before the start")
    return part(_stored(spark, path), min(tokens) if tokens else None, start_us, end_us, row_ranges).drop("day").orderBy("id")


@dataclass(frozen=True)
class Heartbeat:
    """There is nothing after ``token``; all records to come have later commits than ``low_watermark`` (in microseconds)."""

    token: int
    low_watermark: int


def poll(spark: SparkSession, path: str, token: int, now: int, *, limit: int = BATCH, row_ranges: list[ranges.Range] = ()) -> DataFrame | Heartbeat:
    """The next records after ``token``, ``limit`` at most; a heartbeat if there are none.  ``now`` is taken before the log is looked at."""
    found = read(spark, path, tokens=[token], row_ranges=row_ranges).limit(limit)
    return Heartbeat(token, now) if found.isEmpty() else found


def stream(spark: SparkSession, path: str, *, start_us: int | None = None, end_us: int | None = None, row_ranges: list[ranges.Range] = (), files: int = 100) -> DataFrame:
    """The same as a stream; the checkpoint of the query that reads it keeps its place."""
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)
    return part(source, None, start_us, end_us, row_ranges).withColumn("commit_time", F.timestamp_micros("commit_us"))


def part(df: DataFrame, after_id: int | None, start_us: int | None, end_us: int | None, row_ranges: list[ranges.Range]) -> DataFrame:
    """Of records those after an id, in a time (both ends included; days prune folders), of the given keys."""
    df = df.where(F.col("id") > after_id) if after_id is not None else df
    for bound, holds in ((start_us, lambda c, b: c >= b), (end_us, lambda c, b: c <= b)):
        if bound is not None:
            df = df.where(holds(F.col("commit_us"), bound))
            df = df.where(holds(F.col("day"), bound // _DAY)) if "day" in df.columns else df
    return df.where(ranges.predicate(list(row_ranges))) if row_ranges else df


def purge(spark: SparkSession, path: str, now: int, retention: int = LONGEST) -> int:
    """Delete the days of the log that lie wholly before ``retention``, of one to seven days; how many went."""
    if not SHORTEST <= retention <= LONGEST:
        raise InvalidArgument("changes are kept for one to seven days")
    if not folders.exists(spark, path):
        return 0
    old = [name for name in folders.names(spark, path) if name.startswith("day=") and (int(name[4:]) + 1) * _DAY <= now - retention]
    for name in old:
        folders.delete(spark, f"{path}/{name}")
    return len(old)


def tumbling(changes: DataFrame, window: str, late: str) -> DataFrame:
    """Commits per window of commit time; records later than ``late`` behind the newest are dropped."""
    return changes.withWatermark("commit_time", late).groupBy(F.window("commit_time", window).alias("w")).agg(F.count("*").alias("commits")).select(F.col("w.start").alias("window_start"), "commits")
