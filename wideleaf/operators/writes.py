"""Writes as data: a batch of mutations folded into cells.

A mutation is a row (row_key, op, family, qualifier, start_ts, end_ts, value, seq); op is ``set`` (at start_ts), ``del_column`` (times in
[start_ts, end_ts); null for no bound), ``del_family`` or ``del_row``.  Of two mutations the one of the greater seq is later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideleaf.functions import sketches
from wideleaf.sources.cells import COLUMNS

MUTATIONS = "row_key binary, op string, family string, qualifier binary, start_ts long, end_ts long, value binary, seq long"

MUTATIONS_COLUMNS = tuple(x.split()[0] for x in MUTATIONS.split(", "))


def fold(cells: DataFrame, mutations: DataFrame, fam_order: dict[str, int]) -> DataFrame:
    """The cells after ``mutations``, all of which are later than ``cells``.  Of cells of one key, family, qualifier and ts the last holds:
    any written by a mutation before any that was there, then the greatest seq.

    One shuffle by key: windows over cells and mutations of a row give the last delete of the row, of the family, and the deletes of
    the column, which are ranges of time."""
    order = F.create_map(*[x for f, k in fam_order.items() for x in (F.lit(f), F.lit(k))])
    columns = ["row_key", "family", "qualifier", "fam_order", "ts", "value", "seq", "op", "start_ts", "end_ts"]
    old = cells.select(*COLUMNS, F.lit("old").alias("op"), F.lit(None).cast("long").alias("start_ts"), F.lit(None).cast("long").alias("end_ts"))
    new = mutations.withColumn("fam_order", order[F.col("family")]).withColumn("ts", F.when(F.col("op") == "set", F.col("start_ts")))
    every = old.select(*columns).unionByName(new.select(*columns))
    column = Window.partitionBy("row_key", "family", "qualifier")
    cell = F.col("op").isin("old", "set")
    #: A cell's place among deletes: what was there is before all of them.
    at = F.when(F.col("op") == "set", F.col("seq")).otherwise(F.lit(-(1 << 62)))
    cut = F.when(F.col("op") == "del_column", F.struct("start_ts", "end_ts", F.col("seq").alias("cut")))
    seen = every.repartition("row_key").withColumns({
        "_n": F.when(cell, F.row_number().over(Window.partitionBy("row_key", "family", "qualifier", "ts").orderBy(cell.desc(), (F.col("op") == "set").desc(), F.desc("seq")))),
        "_cuts": F.collect_list(cut).over(column),
        "_family": F.max(F.when(F.col("op") == "del_family", F.col("seq"))).over(Window.partitionBy("row_key", "family")),
        "_row": F.max(F.when(F.col("op") == "del_row", F.col("seq"))).over(Window.partitionBy("row_key")),
    })
    hit = F.exists("_cuts", lambda x: (x["cut"] > at) & (F.col("ts") >= F.coalesce(x["start_ts"], F.lit(0))) & (x["end_ts"].isNull() | (F.col("ts") < x["end_ts"])))
    lost = (at < F.col("_row")) | (at < F.col("_family"))
    return seen.where((F.col("_n") == 1) & ~F.coalesce(lost, F.lit(False)) & ~hit).select(*COLUMNS)


def _wrapped(total):
    """A sum of 64-bit numbers, given as a decimal, as it is left in 64 bits."""
    half, whole = (F.lit(str(2**n)).cast("decimal(20,0)") for n in (63, 64))
    return (F.pmod(total + half, whole) - half).cast("long")


def aggregate(cells: DataFrame, added: DataFrame, how: str) -> DataFrame:
    """Cells of an aggregate family (values as BIGINT in ``n``) after ``added``: ``sum`` (which wraps), ``min`` or ``max`` per cell."""
    merge = {"sum": lambda c: _wrapped(F.sum(F.col(c).cast("decimal(20,0)"))), "min": F.min, "max": F.max}[how]
    key = ["row_key", "family", "qualifier", "ts"]
    return cells.select(*key, "n").unionByName(added.select(*key, "n")).groupBy(*key).agg(merge("n").alias("n"))


def add_to_sketches(cells: DataFrame, added: DataFrame, precision: int = 14) -> DataFrame:
    """Cells of a sketch family after input values (``value`` BINARY) were added to them."""
    key = ["row_key", "family", "qualifier", "ts"]
    return merge_sketches(cells, added.groupBy(*key).agg(sketches.sketch(F.col("value"), T.BinaryType(), precision).alias("value")))


def merge_sketches(cells: DataFrame, added: DataFrame) -> DataFrame:
    """Cells of a sketch family after sketches were merged into them."""
    key = ["row_key", "family", "qualifier", "ts"]
    return cells.select(*key, "value").unionByName(added.select(*key, "value")).groupBy(*key).agg(sketches.merge(F.col("value")).alias("value"))


def big_endian(n):
    """Eight bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(n), 16, "0"))


def from_big_endian(value):
    """The number in eight bytes; null for other lengths."""
    return F.when(F.octet_length(value) == 8, F.conv(F.hex(value), 16, -10).cast("long"))


RULES = "row_key binary, family string, qualifier binary, rule_no int, append binary, by long"


def read_modify_write(cells: DataFrame, rules: DataFrame, now: int) -> DataFrame:
    """The cells that rules write: row_key, family, qualifier, ts, value and ``error``, one per column.

    The rules of a column apply in the order of ``rule_no``, each to what the one before left: ``append`` adds bytes, ``by`` adds to a
    big-endian number of eight bytes, wrapping; an absent cell is empty, or 0.  A number of another length is an error, and
    ``value`` is null.  The time is ``now`` or that of the newest cell, whichever is later.  A row's rules stand in one request, so
    their list is bounded."""
    key = ["row_key", "family", "qualifier"]
    asked = rules.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rule_no", "append", "by"))).alias("rules"))
    at = F.struct("ts", "seq")
    latest = cells.join(asked.select(*key), key, "left_semi").groupBy(*key).agg(F.max("ts").alias("last"), F.max_by("value", at).alias("was"))
    add = lambda v, by: big_endian(_wrapped(F.coalesce(from_big_endian(v), F.lit(0)).cast("decimal(20,0)") + by.cast("decimal(20,0)")))

    def step(state, rule):
        bad = rule["by"].isNotNull() & state["value"].isNotNull() & (F.octet_length(state["value"]) != 8)
        value = F.when(rule["by"].isNotNull(), add(state["value"], rule["by"])).otherwise(F.concat(F.coalesce(state["value"], F.lit(bytearray())), rule["append"]))
        return F.struct(F.when(state["error"].isNotNull() | bad, state["value"]).otherwise(value).alias("value"), F.coalesce(state["error"], F.when(bad, F.format_string("rule %d: the value is %d bytes long, not a number of eight", rule["rule_no"], F.octet_length(state["value"])))).alias("error"))

    start = F.struct(F.col("was").alias("value"), F.lit(None).cast("string").alias("error"))
    done = asked.join(latest, key, "left").withColumn("done", F.aggregate("rules", start, step))
    return done.select(*key, F.greatest(F.lit(now), F.coalesce("last", F.lit(0))).alias("ts"), F.when(F.col("done.error").isNull(), F.col("done.value")).alias("value"), F.col("done.error").alias("error"))


def increment(cells: DataFrame, rules: DataFrame, now: int) -> DataFrame:
    """For each rule (row_key, family, qualifier, by): the cell that increments write, and its number ``n``; null where the cell held none."""
    ruled = rules.select("row_key", "family", "qualifier", F.lit(0).alias("rule_no"), F.lit(None).cast("binary").alias("append"), "by")
    return read_modify_write(cells, ruled, now).drop("error").withColumn("n", from_big_endian(F.col("value")))
