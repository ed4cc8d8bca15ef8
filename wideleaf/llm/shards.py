"""Sharding by histogram sort.

Rows are put in the order of a key in which equal texts stand together: a hash of the text, then of the id and
of the whole row.  The bytes below candidate boundaries are counted exactly over all partitions; where a
splitter is not near enough to its goal and more than one row is left to part, only the interval that holds it is probed again, at 4096 finer boundaries.
When all splitters meet the tolerance (or stand between two rows), the rows are exchanged once.

Law ``bytes``: a row weighs the UTF-8 bytes of its text (null: none) plus 1; the bytes below each splitter differ from
their goal by at most ``tolerance`` of a shard, or by one row.  Copies of a text stand together in the order, so they share a
shard, but for a group that a border must part to meet the tolerance: its rows are told apart by id.  Defined results: null ids and texts
are keys like others; rows equal in id and text are told apart by their place and never lost; an empty
table gives an empty result; further columns are carried by ``shard`` (its own come in ``_shard``, a struct).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wideleaf.llm.common import row_id, spool, text_bytes

BITS, DIGITS = 12, 5  # a key is two numbers of DIGITS * BITS bits


def _number(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - BITS * DIGITS)


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """For each inner border the first key (k1, k2) of the next shard; iterations over ``keys`` (_k1, _k2, size).

    Each iteration returns at most 4096 counts for each splitter."""
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    slack = tolerance * total / shards
    goals = [total * (k + 1) / shards for k in range(shards - 1)]
    #: per splitter: digits of the interval that holds it, and the bytes below this interval
    state: list[tuple[tuple[int, ...], int]] = [((), 0)] * len(goals)
    found: dict[int, tuple[int, ...]] = {}
    for level in range(1, 2 * DIGITS + 1):
        open_ = {k for k in range(len(goals)) if k not in found}
        if not open_ or not total:
            break
        digit = F.shiftrightunsigned("_k1" if level <= DIGITS else "_k2", BITS * ((DIGITS if level <= DIGITS else 2 * DIGITS) - level)).bitwiseAND((1 << BITS) - 1)
        if level == 1:
            here, prefix = keys, F.lit("")
        else:
            prefixes = {state[k][0] for k in open_}
            prefix = F.concat_ws(".", *[F.shiftrightunsigned("_k1" if i < DIGITS else "_k2", BITS * ((DIGITS if i < DIGITS else 2 * DIGITS) - 1 - i)).bitwiseAND((1 << BITS) - 1).cast("string") for i in range(level - 1)])
            here = keys.where(prefix.isin(sorted(".".join(map(str, p)) for p in prefixes)))
        counts: dict[str, dict[int, tuple[int, int]]] = {}
        for p, d, size, n in here.groupBy(prefix.alias("p"), digit.alias("d")).agg(F.sum("size"), F.count("*")).collect():
            counts.setdefault(p, {})[d] = size, n
        for k in open_:
            digits, below = state[k]
            hist = sorted(counts.get(".".join(map(str, digits)), {}).items())
            best, inside, alone = None, None, True
            at = below
            for d, (size, n) in hist:
                if best is None or abs(at - goals[k]) < best[0]:
                    best = (abs(at - goals[k]), (*digits, d))
                if at <= goals[k] < at + size or inside is None:
                    inside, alone = ((*digits, d), at), n == 1
                at += size
            if best is None or best[0] <= slack or alone or level == 2 * DIGITS:
                found[k] = best[1] if best else digits
            else:
                state[k] = inside

    def key(digits: tuple[int, ...]) -> tuple[int, int]:
        full = [*digits, *[0] * (2 * DIGITS - len(digits))]
        join = lambda xs: reduce(lambda a, b: a << BITS | b, xs, 0)
        return join(full[:DIGITS]), join(full[DIGITS:])

    return [key(found[k]) for k in range(len(goals)) if k in found]


def shard(docs: DataFrame, shards: int = 8, *, tolerance: float = 0.001, narrow: bool = False) -> DataFrame:
    """``docs`` with struct ``_shard``: size, text_crc32, shard, slot.  ``narrow``: with doc_id only, so that texts aren't moved.

    Slots are gapless from 0 in each shard, in the order of the key."""
    text = F.col("text").cast("string")
    carried = [F.col("doc_id")] if narrow else [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")]
    keyed = docs.select(*carried, (text_bytes(text) + 1).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), _number(text).alias("_k1"), _number(F.col("doc_id").cast("string"), row_id()).alias("_k2"))
    if narrow:
        keyed = spool(keyed, "shards")
    borders = splitters(keyed.select("_k1", "_k2", "size"), shards, tolerance)
    number = F.lit(0)
    for k1, k2 in borders:
        number = number + F.when((F.col("_k1") > k1) | (F.col("_k1") == k1) & (F.col("_k2") >= k2), 1).otherwise(0)
    # The exchange: ranges of the key in each shard, sorted; the key's second half spreads the copies of one text.
    fine = keyed.withColumn("shard", number.cast("int"))
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    moved = spool(fine.repartitionByRange(parts, "shard", "_k1", "_k2").sortWithinPartitions("shard", "_k1", "_k2").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "sharded")
    # A row's slot: its place in its partition, less the rows of earlier shards there, plus the shard's rows in earlier partitions.
    runs = moved.groupBy("_part", "shard").agg(F.count("*").alias("n"), F.min("_at").alias("_from")).collect()  # partitions and shards, no rows
    start, sums = [], {}
    for part, s, n, first in sorted((r["_part"], r["shard"], r["n"], r["_from"]) for r in runs):
        start.append((part, s, sums.get(s, 0) - first))
        sums[s] = sums.get(s, 0) + n
    offsets = moved.sparkSession.createDataFrame(start or [(0, 0, 0)], "_part int, shard int, _shift long")
    placed = moved.join(F.broadcast(offsets), ["_part", "shard"])
    own = F.struct("size", "text_crc32", "shard", (F.col("_at") + F.col("_shift")).alias("slot")).alias("_shard")
    return placed.select("doc_id", own) if narrow else placed.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], own)


def report(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard, a row per document."""
    s = F.col("_shard")
    return shard(docs, shards, narrow=True).select("doc_id", s["size"].alias("size"), s["text_crc32"].alias("text_crc32"), F.lit("bytes").alias("law"), s["shard"].alias("shard"), s["slot"].alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
