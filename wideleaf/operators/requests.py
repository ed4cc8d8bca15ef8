"""Write requests over cells: validation, statuses, tokens, conditional writes and dropped ranges.

Requests come as a table of entries: ``ENTRIES``, a row per mutation.  An entry is the mutations of one row that are applied together or
not at all; ``entry_no`` orders entries, ``mut_no`` the mutations in one.  All checks are aggregates by entry, so batches of any size
take one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wideleaf.errors import InvalidArgument, PermissionDenied
from wideleaf.operators import ranges, rowfilters, writes

# The limits of requests.
KEY_BYTES, MUTATIONS, TOKEN_BYTES, TOKEN_MICROS = 4096, 100_000, 8, 15 * 60 * 1_000_000

ENTRIES = "entry_no long, mut_no int, row_key binary, op string, family string, qualifier binary, start_ts long, end_ts long, value binary"
_OPS = ("set", "del_column", "del_family", "del_row")


@dataclass(frozen=True)
class Families:
    """Families of a table in order of their creation, those of them that aggregate, and whether times may be finer than a millisecond."""

    order: tuple[str, ...]
    aggregates: tuple[str, ...] = ()
    micros: bool = False


def _fault(families: Families) -> Column:
    """What is wrong with a mutation; null if nothing."""
    op, known = F.col("op"), F.coalesce(F.col("family").isin(*families.order) if families.order else F.lit(False), F.lit(False))
    whole = F.lit(True) if families.micros else F.col("start_ts") % 1000 == 0
    ends = F.lit(True) if families.micros else F.coalesce(F.col("end_ts") % 1000 == 0, F.lit(True))
    is_set, is_cut = op == "set", op == "del_column"
    return (
        F.when(~op.isin(*_OPS), "INVALID_ARGUMENT: no such mutation")
        .when((op != "del_row") & ~known, F.concat(F.lit("NOT_FOUND: no family "), F.coalesce("family", F.lit(""))))
        .when(is_set & F.col("family").isin(*families.aggregates) if families.aggregates else F.lit(False), "INVALID_ARGUMENT: an aggregate family takes no set")
        .when(is_set & (F.col("start_ts").isNull() | (F.col("start_ts") < -1)), "INVALID_ARGUMENT: a bad timestamp")
        .when(is_set & (F.col("start_ts") >= 0) & ~whole, "INVALID_ARGUMENT: a timestamp finer than the table's")
        .when(is_cut & (~F.coalesce(whole, F.lit(True)) | ~ends), "INVALID_ARGUMENT: a time range finer than the table's")
        .when(is_cut & F.coalesce(F.col("end_ts") <= F.coalesce("start_ts", F.lit(0)), F.lit(False)), "INVALID_ARGUMENT: an empty time range")
    )


def validate(entries: DataFrame, families: Families) -> DataFrame:
    """entry_no, row_key and ``status`` of each entry: ``OK``, or the fault of its first wrong mutation."""
    fault = _fault(families)
    judged = entries.groupBy("entry_no").agg(F.first("row_key").alias("row_key"), F.count("*").alias("n"), F.min(F.when(fault.isNotNull(), F.struct("mut_no", fault.alias("why")))).alias("first"))
    length = F.coalesce(F.octet_length("row_key"), F.lit(0))
    status = (
        F.when(length == 0, "INVALID_ARGUMENT: row keys must not be empty")
        .when(length > KEY_BYTES, F.concat(F.lit("INVALID_ARGUMENT: a row key of "), length, F.lit(" bytes")))
        .when(F.col("n") > MUTATIONS, "INVALID_ARGUMENT: too many mutations")
        .when(F.col("first").isNotNull(), F.concat(F.element_at(F.split("first.why", ":"), 1), F.lit(": mutation "), F.col("first.mut_no"), F.lit(":"), F.element_at(F.split("first.why", ":"), 2)))
        .otherwise("OK")
    )
    return judged.select("entry_no", "row_key", status.alias("status"))


def resolved(entries: DataFrame, now: int, base: int = 0) -> DataFrame:
    """Entries as mutations: in the order of entry and mutation; a time of -1 is ``now``, to the millisecond."""
    ts = F.when((F.col("op") == "set") & (F.col("start_ts") == -1), F.lit(now - now % 1000)).otherwise(F.col("start_ts"))
    return entries.select("row_key", "op", "family", "qualifier", ts.alias("start_ts"), "end_ts", "value", (F.lit(base) + F.col("entry_no") * MUTATIONS + F.col("mut_no")).alias("seq"))


def mutate_rows(cells: DataFrame, entries: DataFrame, families: Families, now: int) -> tuple[DataFrame, DataFrame]:
    """The cells after all entries that are in order, and the status of each entry.  Entries of one row apply in their order."""
    statuses = validate(entries, families)
    good = entries.join(statuses.where("status = 'OK'").select("entry_no"), "entry_no", "left_semi")
    return writes.fold(cells, resolved(good, now), {f: k for k, f in enumerate(families.order)}), statuses


def fresh(requests: DataFrame, tokens: DataFrame, now: int) -> DataFrame:
    """``requests`` (entry_no, row_key, token) with ``status``: ``OK`` for those to apply, ``DONE`` for those whose token the row has
    seen in the last fifteen minutes (``tokens``: row_key, token, expire_us) or in an earlier entry.  A null or empty token protects nothing."""
    given = F.coalesce(F.octet_length("token"), F.lit(0))
    known = tokens.where(F.col("expire_us") > now).select("row_key", "token").distinct().withColumn("seen", F.lit(True))
    first = requests.where(given > 0).groupBy("row_key", "token").agg(F.min("entry_no").alias("first"))
    joined = requests.join(known, ["row_key", "token"], "left").join(first, ["row_key", "token"], "left")
    status = F.when((given > 0) & (given < TOKEN_BYTES), f"INVALID_ARGUMENT: a token of under {TOKEN_BYTES} bytes").when((given > 0) & (F.coalesce("seen", F.lit(False)) | (F.col("entry_no") > F.col("first"))), "DONE").otherwise("OK")
    return joined.select("entry_no", "row_key", "token", status.alias("status"))


def remembered(requests: DataFrame, now: int) -> DataFrame:
    """The tokens to keep after ``fresh`` requests were applied."""
    return requests.where("status = 'OK' and octet_length(token) > 0").select("row_key", "token", F.lit(now + TOKEN_MICROS).alias("expire_us"))


def check_and_mutate(cells: DataFrame, keys: DataFrame, predicate: rowfilters.Filter | None, on_true: DataFrame, on_false: DataFrame, families: Families, now: int, *, visible: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """For each of ``keys`` (row_key), if ``predicate`` leaves a cell of the row, the entries of ``on_true`` apply, else those of
    ``on_false``.  Without a predicate a row matches if it has cells.  ``visible`` are the cells that the predicate sees (after
    garbage collection, or of a part); all, if not given.  Only the chosen entries are validated.

    The cells after, and row_key, ``matched`` and ``status`` of each key."""
    asked = keys.select("row_key").distinct()
    seen = (cells if visible is None else visible).join(asked, "row_key", "left_semi")
    left = rowfilters.apply(seen, predicate or rowfilters.PassAll()).select("row_key").distinct().withColumn("matched", F.lit(True))
    matched = asked.join(left, "row_key", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    chosen = on_true.join(matched.where("matched"), "row_key", "left_semi").unionByName(on_false.join(matched.where("not matched"), "row_key", "left_semi"))
    after, statuses = mutate_rows(cells, chosen, families, now)
    worst = statuses.groupBy("row_key").agg(F.min(F.when(F.col("status") != "OK", F.col("status"))).alias("status"))
    return after, matched.join(worst, "row_key", "left").withColumn("status", F.coalesce("status", F.lit("OK")))


def drop_row_range(cells: DataFrame, prefix: bytes | None) -> tuple[DataFrame, DataFrame]:
    """The cells without the rows of ``prefix`` (None: without all), and what went: row_key and family of each family that held data."""
    if prefix is not None and not prefix:
        raise InvalidArgument("a prefix must not be empty")
    hit = ranges.predicate([ranges.prefix(prefix)]) if prefix is not None else F.lit(True)
    return cells.where(~hit), cells.where(hit).select("row_key", "family").distinct()


def check_view(entries: DataFrame, prefixes: list[bytes], subsets: dict[str, tuple[list[bytes], list[bytes]]]) -> None:
    """Turns away entries that write outside an authorised part: a key without one of the prefixes, or a column that isn't in the part.
    Deletes of rows and families need the whole of it."""
    row = ranges.predicate([ranges.prefix(p) for p in prefixes] or ranges.EVERYTHING)
    column = F.lit(False)
    for family, (qualifiers, starts) in subsets.items():
        rs = [*map(ranges.point, qualifiers), *map(ranges.prefix, starts)]
        everything = ranges.normalise(rs) == ranges.EVERYTHING
        column = column | ((F.col("family") == family) & (F.when(F.col("op") == "del_family", F.lit(everything)).otherwise(F.coalesce(ranges.predicate(rs, "qualifier"), F.lit(False)))))
    fine = row & F.coalesce(column, F.lit(False)) & (F.col("op") != "del_row")
    if not entries.where(~F.coalesce(fine, F.lit(False))).isEmpty():
        raise PermissionDenied("a mutation lies outside the authorised view")
