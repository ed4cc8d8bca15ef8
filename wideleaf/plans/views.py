"""Continuous materialised views defined by a query: grouped views, and secondary indexes by ORDER BY.

A row is left out if a key column is null, if its ``_timestamp`` is null, negative or finer than a millisecond, if all its value
columns are null, or if its evaluation fails.  Rows are kept in the order of their ``_key``, then newest ``_timestamp`` first.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideleaf.dialect import aggregates, lexer, parser
from wideleaf.dialect.query import Catalog, _name_of, _Planner, _walk
from wideleaf.errors import InvalidArgument
from wideleaf.functions import keys as K
from wideleaf.functions.codecs import to_float_bytes

# Aggregates that a view takes, functions that it doesn't, and types of key columns.
_AGGREGATES = frozenset("ANY_VALUE APPROX_COUNT_DISTINCT AVG BIT_AND BIT_OR BIT_XOR COUNT COUNTIF HLL_COUNT.INIT HLL_COUNT.MERGE HLL_COUNT.MERGE_PARTIAL LOGICAL_AND LOGICAL_OR MAX MIN SUM".split())
_UNSTABLE = frozenset("RAND CURRENT_DATE CURRENT_TIMESTAMP".split())
_KEY_TYPES = {T.StringType: "STRING", T.BinaryType: "BYTES", T.LongType: "INT64", T.TimestampType: "TIMESTAMP"}


@dataclass(frozen=True)
class Definition:
    """Names of the key columns in order, of the value columns, and of all in the order of the query."""

    keys: tuple[str, ...]
    values: tuple[str, ...]
    columns: tuple[str, ...]


def _check(q: parser.Query) -> None:
    if q.limit is not None:
        raise InvalidArgument("a view takes no LIMIT")
    if q.distinct or q.having is not None:
        raise InvalidArgument("a view takes neither DISTINCT nor HAVING")
    if bool(q.group) == bool(q.order):
        raise InvalidArgument("a view has either GROUP BY or ORDER BY")
    if q.source is None or q.source.kind == "query" or q.source.args:
        raise InvalidArgument("a view reads one table, without arguments")
    for x in _walk(q):
        if x[:1] == ("param",) and len(x) == 2:
            raise InvalidArgument("a view takes no parameters")
        if x[:1] == ("star",) and len(x) == 4:
            raise InvalidArgument("a view lists its columns")
        if x[:1] == ("call",) and len(x) == 4 and x[1] in _UNSTABLE:
            raise InvalidArgument(f"a view takes no {x[1]}")
        if x[:1] == ("struct",) and len(x) == 3:
            raise InvalidArgument("a view takes no STRUCT")
    for c in aggregates.find(tuple(x for x, _ in q.items), []):
        if c[1] not in _AGGREGATES or ("distinct",) in c[3]:
            raise InvalidArgument(f"a view takes no {c[1]} of this kind")


def _key_names(q: parser.Query, names: list[str]) -> list[str]:
    """The output columns that GROUP BY or ORDER BY names by alias, place or expression."""
    found = []
    for x in q.group or [o[0] for o in q.order]:
        if x[0] == "lit" and type(x[1]) is int and 1 <= x[1] <= len(names):
            at = x[1] - 1
        else:
            hits = [i for i, (y, _) in enumerate(q.items) if (x[0] == "name" and names[i].lower() == x[1].lower()) or y == x]
            if not hits:
                raise InvalidArgument("the key of a view must be among its columns")
            at = hits[0]
        found.append(names[at])
    if any(down or nulls for _, down, nulls in q.order):
        raise InvalidArgument("a view is in ascending order")
    if len(set(found)) != len(found):
        raise InvalidArgument("a key column is given twice")
    return found


def plan(spark: SparkSession, catalog: Catalog, sql: str) -> tuple[DataFrame, Definition]:
    """All rows of a view, with their ``_key``, in no order."""
    if any(t.kind == "op" and t.value == "@{" for t in lexer.tokens(sql)):
        raise InvalidArgument("a view takes no hints")
    q = parser.parse(sql)
    while q.source is not None and q.source.kind == "query" and not q.order and q.limit is None:
        q = q.source.query
    _check(q)
    names = [alias or _name_of(x) for x, alias in q.items]
    if not all(names) or len({n.lower() for n in names}) != len(names):
        raise InvalidArgument("the columns of a view need distinct names")
    keys = _key_names(q, names)
    rel = _Planner(spark, catalog, {}, tolerant=True).relation(replace(q, order=()))
    types = {n: v.type for n, v in rel.columns}
    for n, t in types.items():
        if isinstance(t, (T.DateType, T.ArrayType, T.StructType)) or (isinstance(t, T.MapType) and q.group):
            raise InvalidArgument(f"a view has no column of {t.simpleString()}")
    timed = "_timestamp" in names
    if timed and (not isinstance(types["_timestamp"], T.TimestampType)):
        raise InvalidArgument("_timestamp is a TIMESTAMP")
    keys = [k for k in keys if k != "_timestamp"]
    kinds = [_KEY_TYPES.get(type(types[k])) for k in keys]
    if not keys or None in kinds:
        raise InvalidArgument("key columns are STRING, BYTES, INT64 or TIMESTAMP")
    if "_key" in keys and (keys != ["_key"] or kinds != ["BYTES"]):
        raise InvalidArgument("_key is the only key column, of BYTES")
    values = [n for n in names if n not in keys and n != "_timestamp"]
    rows = rel.frame.select(*[v.col.alias(n) for n, v in rel.columns])
    rows = rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    if timed:
        us = F.unix_micros("_timestamp")
        rows = rows.where((us >= 0) & (us % 1000 == 0))
    if values:
        rows = rows.where(reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in values]))
    if keys != ["_key"]:
        fields = [F.unix_micros(k) if kind == "TIMESTAMP" else F.col(k) for k, kind in zip(keys, kinds)]
        rows = rows.withColumn("_key", K.encoder(kinds)(*fields))
    return rows, Definition(tuple(keys), tuple(values), tuple(names))


def create(spark: SparkSession, catalog: Catalog, name: str, sql: str, path: str) -> Definition:
    """Writes a view in the order of its keys, so that ranges of them prune files, and enters it into the catalog."""
    rows, definition = plan(spark, catalog, sql)
    order = [F.col("_key")] + ([F.desc("_timestamp")] if "_timestamp" in definition.columns else [])
    rows.repartitionByRange("_key").sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    catalog.relations[name] = spark.read.parquet(path)
    if "_key" in definition.columns:
        catalog.keyed.add(name)
    return definition


def as_cells(stored: DataFrame, values: list[str]) -> DataFrame:
    """A stored view as cells: key ``_key``; the family ``default`` with a qualifier for each column, and a family for each column
    that is a map; at time 0, or at the row's ``_timestamp``.  Null values make no cell."""
    ts = F.unix_micros("_timestamp") if "_timestamp" in stored.columns else F.lit(0).cast("long")
    kinds = {f.name: f.dataType for f in stored.schema.fields}
    cell = lambda family, order, qualifier, value: F.struct(F.lit(family).alias("family"), F.lit(order).alias("fam_order"), qualifier.alias("qualifier"), value.alias("value"))
    parts = []
    maps = [v for v in values if isinstance(kinds[v], T.MapType)]
    for v in values:
        if v in maps:
            parts.append(F.transform(F.map_entries(v), lambda e, v=v: cell(v, 1 + maps.index(v), e["key"].cast("binary"), _as_bytes(e["value"], kinds[v].valueType))))
        else:
            parts.append(F.array(cell("default", 0, F.lit(v).cast("binary"), _as_bytes(F.col(f"`{v}`"), kinds[v]))))
    made = stored.select(F.col("_key").alias("row_key"), ts.alias("ts"), F.explode(F.flatten(F.array(*[F.coalesce(p, F.array().cast(_CELLS)) for p in parts]))).alias("c"))
    return made.where("c.value is not null").select("row_key", "c.family", "c.fam_order", "c.qualifier", "ts", "c.value", F.lit(0).cast("long").alias("seq"))


_CELLS = "array<struct<family:string,fam_order:int,qualifier:binary,value:binary>>"


def _as_bytes(c: Column, kind: T.DataType) -> Column:
    """A value as it stands in a cell: text and bytes as they are, numbers and times as eight bytes, most significant first."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return c.cast("binary")
    if isinstance(kind, T.BooleanType):
        return F.when(c, F.lit(b"\x01")).when(~c, F.lit(b"\x00"))
    if isinstance(kind, T.DoubleType):
        return F.when(c.isNotNull(), to_float_bytes(c))
    number = F.unix_micros(c) if isinstance(kind, T.TimestampType) else c.cast("long")
    return F.unhex(F.lpad(F.hex(number), 16, "0"))
