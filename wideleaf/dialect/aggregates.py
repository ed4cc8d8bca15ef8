"""Aggregate calls as columns.  What depends on the order of rows takes that of ``_ord``, the key order of the source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideleaf.dialect import binder as B
from wideleaf.dialect.functions import AGGREGATES
from wideleaf.errors import InvalidArgument, Unimplemented
from wideleaf.functions import scalars as S
from wideleaf.functions import sketches

# Which aggregates take which modifiers.
_DISTINCT = frozenset("ARRAY_AGG STRING_AGG COUNT SUM AVG MIN MAX BIT_AND BIT_OR BIT_XOR ANY_VALUE COUNTIF LOGICAL_AND LOGICAL_OR".split())
_ORDERED = frozenset("ARRAY_AGG ARRAY_CONCAT_AGG STRING_AGG".split())
#: Spark's sketches take at most this precision; greater ones are lowered to it.
_MAX_PRECISION = 21


def find(node, out: list) -> list:
    """Aggregate calls of a tree, outermost first, each once."""
    if isinstance(node, tuple):
        if node and node[0] == "call" and node[1] in AGGREGATES:
            if node not in out:
                out.append(node)
            inner = find((node[2], node[3]), [])
            if inner:
                raise InvalidArgument("aggregates can't be nested")
            return out
        if node and node[0] == "safe" and node[1][1] in AGGREGATES:
            raise InvalidArgument("aggregates don't take SAFE.")
        for x in node:
            find(x, out)
    return out


def _numeric(v: B.Value, name: str) -> B.Value:
    if not B.is_number(v.type) and not isinstance(v.type, T.NullType):
        raise InvalidArgument(f"{name} needs numbers, found {v.type.simpleString()}")
    return v if B.is_number(v.type) else B.assign(v, B.INT)


def _before(keys: list[tuple[bool, str | None]]):
    """A comparison of structs of k0.., o: nulls first when ascending and last when descending, unless told otherwise."""

    def compare(a: Column, b: Column) -> Column:
        sign = lambda x, y: F.when(x < y, -1).when(x > y, 1)
        out = F.coalesce(sign(a["o"], b["o"]), F.lit(0))
        for k in reversed(range(len(keys))):
            down, nulls = keys[k]
            x, y = a[f"k{k}"], b[f"k{k}"]
            first = -1 if (nulls or ("LAST" if down else "FIRST")) == "FIRST" else 1
            step = sign(y, x) if down else sign(x, y)
            out = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), first).when(y.isNull(), -first).otherwise(F.coalesce(step, out))
        return out

    return compare


def bind(b: B.Binder, node: tuple) -> tuple[Column, T.DataType | None]:
    _, name, args, options = node
    given = {o[0]: o[1:] for o in options}
    distinct = "distinct" in given
    if distinct and name not in _DISTINCT:
        raise InvalidArgument(f"{name} doesn't take DISTINCT")
    if name not in _ORDERED and set(given) - {"distinct"}:
        raise InvalidArgument(f"{name} doesn't take {', '.join(set(given) - {'distinct'})}")
    vs = [b.bind(a) for a in args]
    if b.tolerant:
        vs = [b.new(v.col if v.err is None else F.when(B.any_of(v.err), None).otherwise(v.col), v.type, None, v.const) for v in vs]
    if name == "COUNT" and not vs:
        return F.count(F.lit(1)), B.INT
    low, high = {"STRING_AGG": (1, 2), "HLL_COUNT.INIT": (1, 2), "CORR": (2, 2), "COVAR_POP": (2, 2), "COVAR_SAMP": (2, 2)}.get(name, (1, 1))
    if not low <= len(vs) <= high:
        raise InvalidArgument(f"{name} takes {low} to {high} arguments")
    v, ord_ = vs[0], F.col("_ord")
    kind, x = v.type, v.strict()
    if name in _ORDERED:
        return _ordered(b, name, vs, given, distinct)
    match name:
        case "COUNT":
            x = F.map_entries(x) if isinstance(kind, T.MapType) else x
            return (F.count_distinct(x) if distinct else F.count(x)), B.INT
        case "COUNTIF":
            flag = b.boolean(v)
            return (F.count_distinct(F.when(x, True)) if distinct else F.count_if(flag.strict())), B.INT
        case "SUM" | "AVG":
            _numeric(v, name)
            x = x.cast("double") if B.is_float(kind) else x.cast("long")
            if name == "SUM":
                return (F.sum_distinct(x) if distinct else F.sum(x)), (B.FLOAT if B.is_float(kind) else B.INT)
            return (F.sum_distinct(x) / F.nullif(F.count_distinct(x), F.lit(0)) if distinct else F.avg(x)), B.FLOAT
        case "MIN" | "MAX":
            if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
                raise InvalidArgument(f"{name} needs an ordered type")
            f = F.min if name == "MIN" else F.max
            if B.is_float(kind):
                return F.when(F.bool_or(F.isnan(x)), float("nan")).otherwise(f(F.when(~F.isnan(x), x))), kind
            return f(x), kind
        case "ANY_VALUE":
            return F.min_by(x, F.when(x.isNotNull(), ord_)), kind
        case "LOGICAL_AND" | "LOGICAL_OR":
            flag = b.boolean(v).strict()
            return (F.bool_and(flag) if name == "LOGICAL_AND" else F.bool_or(flag)), B.BOOL
        case "BIT_AND" | "BIT_OR" | "BIT_XOR":
            x = B.assign(v, B.INT).strict()
            if distinct and name == "BIT_XOR":
                return F.when(F.count(x) > 0, F.aggregate(F.collect_set(x), F.lit(0).cast("long"), lambda s, e: s.bitwiseXOR(e))), B.INT
            return {"BIT_AND": F.bit_and, "BIT_OR": F.bit_or, "BIT_XOR": F.bit_xor}[name](x), B.INT
        case "APPROX_COUNT_DISTINCT":
            return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(_hashable(x, kind), F.lit(14))), F.lit(0).cast("long")), B.INT
        case "HLL_COUNT.INIT":
            precision = 15 if len(vs) == 1 else vs[1].const if vs[1].literal else None
            if not isinstance(precision, int) or not 10 <= precision <= 24:
                raise InvalidArgument("a precision is a constant from 10 to 24")
            if not isinstance(kind, (T.LongType, T.StringType, T.BinaryType)):
                raise InvalidArgument("sketches take INT64, STRING or BYTES")
            if precision > _MAX_PRECISION:
                raise Unimplemented(f"sketches of a precision above {_MAX_PRECISION}")
            return F.when(F.count(x) > 0, sketches.sketch(x, kind, precision)), B.BYTES
        case "HLL_COUNT.MERGE" | "HLL_COUNT.MERGE_PARTIAL":
            x = B.assign(v, B.BYTES).strict()
            if name == "HLL_COUNT.MERGE":
                return F.when(F.count(x) > 0, sketches.merged_count(x)).otherwise(F.lit(0).cast("long")), B.INT
            return F.when(F.count(x) > 0, sketches.merge(x)), B.BYTES
        case "CORR":
            return S.corr(_numeric(v, name).strict(), _numeric(vs[1], name).strict()), B.FLOAT
        case "COVAR_POP" | "COVAR_SAMP":
            y = _numeric(vs[1], name).strict()
            return getattr(F, name.lower())(x.cast("double"), y.cast("double")), B.FLOAT
    _numeric(v, name)
    return {"STDDEV": F.stddev_samp, "STDDEV_SAMP": F.stddev_samp, "STDDEV_POP": F.stddev_pop, "VARIANCE": F.var_samp, "VAR_SAMP": F.var_samp, "VAR_POP": F.var_pop}[name](x.cast("double")), B.FLOAT


def _hashable(x: Column, kind: T.DataType) -> Column:
    return x if isinstance(kind, (T.LongType, T.StringType, T.BinaryType)) else x.cast("string")


def _ordered(b: B.Binder, name: str, vs: list[B.Value], given: dict, distinct: bool) -> tuple[Column, T.DataType | None]:
    """Rows are gathered as structs, so that null elements stay; sorted, cut, then told apart and stripped of nulls."""
    v = vs[0]
    x, kind = v.strict(), v.type
    if (name == "ARRAY_CONCAT_AGG") != isinstance(kind, T.ArrayType):
        raise InvalidArgument(f"{name} doesn't take {kind.simpleString()}")
    if name == "STRING_AGG" and not B.is_text(kind) and not isinstance(kind, T.NullType):
        raise InvalidArgument("STRING_AGG takes STRING or BYTES")
    order = given.get("order", ((),))[0]
    keys = [b.bind(o[0]) for o in order]
    marked = name == "STRING_AGG" and len(vs) > 1 and not vs[1].literal
    if marked and distinct:
        raise Unimplemented("DISTINCT texts with a delimiter of each row")
    mark_of = [vs[1].strict().alias("d")] if marked else []
    rows = F.collect_list(F.struct(*[k.strict().alias(f"k{i}") for i, k in enumerate(keys)], F.col("_ord").alias("o"), x.alias("x"), *mark_of))
    found = F.array_sort(rows, _before([(o[1], o[2]) for o in order]))
    if "limit" in given:
        n = b.bind(given["limit"][0])
        if not n.literal or not isinstance(n.const, int) or n.const < 0:
            raise InvalidArgument("LIMIT needs a constant that isn't negative")
        found = F.slice(found, 1, n.const)
    if marked:
        # The delimiter is that of the first text taken, and one without a delimiter isn't taken first.
        found = F.filter(found, lambda e: e["x"].isNotNull())
        first = F.array_position(F.transform(found, lambda e: e["d"].isNotNull()), True)
        found = F.when(first > 0, F.slice(found, F.greatest(first, F.lit(1)).cast("int"), F.greatest(F.array_size(found), F.lit(1)))).otherwise(F.slice(found, 1, 0))
        latin = (lambda c: B.latin(c)) if isinstance(kind, T.BinaryType) else (lambda c: c)
        text = F.array_join(F.transform(found, lambda e: latin(e["x"])), "\0")
        text = F.replace(text, F.lit("\0"), latin(F.get(found, F.lit(0))["d"]))
        return F.when(F.array_size(found) > 0, F.encode(text, "ISO-8859-1") if isinstance(kind, T.BinaryType) else text), kind
    found = F.transform(found, lambda e: e["x"])
    skips = name != "ARRAY_AGG" or distinct or given.get("nulls") == ("IGNORE",)
    if skips:
        found = F.filter(found, lambda e: e.isNotNull())
    if distinct:
        found = F.array_distinct(found)
    if name == "STRING_AGG":
        binary = isinstance(kind, T.BinaryType)
        mark = vs[1].const if len(vs) > 1 and vs[1].literal else "," if len(vs) == 1 else None
        if mark is None:
            raise InvalidArgument("the delimiter must be a constant")
        mark = mark.decode("latin-1") if isinstance(mark, bytes) else mark
        text = F.array_join(F.transform(found, lambda e: B.latin(e)) if binary else found, mark)
        return F.when(F.array_size(found) > 0, F.encode(text, "ISO-8859-1") if binary else text), kind
    out = F.flatten(found) if name == "ARRAY_CONCAT_AGG" else found
    return F.when(F.array_size(found) > 0, out), (kind if name == "ARRAY_CONCAT_AGG" else T.ArrayType(kind))
