"""Expressions as columns.  Each becomes a value that never raises and a condition under which it is in error; errors are raised
where a value leaves the query, so that SAFE, IFERROR and lazy branches can absorb them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideleaf.errors import InvalidArgument, Unimplemented

_NONE = object()
STRING, BYTES, INT, FLOAT, BOOL, TIME, DATE, NULL = T.StringType(), T.BinaryType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(), T.DateType(), T.NullType()
# Type names and their aliases.
TYPES = {"BOOL": BOOL, "BOOLEAN": BOOL, "STRING": STRING, "BYTES": BYTES, "TIMESTAMP": TIME, "DATE": DATE, "FLOAT64": FLOAT, "FLOAT32": T.FloatType(), **dict.fromkeys(("INT64", "INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT", "BYTEINT"), INT)}


class Value:
    """A column, its type (asked of Spark when needed), the condition of its error, and its constant if it is a literal."""

    __slots__ = ("col", "err", "const", "_type", "_frame")

    def __init__(self, col: Column, type: T.DataType | None = None, err: Column | None = None, const=_NONE, frame: DataFrame | None = None):
        self.col, self._type, self.err, self.const, self._frame = col, type, err, const, frame

    @property
    def type(self) -> T.DataType:
        if self._type is None:
            self._type = self._frame.select(self.col.alias("x")).schema[0].dataType
            narrow = isinstance(self._type, (T.IntegerType, T.ShortType, T.ByteType))
            if narrow or isinstance(self._type, T.DecimalType):
                self._type = INT if narrow else FLOAT
                self.col = self.col.cast(self._type)
        return self._type

    @property
    def literal(self) -> bool:
        return self.const is not _NONE

    def strict(self) -> Column:
        """The value, raising its errors."""
        self.type
        return self.col if self.err is None else F.when(self.err, F.raise_error(F.lit("evaluation failed"))).otherwise(self.col)


def constant(v, type: T.DataType | None = None) -> Value:
    if type is None:
        type = NULL if v is None else {bool: BOOL, int: INT, float: FLOAT, str: STRING, bytes: BYTES}.get(v.__class__)
    col = F.lit(bytearray(v)) if isinstance(v, bytes) else F.lit(v)
    return Value(col if type is None or type in (NULL, BYTES) else col.cast(type), type if type is not None else None, const=v)


def any_of(*conditions: Column | None) -> Column | None:
    found = [F.coalesce(c, F.lit(False)) for c in conditions if c is not None]
    return reduce(lambda a, b: a | b, found) if found else None


def unless_null(result: Column, *args: Column) -> Column:
    """The error of a function that gives null for failure."""
    return reduce(lambda a, b: a & b, [a.isNotNull() for a in args]) & result.isNull()


def not_finite(result: Column, *args: Column) -> Column:
    """The error of arithmetic on finite numbers that gives none."""
    odd = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    return odd(result) & ~reduce(lambda a, b: a | b, [odd(a) for a in args])


def is_text(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.BinaryType))


def is_float(t: T.DataType) -> bool:
    return isinstance(t, (T.DoubleType, T.FloatType))


def is_number(t: T.DataType) -> bool:
    return is_float(t) or isinstance(t, T.LongType)


def latin(x: Column) -> Column:
    return F.decode(x, "ISO-8859-1")


def spark_type(t: tuple) -> T.DataType:
    if t[0] == "ARRAY":
        if t[1][0] == "ARRAY":
            raise InvalidArgument("arrays of arrays aren't allowed")
        return T.ArrayType(spark_type(t[1]))
    if t[0] == "STRUCT":
        return T.StructType([T.StructField(n or f"_{k}", spark_type(f)) for k, (n, f) in enumerate(t[1])])
    if t[0] not in TYPES:
        raise InvalidArgument(f"no type {t[0]}")
    return TYPES[t[0]]


# -- casts ---------------------------------------------------------------------------------------------------------------------


def _float_text(x: Column) -> Column:
    """Shortest digits; no point for whole numbers; exponents below 1e-4 and from 1e15 (two digits at least, with a sign)."""
    size, short = F.abs(x), x.cast("string")
    digits, exponent = F.split_part(short, F.lit("E"), F.lit(1)), F.split_part(short, F.lit("E"), F.lit(2)).try_cast("int")
    power = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    plain = F.regexp_replace(x.try_cast("decimal(38,20)").cast("string"), r"\.?0+$", "")
    whole = F.when(size < 1e15, x.try_cast("long").cast("string"))
    named = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.coalesce(named, F.when(F.floor(x) == x, whole), F.when((size >= 1e-4) & (size < 1e15), plain), F.concat(F.regexp_replace(digits, r"\.0$", ""), F.lit("e"), power))


def time_text(x: Column) -> Column:
    """In UTC, with three or six digits of the second if there are any."""
    fraction = F.pmod(F.unix_micros(x), F.lit(1000000))
    part = F.when(fraction == 0, "").when(F.pmod(fraction, F.lit(1000)) == 0, F.date_format(x, ".SSS")).otherwise(F.date_format(x, ".SSSSSS"))
    return F.concat(F.date_format(x, "yyyy-MM-dd HH:mm:ss"), part, F.lit("+00"))


def cast(v: Value, to: T.DataType) -> tuple[Column, Column | None]:
    """The cast value and the condition of the cast's own error."""
    x, t = v.col, v.type
    if t == to:
        return x, None
    if isinstance(t, T.NullType):
        return x.cast(to), None
    if isinstance(to, T.MapType) or isinstance(t, T.MapType):
        raise InvalidArgument("maps can't be cast")
    tried = x.try_cast(to)
    failed = unless_null(tried, x)
    match to:
        case T.LongType() if isinstance(t, T.BooleanType):
            return x.cast("long"), None
        case T.LongType() if is_float(t):
            tried = F.round(x.cast("double")).try_cast("long")
            tried = F.when(F.abs(x) >= 2.0**63, F.when(x == -(2.0**63), F.lit(-(2**63)))).when(F.isnan(x), None).otherwise(tried)
            return tried, unless_null(tried, x)
        case T.LongType() if isinstance(t, T.StringType):
            bare = F.trim(x)
            hexed = F.regexp_extract(bare, r"^([+-]?)0[xX]([0-9a-fA-F]{1,16})$", 2)
            sign = F.when(bare.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
            tried = F.when(hexed != "", F.conv(hexed, 16, 10).try_cast("long") * sign).when(bare.rlike(r"^[+-]?\d+$"), bare.try_cast("long"))
            return tried, unless_null(tried, x)
        case T.DoubleType() | T.FloatType() if is_number(t) or isinstance(t, T.StringType):
            if isinstance(t, T.StringType):
                return tried, failed
            small = isinstance(to, T.FloatType) and isinstance(t, T.DoubleType)
            return x.cast(to), (not_finite(x.cast("float").cast("double"), x) if small else None)
        case T.BooleanType() if isinstance(t, T.StringType):
            tried = F.when(F.lower(x) == "true", True).when(F.lower(x) == "false", False)
            return tried, unless_null(tried, x)
        case T.BooleanType() if isinstance(t, T.LongType):
            return x != 0, None
        case T.StringType() if isinstance(t, T.BinaryType):
            ok = F.is_valid_utf8(x.cast("string"))
            return F.when(ok, x.cast("string")), ~ok
        case T.StringType() if is_float(t):
            return _float_text(x.cast("double") if isinstance(t, T.DoubleType) else x.cast("string").cast("double")), None
        case T.StringType() if isinstance(t, T.TimestampType):
            return time_text(x), None
        case T.StringType() if isinstance(t, (T.LongType, T.BooleanType, T.DateType)):
            return x.cast("string"), None
        case T.BinaryType() if isinstance(t, T.StringType):
            return x.cast("binary"), None
        case T.DateType() | T.TimestampType() if isinstance(t, (T.StringType, T.DateType, T.TimestampType)):
            if isinstance(t, T.StringType):
                shaped = x.rlike(r"^\s*\d{1,4}-\d{1,2}-\d{1,2}" + (r"\s*$" if isinstance(to, T.DateType) else ""))
                tried = F.when(shaped, F.regexp_replace(F.trim(x), r"([+-]\d\d)$", "$1:00").try_cast(to) if isinstance(to, T.TimestampType) else tried)
                return tried, unless_null(tried, x)
            return x.cast(to), None
        case T.ArrayType() if isinstance(t, T.ArrayType):
            inner = lambda e: cast(Value(e, t.elementType), to.elementType)
            return F.transform(x, lambda e: inner(e)[0]), F.exists(x, lambda e: any_of(inner(e)[1]) if inner(e)[1] is not None else F.lit(False))
        case T.StructType() if isinstance(t, T.StructType) and len(t) == len(to):
            parts = [cast(Value(x[a.name], a.dataType), b.dataType) for a, b in zip(t, to)]
            return F.when(x.isNotNull(), F.struct(*[c.alias(b.name) for (c, _), b in zip(parts, to)])), any_of(*[e for _, e in parts])
    raise InvalidArgument(f"no cast from {t.simpleString()} to {to.simpleString()}")


def assignable(v: Value, to: T.DataType) -> bool:
    """Whether a value turns into the type without being asked to."""
    t = v.type
    if isinstance(t, T.NullType) or t == to or (isinstance(t, T.LongType) and is_float(to)) or (isinstance(t, T.FloatType) and isinstance(to, T.DoubleType)):
        return True
    if isinstance(t, T.StringType):
        return isinstance(to, T.BinaryType) or (v.literal and isinstance(to, (T.DateType, T.TimestampType)))
    if isinstance(t, T.DateType) and isinstance(to, T.TimestampType):
        return True
    if isinstance(t, T.ArrayType) and isinstance(to, T.ArrayType):
        return isinstance(t.elementType, T.NullType) or assignable(Value(v.col, t.elementType), to.elementType)
    if isinstance(t, T.StructType) and isinstance(to, T.StructType) and len(t) == len(to):
        return all(assignable(Value(v.col, a.dataType), b.dataType) for a, b in zip(t, to))
    return False


def assign(v: Value, to: T.DataType) -> Value:
    if not assignable(v, to):
        raise InvalidArgument(f"expected {to.simpleString()}, found {v.type.simpleString()}")
    if v.type == to:
        return v
    col, err = cast(v, to)
    const = v.const.encode() if v.literal and isinstance(v.const, str) and isinstance(to, T.BinaryType) else v.const
    return Value(col, to, any_of(v.err, err), const)


def common(*vs: Value) -> tuple[T.DataType, list[Value]]:
    """The one type that all of them turn into."""
    kinds = [v.type for v in vs if not isinstance(v.type, T.NullType)] or [NULL]
    floats = [FLOAT] if any(is_float(k) for k in kinds) else []
    for k in [*floats, BYTES, TIME, *kinds]:
        if (k in kinds or k in floats) and all(assignable(v, k) for v in vs):
            return k, [assign(v, k) for v in vs]
    raise InvalidArgument("no common type of " + ", ".join(k.simpleString() for k in kinds))


# -- operators -----------------------------------------------------------------------------------------------------------------


def equal(a: Value, b: Value) -> Column:
    if isinstance(a.type, T.ArrayType):
        raise InvalidArgument("arrays can't be compared")
    if isinstance(a.type, T.MapType):
        return F.array_sort(F.map_entries(a.col)) == F.array_sort(F.map_entries(b.col))
    same = a.col == b.col
    return same & ~F.isnan(a.col) if is_float(a.type) else same


def _order(symbol: str, a: Value, b: Value) -> Column:
    if isinstance(a.type, (T.StructType, T.ArrayType, T.MapType)):
        raise InvalidArgument(f"{a.type.simpleString()} has no order")
    out = {"<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[symbol]
    return out & ~F.isnan(a.col) & ~F.isnan(b.col) if is_float(a.type) else out


def compare(symbol: str, a: Value, b: Value) -> Column:
    _, (a, b) = common(a, b)
    if symbol in ("=", "!="):
        return equal(a, b) if symbol == "=" else ~equal(a, b)
    return _order(symbol, a, b)


_TRY = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}


def arithmetic(symbol: str, a: Value, b: Value) -> tuple[Column, Column, T.DataType]:
    for v in (a, b):
        if not is_number(v.type) and not isinstance(v.type, T.NullType):
            raise InvalidArgument(f"{symbol} needs numbers, found {v.type.simpleString()}")
    if symbol != "/" and not is_float(a.type) and not is_float(b.type):
        x, y = a.col.cast("long"), b.col.cast("long")
        out = _TRY[symbol](x, y)
        return out, unless_null(out, x, y), INT
    x, y = a.col.cast("double"), b.col.cast("double")
    if symbol == "/":
        out = F.try_divide(x, y)
        return out, unless_null(out, x, y) | not_finite(out, x, y), FLOAT
    out = {"+": x + y, "-": x - y, "*": x * y}[symbol]
    return out, not_finite(out, x, y), FLOAT


def concat(a: Value, b: Value) -> tuple[Column, T.DataType]:
    kind, (a, b) = common(a, b)
    if not is_text(kind) and not isinstance(kind, (T.ArrayType, T.NullType)):
        raise InvalidArgument("|| needs texts, bytes or arrays")
    return F.concat(a.col, b.col), kind


_INDEX_MODES = {"OFFSET": (0, False), "SAFE_OFFSET": (0, True), "ORDINAL": (1, False), "SAFE_ORDINAL": (1, True), "": (0, False)}


def subscript(x: Value, mode: str, index: Value) -> tuple[Column, Column | None, T.DataType]:
    if isinstance(x.type, T.MapType):
        key = assign(index, x.type.keyType)
        out = F.try_element_at(x.col, key.col)
        missing = ~F.map_contains_key(x.col, key.col) if mode == "KEY" else None
        if mode not in ("", "KEY", "SAFE_KEY"):
            raise InvalidArgument(f"{mode} isn't for maps")
        return out, missing, x.type.valueType
    if not isinstance(x.type, T.ArrayType) or mode not in _INDEX_MODES:
        raise InvalidArgument(f"{x.type.simpleString()} has no such subscript")
    base, safe = _INDEX_MODES[mode]
    at = assign(index, INT).col - base
    inside = (at >= 0) & (at < F.array_size(x.col))
    return F.get(x.col, F.when(inside, at).cast("int")), (None if safe else ~inside), x.type.elementType


def like_pattern(pattern: str) -> str:
    """A regular expression of a LIKE pattern."""
    out, escaped = [], False
    for c in pattern:
        if escaped or c not in "%_\\":
            out.append("\\" + c if c in r"\.[]{}()*+-?^$|&" else c)
            escaped = False
        elif c == "\\":
            escaped = True
        else:
            out.append(".*" if c == "%" else ".")
    if escaped:
        raise InvalidArgument("a LIKE pattern ends in a backslash")
    return "(?s)^" + "".join(out) + r"\z"


class Binder:
    """Binds trees over a frame.  ``columns`` are the names in scope; ``known`` maps whole trees to values (groups, aggregates)."""

    def __init__(self, frame: DataFrame, columns: dict[str, Value], params: dict[str, Value], *, known: dict | None = None, aliases: dict | None = None, row: str | None = None, tolerant: bool = False):
        self.frame, self.columns, self.params = frame, columns, params
        self.known, self.aliases, self.row, self.tolerant = known or {}, aliases or {}, row, tolerant

    def new(self, col: Column, type: T.DataType | None = None, err: Column | None = None, const=_NONE) -> Value:
        return Value(col, type, err, const, self.frame)

    def boolean(self, v: Value) -> Value:
        if not isinstance(v.type, (T.BooleanType, T.NullType)):
            raise InvalidArgument(f"expected BOOL, found {v.type.simpleString()}")
        return assign(v, BOOL)

    def bind(self, x: tuple) -> Value:
        if x in self.known:
            return self.known[x]
        return getattr(self, "_" + x[0])(*x[1:])

    def _lit(self, value, kind=None) -> Value:
        if isinstance(value, int) and not isinstance(value, bool) and not -(2**63) <= value < 2**63:
            raise InvalidArgument("an integer literal is out of range")
        return constant(value)

    def _param(self, name: str) -> Value:
        if name not in self.params:
            raise InvalidArgument(f"parameter @{name} isn't bound")
        return self.params[name]

    def lookup(self, name: str) -> Value | None:
        for scope in (self.aliases, self.columns):
            if name in scope:
                return scope[name]
            near = [v for k, v in scope.items() if k.lower() == name.lower()]
            if len(near) > 1:
                raise InvalidArgument(f"{name} is ambiguous")
            if near:
                return near[0]
        return None

    def _name(self, name: str) -> Value:
        found = self.lookup(name)
        if found is None and self.row and name.lower() == self.row.lower():
            raise Unimplemented("a row as a value")
        if found is None:
            raise InvalidArgument(f"no column {name} here" + (": it is neither grouped nor aggregated" if self.known else ""))
        return found

    def _field(self, x: tuple, name: str) -> Value:
        if x[0] == "name" and self.row and x[1].lower() == self.row.lower() and self.lookup(x[1]) is None:
            return self.bind(("name", name))
        v = self.bind(x)
        if not isinstance(v.type, T.StructType):
            raise InvalidArgument(f"{v.type.simpleString()} has no fields")
        found = [f for f in v.type if f.name == name] or [f for f in v.type if f.name.lower() == name.lower()]
        if len(found) != 1:
            raise InvalidArgument(f"{'no' if not found else 'more than one'} field {name}")
        return self.new(v.col.getField(found[0].name), found[0].dataType, v.err)

    def _at(self, x: tuple, mode: str, index: tuple) -> Value:
        v, i = self.bind(x), self.bind(index)
        col, own, kind = subscript(v, mode, i)
        return self.new(col, kind, any_of(v.err, i.err, own))

    def _op(self, symbol: str, *operands: tuple) -> Value:
        if symbol in ("+", "-") and operands[-1][0] == "interval":
            from wideleaf.dialect import functions

            return functions.shift(self, self.bind(operands[0]), operands[1], 1 if symbol == "+" else -1)
        vs = [self.bind(x) for x in operands]
        errs = [v.err for v in vs]
        if symbol in ("AND", "OR"):
            a, b = (self.boolean(v) for v in vs)
            stop = F.lit(symbol == "OR")
            late = None if b.err is None else b.err & ~F.coalesce(a.col == stop, F.lit(False))
            return self.new(a.col & b.col if symbol == "AND" else a.col | b.col, BOOL, any_of(a.err, late))
        if symbol == "NOT":
            return self.new(~self.boolean(vs[0]).col, BOOL, errs[0])
        if symbol == "DISTINCT":
            _, (a, b) = common(*vs)
            return self.new(~a.col.eqNullSafe(b.col), BOOL, any_of(*errs))
        if symbol in ("=", "!=", "<", "<=", ">", ">="):
            return self.new(compare(symbol, *vs), BOOL, any_of(*errs))
        if symbol == "||":
            col, kind = concat(*vs)
            return self.new(col, kind, any_of(*errs))
        if symbol in ("+", "-") and any(isinstance(v.type, (T.DateType, T.TimestampType)) for v in vs):
            a, b = vs
            if symbol == "+" and isinstance(a.type, T.LongType):
                a, b = b, a
            if not isinstance(a.type, T.DateType) or not isinstance(b.type, T.LongType):
                raise Unimplemented("differences of times")
            days = b.col.cast("int")
            return self.new(F.date_add(a.col, days) if symbol == "+" else F.date_sub(a.col, days), DATE, any_of(*errs))
        if symbol in ("+", "-", "*", "/"):
            col, own, kind = arithmetic(symbol, *vs)
            return self.new(col, kind, any_of(*errs, own))
        from wideleaf.dialect import functions

        return functions.operator(self, symbol, vs)

    def _is(self, x: tuple, what: str) -> Value:
        v = self.bind(x)
        if what == "NULL":
            return self.new(v.col.isNull(), BOOL, v.err)
        b = self.boolean(v).col
        return self.new(b.isNull() if what == "UNKNOWN" else b.eqNullSafe(F.lit(what == "TRUE")), BOOL, v.err)

    def _in(self, x: tuple, items: tuple) -> Value:
        vs = [self.bind(y) for y in (x, *items)]
        kind, vs = common(*vs)
        plain = not is_float(kind) and not isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
        col = vs[0].col.isin([v.col for v in vs[1:]]) if plain else reduce(lambda a, b: a | b, [equal(vs[0], v) for v in vs[1:]])
        return self.new(col, BOOL, any_of(*[v.err for v in vs]))

    def _in_unnest(self, x: tuple, array: tuple) -> Value:
        v, a = self.bind(x), self.bind(array)
        if not isinstance(a.type, T.ArrayType):
            raise InvalidArgument("UNNEST needs an array")
        w = assign(v, a.type.elementType)
        empty = a.col.isNull() | (F.array_size(a.col) == 0)
        return self.new(F.when(empty, F.lit(False)).otherwise(F.exists(a.col, lambda e: equal(Value(e, w.type), w))), BOOL, any_of(v.err, a.err))

    def _like(self, x: tuple, pattern: tuple) -> Value:
        kind, (v, p) = common(self.bind(x), self.bind(pattern))
        if not is_text(kind) and not isinstance(kind, T.NullType):
            raise InvalidArgument("LIKE needs texts or bytes")
        binary = isinstance(kind, T.BinaryType)
        text = latin(v.col) if binary else v.col
        if p.literal and p.const is not None:
            shape = p.const.decode("latin-1") if binary else p.const
            return self.new(text.rlike(like_pattern(shape)), BOOL, any_of(v.err, p.err))
        shape = latin(p.col) if binary else p.col
        broken = F.length(F.regexp_extract(shape, r"(\\*)$", 1)) % 2 == 1
        quoted = F.call_function("like", text, F.when(broken, F.lit("")).otherwise(F.regexp_replace(shape, r"\\([^%_\\])", "$1")))
        return self.new(quoted, BOOL, any_of(v.err, p.err, broken))

    def _between(self, x: tuple, low: tuple, high: tuple) -> Value:
        _, (v, a, b) = common(self.bind(x), self.bind(low), self.bind(high))
        return self.new(_order(">=", v, a) & _order("<=", v, b), BOOL, any_of(v.err, a.err, b.err))

    def _case(self, operand: tuple | None, branches: tuple, otherwise: tuple | None) -> Value:
        o = self.bind(operand) if operand else None
        conditions = []
        for c, _ in branches:
            v = self.bind(c)
            conditions.append(self.boolean(v) if o is None else self.new(compare("=", o, v), BOOL, v.err))
        last = self.bind(otherwise) if otherwise else constant(None)
        return self.choose(conditions, [*(self.bind(y) for _, y in branches), last], o.err if o else None)

    def choose(self, conditions: list[Value], results: list[Value], err: Column | None = None) -> Value:
        """The result of the first true condition, else the last; only what is reached can be in error."""
        kind, results = common(*results)
        col, late = results[-1].col, results[-1].err
        for c, r in zip(reversed(conditions), reversed(results[:-1])):
            col = F.when(c.col, r.col).otherwise(col)
            if late is not None or r.err is not None:
                late = F.when(c.col, any_of(r.err) if r.err is not None else F.lit(False)).otherwise(any_of(late) if late is not None else F.lit(False))
            late = any_of(c.err, late)
        return self.new(col, kind, any_of(err, late))

    def _cast(self, x: tuple, kind: tuple, safe: bool) -> Value:
        v = self.bind(x)
        to = spark_type(kind)
        col, own = cast(v, to)
        if safe:
            return self.new(col if own is None else F.when(any_of(own), None).otherwise(col), to, v.err)
        return self.new(col, to, any_of(v.err, own), v.const if v.type == to else _NONE)

    def _array(self, kind: tuple | None, items: tuple) -> Value:
        vs = [self.bind(x) for x in items]
        if kind:
            to = spark_type(kind).elementType
            vs = [assign(v, to) for v in vs]
        else:
            to, vs = common(*vs) if vs else (NULL, [])
        if isinstance(to, T.ArrayType):
            raise InvalidArgument("arrays of arrays aren't allowed")
        out = T.ArrayType(to)
        return self.new(F.array(*[v.col for v in vs]) if isinstance(to, T.NullType) else F.array(*[v.col for v in vs]).cast(out), out, any_of(*[v.err for v in vs]))

    def _struct(self, kind: tuple | None, items: tuple) -> Value:
        vs = [self.bind(x) for x, _ in items]
        if kind:
            to = spark_type(kind)
            if len(to) != len(vs):
                raise InvalidArgument("a STRUCT needs a value for each field")
            vs, names = [assign(v, f.dataType) for v, f in zip(vs, to)], [f.name for f in to]
        else:
            names = [n or (x[1] if x[0] == "name" else x[2] if x[0] == "field" else f"_{k}") for k, (x, n) in enumerate(items)]
        [v.type for v in vs]
        return self.new(F.struct(*[v.col.alias(n) for v, n in zip(vs, names)]), None, any_of(*[v.err for v in vs]))

    def _interval(self, x: tuple, unit: str) -> Value:
        raise InvalidArgument("an INTERVAL isn't a value")

    def _star(self, *_) -> Value:
        raise InvalidArgument("* isn't an expression")

    def _extract(self, part: str, x: tuple, zone: tuple | None) -> Value:
        from wideleaf.dialect import functions

        return functions.extract(self, part, x, zone)

    def _safe(self, call: tuple) -> Value:
        from wideleaf.dialect import functions

        return functions.call(self, call, safe=True)

    def _call(self, name: str, args: tuple, options: tuple) -> Value:
        from wideleaf.dialect import functions

        return functions.call(self, ("call", name, args, options))

