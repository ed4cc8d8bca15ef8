"""SELECT over cells: sources, the derivation of key ranges, grouping, and the order of rows.

Every relation carries ``_ord``, by which its rows are in the order of the source's keys.  Only the families and qualifiers that a
query names are gathered, in one shuffle by key unless a whole family is wanted.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideleaf.dialect import aggregates, parser
from wideleaf.dialect import binder as B
from wideleaf.dialect.parser import Query, Source
from wideleaf.errors import InvalidArgument, NotFound, Unimplemented
from wideleaf.functions import keys
from wideleaf.operators import ranges as R
from wideleaf.operators import temporal
from wideleaf.sources import cells as C

_MAX_VIEWS = 8
_MAP_KEY = B.BYTES


@dataclass(frozen=True)
class Table:
    """Cells, families in order of creation with their kinds (``bytes``, ``int64`` or ``hll``), and the fields of the key: names with
    ``STRING``, ``BYTES`` or ``INT64`` (big-endian), between literal delimiters; or, if ``ordered``, in the order-preserving code."""

    cells: DataFrame
    families: dict[str, str]
    key_fields: tuple[tuple[str, str], ...] = ()
    delimiter: bytes = b"#"
    ordered: bool = False


@dataclass
class Catalog:
    """Tables of cells, relations in key order (materialised views, with a ``_key``), and texts of logical views."""

    tables: dict[str, Table] = field(default_factory=dict)
    relations: dict[str, DataFrame] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    keyed: set[str] = field(default_factory=set)  # relations in which _key is a column to be seen


@dataclass
class _Relation:
    frame: DataFrame
    columns: list[tuple[str, B.Value]]
    row: str | None = None
    known: dict = field(default_factory=dict)
    hidden: dict = field(default_factory=dict)
    history: bool = False

    def scope(self) -> dict[str, B.Value]:
        out: dict[str, B.Value] = {}
        for name, v in self.columns:
            if name in out:
                v = B.Value(F.lit(None), B.NULL, F.lit(True))
            out[name] = v
        return out | self.hidden


def run(spark: SparkSession, catalog: Catalog, sql: str, params: dict | None = None, *, ordered: bool = True) -> DataFrame:
    """The result of a query.  ``ordered=False`` leaves out the sort by key that a query without ORDER BY and LIMIT would get;
    values of ``params`` may be (value, type name) pairs.  Unnamed columns are called ``_c`` and their place."""
    bound = {k.lower(): _param(v) for k, v in (params or {}).items()}
    query = parser.parse(sql)
    used = _params_of(query)
    if used ^ set(bound):
        raise InvalidArgument(f"parameters don't match: {', '.join(sorted(used ^ set(bound)))}")
    rel = _Planner(spark, catalog, bound).relation(query)
    named = rel.frame
    if ordered and query.limit is None:
        named = named.orderBy("_ord")
    return named.select(*[v.col.alias(n or f"_c{i}") for i, (n, v) in enumerate(rel.columns)])


def _param(v) -> B.Value:
    v, kind = v if isinstance(v, tuple) else (v, None)
    made = B.constant(v)
    if kind is None and (v is None or made._type is None):
        raise InvalidArgument("a parameter needs a type")
    return made if kind is None else B.Value(F.lit(bytearray(v) if isinstance(v, bytes) else v).cast(B.spark_type((kind.upper(),))), B.spark_type((kind.upper(),)), const=v)


def _walk(x):
    """All trees in a query or tree."""
    if isinstance(x, (Query, Source)):
        for f in x.__dataclass_fields__:
            yield from _walk(getattr(x, f))
    elif isinstance(x, tuple):
        yield x
        for y in x:
            yield from _walk(y)


def _params_of(q: Query) -> set[str]:
    return {x[1] for x in _walk(q) if len(x) == 2 and x[0] == "param"}


class _Planner:
    def __init__(self, spark: SparkSession, catalog: Catalog, params: dict, depth: int = 0, *, tolerant: bool = False):
        self.spark, self.catalog, self.params, self.depth, self.tolerant = spark, catalog, params, depth, tolerant

    # sources ------------------------------------------------------------------------------------------------------------------

    def source(self, q: Query) -> _Relation:
        s = q.source
        if s is None:
            return _Relation(self.spark.range(1).select(F.lit(bytearray()).alias("_ord")), [])
        if s.kind == "query":
            return replace(self.relation(s.query), row=s.alias)
        if s.kind == "unpack":
            return self.unpack(s)
        for names, make in ((self.catalog.tables, self.table), (self.catalog.relations, self.stored), (self.catalog.views, self.view)):
            if s.name in names:
                return make(names[s.name], q)
        raise NotFound(f"no table {s.name}")

    def stored(self, df: DataFrame, q: Query) -> _Relation:
        if q.source.args:
            raise InvalidArgument("a view takes no arguments")
        narrowed = df.where(R.predicate(self.key_ranges(q), "_key")) if q.where else df
        frame = narrowed.select(F.col("_key").alias("_ord"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
        named = [(c, B.Value(F.col(f"c{i}"), frame=frame)) for i, c in enumerate(df.columns)]
        return _Relation(frame, [(n, v) for n, v in named if n != "_key" or q.source.name in self.catalog.keyed], q.source.alias or q.source.name, hidden={n: v for n, v in named if n == "_key"})

    def view(self, sql: str, q: Query) -> _Relation:
        if q.source.args:
            raise InvalidArgument("a view takes no arguments")
        if self.depth >= _MAX_VIEWS:
            raise InvalidArgument("views are nested too deeply")
        rel = _Planner(self.spark, self.catalog, {}, self.depth + 1).relation(parser.parse(sql))
        return replace(rel, row=q.source.alias or q.source.name)

    def arguments(self, s: Source) -> dict:
        out = {}
        b = B.Binder(self.spark.range(1), {}, self.params)
        for name, x in s.args:
            if name in out:
                raise InvalidArgument(f"{name} is given twice")
            v = b.bind(x)
            if name == "with_history":
                if not v.literal or not isinstance(v.const, bool):
                    raise InvalidArgument("with_history is TRUE or FALSE")
                out[name] = v.const
            elif name == "latest_n":
                if not v.literal or type(v.const) is not int or v.const < 1:
                    raise InvalidArgument("latest_n is at least 1")
                out[name] = v.const
            elif name in ("as_of", "after", "after_or_equal", "before"):
                t = B.assign(v, B.TIME)
                out[name] = self.spark.range(1).select(F.unix_micros(t.strict())).first()[0]
                if out[name] is None:
                    raise InvalidArgument(f"{name} can't be null")
            else:
                raise InvalidArgument(f"no table argument {name}")
        history = out.pop("with_history", False)
        if not history and set(out) - {"as_of"}:
            raise InvalidArgument(f"{', '.join(sorted(set(out) - {'as_of'}))} needs with_history => TRUE")
        return out | {"history": history}

    def table(self, t: Table, q: Query) -> _Relation:
        args, row = self.arguments(q.source), q.source.alias or q.source.name
        history = args.pop("history")
        cells = t.cells.where(F.col("family").isin(list(t.families)))
        if q.where is not None:
            cells = cells.where(R.predicate(self.key_ranges(q)))
        cells = temporal.visible(cells, **args)
        whole, single = _needs(q, t, row, history)
        frame = self.histories(cells, t, whole) if history else self.newest(cells, t, whole, single)
        entry = T.StructType([T.StructField("timestamp", B.TIME), T.StructField("value", B.BYTES)])
        columns = [("_key", B.Value(F.col("_ord"), B.BYTES))]
        parts = F.split(F.decode(F.col("_ord"), "ISO-8859-1"), "\\Q" + t.delimiter.decode("latin-1") + "\\E", -1)
        for i, (name, kind) in enumerate(t.key_fields):
            columns.append((name, _ordered_field(t, i, kind) if t.ordered else _key_field(parts, i, kind, len(t.key_fields))))
        for i, (name, kind) in enumerate(t.families.items()):
            value = B.INT if kind == "int64" else B.BYTES
            inner = T.ArrayType(T.StructType([entry[0], T.StructField("value", value)])) if history else value
            columns.append((name, B.Value(F.col(f"f{i}"), T.MapType(_MAP_KEY, inner)) if name in whole else B.Value(F.lit(None), T.MapType(_MAP_KEY, inner))))
        known = {node: B.Value(F.col(f"q{i}"), B.INT if t.families[fam] == "int64" else B.BYTES) for i, ((fam, _), nodes) in enumerate(single.items()) for node in nodes}
        return _Relation(frame, columns, row, known, history=history)

    def newest(self, cells: DataFrame, t: Table, whole: list[str], single: dict) -> DataFrame:
        base = C.newest(cells) if whole else cells
        at, gathered = F.struct("ts", "seq"), []
        for i, (fam, qualifier) in enumerate(single):
            this = (F.col("family") == fam) & (F.col("qualifier") == F.lit(bytearray(qualifier)))
            gathered.append(_typed(F.max_by(F.when(this, F.col("value")), F.when(this, at)), t.families[fam]).alias(f"q{i}"))
        for i, (fam, kind) in enumerate(t.families.items()):
            if fam in whole:
                entry = F.struct(F.col("qualifier").alias("key"), _typed(F.col("value"), kind).alias("value"))
                gathered.append(F.array_sort(F.collect_list(F.when(F.col("family") == fam, entry))).alias(f"f{i}"))
        rows = base.groupBy(F.col("row_key").alias("_ord")).agg(*gathered) if gathered else base.select(F.col("row_key").alias("_ord")).distinct()
        return _maps(rows, t, whole, single)

    def histories(self, cells: DataFrame, t: Table, whole: list[str]) -> DataFrame:
        settled = C.settle(cells)
        versions = F.sort_array(F.collect_list(F.struct("ts", "value")), asc=False)
        per = settled.groupBy("row_key", "family", "qualifier").agg(versions.alias("v"))
        gathered = []
        for i, (fam, kind) in enumerate(t.families.items()):
            if fam in whole:
                entry = F.struct(F.col("qualifier").alias("key"), F.transform("v", _stamped(kind)).alias("value"))
                gathered.append(F.array_sort(F.collect_list(F.when(F.col("family") == fam, entry))).alias(f"f{i}"))
        rows = per.groupBy(F.col("row_key").alias("_ord")).agg(*gathered) if gathered else per.select(F.col("row_key").alias("_ord")).distinct()
        return _maps(rows, t, whole, {})

    def unpack(self, s: Source) -> _Relation:
        inner = self.relation(s.query)
        if not inner.history:
            raise InvalidArgument("UNPACK needs a query of a table with with_history => TRUE")
        kinds = [_history_kind(v.type) for _, v in inner.columns]
        times = [F.flatten(F.transform(F.map_values(v.col), lambda h: F.transform(h, lambda e: e["timestamp"]))) if k == "map" else F.transform(v.col, lambda e: e["timestamp"]) for (_, v), k in zip(inner.columns, kinds) if k]
        none = F.array().cast("array<timestamp>")
        all_times = F.array_distinct(F.flatten(F.array(*[F.coalesce(x, none) for x in times]))) if times else none
        frame = inner.frame.withColumn("_t", F.explode(all_times))
        out, here = [], F.col("_t")
        held = lambda h: F.get(F.filter(h, lambda e: e["timestamp"] == here), F.lit(0))["value"]
        present = lambda h: F.exists(h, lambda e: e["timestamp"] == here)
        for i, ((_, v), k) in enumerate(zip(inner.columns, kinds)):
            if k == "map":
                kept = F.map_filter(v.col, lambda q, h: present(h))
                out.append(F.when(F.size(kept) > 0, F.transform_values(kept, lambda q, h: held(h))).alias(f"c{i}"))
            else:
                out.append((held(v.col) if k == "array" else v.col).alias(f"c{i}"))
        frame = frame.select(F.struct(F.col("_ord").alias("k"), (-F.unix_micros("_t")).alias("t")).alias("_ord"), *out, F.col("_t").alias(f"c{len(out)}"))
        columns = [(n, B.Value(F.col(f"c{i}"), frame=frame)) for i, n in enumerate([*(n for n, _ in inner.columns), "_timestamp"])]
        return _Relation(frame, columns, s.alias)

    # key ranges ---------------------------------------------------------------------------------------------------------------

    def key_ranges(self, q: Query) -> list[R.Range]:
        """Ranges outside of which no key can satisfy WHERE."""
        row = (q.source.alias or q.source.name).lower()

        def is_key(x) -> bool:
            return x == ("name", "_key") or (x[0] == "field" and x[2] == "_key" and x[1][0] == "name" and x[1][1].lower() == row)

        def const(x) -> bytes | None:
            if x[0] == "cast" and x[2] == ("BYTES",):
                return const(x[1])
            v = x[1] if x[0] == "lit" else self.params[x[1]].const if x[0] == "param" and x[1] in self.params else None
            return v.encode() if isinstance(v, str) else v if isinstance(v, bytes) else None

        def compare(symbol: str, k: bytes | None) -> list[R.Range]:
            if k is None:
                return R.EVERYTHING
            return {"=": [R.point(k)], "<": [(b"", k)], "<=": [(b"", R.successor(k))], ">": [(R.successor(k), None)], ">=": [(k, None)]}.get(symbol, R.EVERYTHING)

        def of(x) -> list[R.Range]:
            match x:
                case ("op", "AND", a, b):
                    return R.intersect(of(a), of(b))
                case ("op", "OR", a, b):
                    return R.normalise(of(a) + of(b))
                case ("op", ("=" | "<" | "<=" | ">" | ">=") as symbol, a, b):
                    if is_key(a):
                        return compare(symbol, const(b))
                    return compare({"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(symbol, symbol), const(a)) if is_key(b) else R.EVERYTHING
                case ("between", a, low, high) if is_key(a):
                    return R.intersect(compare(">=", const(low)), compare("<=", const(high)))
                case ("in", a, items) if is_key(a) and all(const(i) is not None for i in items):
                    return R.normalise([R.point(const(i)) for i in items])
                case ("call", "STARTS_WITH", (a, p), ()) if is_key(a) and const(p) is not None:
                    return [R.prefix(const(p))] if const(p) else R.EVERYTHING
                case ("like", a, p) if is_key(a) and const(p) is not None:
                    return _like_ranges(const(p))
            return R.EVERYTHING

        return of(q.where) if q.where is not None else R.EVERYTHING

    # SELECT -------------------------------------------------------------------------------------------------------------------

    def relation(self, q: Query) -> _Relation:
        src = self.source(q)
        scope = src.scope()
        if q.source is not None and src.row:
            q = _unqualified(q, src.row, scope)
            src.known = {_plain(k, src.row): v for k, v in src.known.items()}
        b = B.Binder(src.frame, scope, self.params, known=src.known, row=src.row, tolerant=self.tolerant)
        frame = src.frame
        if q.where is not None:
            if aggregates.find(q.where, []):
                raise InvalidArgument("WHERE doesn't take aggregates")
            kept = b.boolean(b.bind(q.where))
            frame = self.without_errors(frame, [kept]).where(kept.strict())
        items = self.items(q, src, b)
        calls = aggregates.find(tuple(x for x, _ in items), [])
        if q.having is not None:
            aggregates.find(q.having, calls)
        if q.having is not None and not (q.grouped or calls):
            raise InvalidArgument("HAVING needs groups")
        if q.grouped or calls:
            frame, b = self.grouped(q, items, calls, frame, b)
        outputs = [(name, b.bind(x)) for x, name in items]
        if q.having is not None:
            aliased = B.Binder(frame, {}, self.params, known=b.known, aliases={n: v for n, v in outputs if n})
            frame = frame.where(aliased.boolean(aliased.bind(q.having)).strict())
        self.check_order(q, outputs)
        frame = self.without_errors(frame, [v for _, v in outputs])
        done = frame.select("_ord", *[v.strict().alias(f"c{i}") for i, (_, v) in enumerate(outputs)])
        if q.distinct:
            for _, v in outputs:
                _groupable(v)
            done = done.groupBy(*[f"c{i}" for i in range(len(outputs))]).agg(F.min("_ord").alias("_ord"))
        if q.limit is not None:
            n, skip = self.count(q.limit), 0 if q.offset is None else self.count(q.offset)
            done = done.limit(0) if n == 0 else (done.orderBy("_ord").offset(skip) if skip else done.orderBy("_ord")).limit(n)
        return _Relation(done, [(n, B.Value(F.col(f"c{i}"), v.type)) for i, (n, v) in enumerate(outputs)], history=src.history)

    def without_errors(self, frame: DataFrame, vs: list[B.Value]) -> DataFrame:
        """In a view, the rows without errors."""
        err = B.any_of(*[v.err for v in vs])
        return frame if err is None or not self.tolerant else frame.where(~err)

    def items(self, q: Query, src: _Relation, b: B.Binder) -> list[tuple[tuple, str]]:
        out = []
        for x, alias in q.items:
            if x[0] != "star":
                out.append((x, alias or _name_of(x)))
                continue
            _, of, dropped, replaced = x
            if of is None or (of[0] == "name" and src.row and of[1].lower() == src.row.lower()):
                if q.source is None:
                    raise InvalidArgument("* needs FROM")
                names = [(n, ("name", n)) for n, _ in src.columns]
            else:
                v = b.bind(of)
                if not isinstance(v.type, T.StructType):
                    raise InvalidArgument("only structs have fields")
                names = [(f.name, ("field", of, f.name)) for f in v.type]
            low = {n.lower() for n, _ in names}
            swaps = {n.lower(): y for y, n in replaced}
            if missing := ({d.lower() for d in dropped} | set(swaps)) - low:
                raise InvalidArgument(f"* has no {', '.join(sorted(missing))}")
            out += [(swaps.get(n.lower(), node), n) for n, node in names if n.lower() not in {d.lower() for d in dropped}]
        if not out:
            raise InvalidArgument("no columns are left")
        return out

    def grouped(self, q: Query, items: list, calls: list, frame: DataFrame, b: B.Binder) -> tuple[DataFrame, B.Binder]:
        by_alias = {name.lower(): x for x, name in items if name}
        groups: list[tuple] = []
        for g in q.group:
            if g[0] == "lit" and type(g[1]) is int:
                if not 1 <= g[1] <= len(items):
                    raise InvalidArgument(f"no column {g[1]} to group by")
                g = items[g[1] - 1][0]
            elif g[0] == "name" and g[1].lower() in by_alias:
                g = by_alias[g[1].lower()]
            elif g[0] == "name" and g[1].lower().startswith("$col") and g[1][4:].isdigit() and 1 <= int(g[1][4:]) <= len(items):
                g = items[int(g[1][4:]) - 1][0]
            if aggregates.find(g, []):
                raise InvalidArgument("GROUP BY doesn't take aggregates")
            groups.append(g)
        keys = [b.bind(g) for g in groups]
        for k in keys:
            _groupable(k)
        frame = self.without_errors(frame, keys)
        known, measures = {}, [F.min("_ord").alias("_ord")]
        for i, (g, v) in enumerate(zip(groups, keys)):
            known[g] = B.Value(F.col(f"g{i}"), v.type)
        for i, c in enumerate(calls):
            col, kind = aggregates.bind(b, c)
            measures.append(col.alias(f"a{i}"))
            known[c] = B.Value(F.col(f"a{i}"), kind)
        by = [k.strict().alias(f"g{i}") for i, k in enumerate(keys)]
        done = frame.groupBy(*by).agg(*measures)
        for v in known.values():
            v._frame = done
        return done, B.Binder(done, {}, self.params, known=known)

    def check_order(self, q: Query, outputs: list) -> None:
        """ORDER BY takes only ``_key``, ascending: the order in which rows are anyway."""
        if not q.order:
            return
        if len(q.order) != 1 or q.order[0][0] != ("name", "_key") or q.order[0][1] or q.order[0][2]:
            raise InvalidArgument("ORDER BY takes _key ASC only")
        if (q.distinct or q.grouped) and "_key" not in [n for n, _ in outputs]:
            raise InvalidArgument("ORDER BY needs _key in the list of columns")

    def count(self, x: tuple) -> int:
        v = B.Binder(self.spark.range(1), {}, self.params).bind(x)
        if not v.literal or type(v.const) is not int or v.const < 0:
            raise InvalidArgument("LIMIT and OFFSET need constants that aren't negative")
        return v.const


def _stamped(kind: str):
    return lambda e: F.struct(F.timestamp_micros(e["ts"]).alias("timestamp"), _typed(e["value"], kind).alias("value"))


def _typed(value: Column, kind: str) -> Column:
    return F.when(F.octet_length(value) == 8, F.conv(F.hex(value), 16, -10).cast("long")) if kind == "int64" else value


def _maps(rows: DataFrame, t: Table, whole: list[str], single: dict) -> DataFrame:
    maps = [F.when(F.size(f"f{i}") > 0, F.map_from_entries(f"f{i}")).alias(f"f{i}") for i, fam in enumerate(t.families) if fam in whole]
    return rows.select("_ord", *[f"q{i}" for i in range(len(single))], *maps)


def _key_field(parts: Column, i: int, kind: str, n: int) -> B.Value:
    """A field of the key; in error where the key has other fields than the schema."""
    part, bad = F.encode(F.get(parts, F.lit(i)), "ISO-8859-1"), F.array_size(parts) != n
    if kind == "BYTES":
        return B.Value(part, B.BYTES, bad)
    if kind == "INT64":
        bad = bad | (F.octet_length(part) != 8)
        return B.Value(_typed(part, "int64"), B.INT, bad)
    if kind != "STRING":
        raise Unimplemented(f"key fields of {kind}")
    text = part.cast("string")
    return B.Value(F.when(F.is_valid_utf8(text), text), B.STRING, bad | ~F.is_valid_utf8(text))


def _ordered_field(t: Table, i: int, kind: str) -> B.Value:
    fields = keys.decoder([k for _, k in t.key_fields])(F.col("_ord"))
    v = F.timestamp_micros(fields[f"f{i}"]) if kind == "TIMESTAMP" else fields[f"f{i}"]
    return B.Value(v, B.spark_type((kind,)), ~fields["ok"])


def _history_kind(t: T.DataType) -> str | None:
    def is_history(a) -> bool:
        return isinstance(a, T.ArrayType) and isinstance(a.elementType, T.StructType) and a.elementType.names == ["timestamp", "value"]

    return "map" if isinstance(t, T.MapType) and is_history(t.valueType) else "array" if is_history(t) else None


def _groupable(v: B.Value) -> None:
    if isinstance(v.type, (T.ArrayType, T.StructType)):
        raise InvalidArgument(f"{v.type.simpleString()} can't be grouped")


def _name_of(x: tuple) -> str:
    return x[1] if x[0] == "name" else x[2] if x[0] == "field" else ""


def _like_ranges(pattern: bytes) -> list[R.Range]:
    fixed, i = bytearray(), 0
    while i < len(pattern) and pattern[i : i + 1] not in (b"%", b"_"):
        i += pattern[i : i + 1] == b"\\"
        fixed += pattern[i : i + 1]
        i += 1
    if i >= len(pattern):
        return [R.point(bytes(fixed))]
    return [R.prefix(bytes(fixed))] if fixed else R.EVERYTHING


def _plain(x, row: str, scope: dict | None = None):
    """A tree without the row's name before columns, and columns spelled as the source does."""
    if not isinstance(x, tuple):
        return x
    if len(x) == 3 and x[0] == "field" and x[1] == ("name", row):
        return _plain(("name", x[2]), row, scope)
    if len(x) == 2 and x[0] == "name" and scope and x[1] not in scope:
        near = [k for k in scope if k.lower() == x[1].lower()]
        return ("name", near[0]) if len(near) == 1 else x
    return tuple(_plain(y, row, scope) for y in x)


def _unqualified(q: Query, row: str, scope: dict) -> Query:
    fix = lambda x: _plain(_lower_row(x, row), row, scope)
    return replace(q, items=tuple((fix(x), a) for x, a in q.items), where=fix(q.where), group=fix(q.group), having=fix(q.having), order=fix(q.order))


def _lower_row(x, row: str):
    """The row's name as it is spelled in FROM."""
    if not isinstance(x, tuple):
        return x
    if len(x) == 3 and x[0] == "field" and x[1][0] == "name" and x[1][1].lower() == row.lower():
        return "field", ("name", row), x[2]
    return tuple(_lower_row(y, row) for y in x)


def _needs(q: Query, t: Table, row: str, history: bool) -> tuple[list[str], dict]:
    """Families wanted whole, and (family, qualifier) pairs wanted alone with the trees that name them."""
    whole: set[str] = set()
    single: dict[tuple[str, bytes], list] = {}
    names = {f.lower(): f for f in t.families}

    def family(x) -> str | None:
        if x[:1] == ("name",) and len(x) == 2:
            return names.get(x[1].lower())
        if x[:1] == ("field",) and x[1][0] == "name" and x[1][1].lower() == row.lower():
            return names.get(x[2].lower())
        return None

    def visit(x) -> None:
        if not isinstance(x, tuple) or not x:
            return
        if x[0] == "star":
            whole.update(t.families if x[1] is None or (x[1][0] == "name" and x[1][1].lower() == row.lower()) else ())
        if x[0] == "at" and len(x) == 4 and not history and family(x[1]) and x[2] in ("", "SAFE_KEY") and x[3][0] == "lit" and isinstance(x[3][1], (str, bytes)):
            qualifier = x[3][1].encode() if isinstance(x[3][1], str) else x[3][1]
            fam = family(x[1])
            single.setdefault((fam, qualifier), []).append(("at", ("name", fam), x[2], x[3]))
            return
        if isinstance(x[0], str) and x[0] in ("name", "field") and family(x):
            whole.add(family(x))
            return
        for y in x:
            visit(y)

    for part in (tuple(x for x, _ in q.items), q.where, q.group, q.having):
        visit(part)
    return sorted(whole), single
