"""The registry of scalar functions.  A function gives a column, or a column and the condition of its own error; results are never
raised here.  Signatures are strings of codes: S text, B bytes, X text or bytes, I integer, F float, N number, Z BOOL, D date,
T timestamp, A array, M map, * anything; a trailing + repeats the last."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideleaf.dialect import binder as B
from wideleaf.dialect.binder import BOOL, BYTES, DATE, FLOAT, INT, STRING, TIME, Value
from wideleaf.errors import InvalidArgument, Unimplemented
from wideleaf.functions import codecs, patterns, sketches
from wideleaf.functions import scalars as S

_PLAIN: dict = {}
_SPECIAL: dict = {}
_CODES = {"S": STRING, "B": BYTES, "I": INT, "F": FLOAT, "Z": BOOL, "D": DATE, "T": TIME}
_KINDS = {"A": T.ArrayType, "M": T.MapType, "N": (T.LongType, T.DoubleType, T.FloatType), "X": (T.StringType, T.BinaryType)}
_LIMIT = 64 << 20


def names() -> list[str]:
    return sorted(_PLAIN.keys() | _SPECIAL.keys())


def fn(names: str, *signatures: str):
    """Registers a function under names, with the signatures it takes, the first fitting one first."""

    def register(f):
        for n in names.split():
            _PLAIN[n] = (signatures, f)
        return f

    return register


def special(names: str):
    def register(f):
        for n in names.split():
            _SPECIAL[n] = f
        return f

    return register


def _match(signature: str, vs: list[Value]) -> list[Value] | None:
    codes = signature.rstrip("+")
    if signature.endswith("+") and len(vs) > len(codes):
        codes += codes[-1] * (len(vs) - len(codes))
    if len(codes) != len(vs):
        return None
    out = []
    for c, v in zip(codes, vs):
        if c in _CODES:
            if not B.assignable(v, _CODES[c]):
                return None
            v = B.assign(v, _CODES[c])
        elif c != "*" and not isinstance(v.type, (T.NullType,)) and not isinstance(v.type, _KINDS[c]):
            return None
        elif c == "X" and isinstance(v.type, T.NullType):
            v = B.assign(v, STRING)
        out.append(v)
    texts = [k for k, c in enumerate(codes) if c == "X"]
    if any(isinstance(out[k].type, T.BinaryType) for k in texts):
        for k in texts:
            out[k] = B.assign(out[k], BYTES)
    return out


def call(b: B.Binder, node: tuple, safe: bool = False) -> Value:
    _, name, args, options = node
    if options or name in AGGREGATES:
        raise InvalidArgument(f"{name} isn't allowed here")
    if name in _SPECIAL:
        v = _SPECIAL[name](b, *args)
        if safe and v.err is not None:
            return b.new(F.when(B.any_of(v.err), None).otherwise(v.col), v.type)
        return v
    if name not in _PLAIN:
        raise InvalidArgument(f"no function {name}")
    vs = [b.bind(a) for a in args]
    signatures, f = _PLAIN[name]
    for s in signatures:
        found = _match(s, vs)
        if found is None:
            continue
        out = f(*found)
        col, own = out if isinstance(out, tuple) else (out, None)
        if safe and own is not None:
            col, own = F.when(B.any_of(own), None).otherwise(col), None
        return b.new(col, None, B.any_of(own, *[v.err for v in vs]))
    raise InvalidArgument(f"{name} doesn't take ({', '.join(v.type.simpleString() for v in vs)})")


# Aggregate functions.
AGGREGATES = frozenset("ANY_VALUE APPROX_COUNT_DISTINCT ARRAY_AGG ARRAY_CONCAT_AGG AVG BIT_AND BIT_OR BIT_XOR CORR COUNT COUNTIF COVAR_POP COVAR_SAMP HLL_COUNT.INIT HLL_COUNT.MERGE HLL_COUNT.MERGE_PARTIAL LOGICAL_AND LOGICAL_OR MAX MIN STDDEV STDDEV_POP STDDEV_SAMP STRING_AGG SUM VARIANCE VAR_POP VAR_SAMP".split())


def _need(v: Value, what: str):
    if not v.literal or v.const is None:
        raise Unimplemented(f"{what} must be a constant")
    return v.const


def bytewise(f, back: bool = True):
    """A function of texts, for bytes as well: as texts of one character a byte."""

    def both(*vs: Value):
        binary = isinstance(vs[0].type, T.BinaryType)
        cs = [B.latin(v.col) if isinstance(v.type, T.BinaryType) else v.col for v in vs]
        out = f(*cs)
        col, err = out if isinstance(out, tuple) else (out, None)
        return (F.encode(col, "ISO-8859-1") if binary and back else col), err

    return both


def cols(f):
    return lambda *vs: f(*[v.col for v in vs])


# -- texts ---------------------------------------------------------------------------------------------------------------------

fn("CONCAT", "X+")(cols(F.concat))
fn("LENGTH", "X")(cols(F.length))
fn("CHAR_LENGTH CHARACTER_LENGTH", "S")(cols(F.length))
fn("BYTE_LENGTH OCTET_LENGTH", "X")(cols(F.octet_length))


def _ascii_case(x: Column, up: bool) -> Column:
    small, large = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(x, small if up else large, large if up else small)


def _case(up: bool):
    def f(v: Value):
        if isinstance(v.type, T.BinaryType):
            return F.encode(_ascii_case(B.latin(v.col), up), "ISO-8859-1")
        return F.upper(v.col) if up else F.lower(v.col)

    return f


fn("LOWER", "X")(_case(False))
fn("UPPER", "X")(_case(True))


def _substr(x, p, n=None):
    size = F.length(x)
    start = F.when(p > 0, F.least(p, size + 1)).when(p == 0, 1).otherwise(F.greatest(size + p + 1, F.lit(1)))
    length = size if n is None else F.least(F.greatest(n, F.lit(0)), size)
    return F.substring(x, start.cast("int"), length.cast("int")), (None if n is None else n < 0)


fn("SUBSTR SUBSTRING", "XI", "XII")(bytewise(_substr))
fn("STARTS_WITH", "XX")(cols(F.startswith))
fn("ENDS_WITH", "XX")(cols(F.endswith))
fn("STRPOS", "XX")(bytewise(lambda x, y: F.call_function("instr", x, y), back=False))
fn("INSTR", "XX", "XXI", "XXII")(bytewise(lambda x, y, p=None, n=None: F.call_function("instr", x, y) if p is None else (codecs.instr(x, y, p, F.lit(1) if n is None else n), (p == 0) | (F.lit(False) if n is None else n <= 0)), back=False))
fn("LEFT", "XI")(bytewise(lambda x, n: (F.substring(x, F.lit(1), F.least(F.greatest(n, F.lit(0)), F.length(x)).cast("int")), n < 0)))
fn("RIGHT", "XI")(bytewise(lambda x, n: (F.substring(x, (F.greatest(F.length(x) - F.greatest(n, F.lit(0)), F.lit(0)) + 1).cast("int"), F.length(x)), n < 0)))
fn("REPLACE", "XXX")(bytewise(lambda x, a, c: F.when(a == "", F.when(c.isNotNull(), x)).otherwise(F.replace(x, a, c))))


def _repeat(x, n):
    bad = (n < 0) | (F.octet_length(x) * n > _LIMIT)
    return F.repeat(x, F.when(bad, 0).otherwise(n).cast("int")), bad


fn("REPEAT", "XI")(bytewise(_repeat))
fn("REVERSE", "X")(bytewise(F.reverse))


def _trim(side: str):
    strip = {"both": F.trim, "left": F.ltrim, "right": F.rtrim}[side]

    def f(v: Value, chars: Value | None = None):
        if chars is None:
            return S.trim(v.col, side)
        return bytewise(lambda x, c: F.when(c == "", x).otherwise(strip(x, c)))(v, chars)

    return f


for _name, _side in (("TRIM", "both"), ("LTRIM", "left"), ("RTRIM", "right")):
    fn(_name, "S", "XX")(_trim(_side))


def _pad(f):
    def g(x, n, p=None):
        p = F.lit(" ") if p is None else p
        bad = (n < 0) | (p == "") | (n > _LIMIT)
        return f(x, F.when(bad, 0).otherwise(n).cast("int"), p), bad

    return bytewise(g)


fn("LPAD", "XI", "XIX")(_pad(F.lpad))
fn("RPAD", "XI", "XIX")(_pad(F.rpad))


def _split(v: Value, d: Value | None = None):
    binary = isinstance(v.type, T.BinaryType)
    x = B.latin(v.col) if binary else v.col
    mark = F.lit(",") if d is None else B.latin(d.col) if binary else d.col
    quoted = F.concat(F.lit("\\Q"), F.replace(mark, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    units = F.when(x == "", F.array(F.lit(""))).otherwise(F.filter(F.split(x, ""), lambda c: c != ""))
    parts = F.when(mark == "", units).otherwise(F.split(x, quoted, -1))
    return F.transform(parts, lambda p: F.encode(p, "ISO-8859-1")) if binary else parts


fn("SPLIT", "S", "XX")(_split)
fn("ASCII", "X")(lambda v: F.ascii(B.latin(v.col)) if isinstance(v.type, T.BinaryType) else (F.ascii(v.col), F.ascii(v.col) > 127))
fn("UNICODE", "S")(cols(F.ascii))


def _char(n: Column) -> tuple[Column, Column]:
    bad = (n < 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    return S.char(F.when(bad, F.lit(0)).otherwise(n).cast("long")), bad


fn("CHR", "I")(cols(_char))
# What INITCAP takes for the end of a word.
_WORD_ENDS = " []()/|!?@<>\"^#$&~_,.:;*%+-\n\t\r\v\f\\{}='`"
fn("INITCAP", "S", "SS")(cols(lambda x, d=None: codecs.initcap(x, F.lit(_WORD_ENDS) if d is None else d)))


@fn("TRANSLATE", "XXX")
def _translate(x: Value, a: Value, c: Value):
    source = B.latin(a.col) if isinstance(a.type, T.BinaryType) else a.col
    units = F.split(source, "")
    return bytewise(lambda *ts: F.call_function("translate", *ts))(x, a, c)[0], F.array_size(F.array_distinct(units)) != F.array_size(units)


fn("SOUNDEX", "S")(cols(lambda x: F.when(F.regexp_replace(x, "[^A-Za-z]", "") == "", "").otherwise(F.soundex(F.regexp_replace(x, "[^A-Za-z]", "")))))


def _pattern(v: Value) -> str:
    p = _need(v, "a pattern")
    return patterns.translate(p.decode("latin-1") if isinstance(p, bytes) else p)[0]


def _groups(java: str) -> int:
    """The groups of a translated pattern, in which every other parenthesis is followed by a question mark or spelled as a number."""
    return len(re.findall(r"\((?!\?)", java))


def _one_group(p: str) -> int:
    n = _groups(p)
    if n > 1:
        raise InvalidArgument("a pattern of extraction has at most one group")
    return n


def _by_row(kind: str, v: Value, p: Value, *more: Value, back: bool = True, groups: int | None = None):
    """A function of a pattern that comes with the row; a bad pattern is an error of evaluation."""
    udf = codecs.regexp_by_row(kind)
    count = codecs.pattern_groups(B.latin(p.col) if isinstance(p.type, T.BinaryType) else p.col)
    return bytewise(lambda *xs: udf(*xs), back=back)(v, p, *more)[0], F.coalesce((count < 0) if groups is None else (count < 0) | (count > groups), F.lit(False))


@fn("REGEXP_CONTAINS", "XX")
def _regexp_contains(v: Value, p: Value):
    return _by_row("contains", v, p, back=False) if not p.literal else bytewise(lambda x: x.rlike(_pattern(p)), back=False)(v)


@fn("REGEXP_EXTRACT REGEXP_SUBSTR", "XX", "XXI", "XXII")
def _regexp_extract(v: Value, p: Value, at: Value | None = None, n: Value | None = None):
    if not p.literal and at is None:
        return _by_row("extract", v, p, groups=1)
    pattern = _pattern(p)
    group = _one_group(pattern)
    if at is None:
        return bytewise(lambda x: F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group)))(v)
    nth = F.lit(1) if n is None else n.col
    bad = (at.col < 1) | (nth < 1)
    udf = codecs.regexp_nth(pattern, "text")
    return bytewise(lambda x: udf(x, F.greatest(at.col, F.lit(1)), nth))(v)[0], bad


@fn("REGEXP_EXTRACT_ALL", "XX")
def _regexp_extract_all(v: Value, p: Value):
    binary = isinstance(v.type, T.BinaryType)
    back = lambda c: F.transform(c, lambda e: F.encode(e, "ISO-8859-1")) if binary else c
    if not p.literal:
        found, bad = _by_row("all", v, p, back=False, groups=1)
        return back(found), bad
    pattern = _pattern(p)
    return back(F.regexp_extract_all(B.latin(v.col) if binary else v.col, F.lit(pattern), _one_group(pattern)))


@fn("REGEXP_REPLACE", "XXX")
def _regexp_replace(v: Value, p: Value, r: Value):
    if not (p.literal and r.literal):
        # A backslash must name a group that there is, or stand for itself.
        plain = B.latin(r.col) if isinstance(r.type, T.BinaryType) else r.col
        count = codecs.pattern_groups(B.latin(p.col) if isinstance(p.type, T.BinaryType) else p.col)
        named = F.regexp_extract_all(F.regexp_replace(plain, r"\\\\", ""), F.lit(r"(?s)\\(.?)"), 1)
        wrong = F.array_max(F.transform(named, lambda x: F.when(x.rlike("^[0-9]$"), F.when(x.rlike("^[0-9]$"), x).cast("long")).otherwise(99))) > count
        made, bad = _by_row("replace", v, p, r)
        return made, bad | F.coalesce(wrong, F.lit(False))
    pattern, to = _pattern(p), _need(r, "a replacement")
    to = to.decode("latin-1") if isinstance(to, bytes) else to
    groups = _groups(pattern)
    for m in re.finditer(r"\\(.?)", re.sub(r"\\\\", "", to), re.S):
        if not m[1].isdigit() or int(m[1]) > groups:
            raise InvalidArgument("a bad escape in a replacement")
    java = re.sub(r"\\(\\|\d)|\$", lambda m: r"\$" if m[0] == "$" else r"\\" if m[1] == "\\" else "$" + m[1], to)
    return bytewise(lambda x: F.regexp_replace(x, pattern, java))(v)


@fn("REGEXP_INSTR", "XX", "XXI", "XXII", "XXIII")
def _regexp_instr(v: Value, p: Value, at: Value | None = None, n: Value | None = None, after: Value | None = None):
    pattern = _pattern(p)
    _one_group(pattern)
    last = _need(after, "the last argument") if after is not None else 0
    start, nth = F.lit(1) if at is None else at.col, F.lit(1) if n is None else n.col
    udf = codecs.regexp_nth(pattern, "end" if last else "start")
    return bytewise(lambda x: udf(x, F.greatest(start, F.lit(1)), nth), back=False)(v)[0], (start < 1) | (nth < 1)


fn("TO_HEX", "B")(cols(lambda x: F.lower(F.hex(x))))
fn("FROM_HEX", "S")(cols(lambda x: (F.unhex(F.when(x.rlike("^[0-9a-fA-F]*$"), x)), ~x.rlike("^[0-9a-fA-F]*$"))))
fn("TO_BASE64", "B")(cols(lambda x: F.regexp_replace(F.base64(x), "\\s", "")))


@fn("FROM_BASE64", "S")
def _from_base64(v: Value):
    bare = F.regexp_replace(v.col, r"\s|=+$", "")
    fits = bare.rlike(r"^[A-Za-z0-9+/]*$") & (F.length(bare) % 4 != 1)
    return F.unbase64(F.when(fits, F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), F.lit("=")))), ~fits


def _fails(f):
    def g(*vs: Value):
        out = f(*[v.col for v in vs])
        return out, B.unless_null(out, *[v.col for v in vs])

    return g


fn("TO_BASE32", "B")(cols(codecs.to_base32))
fn("FROM_BASE32", "S")(_fails(codecs.from_base32))
fn("SAFE_CONVERT_BYTES_TO_STRING", "B")(cols(lambda x: F.make_valid_utf8(x.cast("string"))))
fn("TO_CODE_POINTS", "X")(bytewise(lambda x: S.to_code_points(x), back=False))


def _points(top: int):
    def g(v: Value):
        a = v.col.cast("array<bigint>")
        bad = F.exists(a, lambda n: F.coalesce((n < 0) | (n > top) | (n.between(0xD800, 0xDFFF) if top > 255 else F.lit(False)), F.lit(False)))
        safe = F.transform(a, lambda n: F.when((n < 0) | (n > top), F.lit(0).cast("long")).otherwise(n))
        nul = F.decode(F.unhex(F.lit("00")), "UTF-8")
        text = F.array_join(F.transform(safe, lambda n: F.when(n == 0, nul).otherwise(_char(n)[0])), "")
        text = F.when(F.exists(a, lambda n: n.isNull()), None).otherwise(text)
        return (F.encode(text, "ISO-8859-1") if top == 255 else text), bad

    return g


fn("CODE_POINTS_TO_STRING", "A")(_points(0x10FFFF))
fn("CODE_POINTS_TO_BYTES", "A")(_points(255))
fn("TO_INT64", "B")(cols(lambda x: (F.conv(F.hex(F.when(F.octet_length(x) == 8, x)), 16, -10).cast("long"), F.octet_length(x) != 8)))
fn("TO_FLOAT64", "B")(_fails(codecs.float64))
fn("TO_FLOAT32", "B")(_fails(codecs.float32))
fn("TO_VECTOR32", "B")(_fails(codecs.vector32))
fn("TO_VECTOR64", "B")(_fails(codecs.vector64))


@fn("FORMAT", "S", "S*+")
def _format(f: Value, *args: Value):
    shape, parts, used, at = _need(f, "a format"), [], 0, 0
    for m in re.finditer(r"%([-+ #0']*)(\d*)(?:\.(\d+))?(.?)", shape, re.S):
        parts.append(F.lit(shape[at : m.start()]))
        at, kind = m.end(), m[4]
        if kind == "%":
            parts.append(F.lit("%"))
            continue
        if used >= len(args):
            raise InvalidArgument("FORMAT has too few arguments")
        v, used = args[used], used + 1
        spec = "%" + m[1].replace("'", ",") + m[2]
        if kind in "diuoxX" and kind:
            parts.append(F.call_function("format_string", F.lit(spec + ("d" if kind in "diu" else kind)), B.assign(v, INT).col))
        elif kind in "fFeE" and kind:
            parts.append(F.call_function("format_string", F.lit(f"{spec}.{m[3] or 6}{kind.replace('F', 'f')}"), B.assign(v, FLOAT).col))
        elif kind in "gG" and kind:
            text = B.cast(B.assign(v, FLOAT), STRING)[0]
            parts.append(F.call_function("format_string", F.lit("%" + m[2] + "s"), F.upper(text) if kind == "G" else text))
        elif kind in "stT" and kind:
            text = _quoted(v) if kind == "T" else B.assign(v, STRING).col if kind == "s" else _shown(v)
            parts.append(F.call_function("format_string", F.lit(("%-" if "-" in m[1] else "%") + m[2] + (f".{m[3]}" if m[3] else "") + "s"), text))
        else:
            raise InvalidArgument(f"FORMAT has no %{kind}")
    if used != len(args):
        raise InvalidArgument("FORMAT has too many arguments")
    return F.concat(*parts, F.lit(shape[at:]))


def _shown(v: Value) -> Column:
    text = v.col.cast("string") if isinstance(v.type, (T.BinaryType, T.ArrayType, T.StructType, T.MapType, T.NullType)) else B.cast(v, STRING)[0]
    return F.coalesce(text, F.lit("NULL"))


def _quoted(v: Value) -> Column:
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    head = {T.DateType: "DATE ", T.TimestampType: "TIMESTAMP ", T.StringType: ""}.get(type(v.type))
    if head is not None:
        return F.coalesce(F.concat(F.lit(head), quote(B.cast(v, STRING)[0])), F.lit("NULL"))
    if isinstance(v.type, T.BinaryType):
        return F.coalesce(F.concat(F.lit("b"), quote(B.latin(v.col))), F.lit("NULL"))
    whole = isinstance(v.type, T.DoubleType)
    return F.when(F.floor(v.col) == v.col, F.concat(_shown(v), F.lit(".0"))).otherwise(_shown(v)) if whole else _shown(v)


# -- numbers -------------------------------------------------------------------------------------------------------------------

fn("ABS", "I", "F")(cols(lambda x: (F.when(x.cast("string") != str(-(2**63)), F.abs(x)), x.cast("string") == str(-(2**63)))))
fn("SIGN", "I", "F")(lambda v: F.when(F.isnan(v.col), v.col).otherwise(F.signum(v.col)) if B.is_float(v.type) else F.signum(v.col).cast("long"))
fn("MOD", "II")(_fails(F.try_mod))


@fn("DIV", "II")
def _div(a: Value, b: Value):
    bad = (b.col == 0) | ((a.col == -(2**63)) & (b.col == -1))
    return F.call_function("div", F.when(bad, 0).otherwise(a.col), F.when(bad, 1).otherwise(b.col)), bad


@fn("ROUND", "F", "FI")
def _round(v: Value, d: Value | None = None):
    return codecs.rounded("ROUND_HALF_UP")(v.col, d.col) if d is not None and not d.literal else F.round(v.col, int(_need(d, "the digits")) if d is not None else 0)


@fn("TRUNC", "F", "FI")
def _trunc(v: Value, d: Value | None = None):
    return codecs.rounded("ROUND_DOWN")(v.col, d.col) if d is not None and not d.literal else S.trunc(v.col, int(_need(d, "the digits")) if d is not None else 0)


_whole = lambda f: cols(lambda x: F.when(F.abs(x) >= 2.0**53, x).when(F.isnan(x), x).otherwise(f(F.when(F.abs(x) < 2.0**53, x)).cast("double")))
fn("CEIL CEILING", "F")(_whole(F.ceil))
fn("FLOOR", "F")(_whole(F.floor))


def _math(f, domain=None):
    def g(*vs: Value):
        xs = [v.col for v in vs]
        out = f(*xs)
        bad = B.not_finite(out, *xs)
        return out, (bad if domain is None else B.any_of(domain(*xs), bad))

    return g


fn("SQRT", "F")(_math(F.sqrt, lambda x: x < 0))
fn("POW POWER", "FF")(_math(F.pow, lambda x, y: ((x == 0) & (y < 0)) | ((x < 0) & (y != F.floor(y)))))
fn("EXP", "F")(_math(F.exp))
fn("LN", "F")(_math(F.ln, lambda x: x <= 0))
fn("LOG10", "F")(_math(F.log10, lambda x: x <= 0))
fn("LOG", "F")(_math(F.ln, lambda x: x <= 0))
_PLAIN["LOG"] = (("F", "FF"), lambda v, base=None: (F.ln(v.col), v.col <= 0) if base is None else (F.try_divide(F.ln(v.col), F.ln(base.col)), (v.col <= 0) | (base.col <= 0) | (base.col == 1)))
fn("IEEE_DIVIDE", "FF")(cols(lambda a, b: F.when(a.isNull() | b.isNull(), None).when((b == 0) & ((a == 0) | F.isnan(a)), float("nan")).when(b == 0, F.when(a > 0, float("inf")).otherwise(float("-inf"))).otherwise(F.try_divide(a, b))))
fn("IS_INF", "F")(cols(lambda x: F.abs(x) == float("inf")))
fn("IS_NAN", "F")(cols(lambda x: F.when(x.isNotNull(), F.isnan(x))))


def _safe_arithmetic(symbol: str):
    def g(a: Value, b: Value):
        out, bad, _ = B.arithmetic(symbol, a, b)
        return F.when(bad, None).otherwise(out)

    return g


for _name, _symbol in (("SAFE_ADD", "+"), ("SAFE_SUBTRACT", "-"), ("SAFE_MULTIPLY", "*"), ("SAFE_DIVIDE", "/")):
    fn(_name, "NN")(_safe_arithmetic(_symbol))
fn("SAFE_NEGATE", "N")(lambda v: -v.col if B.is_float(v.type) else F.try_subtract(F.lit(0).cast("long"), v.col))
for _name in "acos asin cos sin tan atan cosh sinh tanh acosh asinh atanh cot csc sec".split():
    fn(_name.upper(), "F")(_math(getattr(F, _name)))
for _name, _base in (("COTH", F.tanh), ("CSCH", F.sinh), ("SECH", F.cosh)):
    fn(_name, "F")(_math(lambda x, f=_base: F.try_divide(F.lit(1.0), f(x)), (lambda x: x == 0) if _name != "SECH" else None))
fn("ATAN2", "FF")(cols(F.atan2))
fn("PI", "")(lambda: F.pi())
fn("RAND", "")(lambda: F.rand())


def _extreme(largest: bool):
    def g(*vs: Value):
        kind, vs = B.common(*vs)
        xs = [v.col for v in vs]
        out = xs[0] if len(xs) == 1 else (F.greatest if largest else F.least)(*xs)
        if B.is_float(kind):
            out = F.when(reduce(lambda a, b: a | b, [F.isnan(x) for x in xs]), float("nan")).otherwise(out)
        return F.when(reduce(lambda a, b: a | b, [x.isNull() for x in xs]), None).otherwise(out)

    return g


fn("GREATEST", "*+")(_extreme(True))
fn("LEAST", "*+")(_extreme(False))


def operator(b: B.Binder, symbol: str, vs: list[Value]) -> Value:
    """Signs, bits and shifts; bytes of equal lengths bit by bit through their hex digits."""
    errs = [v.err for v in vs]
    if symbol in ("u-", "u+"):
        v = vs[0]
        if not B.is_number(v.type):
            raise InvalidArgument("a sign needs a number")
        if symbol == "u+":
            return v
        out = -v.col if B.is_float(v.type) else F.try_subtract(F.lit(0).cast("long"), v.col)
        return b.new(out, v.type, B.any_of(*errs, None if B.is_float(v.type) else B.unless_null(out, v.col)))
    if isinstance(vs[0].type, T.BinaryType):
        return _byte_operator(b, symbol, vs)
    x = [B.assign(v, INT).col for v in vs]
    if symbol == "u~":
        return b.new(F.bitwise_not(x[0]), INT, errs[0])
    if symbol in ("<<", ">>"):
        shift = F.call_function("shiftleft" if symbol == "<<" else "shiftrightunsigned", x[0], F.pmod(x[1], F.lit(64)).cast("int"))
        return b.new(F.when(x[1] >= 64, F.lit(0).cast("long")).otherwise(shift), INT, B.any_of(*errs, x[1] < 0))
    return b.new({"&": x[0].bitwiseAND, "|": x[0].bitwiseOR, "^": x[0].bitwiseXOR}[symbol](x[1]), INT, B.any_of(*errs))


def _byte_operator(b: B.Binder, symbol: str, vs: list[Value]) -> Value:
    x, errs = vs[0].col, [v.err for v in vs]
    if symbol == "u~":
        return b.new(codecs.invert(x), BYTES, errs[0])
    if symbol in ("<<", ">>"):
        n = B.assign(vs[1], INT).col
        return b.new(codecs.shift_bytes(x, n if symbol == "<<" else F.try_subtract(F.lit(0).cast("long"), n)), BYTES, B.any_of(*errs, n < 0))
    y = B.assign(vs[1], BYTES).col
    return b.new(codecs.bits(symbol)(x, y), BYTES, B.any_of(*errs, F.octet_length(x) != F.octet_length(y)))


# -- arrays and maps -----------------------------------------------------------------------------------------------------------

fn("ARRAY_LENGTH", "A")(cols(F.array_size))
fn("ARRAY_CONCAT", "A+")(lambda *vs: F.concat(*[v.col for v in B.common(*vs)[1]]))
fn("ARRAY_REVERSE", "A")(cols(F.reverse))


@fn("ARRAY_TO_STRING", "AS", "ASS", "AB", "ABB")
def _array_to_string(a: Value, d: Value, n: Value | None = None):
    binary = isinstance(a.type.elementType, T.BinaryType)
    text = lambda v: B.latin(v.col) if isinstance(v.type, T.BinaryType) else v.col
    kept = F.filter(a.col, lambda e: e.isNotNull()) if n is None else a.col
    kept = F.transform(kept, lambda e: B.latin(e) if binary else e) if n is None else F.transform(kept, lambda e: F.coalesce(B.latin(e) if binary else e, text(n)))
    out = F.call_function("array_join", kept, text(d))
    return F.encode(out, "ISO-8859-1") if binary else out


fn("ARRAY_FIRST", "A")(cols(lambda a: (F.get(a, F.lit(0)), F.array_size(a) == 0)))
fn("ARRAY_LAST", "A")(cols(lambda a: (F.get(a, F.array_size(a) - 1), F.array_size(a) == 0)))


def _first_n(a, n):
    return F.slice(a, F.lit(1), F.greatest(F.least(n, F.array_size(a)), F.lit(0)).cast("int")), n < 0


def _last_n(a, n):
    size = F.greatest(F.least(n, F.array_size(a)), F.lit(0)).cast("int")
    return F.slice(a, F.array_size(a) - size + 1, size), n < 0


def _slice(a, low, high):
    size = F.array_size(a)
    end = lambda i: F.when(i < 0, size + i).otherwise(i)
    lo, hi = F.greatest(end(low), F.lit(0)), F.least(end(high), size - 1)
    return F.slice(a, F.when(lo <= hi, lo + 1).otherwise(1).cast("int"), F.greatest(hi - lo + 1, F.lit(0)).cast("int"))


fn("ARRAY_FIRST_N", "AI")(cols(_first_n))
fn("ARRAY_LAST_N", "AI")(cols(_last_n))
fn("ARRAY_SLICE", "AII")(cols(_slice))


def _sought(a: Value, v: Value) -> Value:
    return B.assign(v, a.type.elementType)


fn("ARRAY_INCLUDES", "A*")(lambda a, v: S.array_includes(a.col, _sought(a, v).col))


def _includes(every: bool):
    def g(a: Value, b: Value):
        b = B.assign(b, a.type)
        has = F.transform(b.col, lambda s: F.when(s.isNotNull(), F.exists(a.col, lambda e: F.coalesce(e == s, F.lit(False)))))
        first = lambda x: F.array_position(F.transform(has, lambda h: F.coalesce(h.cast("int"), F.lit(2))), F.lit(x))
        stop, null = first(0 if every else 1), first(2)
        early = (stop > 0) & ((null == 0) | (stop < null))
        return F.when(early, not every).when(null > 0, None).otherwise(F.when(a.col.isNotNull() & b.col.isNotNull(), every))

    return g


fn("ARRAY_INCLUDES_ALL", "AA")(_includes(True))
fn("ARRAY_INCLUDES_ANY", "AA")(_includes(False))
fn("ARRAY_IS_DISTINCT", "A")(cols(lambda a: F.array_size(F.array_distinct(a)) == F.array_size(a)))
fn("ARRAY_OFFSET", "A*")(lambda a, v: S.array_offset(a.col, _sought(a, v).col))
fn("ARRAY_OFFSETS", "A*")(lambda a, v: F.filter(F.transform(a.col, lambda e, i: F.when(e == _sought(a, v).col, i.cast("long"))), lambda i: i.isNotNull()))


@fn("GENERATE_ARRAY", "II", "III", "FF", "FFF")
def _generate(low: Value, high: Value, step: Value | None = None):
    a, z, s = low.col, high.col, F.lit(1).cast(low.type) if step is None else step.col
    count = F.floor(F.try_divide((z - a).cast("double"), s.cast("double")))
    bad = (s == 0) | (count >= 1_000_000)
    n = F.when(bad | (count < 0), F.lit(-1)).otherwise(count).cast("int")
    some = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: a + i.cast(low.type) * s)
    return F.when(n >= 0, some).when(n < 0, F.slice(some, 1, 0)), bad


fn("MAP_KEYS", "M")(cols(F.map_keys))
fn("MAP_VALUES", "M")(cols(F.map_values))
fn("MAP_ENTRIES", "M")(cols(F.map_entries))
fn("MAP_CONTAINS_KEY", "M*")(lambda m, k: F.map_contains_key(m.col, B.assign(k, m.type.keyType).col))
fn("MAP_EMPTY", "M")(cols(lambda m: F.when(m.isNotNull(), F.size(m) == 0)))


def _distance(f, zero: bool):
    def g(a: Value, b: Value):
        holes = lambda v: F.exists(v.col, lambda e: e.isNull())
        bad = (F.array_size(a.col) != F.array_size(b.col)) | holes(a) | holes(b)
        x, y = F.when(~bad, a.col), F.when(~bad, b.col)
        if not zero:
            return f(x, y), bad
        size = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
        empty = (size(x) == 0) | (size(y) == 0)
        return f(F.when(~empty, x), F.when(~empty, y)), B.any_of(bad, empty)

    return g


fn("EUCLIDEAN_DISTANCE", "AA")(_distance(S.euclidean, False))
fn("COSINE_DISTANCE", "AA")(_distance(S.cosine_distance, True))


# -- conditions, errors, JSON --------------------------------------------------------------------------------------------------


@special("IF")
def _if(b, c, x, y):
    return b.choose([b.boolean(b.bind(c))], [b.bind(x), b.bind(y)])


@special("COALESCE IFNULL")
def _coalesce(b, *xs):
    if not xs:
        raise InvalidArgument("COALESCE needs arguments")
    vs = [b.bind(x) for x in xs]
    return b.choose([b.new(v.col.isNotNull(), BOOL, v.err) for v in vs[:-1]], [b.new(v.col, v.type) for v in vs[:-1]] + [vs[-1]])


@special("NULLIF")
def _nullif(b, x, y):
    v, w = b.bind(x), b.bind(y)
    return b.new(F.when(B.compare("=", v, w), None).otherwise(v.col), v.type, B.any_of(v.err, w.err))


@special("IFERROR")
def _iferror(b, x, y):
    v, w = b.bind(x), b.bind(y)
    kind, (v, w) = B.common(v, w)
    if v.err is None:
        return v
    bad = B.any_of(v.err)
    return b.new(F.when(bad, w.col).otherwise(v.col), kind, None if w.err is None else bad & w.err)


@special("ISERROR")
def _iserror(b, x):
    v = b.bind(x)
    return b.new(F.lit(False) if v.err is None else B.any_of(v.err), BOOL)


@special("NULLIFERROR")
def _nulliferror(b, x):
    v = b.bind(x)
    return v if v.err is None else b.new(F.when(B.any_of(v.err), None).otherwise(v.col), v.type)


def _json(kind: str):
    def g(v: Value, path: Value | None = None):
        steps = codecs.json_path(_need(path, "a path") if path is not None else "$")
        if steps is None:
            raise InvalidArgument("a bad JSON path")
        return codecs.json_function(kind, steps)(v.col.cast("string"))

    return g


fn("JSON_VALUE JSON_EXTRACT_SCALAR", "X", "XS")(_json("scalar"))
fn("JSON_QUERY JSON_EXTRACT", "X", "XS")(_json("query"))
fn("JSON_QUERY_ARRAY JSON_EXTRACT_ARRAY", "X", "XS")(_json("array"))
fn("JSON_VALUE_ARRAY JSON_EXTRACT_STRING_ARRAY", "X", "XS")(_json("scalars"))


def _json_text(x: Column, t: T.DataType) -> Column:
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    match t:
        case T.StringType():
            text = F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
        case T.BinaryType():
            text = quote(F.regexp_replace(F.base64(x), r"\s", ""))
        case T.LongType():
            text = F.when(~x.between(-(2**53), 2**53), quote(x.cast("string"))).otherwise(x.cast("string"))
        case T.DoubleType() | T.FloatType():
            odd = F.when(F.isnan(x), '"NaN"').when(x == float("inf"), '"Infinity"').when(x == float("-inf"), '"-Infinity"')
            text = F.coalesce(odd, B.cast(Value(x, t), STRING)[0])
        case T.TimestampType():
            text = quote(F.replace(F.replace(B.time_text(x), F.lit("+00"), F.lit("Z")), F.lit(" "), F.lit("T")))
        case T.DateType():
            text = quote(x.cast("string"))
        case T.ArrayType():
            text = F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: _json_text(e, t.elementType)), ","), F.lit("]"))
        case T.StructType():
            parts = [F.concat(_json_text(F.lit(f.name), STRING), F.lit(":"), _json_text(x[f.name], f.dataType)) for f in t]
            text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
        case T.MapType():
            key = lambda k: _json_text(B.cast(Value(k, t.keyType), STRING)[0], STRING)
            entries = F.transform(F.map_entries(x), lambda e: F.concat(key(e["key"]), F.lit(":"), _json_text(e["value"], t.valueType)))
            text = F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))
        case _:
            text = x.cast("string")
    return F.when(x.isNull(), F.lit("null")).otherwise(text)


fn("TO_JSON_STRING", "*")(lambda v: _json_text(v.col, v.type))
fn("HLL_COUNT.EXTRACT", "B")(cols(lambda x: F.coalesce(sketches.count(x), F.lit(0).cast("long"))))


# -- times ---------------------------------------------------------------------------------------------------------------------

# Microseconds of units, and the days of a week from Sunday.
_MICROS = {"MICROSECOND": 1, "MILLISECOND": 1000, "SECOND": 10**6, "MINUTE": 60 * 10**6, "HOUR": 3600 * 10**6, "DAY": 86400 * 10**6}
_DAYS = ("SUNDAY", "MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY")
_MIN, _MAX = -62135596800000000, 253402300799999999  # years 1 to 9999


def _ranged(us: Column) -> tuple[Column, Column]:
    bad = (us < _MIN) | (us > _MAX)
    return F.timestamp_micros(F.when(~bad, us)), bad


def _scaled(k: int):
    def g(v: Value):
        us = F.try_multiply(v.col, F.lit(k).cast("long"))
        out, bad = _ranged(us)
        return out, B.any_of(bad, B.unless_null(us, v.col))

    return g


def _zoned(x: Column, zone: Column | None) -> Column:
    """The wall time in a zone, as if it were UTC."""
    return x if zone is None else F.convert_timezone(F.lit("UTC"), zone, x.cast("timestamp_ntz")).cast("timestamp")


def _unzoned(x: Column, zone: Column | None) -> Column:
    return x if zone is None else F.convert_timezone(zone, F.lit("UTC"), x.cast("timestamp_ntz")).cast("timestamp")


for _name, _k in (("MICROS", 1), ("MILLIS", 1000), ("SECONDS", 10**6)):
    fn(f"TIMESTAMP_{_name}", "I")(_scaled(_k))
    fn(f"TIMESTAMP_FROM_UNIX_{_name}", "I", "T")(lambda v, k=_k: v.col if isinstance(v.type, T.TimestampType) else _scaled(k)(v))
    fn(f"UNIX_{_name}", "T")(cols(lambda x, k=_k: F.call_function("div", F.unix_micros(x) - F.pmod(F.unix_micros(x), F.lit(k)), F.lit(k).cast("long"))))
fn("UNIX_DATE", "D")(cols(F.unix_date))
fn("DATE_FROM_UNIX_DATE", "I")(cols(lambda n: (F.date_from_unix_date(F.when(n.between(-719162, 2932896), n).cast("int")), ~n.between(-719162, 2932896))))
fn("CURRENT_TIMESTAMP", "")(lambda: F.current_timestamp())
fn("CURRENT_DATE", "", "S")(lambda z=None: _zoned(F.current_timestamp(), None if z is None else z.col).cast("date"))


@fn("TIMESTAMP", "S", "D", "T", "SS", "DS")
def _timestamp(v: Value, zone: Value | None = None):
    col, own = B.cast(v, TIME)
    return _unzoned(col, None if zone is None else zone.col), own


@fn("DATE", "III", "T", "D", "S", "TS")
def _date(v: Value, m: Value | None = None, d: Value | None = None):
    if d is not None:
        text = F.concat_ws("-", F.lpad(v.col.cast("string"), 4, "0"), F.lpad(m.col.cast("string"), 2, "0"), F.lpad(d.col.cast("string"), 2, "0"))
        ok = v.col.between(1, 9999) & m.col.between(1, 12) & d.col.between(1, 31)
        out = F.when(ok, text.try_cast("date"))
        return out, B.unless_null(out, v.col, m.col, d.col)
    return B.cast(Value(_zoned(v.col, None if m is None else m.col), v.type), DATE)


@fn("STRING", "T", "TS")
def _string(v: Value, zone: Value | None = None):
    if zone is None:
        return B.time_text(v.col)
    wall = _zoned(v.col, zone.col)
    minutes = F.call_function("div", F.unix_micros(wall) - F.unix_micros(v.col), F.lit(60 * 10**6).cast("long"))
    return F.concat(F.regexp_replace(B.time_text(wall), r"\+00$", ""), _offset(minutes, "short"))


def _offset(minutes: Column, style: str) -> Column:
    sign, size = F.when(minutes < 0, "-").otherwise("+"), F.abs(minutes)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours, rest = two(F.floor(size / 60)), F.pmod(size, F.lit(60))
    if style == "short":
        return F.concat(sign, hours, F.when(rest == 0, "").otherwise(F.concat(F.lit(":"), two(rest))))
    return F.concat(sign, hours, F.lit(":" if style == "colon" else ""), two(rest))


def _unit(node: tuple) -> str:
    """The name of a date part, given as an expression: ``MONTH`` or ``WEEK(MONDAY)``."""
    if node[0] == "name":
        return node[1].upper()
    if node[0] == "call" and len(node[2]) == 1 and node[2][0][0] == "name":
        return f"{node[1]}({node[2][0][1].upper()})"
    raise InvalidArgument("expected a date part")


def _week_first(unit: str) -> int | None:
    """The weekday on which the unit's week begins, from Sunday 0; None if the unit isn't a week."""
    if unit in ("WEEK", "ISOWEEK"):
        return int(unit == "ISOWEEK")
    m = re.fullmatch(r"WEEK\((\w+)\)", unit)
    if m and m[1] not in _DAYS:
        raise InvalidArgument(f"no weekday {m[1]}")
    return _DAYS.index(m[1]) if m else None


def _back_to(d: Column, first: int) -> Column:
    return F.date_sub(d, F.pmod(F.dayofweek(d) - 1 - first, F.lit(7)).cast("int"))


def _iso_start(year: Column) -> Column:
    return _back_to(F.make_date(year, F.lit(1), F.lit(4)), 1)


def _iso_year(d: Column) -> Column:
    return F.year(F.date_add(_back_to(d, 1), 3))


def _date_trunc(d: Column, unit: str) -> Column:
    first = _week_first(unit)
    if first is not None:
        return _back_to(d, first)
    if unit == "ISOYEAR":
        return _iso_start(_iso_year(d))
    if unit not in ("DAY", "MONTH", "QUARTER", "YEAR"):
        raise InvalidArgument(f"no date part {unit}")
    return d if unit == "DAY" else F.trunc(d, unit.lower())


@special("DATE_TRUNC TIMESTAMP_TRUNC")
def _trunc(b, x, part, zone=None):
    v, unit = b.bind(x), _unit(part)
    z = b.bind(zone) if zone else None
    if isinstance(v.type, T.DateType):
        return b.new(_date_trunc(v.col, unit), DATE, v.err)
    v = B.assign(v, TIME)
    wall = _zoned(v.col, z.col if z else None)
    out = F.date_trunc(unit.lower(), wall) if unit in _MICROS else _date_trunc(wall.cast("date"), unit).cast("timestamp")
    return b.new(_unzoned(out, z.col if z else None), TIME, v.err)


def _interval(b, node: tuple) -> tuple[Value, str]:
    if node[0] != "interval":
        raise InvalidArgument("expected an INTERVAL")
    return B.assign(b.bind(node[1]), INT), node[2]


def shift(b, v: Value, interval: tuple, sign: int) -> Value:
    n, unit = _interval(b, interval)
    by = n.col * sign
    if isinstance(v.type, T.DateType):
        months = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}.get(unit)
        days = {"DAY": 1, "WEEK": 7}.get(unit)
        if not months and not days:
            raise InvalidArgument(f"dates don't move by {unit}")
        far = F.abs(n.col) > (120_000 // (months or 1) if months else 3_700_000 // days)
        by = F.when(far, 0).otherwise(by).cast("int")
        out = F.add_months(v.col, by * months) if months else F.date_add(v.col, by * days)
        bad = far | (out < F.lit("0001-01-01").cast("date")) | (out > F.lit("9999-12-31").cast("date"))
        return b.new(F.when(bad, None).otherwise(out), DATE, B.any_of(v.err, n.err, bad))
    v = B.assign(v, TIME)
    if unit not in _MICROS:
        raise InvalidArgument(f"timestamps don't move by {unit}")
    us = F.try_add(F.unix_micros(v.col), F.try_multiply(by, F.lit(_MICROS[unit]).cast("long")))
    out, bad = _ranged(us)
    return b.new(out, TIME, B.any_of(v.err, n.err, bad, B.unless_null(us, v.col, n.col)))


@special("TIMESTAMP_ADD DATE_ADD")
def _add(b, x, interval):
    return shift(b, b.bind(x), interval, 1)


@special("TIMESTAMP_SUB DATE_SUB")
def _sub(b, x, interval):
    return shift(b, b.bind(x), interval, -1)


@special("TIMESTAMP_DIFF")
def _timestamp_diff(b, x, y, part):
    v, w, unit = B.assign(b.bind(x), TIME), B.assign(b.bind(y), TIME), _unit(part)
    if unit not in _MICROS:
        raise InvalidArgument(f"no unit {unit}")
    return b.new(F.call_function("div", F.unix_micros(v.col) - F.unix_micros(w.col), F.lit(_MICROS[unit]).cast("long")), INT, B.any_of(v.err, w.err))


@special("DATE_DIFF")
def _date_diff(b, x, y, part):
    v, w, unit = B.assign(b.bind(x), DATE), B.assign(b.bind(y), DATE), _unit(part)
    month = lambda d: F.year(d) * 12 + F.month(d) - 1
    whole = {"MONTH": month, "YEAR": F.year, "QUARTER": lambda d: F.year(d) * 4 + F.quarter(d), "ISOYEAR": _iso_year}.get(unit)
    first = _week_first(unit)
    if whole:
        out = whole(v.col) - whole(w.col)
    elif first is not None:
        out = F.call_function("div", F.datediff(_back_to(v.col, first), _back_to(w.col, first)), F.lit(7))
    elif unit == "DAY":
        out = F.datediff(v.col, w.col)
    else:
        raise InvalidArgument(f"no date part {unit}")
    return b.new(out.cast("long"), INT, B.any_of(v.err, w.err))


@special("LAST_DAY")
def _last_day(b, x, part=None):
    v, unit = B.assign(b.bind(x), DATE), _unit(part) if part else "MONTH"
    start = _date_trunc(v.col, unit)
    months = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}.get(unit)
    out = F.date_sub(F.add_months(start, months), 1) if months else F.date_sub(_iso_start(_iso_year(v.col) + 1), 1) if unit == "ISOYEAR" else F.date_add(start, 6)
    return b.new(out, DATE, v.err)


def extract(b, part: str, x: tuple, zone: tuple | None) -> Value:
    v = b.bind(x)
    z = b.bind(zone) if zone else None
    timed = isinstance(v.type, T.TimestampType)
    if not timed and not isinstance(v.type, (T.DateType, T.NullType)):
        raise InvalidArgument("EXTRACT needs a date or a timestamp")
    c = _zoned(v.col, z.col if z else None) if timed else v.col
    plain = {"YEAR": F.year, "MONTH": F.month, "DAY": F.day, "QUARTER": F.quarter, "DAYOFWEEK": F.dayofweek, "DAYOFYEAR": F.dayofyear, "ISOWEEK": F.weekofyear, "ISOYEAR": lambda d: _iso_year(d.cast("date"))}
    clock = {"HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second, "MILLISECOND": lambda t: F.floor(F.pmod(F.unix_micros(t), F.lit(10**6)) / 1000), "MICROSECOND": lambda t: F.pmod(F.unix_micros(t), F.lit(10**6))}
    first = _week_first(part)
    if part == "DATE" and timed:
        return b.new(c.cast("date"), DATE, v.err)
    if part in clock and timed:
        out = clock[part](c)
    elif part in plain:
        out = plain[part](c)
    elif first is not None:
        out = F.floor((F.dayofyear(c) + 6 - F.pmod(F.dayofweek(c) - 1 - first, F.lit(7))) / 7)
    else:
        raise InvalidArgument(f"no part {part}")
    return b.new(out.cast("long"), INT, v.err)


@special("GENERATE_DATE_ARRAY GENERATE_TIMESTAMP_ARRAY")
def _date_array(b, low, high, interval=None):
    lo, hi = b.bind(low), b.bind(high)
    kind = TIME if isinstance(lo.type, T.TimestampType) else DATE
    lo, hi = B.assign(lo, kind), B.assign(hi, kind)
    n, unit = _interval(b, interval) if interval else (B.constant(1), "DAY")
    if unit in _MICROS and not (kind == DATE and unit != "DAY"):
        size, step = F.lit(_MICROS[unit]).cast("long") * n.col, None
    else:
        months = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}.get(unit)
        if kind == TIME or (not months and unit != "WEEK"):
            raise InvalidArgument(f"no steps of {unit}")
        size, step = F.lit(7 * _MICROS["DAY"]).cast("long") * n.col, months
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    if step:
        gap = ((F.year(hi.col) - F.year(lo.col)) * 12 + F.month(hi.col) - F.month(lo.col)).cast("long")
        count = F.call_function("div", gap, F.when(n.col != 0, n.col * step))
        back = (hi.col < lo.col) & (n.col > 0) | (hi.col > lo.col) & (n.col < 0)
    else:
        count = F.call_function("div", us(hi.col) - us(lo.col), F.when(size != 0, size))
        back = (us(hi.col) - us(lo.col)) * F.signum(n.col) < 0
    bad = (n.col == 0) | (count >= 1_000_000)
    top = F.when(bad | back, 0).otherwise(F.greatest(count, F.lit(0))).cast("int")
    move = (lambda i: F.add_months(lo.col, i * n.col.cast("int") * step)) if step else (lambda i: F.timestamp_micros(us(lo.col) + i.cast("long") * size).cast(kind))
    some = F.transform(F.sequence(F.lit(0), top), move)
    some = F.filter(some, lambda e: F.when(n.col > 0, e <= hi.col).otherwise(e >= hi.col))
    nothing = lo.col.isNull() | hi.col.isNull() | n.col.isNull()
    return b.new(F.when(~nothing, F.when(back, F.slice(some, 1, 0)).otherwise(some)), T.ArrayType(kind), B.any_of(lo.err, hi.err, n.err, bad))


# Elements of formats that Java's patterns have, and those that stand for others.
_JAVA = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "I": "hh", "p": "a"}
_SHORT = {"F": "%Y-%m-%d", "T": "%H:%M:%S", "D": "%m/%d/%y", "x": "%m/%d/%y", "X": "%H:%M:%S", "R": "%H:%M", "r": "%I:%M:%S %p", "c": "%a %b %e %H:%M:%S %Y"}
_ELEMENT = re.compile(r"%(E\*S|E\dS|E4Y|Ez|E[cCxXyY]|O[a-zA-Z]|.)", re.S)


def _spelled(shape: str) -> str:
    return re.sub(r"%([FTDxXRrc])", lambda m: _SHORT[m[1]], re.sub(r"%%", "%\0", shape)).replace("%\0", "%%")


def _formatted(shape: str, x: Column, minutes: Column) -> Column:
    """A time by a strftime format: each element its own expression."""
    d, us = x.cast("date"), F.pmod(F.unix_micros(x), F.lit(10**6))
    number = lambda c, width: F.lpad(c.cast("string"), width, "0")
    week = lambda first: F.floor((F.dayofyear(d) + 6 - F.pmod(F.dayofweek(d) - 1 - first, F.lit(7))) / 7)
    digits = F.lpad(us.cast("string"), 6, "0")
    special_elements = {
        "e": lambda: F.lpad(F.day(x).cast("string"), 2, " "), "k": lambda: F.lpad(F.hour(x).cast("string"), 2, " "), "l": lambda: F.lpad((F.pmod(F.hour(x) + 11, F.lit(12)) + 1).cast("string"), 2, " "),
        "u": lambda: (F.pmod(F.dayofweek(x) + 5, F.lit(7)) + 1).cast("string"), "w": lambda: (F.dayofweek(x) - 1).cast("string"), "V": lambda: number(F.weekofyear(d), 2), "G": lambda: number(_iso_year(d), 4), "g": lambda: number(F.pmod(_iso_year(d), F.lit(100)), 2),
        "U": lambda: number(week(0), 2), "W": lambda: number(week(1), 2), "Q": lambda: F.quarter(x).cast("string"), "C": lambda: number(F.floor(F.year(x) / 100), 2), "P": lambda: F.lower(F.date_format(x, "a")),
        "s": lambda: F.floor((F.unix_micros(x) - minutes * 60 * 10**6) / 10**6).cast("string"), "z": lambda: _offset(minutes, "plain"), "Ez": lambda: _offset(minutes, "colon"), "Z": lambda: F.when(minutes == 0, "UTC").otherwise(F.concat(F.lit("UTC"), F.regexp_replace(_offset(minutes, "short"), r"^([+-])0", "$1"))),
        "E*S": lambda: F.concat(F.date_format(x, "ss"), F.regexp_replace(F.concat(F.lit("."), digits), r"\.?0+$", "")), "E4Y": lambda: F.date_format(x, "yyyy"),
        "n": lambda: F.lit("\n"), "t": lambda: F.lit("\t"), "%": lambda: F.lit("%"),
    }
    shape, parts, at = _spelled(shape), [], 0
    for m in _ELEMENT.finditer(shape):
        parts.append(F.lit(shape[at : m.start()]))
        at, e = m.end(), m[1]
        if e in special_elements:
            parts.append(special_elements[e]())
        elif e in _JAVA:
            parts.append(F.date_format(x, _JAVA[e]))
        elif re.fullmatch(r"E\dS", e):
            n = int(e[1])
            parts.append(F.date_format(x, "ss") if n == 0 else F.concat(F.date_format(x, "ss"), F.lit("."), F.rpad(F.substring(digits, 1, min(n, 6)), n, "0")))
        else:
            raise InvalidArgument(f"no element %{e} of a format")
    return F.concat(*parts, F.lit(shape[at:]))


@fn("FORMAT_DATE", "SD")
def _format_date(f: Value, v: Value):
    return _formatted(_need(f, "a format"), v.col.cast("timestamp"), F.lit(0).cast("long"))


@fn("FORMAT_TIMESTAMP", "ST", "STS")
def _format_timestamp(f: Value, v: Value, zone: Value | None = None):
    wall = _zoned(v.col, None if zone is None else zone.col)
    return _formatted(_need(f, "a format"), wall, F.call_function("div", F.unix_micros(wall) - F.unix_micros(v.col), F.lit(60 * 10**6).cast("long")))


def _java_pattern(shape: str) -> str:
    shape, out, at = _spelled(shape), [], 0
    quote = lambda s: "".join("'" + c + "'" if c.isalpha() else "''" if c == "'" else c for c in s)
    extra = {"z": "xx", "Ez": "xxx", "Z": "VV", "E*S": "ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]", "e": "d", "%": "%", "E4Y": "yyyy", "k": "H", "l": "h", "n": "\n", "t": "\t"}
    elements = list(_ELEMENT.finditer(shape))
    numeric = lambda k: 0 <= k < len(elements) and elements[k][1] in set("YmdHMSIyj")
    for k, m in enumerate(elements):
        out.append(quote(shape[at : m.start()]))
        at, e = m.end(), m[1]
        # Numbers that touch others have all their digits; those that stand alone may lack leading zeros.
        touches = numeric(k - 1) and elements[k - 1].end() == m.start() or numeric(k + 1) and elements[k + 1].start() == m.end()
        found = extra.get(e) or (None if touches else {"m": "M", "d": "d", "H": "H", "M": "m", "S": "s", "I": "h"}.get(e)) or _JAVA.get(e)
        if re.fullmatch(r"E[1-6]S", e):
            found = "ss." + "S" * int(e[1])
        if found is None:
            raise Unimplemented(f"parsing %{e}")
        out.append(found)
    return "".join(out) + quote(shape[at:])


@fn("PARSE_TIMESTAMP", "SS", "SSS")
def _parse_timestamp(f: Value, v: Value, zone: Value | None = None):
    out = F.try_to_timestamp(F.trim(v.col), F.lit(_java_pattern(_need(f, "a format"))))
    return _unzoned(out, None if zone is None else zone.col), B.unless_null(out, v.col)


@fn("PARSE_DATE", "SS")
def _parse_date(f: Value, v: Value):
    out = F.try_to_timestamp(F.trim(v.col), F.lit(_java_pattern(_need(f, "a format")))).cast("date")
    return out, B.unless_null(out, v.col)
