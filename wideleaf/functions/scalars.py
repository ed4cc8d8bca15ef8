"""Scalar functions whose semantics differ from Spark's own, as Column expressions without UDFs.

All are null-strict unless they say otherwise.  Functions that can fail raise in place; ``safe`` forms give null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fail(condition: Column, message: str, value: Column) -> Column:
    return F.when(condition, F.raise_error(F.lit(message))).otherwise(value)


def greatest(*xs: Column) -> Column:
    """Null if any argument is."""
    return F.when(reduce(lambda a, b: a | b, [x.isNull() for x in xs]), None).otherwise(F.greatest(*xs))


def least(*xs: Column) -> Column:
    return F.when(reduce(lambda a, b: a | b, [x.isNull() for x in xs]), None).otherwise(F.least(*xs))


def shift_left(x: Column, n: Column) -> Column:
    """Zero from 64 places on."""
    return _fail(n < 0, "a shift can't be negative", F.when(n >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", x.cast("long"), n.cast("int"))))


def shift_right(x: Column, n: Column) -> Column:
    """Without the sign."""
    return _fail(n < 0, "a shift can't be negative", F.when(n >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", x.cast("long"), n.cast("int"))))


def divide(a: Column, b: Column) -> Column:
    """Always of doubles; a zero divisor fails."""
    return a.cast("double") / b.cast("double")


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def ieee_divide(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, zero).otherwise(a / b)


def trunc(x: Column, digits: int = 0) -> Column:
    """Towards zero, at a decimal place."""
    scale = float(10**digits)
    return F.signum(x.cast("double")) * F.floor(F.abs(x.cast("double")) * scale).cast("double") / scale


def log(x: Column, base: Column | None = None) -> Column:
    """LOG(x) is natural; LOG(x, base)."""
    natural = lambda y: _fail(y <= 0, "a logarithm needs a positive argument", F.ln(y))
    return natural(x) if base is None else natural(x) / natural(base)


def sqrt(x: Column) -> Column:
    return _fail(x < 0, "a square root needs an argument that isn't negative", F.sqrt(x))


def substr(x: Column, position: int, length: int | None = None) -> Column:
    """From 1; 0 is 1; negative positions count from the end, at most to the start."""
    n = F.length(x)
    start = F.lit(max(position, 1)) if position >= 0 else F.greatest(n + position + 1, F.lit(1))
    return F.substring(x, start, n if length is None else F.lit(length))


def starts_with(x: Column, prefix: Column) -> Column:
    return F.startswith(x, prefix)


def trim(x: Column, side: str = "both") -> Column:
    """All Unicode white space."""
    pattern = {"both": r"^(?U)\s+|(?U)\s+$", "left": r"^(?U)\s+", "right": r"(?U)\s+$"}[side]
    return F.regexp_replace(x, pattern, "")


def char(n: Column) -> Column:
    """The character of a code point, also beyond the basic plane; 0 gives ''."""
    unit = lambda u: F.unhex(F.lpad(F.hex(u), 4, "0"))
    high = F.lit(0xD800) + F.call_function("shiftright", n - 0x10000, F.lit(10))
    low = F.lit(0xDC00) + (n - 0x10000).bitwiseAND(0x3FF)
    whole = F.when(n == 0, F.lit("")).when(n < 0x10000, F.decode(unit(n), "UTF-16BE")).otherwise(F.decode(F.concat(unit(high), unit(low)), "UTF-16BE"))
    return _fail((n < 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "no code point", whole)


def to_code_points(x: Column) -> Column:
    return F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def split_bytes(x: Column, delimiter: bytes) -> Column:
    """Parts of a BINARY between literal delimiters."""
    parts = F.split(F.decode(x, "ISO-8859-1"), "\\Q" + delimiter.decode("latin-1") + "\\E", -1)
    return F.transform(parts, lambda p: F.encode(p, "ISO-8859-1"))


def regexp_extract(x: Column, pattern: str, group: int) -> Column:
    """Null, not '', without a match."""
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group))


def array_includes(a: Column, v: Column) -> Column:
    """Never null for arguments that aren't."""
    return F.when(a.isNull() | v.isNull(), None).otherwise(F.coalesce(F.array_contains(a, v), F.lit(False)))


def array_offset(a: Column, v: Column) -> Column:
    """From 0; null if absent."""
    return F.nullif(F.array_position(a, v), F.lit(0).cast("long")) - 1


def array_slice(a: Column, low: int, high: int) -> Column:
    """From 0, both ends included; negative ends count from the back."""
    n = F.size(a)
    lo = F.lit(low) if low >= 0 else F.greatest(n + low, F.lit(0))
    hi = F.least(F.lit(high) if high >= 0 else n + high, n - 1)
    return F.when(hi >= lo, F.slice(a, lo + 1, hi - lo + 1)).otherwise(F.slice(a, 1, 0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


WEEKDAYS = ("SUNDAY", "MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY")


def week_start(d: Column, first: str = "SUNDAY") -> Column:
    """The first day of the week of a date."""
    return F.date_sub(d, F.pmod(F.dayofweek(d) - 1 - WEEKDAYS.index(first) + 7, F.lit(7)))


def week_diff(a: Column, b: Column, first: str = "SUNDAY") -> Column:
    """Week borders between two dates."""
    return (F.datediff(week_start(a, first), week_start(b, first)) / 7).cast("long")


def month_diff(a: Column, b: Column) -> Column:
    """Month borders between two dates."""
    return ((F.year(a) * 12 + F.month(a)) - (F.year(b) * 12 + F.month(b))).cast("long")


def to_int64(b: Column) -> Column:
    """Eight bytes, most significant first."""
    return _fail(F.octet_length(b) != 8, "an INT64 has eight bytes", F.conv(F.hex(b), 16, -10).cast("long"))


def float_to_int(x: Column) -> Column:
    """CAST to INT64 rounds half away from zero."""
    return F.round(x).cast("long")


def corr(x: Column, y: Column) -> Column:
    """NaN without variance, null for fewer than two pairs; pairs with a null don't count."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(F.count(a) < 2, None).when(spread == 0, F.lit(float("nan"))).otherwise(F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0)))


def first_value(x: Column, key: Column) -> Column:
    """ANY_VALUE: the first value in key order that isn't null."""
    return F.min_by(x, F.when(x.isNotNull(), key))


def array_agg(x: Column, key: Column, *, limit: int | None = None) -> Column:
    """ARRAY_AGG in key order; keeps nulls, null for no rows."""
    found = F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), x.alias("x")))), lambda e: e["x"])
    found = F.slice(found, 1, limit) if limit else found
    return F.when(F.count(F.lit(1)) > 0, found)


def string_agg(x: Column, delimiter: str, key: Column) -> Column:
    """STRING_AGG in key order; nulls don't count, null for no values."""
    found = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(key.alias("k"), x.alias("x"))))), lambda e: e["x"]), delimiter)
    return F.when(F.count(x) > 0, found)


def maximum(x: Column) -> Column:
    """MAX of doubles: NaN if any is."""
    return F.when(F.max(F.isnan(x)), F.lit(float("nan"))).otherwise(F.max(F.when(~F.isnan(x), x)))
