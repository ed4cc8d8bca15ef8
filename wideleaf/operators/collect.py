"""Garbage collection of versions by nested rules."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wideleaf.errors import InvalidArgument


#: Fixed value: what a rule may take when stored.
MOST_BYTES = 500


@dataclass(frozen=True)
class MaxVersions:
    """All but the newest ``n`` versions of a column go."""

    n: int


@dataclass(frozen=True)
class MaxAge:
    """Cells older than ``micros`` go."""

    micros: int


@dataclass(frozen=True)
class Union:
    """What any of the rules drops goes."""

    rules: tuple


@dataclass(frozen=True)
class Intersection:
    """What all rules drop goes; without rules nothing does."""

    rules: tuple


Rule = MaxVersions | MaxAge | Union | Intersection


def check(rule: Rule) -> None:
    if isinstance(rule, MaxVersions) and rule.n < 1:
        raise InvalidArgument("at least one version must stay")
    if isinstance(rule, MaxAge) and rule.micros < 1000:
        raise InvalidArgument("an age must be a millisecond at least")
    for r in getattr(rule, "rules", ()):
        check(r)


def _drops(rule: Rule, now: int) -> Column:
    if isinstance(rule, MaxVersions):
        return F.col("_version") > rule.n
    if isinstance(rule, MaxAge):
        return F.col("ts") < now - rule.micros
    parts = [_drops(r, now) for r in rule.rules]
    if not parts:
        return F.lit(False)
    return reduce((lambda a, b: a | b) if isinstance(rule, Union) else (lambda a, b: a & b), parts)


def _counts(rule: Rule) -> bool:
    return isinstance(rule, MaxVersions) or any(map(_counts, getattr(rule, "rules", ())))


def size(rule: Rule) -> int:
    """The bytes that a rule takes when stored, counting what each part takes in a tagged encoding."""
    def number(n: int) -> int:
        return max(1, -(-n.bit_length() // 7))

    if isinstance(rule, MaxVersions):
        return 1 + number(rule.n)
    if isinstance(rule, MaxAge):
        seconds, rest = divmod(rule.micros, 1_000_000)
        body = (1 + number(seconds) if seconds else 0) + (1 + number(rest * 1000) if rest else 0)
    else:
        body = sum(1 + number(n) + n for n in map(size, rule.rules))
    return 1 + number(body) + body


def _judged(cells: DataFrame, rules: dict[str, Rule], now: int) -> DataFrame:
    """``cells`` with ``_gone``.  All rules judge the same input.  Versions are only ranked if some rule counts them."""
    for rule in rules.values():
        check(rule)
        if size(rule) > MOST_BYTES:
            raise InvalidArgument(f"a rule of over {MOST_BYTES} bytes")
    if any(map(_counts, rules.values())):
        w = Window.partitionBy("row_key", "family", "qualifier").orderBy(F.desc("ts"), F.desc("seq"))
        cells = cells.withColumn("_version", F.row_number().over(w))
    gone = F.lit(False)
    for family, rule in rules.items():
        gone = gone | ((F.col("family") == family) & _drops(rule, now))
    return cells.withColumn("_gone", gone)


def survivors(cells: DataFrame, rules: dict[str, Rule], now: int) -> DataFrame:
    """The cells that the rules of their families leave; families without a rule keep all."""
    return _judged(cells, rules, now).where("not _gone").drop("_version", "_gone")


def collected(cells: DataFrame, rules: dict[str, Rule], now: int) -> DataFrame:
    """The cells that the rules take."""
    return _judged(cells, rules, now).where("_gone").drop("_version", "_gone")
