"""Arithmetic on zone-free timestamps (TIMESTAMP_NTZ) in microseconds."""

import re
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000

# Unit spellings accepted in a bucket rule such as '15min'.
_UNIT_US = {
    "us": 1,
    "ms": 1_000,
    "s": 1_000_000,
    "min": 60_000_000,
    "t": 60_000_000,
    "h": 3_600_000_000,
    "d": DAY_US,
}
# Rules whose buckets are calendar units.
CALENDAR_RULES = {"W": "week", "W-SUN": "week", "ME": "month", "M": "month"}


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch() -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def micros(ts) -> Column:
    """Microseconds since 1970-01-01 on the reading's own clock."""
    return F.timestamp_diff("MICROSECOND", epoch(), as_col(ts))


def from_micros(us) -> Column:
    return F.timestamp_add("MICROSECOND", as_col(us), epoch())


def floor_to(ts, step_us: int, origin=None) -> Column:
    """Start of the left-closed bucket of ``step_us`` that holds ``ts``."""
    us = micros(ts)
    since = us if origin is None else us - micros(origin)
    return from_micros(us - F.pmod(since, F.lit(step_us)))


def midnight(ts) -> Column:
    return floor_to(ts, DAY_US)


def calendar_unit(rule: str) -> str | None:
    """``week`` or ``month`` for a rule that is labelled by the last day of one, otherwise None."""
    return CALENDAR_RULES.get(rule.strip().removeprefix("1"))


def rule_micros(rule: str) -> int:
    """Length of a bucket rule: ``5min``, ``1h``, ``1D``, ``90s``, ``h``, ``1h30min``, ``1.5h``, ``500ms``."""
    parts = re.findall(r"(\d+(?:\.\d+)?|\.\d+)?\s*([A-Za-z]+)\s*", rule)
    if not parts or "".join(a + b for a, b in parts) != re.sub(r"\s", "", rule):
        raise ValueError(f"unsupported bucket rule: {rule!r}")
    total = Fraction(0)
    for count, unit in parts:
        if unit.lower() not in _UNIT_US:
            raise ValueError(f"unsupported bucket rule: {rule!r}")
        total += Fraction(count or "1") * _UNIT_US[unit.lower()]
    if total < 1 or total.denominator != 1:
        raise ValueError(f"bucket rule must be a positive number of microseconds: {rule!r}")
    return int(total)
