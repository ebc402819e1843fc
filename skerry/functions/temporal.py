"""Intervals of months, days and microseconds that compare and sort, times with zones, and arithmetic on them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
_UNITS = {"us": (0, 0, 1), "microsecond": (0, 0, 1), "ms": (0, 0, 1000), "millisecond": (0, 0, 1000), "second": (0, 0, 1_000_000), "minute": (0, 0, 60_000_000), "hour": (0, 0, 3_600_000_000), "day": (0, 1, 0), "week": (0, 7, 0), "month": (1, 0, 0), "year": (12, 0, 0)}


def interval(months: Column | int = 0, days: Column | int = 0, us: Column | int = 0) -> Column:
    c = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(c(months, "int").alias("months"), c(days, "int").alias("days"), c(us, "long").alias("us"))


def parse_interval(text: str) -> tuple[int, int, int]:
    """'1 year 2 days 03:04:05.5' -> (months, days, microseconds)."""
    months = days = us = 0
    for sign, h, m, s in re.findall(r"(-?)(\d+):(\d+)(?::(\d+(?:\.\d+)?))?", text):
        us += (-1 if sign else 1) * (int(h) * 3_600_000_000 + int(m) * 60_000_000 + round(float(s or 0) * 1_000_000))
    for n, unit in re.findall(r"(-?\d+(?:\.\d+)?)\s*([a-zA-Z]+)", text):
        a, b, c = _UNITS[unit.lower().rstrip("s") if unit.lower() not in ("us", "ms") else unit.lower()]
        months, days, us = months + int(float(n) * a), days + int(float(n) * b), us + round(float(n) * c)
    return months, days, us


def sort_key(i: Column) -> Column:
    """A month counts as 30 days: 1 month = 30 days = 720 hours."""
    return i["months"].cast("decimal(38,0)") * (30 * DAY_US) + i["days"].cast("decimal(38,0)") * DAY_US + i["us"]


def add(a: Column, b: Column, sign: int = 1) -> Column:
    return interval(a["months"] + sign * b["months"], a["days"] + sign * b["days"], a["us"] + sign * b["us"])


def scale(i: Column, by: Column | float) -> Column:
    """Each part times a number, rounded on its own."""
    by = by if isinstance(by, Column) else F.lit(by)
    return interval(F.round(i["months"] * by), F.round(i["days"] * by), F.round(i["us"] * by))


def date_plus(d: Column, i: Column, sign: int = 1) -> Column:
    """A date: months first (clamped to the month's end), then days; the time part is left out."""
    return F.date_add(F.add_months(d, sign * i["months"]), sign * i["days"])


def timestamp_plus(t: Column, i: Column, sign: int = 1) -> Column:
    """Months, then days, then microseconds."""
    seconds = (F.lit(sign) * i["us"]).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(20,0)")
    return t + F.make_interval(months=F.lit(sign) * i["months"], days=F.lit(sign) * i["days"], secs=seconds.cast("decimal(18,6)"))


def time_plus(us_of_day: Column, i: Column, sign: int = 1) -> Column:
    """Microseconds since midnight, around the clock."""
    return F.pmod(us_of_day + sign * i["us"], F.lit(DAY_US))


def timetz_key(t: Column) -> Column:
    """Times with zones (us, zone in seconds) compare as UTC."""
    return t["us"] - t["zone"].cast("long") * 1_000_000


def enum_key(c: Column, labels: list[str]) -> Column:
    """Labels sort in the order they were declared."""
    return F.array_position(F.array(*[F.lit(x) for x in labels]), c)
