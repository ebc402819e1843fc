"""Older semantics, asked for by name; the default everywhere is ANSI SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def two_valued(test: Column) -> Column:
    """A comparison with null is false, so that NOT keeps such rows."""
    return F.coalesce(test, F.lit(False))


def not_in(value: Column, others: list) -> Column:
    return ~two_valued(value.isin(*others))


def sum_as(column: Column, kind: str) -> Column:
    """A sum of its argument's type."""
    return F.sum(column).cast(kind)


def avg_as(column: Column, kind: str) -> Column:
    """An average of its argument's type: integers are cut."""
    return F.avg(column).cast(kind)


def like_line(column: Column, pattern: str) -> Column:
    """LIKE whose % does not cross the end of a line."""
    import re

    regex = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    return column.rlike(f"^{regex}$")


def byte_length(column: Column) -> Column:
    return F.octet_length(column).cast("long")


def byte_substring(column: Column, start: int, length: int | None = None) -> Column:
    """By bytes from 1; a start below 1 is 1, a length below 1 gives ''."""
    raw = column.cast("binary")
    n = F.octet_length(column) if length is None else F.lit(max(length, 0))
    return F.substring(raw, F.lit(max(start, 1)), n).cast("string")


def divide(a: Column, b: Column | int | float) -> Column:
    """Null for a zero in a column; an error for a literal zero."""
    if not isinstance(b, Column):
        if b == 0:
            raise ZeroDivisionError("division by a literal zero")
        return a / F.lit(b)
    return F.try_divide(a, b)


def sort_order(column: Column, descending: bool = False) -> Column:
    """Nulls last upwards, first downwards."""
    return column.desc_nulls_first() if descending else column.asc_nulls_last()
