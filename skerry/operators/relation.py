"""Lazy relations and expressions over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.session import Cursor
from skerry.sources.ingest import to_frame


class Expr:
    """A column expression with operators, ordering, names and aggregates."""

    def __init__(self, column: Column, aggregate: bool = False):
        self.column, self.aggregate = column, aggregate

    def _with(self, other, f, swap: bool = False) -> Expr:
        o = other.column if isinstance(other, Expr) else F.lit(other)
        agg = self.aggregate or isinstance(other, Expr) and other.aggregate
        return Expr(f(o, self.column) if swap else f(self.column, o), agg)

    def alias(self, name: str) -> Expr:
        return Expr(self.column.alias(name), self.aggregate)

    def asc(self) -> Expr:
        return Expr(self.column.asc_nulls_last())

    def desc(self) -> Expr:
        return Expr(self.column.desc_nulls_first())

    def rlike(self, pattern: str) -> Expr:
        return Expr(self.column.rlike(pattern))

    def is_null(self) -> Expr:
        return Expr(self.column.isNull())

    def is_not_null(self) -> Expr:
        return Expr(self.column.isNotNull())

    def isin(self, *values) -> Expr:
        return Expr(self.column.isin(*values))

    def cast(self, kind: str) -> Expr:
        return Expr(self.column.cast(kind), self.aggregate)

    def sum(self) -> Expr:
        return Expr(F.sum(self.column), True)

    def min(self) -> Expr:
        return Expr(F.min(self.column), True)

    def max(self) -> Expr:
        return Expr(F.max(self.column), True)

    def avg(self) -> Expr:
        return Expr(F.avg(self.column * 1.0), True)

    def count(self) -> Expr:
        return Expr(F.count(self.column), True)

    def __invert__(self) -> Expr:
        return Expr(~self.column)

    def __neg__(self) -> Expr:
        return Expr(-self.column, self.aggregate)

    def __abs__(self) -> Expr:
        return Expr(F.abs(self.column), self.aggregate)

    def __hash__(self) -> int:
        return id(self)


def _operators() -> None:
    plain = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "truediv": F.try_divide, "floordiv": lambda a, b: F.floor(F.try_divide(a, b)), "mod": F.try_mod, "pow": F.pow, "and": lambda a, b: a & b, "or": lambda a, b: a | b}
    for name, f in plain.items():
        setattr(Expr, f"__{name}__", lambda self, o, f=f: self._with(o, f))
        setattr(Expr, f"__r{name}__", lambda self, o, f=f: self._with(o, f, True))
    compare = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b}
    for name, f in compare.items():
        setattr(Expr, f"__{name}__", lambda self, o, f=f: self._with(o, f))


_operators()


def ColumnExpression(name: str) -> Expr:
    return Expr(F.col(name))


def ConstantExpression(value) -> Expr:
    return Expr(F.lit(value))


def CountExpression() -> Expr:
    return Expr(F.count(F.lit(1)), True)


class Relation:
    """A lazy query: every method gives another relation; only fetching runs it."""

    def __init__(self, frame: DataFrame):
        self.frame = frame
        self._cursor: Cursor | None = None

    @property
    def columns(self) -> list[str]:
        return self.frame.columns

    @property
    def types(self) -> list[str]:
        return [t for _, t in self.frame.dtypes]

    dtypes = types

    def _columns(self, items: Sequence) -> list[Column]:
        return [i.column if isinstance(i, Expr) else F.col(i) for i in items]

    def project(self, *items: Expr | str) -> Relation:
        if any(isinstance(i, Expr) and i.aggregate for i in items):
            raise ValueError("aggregates belong to group()")
        return Relation(self.frame.select(*self._columns(items)))

    select = project

    def filter(self, predicate: Expr) -> Relation:
        if not isinstance(predicate, Expr):
            raise TypeError("a predicate is an expression, not text")
        return Relation(self.frame.where(predicate.column))

    def group(self, keys: Sequence[Expr | str], aggregates: Sequence[Expr]) -> Relation:
        """Rows of keys and aggregates; no keys: one row."""
        found = [a.column for a in aggregates]
        return Relation(self.frame.groupBy(*self._columns(keys)).agg(*found) if keys else self.frame.agg(*found))

    def order(self, *items: Expr | str) -> Relation:
        return Relation(self.frame.orderBy(*[i.column if isinstance(i, Expr) else F.col(i).asc_nulls_last() for i in items]))

    sort = order

    def join(self, other: Relation, on: Expr | str | Sequence[str], how: str = "inner") -> Relation:
        if how not in ("inner", "left", "right", "full", "cross"):
            raise ValueError(f"no such join: {how}")
        if how == "cross":
            return self.cross(other)
        return Relation(self.frame.join(other.frame, on.column if isinstance(on, Expr) else on, how))

    def cross(self, other: Relation) -> Relation:
        return Relation(self.frame.crossJoin(other.frame))

    def union(self, other: Relation) -> Relation:
        return Relation(self.frame.union(other.frame))

    def distinct(self) -> Relation:
        return Relation(self.frame.distinct())

    def limit(self, n: int, offset: int = 0) -> Relation:
        return Relation((self.frame.offset(offset) if offset else self.frame).limit(n))

    def _fetch(self) -> Cursor:
        self._cursor = self._cursor or Cursor(self.frame)
        return self._cursor

    def fetchone(self):
        return self._fetch().fetchone()

    def fetchmany(self, n: int):
        return self._fetch().fetchmany(n)

    def fetchall(self):
        return self._fetch().fetchall()

    def df(self):
        return self.frame.toPandas()

    fetchdf = to_df = df

    def arrow(self):
        return self.frame.toArrow()


def relation(spark: SparkSession, data) -> Relation:
    return Relation(data if isinstance(data, DataFrame) else to_frame(spark, data))
