"""User functions with typed signatures: row, vector and aggregate kernels, overloads by argument types."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Kernel:
    call: Callable
    returns: str | Callable[[list[str]], str]
    takes: tuple[str, ...] | None  # None: any number of any types

    def fits(self, types: list[str]) -> bool:
        return self.takes is None or len(types) == len(self.takes) and all(t in ("any", g) for t, g in zip(self.takes, types))


class Registry:
    """Functions by name; a call is dispatched on the types of its arguments."""

    def __init__(self):
        self.kernels: dict[str, list[Kernel]] = {}

    def add(self, name: str, function: Callable, returns, kind: str = "row", takes: Sequence[str] | None = None) -> None:
        self.kernels.setdefault(name, []).append(Kernel(make(function, returns, kind) if isinstance(returns, str) else function, returns, tuple(takes) if takes is not None else None))

    def remove(self, name: str) -> None:
        del self.kernels[name]

    def call(self, df: DataFrame, name: str, *columns: Column) -> Column:
        types = [t for _, t in df.select(*columns).dtypes] if columns else []
        for k in self.kernels[name]:
            if k.fits(types):
                call = k.call if isinstance(k.returns, str) else make(k.call, k.returns(types), "row")
                return call(*columns)
        raise TypeError(f"{name} takes no ({', '.join(types)})")


def make(function: Callable, returns: str, kind: str) -> Callable:
    if kind == "row":
        return F.udf(function, returns)
    if kind == "vector":

        def vector(*columns: pd.Series) -> pd.Series:
            return pd.Series(function(*columns))

        return F.pandas_udf(vector, returns, F.PandasUDFType.SCALAR)
    if kind == "aggregate":

        def fold(column: pd.Series):
            return function(column)

        return F.pandas_udf(fold, returns, F.PandasUDFType.GROUPED_AGG)
    raise ValueError(f"no such kind of kernel: {kind}")


def register(engine, name: str, function: Callable, returns: str, kind: str = "row", takes: Sequence[str] | None = None) -> None:
    made = make(function, returns, kind)
    engine.functions[name] = made
    engine.spark.udf.register(name, made)


@dataclass
class Aggregate:
    """An aggregate with a state that merges: partial states are made before the shuffle, one row for each key and task."""

    init: Callable[[], object]
    consume: Callable[[object, pd.Series], object]
    merge: Callable[[object, object], object]
    finalize: Callable[[object], object]
    state: str
    returns: str

    def apply(self, df: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
        init, consume, merge, finalize = self.init, self.consume, self.merge, self.finalize
        kinds = dict(df.dtypes)
        listed = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

        def partial(frames):
            states = {}
            for pdf in frames:
                for key, rows in pdf.groupby(keys, dropna=False, sort=False):
                    states[key] = consume(states.get(key, init()), rows[column])
            yield pd.DataFrame([(*k, s) for k, s in states.items()], columns=[*keys, "_state"])

        def final(pdf: pd.DataFrame) -> pd.DataFrame:
            state = init()
            for s in pdf["_state"]:
                state = merge(state, s)
            first = pdf.iloc[:1][keys].copy()
            first[out] = [finalize(state)]
            return first

        sep = ", " if listed else ""
        return df.select(*keys, column).mapInPandas(partial, f"{listed}{sep}_state {self.state}").groupBy(*keys).applyInPandas(final, f"{listed}{sep}`{out}` {self.returns}")
