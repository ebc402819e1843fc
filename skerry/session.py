"""Engine, Connection and Cursor: SQL text in, DataFrames out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from skerry.plans import dialect


class Engine:
    """SQL over Spark. Statements that change tables need a ``folder`` for the catalogue and its versions."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.hooks = spark, []
        self.functions: dict[str, object] = {}
        self.catalog = None
        if folder is not None:
            from skerry.sources.tables import Catalog

            self.catalog = Catalog(spark, folder)
        # A recursive query may go as deep as 10 000 levels.
        spark.conf.set("spark.sql.cteRecursionLevelLimit", "10000")

    def load(self, sf_dir: str, *names: str) -> Engine:
        for name in names:
            self.spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        return self

    def sql(self, text: str, params: Sequence | dict | None = None) -> DataFrame:
        """Run one statement. Parser hooks see the text first; params fill ``$1``/``?`` (a sequence) or ``:name`` (a dict)."""
        for hook in self.hooks:
            text = hook(text) or text
        text = text.strip().rstrip(";")
        first = dialect.tokens(text)[0].low
        if self.catalog is None or first in ("explain", "show", "describe"):
            return self.select(text, params)
        if first in ("select", "with", "values", "("):
            return self.select(text, params)
        from skerry.operators.statements import run

        return run(self, text, params)

    def select(self, text: str, params: Sequence | dict | None = None) -> DataFrame:
        dynamic = {}
        if self.catalog is not None:
            dynamic = self.catalog.register(dialect.tokens(text))
        ready = dialect.rewrite(text, dynamic)
        if isinstance(params, dict):
            return self.spark.sql(ready, args=params)
        if params and ":p1" in ready:
            return self.spark.sql(ready, args={f"p{i + 1}": v for i, v in enumerate(params)})
        return self.spark.sql(ready, args=list(params)) if params else self.spark.sql(ready)

    def execute(self, text: str, params: Sequence | dict | None = None) -> Cursor:
        return Cursor(self.sql(text, params))

    execute_sql = execute
    execute_sql_with_params = execute

    def set_timezone(self, zone: str) -> None:
        self.spark.conf.set("spark.sql.session.timeZone", zone)

    def add_parser_extension(self, hook: Callable[[str], str | None]) -> None:
        """hook(text) returns other text, or None to pass."""
        self.hooks.append(hook)

    def create_database(self, name: str) -> None:
        self.sql(f"CREATE DATABASE {name}")

    def drop_database(self, name: str) -> None:
        self.sql(f"DROP DATABASE {name}")

    def register_udf(self, name: str, function: Callable, returns: str, kind: str = "row", takes: Sequence[str] | None = None) -> None:
        from skerry.functions.kernels import register

        register(self, name, function, returns, kind, takes)

    def unregister_udf(self, name: str) -> None:
        self.functions.pop(name, None)
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")


class Cursor:
    """Rows of a result, fetched as they are asked for."""

    def __init__(self, frame: DataFrame):
        self.frame, self._rows = frame, None

    @property
    def columns(self) -> list[str]:
        return [c.rpartition("#")[0] or c for c in self.frame.columns]

    @property
    def types(self) -> list[str]:
        return [t for _, t in self.frame.dtypes]

    dtypes = types

    def __iter__(self):
        if self._rows is None:
            self._rows = self.frame.toLocalIterator()
        return self._rows

    def fetchone(self):
        row = next(iter(self), None)
        return None if row is None else tuple(row)

    def fetchmany(self, n: int) -> list[tuple]:
        out = []
        while len(out) < n and (row := self.fetchone()) is not None:
            out.append(row)
        return out

    def fetchall(self) -> list[tuple]:
        return [tuple(r) for r in iter(self)]

    def df(self):
        return self.frame.toPandas()

    fetchdf = to_df = df

    def arrow(self):
        return self.frame.toArrow()


class Connection:
    """connect() gives one: execute, relations over data, commit and rollback."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.engine = Engine(spark, folder)

    def execute(self, text: str, params: Sequence | dict | None = None) -> Cursor:
        return self.engine.execute(text, params)

    def commit(self) -> None:
        self.engine.sql("COMMIT")

    def rollback(self) -> None:
        self.engine.sql("ROLLBACK")

    def from_df(self, data):
        from skerry.operators.relation import relation

        return relation(self.engine.spark, data)

    from_object = from_df


def connect(spark: SparkSession, folder: str | None = None) -> Connection:
    return Connection(spark, folder)
