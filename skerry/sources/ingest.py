"""Data of other libraries and files as DataFrames."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def to_frame(spark: SparkSession, data) -> DataFrame:
    """pandas, polars, Arrow (table, batch, reader, dataset, scanner, capsule), numpy 1-D or 2-D, a list or dict of columns.

    NaN and NaT become null; object columns of mixed values become strings;
    categories their labels; repeated names get a number.
    """
    if isinstance(data, pd.DataFrame):
        return _arrow(spark, pa.Table.from_pandas(_plain(data), preserve_index=False))
    if isinstance(data, dict):
        return to_frame(spark, pd.DataFrame(data))
    if isinstance(data, np.ndarray):
        data = data.reshape(len(data), -1)
        return to_frame(spark, pd.DataFrame({f"column{i}": data[:, i] for i in range(data.shape[1])}))
    if isinstance(data, (list, tuple)):
        if data and isinstance(data[0], dict):
            return to_frame(spark, pd.DataFrame(list(data)))
        arrays = [np.asarray(x) for x in data] if data and isinstance(data[0], (list, tuple, np.ndarray)) else [np.asarray(data)]
        return to_frame(spark, pd.DataFrame({f"column{i}": a for i, a in enumerate(arrays)}))
    if isinstance(data, pa.RecordBatch):
        return _arrow(spark, pa.Table.from_batches([data]))
    if isinstance(data, pa.RecordBatchReader):
        return _arrow(spark, data.read_all())
    if isinstance(data, pa.Table):
        return _arrow(spark, data)
    if hasattr(data, "to_arrow"):  # polars
        return _arrow(spark, data.to_arrow())
    if hasattr(data, "to_table"):  # Arrow datasets and scanners
        return _arrow(spark, data.to_table())
    if hasattr(data, "__arrow_c_stream__"):
        return _arrow(spark, pa.RecordBatchReader.from_stream(data).read_all())
    raise TypeError(f"no way to read {type(data).__name__}")


def unique(names: list[str]) -> list[str]:
    """A repeated name gets a number."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n] - 1}")
    return out


def _arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    names = unique(table.column_names)
    table = table.rename_columns(names)
    fields = []
    for column in table.columns:
        if pa.types.is_dictionary(column.type):
            column = column.cast(column.type.value_type)
        if pa.types.is_unsigned_integer(column.type):
            column = column.cast({8: pa.int16(), 16: pa.int32(), 32: pa.int64()}.get(column.type.bit_width, pa.decimal128(20, 0)))
        if pa.types.is_null(column.type):
            column = column.cast(pa.string())
        fields.append(column)
    return spark.createDataFrame(pa.table(fields, names=names) if fields else table)


def _plain(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.copy()
    columns = []
    for i in range(frame.shape[1]):
        c = frame.iloc[:, i]
        if isinstance(c.dtype, pd.CategoricalDtype):
            c = c.astype(object)
        if c.dtype == object:
            kinds = {type(x) for x in c.dropna()}
            if len(kinds) > 1 and not kinds <= {int, float, bool, np.int64, np.float64}:
                c = c.map(lambda x: None if x is None or x is pd.NaT or isinstance(x, float) and np.isnan(x) else str(x))
            else:
                c = c.where(c.notna(), None)
        columns.append(c)
    out = pd.concat(columns, axis=1) if columns else frame
    out.columns = range(len(columns))
    table = {i: out[i] for i in out.columns}
    made = pd.DataFrame(table)
    made.columns = unique([str(x) for x in frame.columns])
    return made


def read_file(spark: SparkSession, path: str, kind: str, schema: str | None = None, **options) -> DataFrame:
    """parquet, orc, json (one document a line), csv, text, and others that the session has a reader for."""
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def read_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON documents as flat columns a/b/c."""
    from skerry.operators.statements import flatten

    return flatten(read_file(spark, path, "json", schema))
