"""Constructors of types: scalar names as in SQL, and nested ones."""

from __future__ import annotations

from pyspark.sql import types as T

from skerry.plans.dialect import spark_type, tokens


def scalar(name: str) -> T.DataType:
    """A type by its SQL name: 'int4', 'decimal(10,2)', 'ubigint', 'timestamptz', 'int[3]' and so on."""
    kind, _ = spark_type(tokens(name))
    return T.DataType.fromDDL(kind)


def list_type(of: T.DataType) -> T.ArrayType:
    return T.ArrayType(of)


def array_type(of: T.DataType, length: int) -> T.StructField:
    """A field of fixed-length arrays; the length is kept in its metadata."""
    return T.StructField("value", T.ArrayType(of), True, {"length": length})


def enum_type(labels: list[str]) -> T.StructField:
    """A field of labels; their order is kept in its metadata and sorts by functions.temporal.enum_key."""
    return T.StructField("value", T.StringType(), True, {"enum": list(labels)})


def decimal_type(width: int, scale: int) -> T.DecimalType:
    return T.DecimalType(width, scale)


def struct_type(fields: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def map_type(key: T.DataType, value: T.DataType) -> T.MapType:
    return T.MapType(key, value)


def union_type(members: dict[str, T.DataType]) -> T.StructType:
    """A tag and one nullable field for each member."""
    return T.StructType([T.StructField("tag", T.StringType(), False), *[T.StructField(n, t) for n, t in members.items()]])


#: Larger number types stand further on; the sign widens.
_RANK = {"tinyint": 1, "smallint": 2, "int": 3, "bigint": 4, "decimal(20,0)": 5, "decimal(38,0)": 6, "float": 7, "double": 8}


def promote(a: str, b: str) -> str:
    """The type of an operation on two numbers: the larger one."""
    return max((spark_type(tokens(x))[0] for x in (a, b)), key=_RANK.__getitem__)
