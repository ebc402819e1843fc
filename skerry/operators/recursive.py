"""Recursion that removes repeats (UNION): a fixpoint over written steps, for graphs with cycles."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.shared import shared_folder


def _written(df: DataFrame, n: int) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/skerry-step-{uuid.uuid4().hex}-{n}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 10_000) -> DataFrame:
    """base UNION step(base) UNION ... until a step brings no new row; an error after ``most`` steps.

    A step sees the rows that the one before has added. Each step's rows are
    written once, so no plan grows with the depth and lost executors cost no recomputation.
    """
    new = _written(base.distinct(), 0)
    found = new
    for n in range(1, most + 1):
        keys = [F.col(f"_n.{c}").eqNullSafe(F.col(f"_f.{c}")) for c in found.columns]
        made = step(new).toDF(*found.columns).distinct().alias("_n").join(found.alias("_f"), keys, "left_anti")
        new = _written(made, n)
        if new.isEmpty():
            return found
        found = found.unionByName(new)
    raise RuntimeError(f"no fixpoint after {most} steps")
