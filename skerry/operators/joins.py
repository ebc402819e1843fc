"""Joins on order: as-of and range joins, without a cross product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, columns: list[str]) -> DataFrame:
    """left with the named columns of right's last row, by key, at or before left's time (null: none).

    Both sides go through one sorted pass for each key (union, then the last
    right row seen), so a key costs its rows, not their product. Of right rows
    with one key and time, the largest values win.
    """
    kept = F.struct(F.col(right_on).alias("_at"), *columns)
    a = left.select(F.struct("*").alias("_left"), *by, F.col(left_on).alias("_t"), F.lit(None).cast(right.select(kept.alias("k")).schema[0].dataType).alias("_right"), F.lit(1).alias("_side"))
    b = right.select(F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), *by, F.col(right_on).alias("_t"), kept.alias("_right"), F.lit(0).alias("_side"))
    order = Window.partitionBy(*by).orderBy("_t", "_side", "_right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("_last", F.last("_right", ignorenulls=True).over(order))
    return both.where("_side = 1").select("_left.*", *[F.col(f"_last.{c}").alias(c) for c in columns])


def range_join(points: DataFrame, intervals: DataFrame, at: Column, low: Column, high: Column, width: float, by: list[str] | None = None) -> DataFrame:
    """Points with the intervals [low, high) that hold them, by an equi-join on bins of the given width.

    An interval is listed under every bin it touches, a point under one: choose
    the width near the usual length of an interval.
    """
    p = points.withColumn("_bin", F.floor(at / width))
    i = intervals.withColumn("_low", low).withColumn("_high", high).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor(F.col("_high") / width))))
    return p.join(i, [*(by or []), "_bin"]).where((at >= F.col("_low")) & (at < F.col("_high"))).drop("_bin", "_low", "_high")
