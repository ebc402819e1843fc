"""Event-time queries: the same functions take a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _late(events: DataFrame, delay: str) -> DataFrame:
    """Watermarks take instants: a stream's local times are read in the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    return _late(events, delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("w_start"), "event_type", "n")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", delay: str = "1 day") -> DataFrame:
    return _late(events, delay).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("w_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """One row for each user and run of events with less than gap between neighbours."""
    grouped = _late(events, delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return grouped.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_ts", "last_ts")], "n")


def without_repeats(events: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    return _late(events, delay).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def running_totals(events: DataFrame) -> DataFrame:
    """Stateful count and sum for each user, updated with every batch."""
    import pandas as pd

    def step(key, frames, state):
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in frames:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", "NoTimeout")


def run_once(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into Parquet in the shared folder: a batch replaces the one before, or adds to it."""
    from skerry.shared import shared_folder

    path = f"{shared_folder(df.sparkSession)}/skerry-stream-{name}"
    write = "append" if mode == "append" else "overwrite"
    query = df.writeStream.foreachBatch(lambda rows, _: rows.write.mode(write).parquet(path)).outputMode(mode).trigger(availableNow=True)
    query.option("checkpointLocation", f"{path}-log").start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
