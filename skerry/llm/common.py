"""Pieces shared by the operators: reading tables, durable intermediates, batches of text, joins on skewed keys."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Keys that count as heavy are fewer than this, whatever the input.
MOST_HEAVY = 10_000

_scopes: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one if both are one machine."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return f"file://{tempfile.gettempdir()}/skerry-checkpoints"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


@contextmanager
def _settings(spark: SparkSession, given: dict[str, str]) -> Iterator[None]:
    """Settings for the actions inside; the session's own come back."""
    before = {key: spark.conf.get(key) for key in given}
    try:
        for key, value in given.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_folder(spark)}/skerry-{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def stored(df: DataFrame, label: str = "part", batch_bytes: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors.

    Spark deletes the write's shuffle files at its end. ``batch_bytes`` bounds the
    Arrow batches that go to Python: of each, the JVM holds copies outside its heap.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    given = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if batch_bytes:
        given["spark.sql.execution.arrow.maxBytesPerBatch"] = str(batch_bytes)
    with _settings(spark, given):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skerry_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files behind frames that stored() returned, once nothing reads them any more."""
    for df in frames:
        _delete(df.sparkSession, df._skerry_path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end all that stored() has written inside, but for the frames given to the function it yields."""
    made: list[str] = []
    _scopes.append(made)

    def keep(df: DataFrame) -> DataFrame:
        made.remove(df._skerry_path)
        return df

    try:
        yield keep
    finally:
        _scopes.remove(made)
        for path in made:
            _delete(spark, path)


def word_count(text: Column) -> Column:
    """Number of words in text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """Tells apart rows that share an identifier."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """none (the id is null), id (0 then), sig (text_key), text: identifiers that join and sort, null ones last."""
    given = F.col(f"`{id_col}`").cast("long")
    text = F.col(f"`{text_col}`")
    return docs.select(given.isNull().alias("none"), F.coalesce(given, F.lit(0)).alias("id"), text_key(text).alias("sig"), text.alias("text"))


def named(none: Column, given: Column) -> Column:
    """The identifier again, from the columns of keyed()."""
    return F.when(~none, given)


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """Column row, which holds all columns of docs, and further ones: no name of docs can clash with a name inside."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(whole.alias("row"), *[c.alias(name) for name, c in more.items()])


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], n: str = "n", how: str = "inner") -> DataFrame:
    """many joined with few on keys, where few holds a key once, with the number n of its rows in many.

    A key with more than 1/parts of all rows is heavy; fewer than ``parts`` keys
    can be, so they are broadcast. A heavy key's rows are dealt over as many tasks
    as it has such parts, and its row in few is repeated for each. No row is
    dropped. few must be a stored frame: it is read several times.
    """
    parts = min(MOST_HEAVY, 2 * partitions(many.sparkSession))
    total, most = few.agg(F.sum(n), F.max(n)).first()
    if not total or most * parts <= total:
        return many.join(few.hint("merge"), keys, how)
    heavy = few.where(F.col(n) * F.lit(parts) > F.lit(total)).select(*keys, F.ceil(F.col(n) * F.lit(parts) / F.lit(total)).cast("int").alias("_salts"))
    deal = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in many.columns]), F.coalesce("_salts", F.lit(1))).cast("int")
    left = many.join(F.broadcast(heavy), keys, "left").withColumn("_salt", deal).drop("_salts")
    right = few.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def release() -> None:
    """Gives back to the system what this worker process has freed; Spark keeps idle workers for a minute, with the memory they hold."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches whose texts hold at most limit bytes (or one row), with the texts in UTF-8 (null: empty)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
        begin, size = 0, 0
        for i, n in enumerate([*sizes, limit + 1]):
            if i > begin and size + n > limit:
                yield batch.slice(begin, i - begin), [t or b"" for t in texts.slice(begin, i - begin).to_pylist()]
                begin, size = i, 0
            size += n + 1
