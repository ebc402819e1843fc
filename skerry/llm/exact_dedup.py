"""Exact deduplication through a log-structured merge index of digests, in DataFrame operations only.

Documents are entered by the SHA-256 digest of their normalised text. Memtables
(partial aggregates of a task's rows) hold, for each digest, the row that stays
and the number of members; they are flushed as runs sorted by digest, with Bloom
filters. When ``fan_in`` runs of a level have gathered, compaction merges them into
one run of the next level, which keeps the best entry of each digest and adds up
the members. Documents then probe the index: those whose digest has several
members are hits, and each hit's bytes are compared with the text that stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import SPACE, forget, keyed, named, partitions, scratch, spread_join, stored

#: What tells a row from others; see common.keyed.
KEY = ["none", "id", "sig"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body.cast("binary"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """none, id, sig, n_chars (code points of the original), digest (of the normalised text), n (1)."""
    rows = keyed(docs, id_col, text_col)
    return rows.select(*KEY, F.coalesce(F.char_length("text"), F.lit(0)).alias("n_chars"), digest(normalised(F.col("text"))).alias("digest"), F.lit(1).cast("long").alias("n"))


def memtable(entries: DataFrame, *by: str) -> DataFrame:
    """For each digest the row that stays (most code points, then smallest identifier, null last) and the members."""
    best = F.min(F.struct((-F.col("n_chars")).alias("shortest"), *KEY)).alias("best")
    merged = entries.groupBy(*by, "digest").agg(best, F.sum("n").alias("n"))
    return merged.select(*by, "digest", *[F.col(f"best.{c}").alias(c) for c in KEY], (-F.col("best.shortest")).alias("n_chars"), "n")


class MergeIndex:
    """A merge index in a folder: ``levels[i]`` lists the runs of level i, each fan_in times as large as those below."""

    def __init__(self, spark: SparkSession, folder: str, fan_in: int = 4):
        self.spark, self.folder, self.fan_in = spark, folder.rstrip("/"), fan_in
        self.levels: list[list[str]] = [[]]
        self.written = 0

    def _write(self, entries: DataFrame, runs: int) -> list[str]:
        """Flush entries (run, digest, ...) as so many runs, each sorted by digest in its files."""
        path = f"{self.folder}/flush-{self.written:06d}"
        self.written += 1
        spread = max(1, partitions(self.spark) // runs)
        dealt = entries.repartition(partitions(self.spark), "run", F.pmod(F.xxhash64("digest"), F.lit(spread)))
        dealt.sortWithinPartitions("run", "digest").write.option("parquet.bloom.filter.enabled#digest", "true").partitionBy("run").parquet(path)
        return [f"{path}/run={i}" for i in range(runs)]

    def insert(self, entries: DataFrame, flushes: int = 1) -> None:
        """Enter rows of digests(): they fill so many memtables, each flushed as a run of level 0; full levels are compacted."""
        batch = F.pmod(F.xxhash64("id", "sig"), F.lit(flushes)).alias("run")
        self.levels[0] += self._write(memtable(entries.select("*", batch), "run"), flushes)
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fan_in:
                self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merge each fan_in runs of a level into one of the next; the rest stays."""
        runs = self.levels[level]
        full = len(runs) // self.fan_in
        frames = [self._read(runs[i * self.fan_in : (i + 1) * self.fan_in]).withColumn("run", F.lit(i)) for i in range(full)]
        merged = frames[0]
        for f in frames[1:]:
            merged = merged.unionByName(f)
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1] += self._write(memtable(merged, "run"), full)
        self.levels[level] = runs[full * self.fan_in :]

    def _read(self, runs: list[str]) -> DataFrame:
        """Entries of runs; a run that no row fell into has left no files."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        there = [r for r in runs if fs.exists(path(r))]
        kind = "digest binary, none boolean, id long, sig long, n_chars int, n long"
        return self.spark.read.schema(kind).parquet(*there) if there else self.spark.createDataFrame([], kind)

    def entries(self) -> DataFrame:
        """One entry for each digest, merged over all runs."""
        return memtable(self._read([r for runs in self.levels for r in runs]))

    def lookup(self, digest: bytes) -> DataFrame:
        """The entry of one digest; files and row groups without it are passed over by statistics and filters."""
        return memtable(self._read([r for runs in self.levels for r in runs]).where(F.col("digest") == F.lit(digest)))


def _grouped(docs: DataFrame, id_col: str, text_col: str, flushes: int, digest: Callable[[Column], Column]) -> DataFrame:
    """Rows (none, id, sig, digest) with keep (none, id, sig) and members, after byte verification."""
    spark = docs.sparkSession
    rows = stored(digests(docs, id_col, text_col, digest), "digests")
    index = MergeIndex(spark, scratch(spark, "index"))
    index.insert(rows, flushes)
    entries = stored(index.entries().select("digest", F.struct(*KEY).alias("keep"), "n"), "entries")
    found = stored(spread_join(rows.drop("n"), entries, ["digest"]).withColumnRenamed("n", "members"), "found")
    # Hits: members of a digest with several, compared with the bytes that stay.
    members = found.where("members > 1").groupBy(*KEY, "digest").agg(F.first("keep").alias("keep"), F.first("members").alias("members"))
    bodies = keyed(docs, id_col, text_col).select(*KEY, normalised(F.col("text")).alias("body")).join(members.hint("merge"), KEY).dropDuplicates([*KEY, "digest"])
    hits = stored(bodies, "hits")
    staying = stored(hits.where(F.struct(*KEY) == F.col("keep")).select("digest", F.col("body").alias("kept_body"), F.col("members").alias("n")), "staying")
    wrong = stored(spread_join(hits, staying, ["digest"]).where("body <> kept_body").select(*KEY, "digest", "body"), "wrong")
    forget(rows, entries, hits, staying)
    return found if wrong.isEmpty() else _split(found, wrong)


def _split(found: DataFrame, wrong: DataFrame) -> DataFrame:
    """Rows whose bytes are not those that stay, though the digest is, form groups of their own bytes."""
    apart = found.join(wrong, [*KEY, "digest"])
    best = F.min(F.struct((-F.col("n_chars")).alias("shortest"), *KEY)).alias("best")
    groups = apart.groupBy("digest", "body").agg(best, F.count("*").alias("n")).select("digest", "body", F.struct(*[F.col(f"best.{c}").alias(c) for c in KEY]).alias("keep"), F.col("n").alias("members"))
    mine = apart.drop("keep", "members").join(groups, ["digest", "body"]).drop("body")
    lost = groups.groupBy("digest").agg(F.sum("members").alias("lost"))
    rest = found.join(wrong.drop("body"), [*KEY, "digest"], "left_anti").join(lost, "digest", "left")
    rest = rest.withColumn("members", F.col("members") - F.coalesce("lost", F.lit(0))).drop("lost")
    return rest.unionByName(mine)


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", flushes: int = 8, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and all empty texts are equal. Of equal texts the
    one with most code points stays, ties go to the smallest doc_id and a null
    doc_id comes last, whatever the others' values. Rows repeated with doc_id and
    text are copies of one another, and ``kept`` marks each of them if it marks one
    (``staying`` tells how many there are). Texts that share a digest but not their
    bytes are told apart. Other columns are ignored; an empty table gives an empty result.
    """
    found = _grouped(docs, id_col, text_col, flushes, digest)
    kept = F.struct(*KEY) == F.col("keep")
    return found.select(
        named(F.col("none"), F.col("id")).alias("doc_id"), named(F.col("keep.none"), F.col("keep.id")).alias("keep_id"),
        F.col("members").cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def staying(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """none, id, sig, n: the rows that stay, and how often each is repeated in docs (with doc_id and text)."""
    found = _grouped(docs, id_col, text_col, 8, sha256)
    return found.where(F.struct(*KEY) == F.col("keep")).groupBy(*KEY).agg(F.count("*").alias("n"))
