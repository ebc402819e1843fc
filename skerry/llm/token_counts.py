"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by encoded length, within each task first. Suffix
sums over the lengths then answer, for every context limit at once: how many
documents and tokens there are up to it and beyond it, which quantile it is, and
how many tokens are left when longer documents are cut there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.common import chunks, stored
from skerry.llm.packing import encoder_of, tokenizer_file

#: Lengths of one block of the suffix sums.
BLOCK = 1024


def histogram(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text") -> DataFrame:
    """length, docs: how many documents encode to that many tokens. Null and empty texts have length 0.

    Whole texts are encoded; rows count one by one, repeated or not; an empty
    table gives an empty histogram; other columns are ignored.
    """
    path = tokenizer or tokenizer_file()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = encoder_of(path), Counter()
        for _, texts in chunks(batches, "text"):
            seen.update([len(encoder.encode(t)) for t in texts])
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["length", "docs"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "length long, docs long")
    return found.groupBy("length").agg(F.sum("docs").alias("docs"))


def sums(lengths: DataFrame) -> DataFrame:
    """For each length: docs, tokens, those up to it and beyond it, its quantile, and the tokens left if texts are cut there.

    For a limit between two lengths take the row below it: tokens left are
    ``tokens_up_to + limit * docs_beyond``.
    """
    lengths = stored(lengths, "histogram")  # read twice below, and counting encodes the corpus
    rows = lengths.withColumn("tokens", F.col("length") * F.col("docs")).withColumn("block", F.floor(F.col("length") / BLOCK))
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row for each 1,024 lengths
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = blocks.select("block", *[(F.sum(f"block_{c}").over(later) - F.col(f"block_{c}")).alias(f"after_{c}") for c in ("docs", "tokens")], *[F.sum(f"block_{c}").over(whole).alias(f"all_{c}") for c in ("docs", "tokens")])
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(ends, "block")
    beyond = {c: F.sum(c).over(within) - F.col(c) + F.col(f"after_{c}") for c in ("docs", "tokens")}
    out = joined.select("length", "docs", "tokens", beyond["docs"].alias("docs_beyond"), beyond["tokens"].alias("tokens_beyond"), "all_docs", "all_tokens")
    return out.select(
        "length", "docs", "tokens", "docs_beyond", "tokens_beyond", (F.col("all_docs") - F.col("docs_beyond")).alias("docs_up_to"), (F.col("all_tokens") - F.col("tokens_beyond")).alias("tokens_up_to"),
        ((F.col("all_docs") - F.col("docs_beyond")) / F.col("all_docs")).alias("quantile"), (F.col("all_tokens") - F.col("tokens_beyond") + F.col("length") * F.col("docs_beyond")).alias("tokens_if_cut"),
    )
