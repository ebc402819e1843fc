"""The operators as stages that take and return tables with the columns of documents.

Rows are told apart by doc_id and text together, so rows that share a doc_id are
judged each by itself; null doc_ids are identifiers like others, the largest.
Helper columns live beside a struct of the whole row: no extra column can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import exact_dedup, jaccard_join, mixing, packing, quality
from skerry.llm.common import packed, spread_join, stored, table, text_key, word_count

#: Texts that packing hands to Python at once; by Spark's own bound a task hands over up to 64 MB, beside the executor's heap.
BATCH_BYTES = 4 << 20


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of docs listed in kept (none, id, sig, n); a row that n repeats of are in docs comes once."""
    kept = stored(kept, "kept")
    rows = packed(docs, none=F.col("doc_id").isNull(), id=F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), sig=text_key(F.col("text")))
    joined = spread_join(rows, kept, exact_dedup.KEY)
    if not kept.where("n > 1").isEmpty():
        joined = joined.where("n = 1").unionByName(joined.where("n > 1").dropDuplicates(exact_dedup.KEY))
    return joined.select("row.*")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among docs, predicts as label 1.

    Without labels of both kinds every document scores 0.5 and stays. Null texts
    are judged as empty ones, whole texts whatever their length, repeated rows alike.
    """
    network = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score(packed(docs, text=F.col("text")), network).where("predicted = 1").select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (white space apart): the one that exact_dedup keeps.

    Null texts are empty ones, and one row of all empty texts stays. Of a row
    repeated with doc_id and text one stays.
    """
    return only(docs, exact_dedup.staying(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at a Jaccard similarity of 0.8: the smallest doc_id, then text_key.

    Rows without words (null texts too) link with nothing and all stay.
    """
    rows = only(docs.where(word_count(F.col("text")) > 0), jaccard_join.representatives(docs, n=5, percent=80))
    return rows.unionByName(docs.where(word_count(F.col("text")) == 0))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 2 times), as rows of their own.

    Null sources are a source of their own. Texts without words (null ones too)
    cost nothing and stay once. Rows repeated with all their columns fare alike.
    """
    rows = packed(docs, doc_id=F.col("doc_id"), sources=F.array(F.col("source").cast("string")), words=word_count(F.col("text")), sig=text_key(F.col("text")))
    mixed = mixing.mix(rows, F.col("sources"), F.col("words"), tell_apart=["sig"])
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, see packing.pack: null and empty texts give one piece, repeated rows pieces of their own.

    They are stored, so that batches of texts are small whoever reads the result.
    """
    return stored(packing.pack(docs), "pieces", batch_bytes=BATCH_BYTES)
