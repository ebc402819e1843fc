"""A training corpus from the documents table: five stages, each over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skerry.llm import stages
from skerry.llm.common import forget, intermediates, stored, table

STAGES = [
    ("quality classifier", stages.drop_low_quality),
    ("exact dedup", stages.drop_exact_copies),
    ("n-gram Jaccard join", stages.drop_near_copies),
    ("mixing sources to target weights", stages.mix_sources),
    ("packing", stages.pack_sequences),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again, the last one by its stage."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with intermediates(spark) as keep:
            docs = keep(stored(stage(spark, docs, sf_dir), name.split()[0]))
        forget(*before)
        before = [docs]
    pieces = STAGES[-1][1](spark, docs, sf_dir)
    forget(*before)
    return pieces
