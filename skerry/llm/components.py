"""Connected components over tables of edges: by alternating stars, and in one task what a size check has found to be small."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import forget, spread_join, stored


#: Edges that one task holds at the most (32 bytes each).
GATHER = 500_000


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node each reaches: roots are hooked to smaller ones, then paths are halved."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        if (p == q).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        node, root = labels(*(np.concatenate(x) for x in zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count("*").alias("n")), "low")
    return spread_join(both.where("b > a"), low, ["a"]).select(F.col("b").alias("a"), F.col("low").alias("b")), low


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = stored(down.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")), "low")
    joined = spread_join(down, low, ["a"])
    return joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))), low


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root): root is the smallest node reachable. Nodes without an edge to another are left out.

    Up to GATHER edges go through one task, which is small by that check. Beyond, each half round is written to the shared folder; rounds end when the edges are
    the stars of their roots and stay so. A chain of n nodes takes about log n rounds:
    each round that changes an edge lowers a node, so the rounds come to an end.
    A node with a large share of all edges is dealt over several tasks.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.count() <= GATHER:
        return now.repartition(1).mapInArrow(_in_one_task, "node long, root long")
    seen = None
    while True:
        print_of = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if print_of == seen or not print_of[0]:
            break
        seen = print_of
        large, low = _large_star(now)
        large = stored(large.distinct(), "edges")
        forget(now, low)
        small, low = _small_star(large)
        now = stored(small.distinct(), "edges")
        forget(large, low)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
