"""Connected components of links, by alternating star contractions.

Large-star and small-star steps (Kiveris et al., 2014) in DataFrame operations:
each halves the paths without ever gathering a node's neighbours in one task; a
node's smallest neighbour is an aggregate with partial sums on the map side and
is joined back, a join whose skew adaptive execution splits. Before the first
step each partition replaces its links by a spanning forest. Rounds are written
to the shared folder, so lineage stays short and lost executors don't matter.
Where at most ONE_TASK links are left after that, one task finds the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, kept

#: Links (16 bytes each) that one task may hold.
ONE_TASK = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its part) that join what a and b join."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, u, v = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        new = np.minimum(new[label], new)
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _forests(links: DataFrame, whole: bool = False) -> DataFrame:
    """A forest for each batch of links, or for each partition."""

    def one(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([t.column(i).to_numpy(zero_copy_only=False) for t in tables]) for i in (0, 1))
        u, v = forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if whole:
            tables = [t for t in batches if t.num_rows]
            if tables:
                yield one(tables)
        else:
            for t in batches:
                if t.num_rows:
                    yield one([t])

    return links.mapInArrow(run, "u long, v long")


def _named(stars: DataFrame) -> DataFrame:
    named = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node and component (its smallest node) of every node that a link (two long columns) names."""
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v")
    edges = compact(_forests(edges).distinct())
    if edges.count() <= one_task:
        return _named(compact(_forests(edges.coalesce(1), whole=True)))
    before = None
    while True:  # labels only fall, so the rounds end
        # Large star: every larger neighbour of a node is linked to the node's smallest one.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node's smaller neighbours and itself are linked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return _named(edges)
        before = state
