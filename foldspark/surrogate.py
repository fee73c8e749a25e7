"""Reads, windows, weights and the like over the driver's tables.

The tables hold no sequencing reads; these views stand in for them, in Spark and
(SQL) in the same words for a second engine.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import merge
from .tables import table

#: Length of a surrogate transcript.
LENGTH = 60

SQL = f"""
mutations as (select distinct l_suppkey % 4 as transcript_id, l_orderkey as read_id, l_partkey % {LENGTH} as base from lineitem),
reads as (select transcript_id, read_id, read_id % 3 as replicate, greatest(0, min(base) - read_id % 10) as b,
  least({LENGTH}, max(base) + 1 + read_id % 7) as e from mutations group by transcript_id, read_id),
grid as (select transcript_id, base from (select distinct transcript_id from mutations), (select unnest(generate_series(0, {LENGTH - 1})) as base)),
coverage as (select g.transcript_id, g.base, count(r.read_id) as coverage from grid g left join reads r
  on r.transcript_id = g.transcript_id and r.b <= g.base and g.base < r.e group by 1, 2),
mutated as (select g.transcript_id, g.base, count(m.read_id) as mutations from grid g left join mutations m
  on m.transcript_id = g.transcript_id and m.base = g.base group by 1, 2),
stats as (select transcript_id, base, coverage, mutations from coverage join mutated using (transcript_id, base))
"""


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transcript_id, read_id, base; one row a mutated base of a read."""
    items = table(spark, sf_dir, "lineitem")
    return items.select((F.col("l_suppkey") % 4).alias("transcript_id"), F.col("l_orderkey").alias("read_id"), (F.col("l_partkey") % LENGTH).alias("base")).distinct()


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transcript_id, read_id, replicate, begin, end (exclusive) and idx, the sorted mutated bases.

    Grouped straight from the items: collect_set makes bases distinct, so a read's rows move once.
    """
    items = table(spark, sf_dir, "lineitem")
    each = items.select((F.col("l_suppkey") % 4).alias("transcript_id"), F.col("l_orderkey").alias("read_id"), (F.col("l_partkey") % LENGTH).alias("base"))
    by = each.groupBy("transcript_id", "read_id").agg(F.min("base").alias("lo"), F.max("base").alias("hi"), F.sort_array(F.collect_set("base")).alias("idx"))
    return by.select(
        "transcript_id", "read_id", (F.col("read_id") % 3).alias("replicate"), F.greatest(F.lit(0).cast("long"), F.col("lo") - F.col("read_id") % 10).alias("begin"),
        F.least(F.lit(LENGTH).cast("long"), F.col("hi") + 1 + F.col("read_id") % 7).alias("end"), "idx",
    )


def nucleotide(base):
    return F.substring(F.lit("ACGT"), (base % 4 + 1).cast("int"), F.lit(1))


def merge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of as many bases as a vector has components, two clusters, four to a region."""
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") / 4).cast("long").alias("region"), F.col("vec_id"), F.col("embedding").alias("v"))


def merge_window(row) -> merge.Merged:
    w = np.abs(np.array(list(row.v), dtype=float))
    w = w / w.max()
    return merge.single(16 * (row.vec_id % 4), np.column_stack([w, 1 - w]), np.full(len(w), 100 + row.vec_id % 7))
