"""Set operations over datasets of reads, and small combinatorics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two datasets has more often, with the surplus (below 0: b's): none if they are equal.

    One aggregation over both instead of two differences.
    """
    cols = a.columns
    both = a.withColumn("__n", F.lit(1)).unionByName(b.select(*cols).withColumn("__n", F.lit(-1)))
    return both.groupBy(*cols).agg(F.sum("__n").alias("surplus")).filter("surplus != 0")


def combinations(df: DataFrame, col: str, k: int) -> DataFrame:
    """All k-subsets, ascending, of the distinct values of a short column."""
    values = df.select(col).distinct()
    out = values.select(F.col(col).alias("c1"))
    for i in range(2, k + 1):
        out = out.join(values.select(F.col(col).alias(f"c{i}")), F.col(f"c{i - 1}") < F.col(f"c{i}"))
    return out
