"""The base-base graph: clipped adjacency, degrees, Laplacian cells, cut scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def adjacency_clip(matrix: DataFrame, keys: list[str], most: float) -> DataFrame:
    """Cells i < j (upper triangle) with n set to 0 where it exceeds ``most`` times the mutations of base i."""
    # A base's own count stands in the same rows of the triangle: a window, not a join with the diagonal.
    own = F.max(F.when(F.col("i") == F.col("j"), F.col("n"))).over(Window.partitionBy(*keys, "i"))
    pairs = matrix.withColumn("own", F.coalesce(own, F.lit(0))).filter("i < j")
    return pairs.select(*keys, "i", "j", F.when(F.col("n") > most * F.col("own"), F.lit(0).cast("long")).otherwise(F.col("n")).alias("n"))


def degree(pairs: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """Row sums of the symmetric matrix with a zero diagonal, from its upper triangle."""
    ends = pairs.select(*keys, F.explode(F.array("i", "j")).alias("i"), value)
    return ends.groupBy(*keys, "i").agg(F.sum(value).alias("degree"))


def normalized_laplacian(pairs: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """Cells i <= j of the symmetric normalized Laplacian; degrees below 1e-4 count as 1."""
    degrees = degree(pairs, keys, value)
    used = degrees.withColumn("d", F.when(F.col("degree") < 1e-4, F.lit(1.0)).otherwise(F.col("degree").cast("double")))
    a, b = (used.select(*keys, F.col("i").alias(c), F.col("d").alias(f"d_{c}")) for c in "ij")
    off = pairs.filter(F.col(value) != 0).join(a, [*keys, "i"]).join(b, [*keys, "j"]).select(*keys, "i", "j", (-F.col(value) / F.sqrt(F.col("d_i") * F.col("d_j"))).alias("cell"))
    on = degrees.select(*keys, "i", F.col("i").alias("j"), F.when(F.col("degree") < 1e-4, F.col("degree").cast("double")).otherwise(F.lit(1.0)).alias("cell"))
    return off.unionByName(on)


def cut_scores(edges: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """cut(c, rest) / cut(c, c) of each cluster, for edges i, j, g (both directions) and weights base, cluster, weight."""
    a = weights.select(*keys, F.col("base").alias("i"), "cluster", F.col("weight").alias("wi"))
    b = weights.select(*keys, F.col("base").alias("j"), "cluster", F.col("weight").alias("wj"))
    terms = edges.join(a, [*keys, "i"]).join(b, [*keys, "j", "cluster"])
    sums = terms.groupBy(*keys, "cluster").agg(F.sum(F.col("g") * F.col("wi") * F.col("wj")).alias("inner"), F.sum(F.col("g") * F.col("wi") * (1 - F.col("wj"))).alias("across"))
    return sums.select(*keys, "cluster", F.when(F.col("inner") == 0, F.lit(None).cast("double")).otherwise(F.col("across") / F.col("inner")).alias("score"))


def log_graph(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The graph that is cut: ln(1 + co-mutation) off the diagonal, normalized by both degrees, negated as in a Laplacian."""
    logged = pairs.select(*keys, "i", "j", F.log1p(F.col("n").cast("double")).alias("w")).filter("w > 0")
    d = degree(logged, keys, "w")
    a, b = (d.select(*keys, F.col("i").alias(c), F.col("degree").alias(f"d_{c}")) for c in "ij")
    half = logged.join(a, [*keys, "i"]).join(b, [*keys, "j"]).select(*keys, "i", "j", (-F.col("w") / F.sqrt(F.col("d_i") * F.col("d_j"))).alias("g"))
    return half.unionByName(half.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "g"))
