"""Statistics as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import kept


#: Centroids of one block.
BLOCK = 1000


def null_moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("stddev"), F.count(value).alias("n"))


def normalized_cumsum(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """The running sum of the sorted values over their total."""
    along = Window.partitionBy(*keys).orderBy(value, tie)
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn("share", F.sum(value).over(along.rowsBetween(Window.unboundedPreceding, 0)) / total)


def average_rank(value: str, keys: list[str]) -> Column:
    """0-based rank; ties share their mean rank."""
    peers = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) - 1 + (peers - 1) / 2


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    ranked = df.withColumn("__x", average_rank(x, keys)).withColumn("__y", average_rank(y, keys))
    return ranked.groupBy(*keys).agg(F.corr("__x", "__y").alias("rho"))


def mcc(df: DataFrame, keys: list[str], truth: Column, predicted: Column) -> DataFrame:
    """Matthews' correlation coefficient; 0 where a margin is empty."""
    rows = df.select(*keys, truth.cast("int").alias("t"), predicted.cast("int").alias("p"))
    cells = {"tp": "t * p", "fp": "(1 - t) * p", "fn": "t * (1 - p)", "tn": "(1 - t) * (1 - p)"}
    c = rows.groupBy(*keys).agg(*[F.sum(F.expr(e)).cast("double").alias(k) for k, e in cells.items()])
    below = F.sqrt((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) * (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn")))
    return c.select(*keys, F.when(below == 0, 0.0).otherwise((F.col("tp") * F.col("tn") - F.col("fp") * F.col("fn")) / below).alias("mcc"))


def winsorize(df: DataFrame, keys: list[str], value: str, share: float = 0.95) -> DataFrame:
    """Values over their percentile, at most 1."""
    top = df.groupBy(*keys).agg(F.percentile(value, F.lit(share)).alias("__top"))
    return df.join(top, keys).withColumn("winsorized", F.least(F.col(value) / F.col("__top"), F.lit(1.0))).drop("__top")


def unfolded_fraction(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The least-squares factor of f (co-mutation share) on u (the product of profiles), over pairs."""
    return pairs.groupBy(*keys).agg((F.sum(F.col("f") * F.col("u")) / F.sum(F.col("u") * F.col("u"))).alias("fraction"))


def two_tailed(cdf: Column) -> Column:
    return 2 * F.least(cdf, 1 - cdf)


def weibull_cdf(x: Column, shape, scale) -> Column:
    return 1 - F.exp(-F.pow(x / scale, shape))


def weibull_log_likelihood(df: DataFrame, keys: list[str], value: str, shape: float, scale: float) -> DataFrame:
    k, s = F.lit(float(shape)), F.lit(float(scale))
    n = F.count(value)
    return df.groupBy(*keys).agg((n * (F.log(k) - k * F.log(s)) + (k - 1) * F.sum(F.log(value)) - F.sum(F.pow(F.col(value) / s, k))).alias("log_likelihood"))


def weibull_fit(df: DataFrame, keys: list[str], value: str, passes: int = 8, steps: int = 15) -> DataFrame:
    """Shape (at least 1) and scale of positive values by key, by maximum likelihood, from sums alone.

    The likelihood's slope in the shape has one root. A pass over the values finds
    its sign at ``steps`` shapes at once, for every key; the first one at powers of
    two, later ones within the bracket that the last one left. No key's values are
    gathered; the brackets, a row a key, are written between passes.
    """
    z = df.join(df.groupBy(*keys).agg(F.max(value).alias("__top")), keys).select(*keys, (F.col(value) / F.col("__top")).alias("__z"), "__top")
    low, high = F.lit(1.0), F.lit(float(2**steps))
    brackets = z.select(*keys).distinct().select(*keys, low.alias("__low"), high.alias("__high"))
    for number in range(passes):
        at = [F.lit(float(2**j)) if number == 0 else F.col("__low") + (F.col("__high") - F.col("__low")) * j / (steps + 1) for j in range(0 if number == 0 else 1, steps + 1)]
        log = F.log("__z")
        sums = [F.struct(F.sum(F.pow("__z", k) * log).alias("a"), F.sum(F.pow("__z", k)).alias("b"), F.first(k).alias("k")) for k in at]
        rows = z.join(brackets, keys).groupBy(*keys, "__low", "__high").agg(F.avg(log).alias("__mean"), F.array(*sums).alias("__s"))
        falls = F.filter("__s", lambda s: s["a"] / s["b"] - 1 / s["k"] - F.col("__mean") < 0)
        rises = F.filter("__s", lambda s: s["a"] / s["b"] - 1 / s["k"] - F.col("__mean") >= 0)
        new_low = F.coalesce(F.array_max(F.transform(falls, lambda s: s["k"])), "__low")
        new_high = F.coalesce(F.array_min(F.transform(rises, lambda s: s["k"])), "__high")
        brackets = kept(rows.select(*keys, F.least(new_low, new_high).alias("__low"), new_high.alias("__high")))
    shape = (F.col("__low") + F.col("__high")) / 2
    fitted = z.join(brackets.select(*keys, shape.alias("shape")), keys)
    return fitted.groupBy(*keys, "shape").agg((F.pow(F.avg(F.pow("__z", F.col("shape"))), 1 / F.first("shape")) * F.max("__top")).alias("scale"))


def covariance(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.covar_samp(x, y).alias("covariance"), F.var_samp(x).alias("variance"))


def nearest_centroid(points: DataFrame, centroids: DataFrame, point_id: str, vector: str) -> DataFrame:
    """Each point's nearest centroid by squared distance; the smaller number wins ties. centroids: number, centre.

    Centroids come in blocks of BLOCK, an array a row. One block is broadcast; more
    are joined, a point meeting each block once, and its best block is aggregated.
    """
    blocks = max(1, -(-centroids.count() // BLOCK))
    block = F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int")
    table = centroids.groupBy(block.alias("__block")).agg(F.sort_array(F.collect_list(F.struct(F.col("number").cast("long").alias("number"), F.col("centre").cast("array<double>").alias("centre")))).alias("__c"))
    asked = points.select(point_id, vector, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block"))
    distance = F.transform("__c", lambda c: F.struct(F.aggregate(F.zip_with(c["centre"], F.col(vector), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d"), c["number"].alias("number")))
    best = asked.join(F.broadcast(table) if blocks == 1 else table, "__block").select(point_id, F.array_min(distance).alias("m"))
    if blocks > 1:
        best = best.groupBy(point_id).agg(F.min("m").alias("m"))
    return best.select(point_id, F.col("m.number").alias("number"), F.col("m.d").alias("distance"))


def tiny_encode(x: Column) -> Column:
    """A share in [0, 1] in 255ths, rounded; null beyond."""
    return F.when((x >= 0) & (x <= 1), F.floor(x * 255 + 0.5).cast("smallint"))


def tiny_decode(x: Column) -> Column:
    return x / F.lit(255.0)


def tiny_add(a: Column, b: Column) -> Column:
    """The sum of two encoded shares, in a wider type: it may go beyond 1."""
    return (a.cast("int") + b.cast("int")).cast("int")


def tiny_subtract(a: Column, b: Column) -> Column:
    """Null below 0."""
    return F.when(a >= b, (a - b).cast("smallint"))


def tiny_multiply(a: Column, b: Column) -> Column:
    """The product of two encoded shares, cut to a whole 255th."""
    return F.floor(a.cast("int") * b.cast("int") / 255).cast("int")


def tiny_divide(a: Column, by: Column) -> Column:
    """An encoded share over a whole number, cut; null over 0."""
    return F.when(by != 0, F.floor(a / by).cast("smallint"))


def null_distance(gap: Column, mean: Column, sd: Column) -> Column:
    """How far beyond one standard deviation of the null model a gap lies."""
    return F.greatest(F.abs(gap - mean) - sd, F.lit(0.0))
