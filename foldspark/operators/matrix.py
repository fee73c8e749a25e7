"""Rows and columns of read matrices: slices, subsets, order, numbers, projections; and the algebra of weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key that one window numbers; read numbers are dense, so this is how far they reach.
SPAN = 1 << 16


def numbered(rows: DataFrame, keys: list[str], order: str = "read_id", name: str = "row") -> DataFrame:
    """Rows with their number, from 0, along a dense numeric column.

    Rows are numbered within stretches of the column and stretches are counted
    before each other, so a key with a third of all rows isn't one task's work.
    """
    part = rows.withColumn("__part", F.floor(F.col(order) / SPAN))
    counts = part.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).drop("__n")
    local = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(order)) - 1
    return part.withColumn("__local", local).join(before, [*keys, "__part"]).withColumn(name, F.col("__before") + F.col("__local")).drop("__part", "__local", "__before")


def without_columns(reads: DataFrame, begin: int, end: int) -> DataFrame:
    """Reads without the bases [begin, end): later ones move down."""
    left = F.filter("idx", lambda i: (i < begin) | (i >= end))
    return reads.withColumn("idx", F.transform(left, lambda i: F.when(i >= end, i - (end - begin)).otherwise(i)))


def spliced(sequence: Column, begin: int, end: int) -> Column:
    """A sequence without [begin, end)."""
    return F.concat(F.substring(sequence, 1, begin), F.substring(sequence, F.lit(end + 1), F.length(sequence)))


def without_rows(reads: DataFrame, keys: list[str], first: int, stop: int) -> DataFrame:
    """Reads without the rows [first, stop) of each key, in the order of read_id."""
    return numbered(reads, keys).filter((F.col("row") < first) | (F.col("row") >= stop)).drop("row")


def resized(reads: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The first ``size`` rows of each key, and as many empty ones as are missing (read_id -1, -2, ...)."""
    rows = numbered(reads, keys).filter(F.col("row") < size).drop("row")
    n = reads.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") < size)
    added = n.select(*keys, F.explode(F.sequence(F.lit(-1).cast("long"), F.col("__n") - size, F.lit(-1).cast("long"))).alias("read_id"))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "idx" else F.array().cast(f.dataType).alias("idx") for f in reads.schema if f.name not in [*keys, "read_id"]]
    return rows.unionByName(added.select(*keys, "read_id", *blank))


def scaled_coverage(coverage: Column, before: Column, after: Column) -> Column:
    """Coverage in proportion to the rows that are left, cut to a whole number."""
    return F.floor(coverage / before * after)


def subset(reads: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """The reads whose keys and read_id are listed."""
    return reads.join(ids.select(*keys, "read_id").distinct(), [*keys, "read_id"], "left_semi")


def row_order() -> Column:
    """What rows are compared by: begin, end, then the mutated bases in order."""
    return F.struct("begin", "end", "idx")


def projected(reads: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Each read times a matrix: the sum of the matrix's rows (base, vector) at the read's mutated bases.

    The matrix of a key comes as one list of rows, by base, so reads aren't
    multiplied by bases and columns.
    """
    rows = vectors.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("base").cast("long"), "vector"))).alias("__rows"), F.max(F.size("vector")).alias("__size"))
    zero = F.array_repeat(F.lit(0.0), F.col("__size"))
    total = F.aggregate("idx", zero, lambda s, i: F.zip_with(s, F.coalesce(F.element_at("__rows", i.cast("long")), zero), lambda a, b: a + b))
    return reads.join(rows, keys).withColumn("projection", total).drop("__rows", "__size")


def remap_patterns(patterns: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Mutations of each cluster on every base of the grid (keys, cluster, base); 0 where there are none."""
    return grid.join(patterns, [*keys, "cluster", "base"], "left").select(*keys, "cluster", "base", F.coalesce("mutations", F.lit(0).cast("long")).alias("mutations"))


# Weights: w[base][cluster]


def complement(w: Column) -> Column:
    return F.transform(w, lambda b: F.transform(b, lambda x: 1 - x))


def only_first(w: Column) -> Column:
    """All weight in the first cluster."""
    return F.transform(w, lambda b: F.transform(b, lambda x, c: F.when(c == 0, 1.0).otherwise(0.0)))


def removed(w: Column) -> Column:
    return F.transform(w, lambda b: F.transform(b, lambda x: F.lit(0.0)))


def weight_order(w: Column) -> Column:
    """What weights are compared by: their numbers of bases and of clusters, then the weights in order."""
    return F.struct(F.size(w).alias("bases"), F.size(F.element_at(w, 1)).alias("clusters"), F.flatten(w).alias("weights"))


def hard_complement(labels: Column, clusters: int) -> Column:
    """For each base the clusters it isn't in; all for one without a label."""
    every = F.sequence(F.lit(0), F.lit(clusters - 1))
    return F.transform(labels, lambda label: F.filter(every, lambda c: label.isNull() | (c != label)))


def best_of(rows: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The row of least score by key; scores that are null or no number lose, ties go to the smaller ``tie``."""
    worst = F.col(score).isNull() | F.isnan(score)
    first = F.min(F.struct(worst.alias("w"), score, tie))
    return rows.groupBy(*keys).agg(first.alias("b")).select(*keys, F.when(~F.col("b.w"), F.col(f"b.{score}")).alias(score), F.col(f"b.{tie}").alias(tie))


def isolated(pairs: DataFrame, bases: DataFrame, keys: list[str]) -> DataFrame:
    """Bases without any weight to another one: a graph that holds one isn't cut."""
    linked = pairs.filter("n > 0").select(*keys, F.explode(F.array("i", "j")).alias("base")).distinct()
    return bases.select(*keys, "base").join(linked, [*keys, "base"], "left_anti")


def without_small_spans(labels: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Runs shorter than ``least`` windows take the label before them; a short first run takes the next one's."""
    from .windows import islands

    runs = islands(labels, keys, "window_idx", ["n_clusters"])
    spans = runs.groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("size"), F.first("n_clusters").alias("label"))
    along = Window.partitionBy(*keys).orderBy("island")
    first = F.when(F.row_number().over(along) == 1, F.coalesce(F.lead("label").over(along), F.col("label")))
    own = spans.withColumn("own", F.when(F.col("size") >= least, F.col("label")).otherwise(first))
    filled = own.withColumn("n_clusters", F.last("own", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))).select(*keys, "island", "n_clusters")
    return runs.drop("n_clusters").join(filled, [*keys, "island"]).select(*keys, "window_idx", "n_clusters")
