"""Per-base counts: coverage, mutations, weights, and read lengths.

Everything is pre-aggregated on the map side to at most one row a base and task,
so a transcript that holds a third of all reads moves no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def along(steps: DataFrame, keys: list[str], length: int | Column) -> DataFrame:
    """base, coverage and mutations of every base, from steps (base, step, marks) summed by base.

    Coverage only changes where a step is, so each step is spread up to the next
    one: no grid of bases is joined, and reads are aggregated once. length is a
    number or, where it differs between keys, a column of keys.
    """
    summed = steps.groupBy(*keys, "base").agg(F.sum("step").alias("step"), F.sum("marks").alias("marks"))
    order = Window.partitionBy(*keys).orderBy("base")
    placed = (
        summed.withColumn("now", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("next", F.least(F.coalesce(F.lead("base").over(order), F.lit(length)), F.lit(length)).cast("long"))
        .withColumn("from", F.when(F.row_number().over(order) == 1, F.lit(0)).otherwise(F.col("base")).cast("long"))
    )
    each = placed.filter("from < next").withColumn("at", F.explode(F.sequence("from", F.col("next") - 1)))
    here = F.col("at") == F.col("base")
    return each.select(*keys, F.col("at").alias("base"), F.when(F.col("at") < F.col("base"), 0).otherwise(F.col("now")).cast("long").alias("coverage"), F.when(here, F.col("marks")).otherwise(0).cast("long").alias("mutations"))


def step(base: Column, by, marks: int) -> Column:
    """A change of coverage at a base, and marks on it."""
    return F.struct(base.cast("long").alias("base"), F.lit(by).cast("long").alias("step"), F.lit(marks).alias("marks"))


def base_coverage(reads: DataFrame, keys: list[str], length: int | Column) -> DataFrame:
    """Reads that cover each base: +1 where a read begins, -1 where it ends, summed along the transcript."""
    ends = F.array(step(F.col("begin"), 1, 0), step(F.col("end"), -1, 0))
    steps = reads.select(*keys, F.explode(ends).alias("s")).select(*keys, "s.*")
    return along(steps, keys, length).drop("mutations")


def base_mutations(mutations: DataFrame, keys: list[str]) -> DataFrame:
    return mutations.groupBy(*keys, "base").agg(F.count(F.lit(1)).alias("mutations"))


def base_stats(reads: DataFrame, keys: list[str], length: int) -> DataFrame:
    """coverage and mutations of every base, in one pass over the reads."""
    ends = F.array(step(F.col("begin"), 1, 0), step(F.col("end"), -1, 0))
    marks = F.transform("idx", lambda i: step(i, 0, 1))
    steps = reads.select(*keys, F.explode(F.concat(ends, marks)).alias("s")).select(*keys, "s.*")
    return along(steps, keys, length)


def base_weights(coverage: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage over the transcript's highest."""
    most = F.max("coverage").over(Window.partitionBy(*keys))
    return coverage.select(*keys, "base", (F.col("coverage") / most).alias("weight"))


def column_means(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Mutations of each base and their share of the reads."""
    n = reads.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    mutated = base_mutations(reads.select(*keys, F.explode("idx").alias("base")), keys)
    return mutated.join(n, keys).select(*keys, "base", "mutations", (F.col("mutations") / F.col("n")).alias("mean"))


def row_means(reads: DataFrame, length: int) -> DataFrame:
    """Mutations of each read and their share of the bases."""
    n = F.size("idx").cast("long")
    return reads.withColumn("mutations", n).withColumn("mean", n / F.lit(length))


def median_read_length(reads: DataFrame, keys: list[str]) -> DataFrame:
    """The upper median, from counts of lengths: no list of lengths is gathered."""
    lengths = reads.groupBy(*keys, (F.col("end") - F.col("begin")).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy(*keys).orderBy("length")
    upto = F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return lengths.withColumn("upto", upto).withColumn("total", total).filter("upto > total div 2").groupBy(*keys).agg(F.min("length").alias("median_length"))


def coverage_p90(coverage: DataFrame, keys: list[str]) -> DataFrame:
    """The element at floor(0.9 n) of the sorted coverages; 0 for none."""
    order = F.array_sort(F.collect_list("coverage"))
    at = F.least(F.floor(F.size("c") * 9 / 10) + 1, F.size("c")).cast("int")
    return coverage.groupBy(*keys).agg(order.alias("c")).select(*keys, F.when(F.size("c") == 0, F.lit(0).cast("long")).otherwise(F.element_at("c", at)).alias("p90"))
