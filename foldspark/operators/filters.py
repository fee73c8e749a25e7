"""Base, read and transcript filters, and the maps between old and new indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def whitelist_filter(df: DataFrame, ids: DataFrame, id_col: str = "transcript_id", most_broadcast: int = 1_000_000) -> DataFrame:
    """Rows whose id, whatever its case, is in the list; the list is broadcast only if it is short."""
    wanted = ids.select(F.lower(ids.columns[0]).alias("__id")).distinct()
    short = ids.limit(most_broadcast + 1).count() <= most_broadcast
    return df.join(F.broadcast(wanted) if short else wanted, F.lower(df[id_col]) == F.col("__id"), "left_semi")


def base_alphabet(nucleotide: Column, shape: bool = False) -> Column:
    """Bases that the probe modifies: A and C, or all."""
    return F.lit(True) if shape else F.upper(nucleotide).isin("A", "C")


def base_quality(min_coverage, min_mutations, min_freq: float, first: bool = True, at_least: bool = False) -> Column:
    """Predicate on coverage and mutations.

    The one-replicate filter asks for more than min_mutations, the one over
    replicates (at_least) for as many; a refilter (not first) only looks at mutations.
    """
    many = F.col("mutations") >= min_mutations if at_least else F.col("mutations") > min_mutations
    return many & (F.col("coverage") >= min_coverage) & (F.col("mutations") / F.col("coverage") > min_freq) if first else many


def keep_bases(reads: DataFrame, bases: DataFrame, keys: list[str]) -> DataFrame:
    """Reads with only the kept bases in idx: a list of bases for each key is joined, not every mutation.

    The list has at most a transcript's length, and there is one a key.
    """
    lists = bases.groupBy(*keys).agg(F.collect_set("base").alias("__kept"))
    return reads.join(lists, keys, "left").withColumn("idx", F.when(F.col("__kept").isNull(), F.slice("idx", 1, 0)).otherwise(F.filter("idx", lambda i: F.array_contains("__kept", i)))).drop("__kept")


def replicate_bases(stats: DataFrame, keys: list[str], passes: Column) -> DataFrame:
    """Bases that pass in every replicate (stats has one row a replicate and base), numbered anew from 0."""
    replicates = F.size(F.collect_set("replicate").over(Window.partitionBy(*keys)))
    kept = stats.withColumn("__all", replicates).groupBy(*keys, "base").agg(F.bool_and(passes).alias("ok"), F.count(F.lit(1)).alias("n"), F.max("__all").alias("all")).filter("ok and n = all")
    return kept.select(*keys, "base", (F.row_number().over(Window.partitionBy(*keys).orderBy("base")) - 1).alias("column"))


def read_filter(reads: DataFrame, min_mutations: int) -> DataFrame:
    return reads.filter(F.size("idx") >= min_mutations)


def long_enough(size) -> Column:
    """Reads shorter than a window don't count when reads are assigned."""
    return F.col("end") - F.col("begin") >= size


def mask_filter(reads: DataFrame, mask: str) -> DataFrame:
    """Keep the bases where the 0/1 mask has 1."""
    return reads.withColumn("idx", F.filter("idx", lambda i: F.substring(F.lit(mask), (i + 1).cast("int"), F.lit(1)) == "1"))


def transpose(mutations: DataFrame, keys: list[str]) -> DataFrame:
    """Base to the sorted list of reads that carry it."""
    return mutations.groupBy(*keys, "base").agg(F.sort_array(F.collect_list("read_id")).alias("read_ids"))


def unfilter_weights(weights: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Weights of kept bases put back on every base; 0 where a base was dropped."""
    return grid.join(weights, [*keys, "base", "cluster"], "left").select(*keys, "base", "cluster", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def analysis_guard(min_reads: int, min_bases: int) -> Column:
    """Why a window has no clusters, from its counts n_reads and n_bases; ok where it may have."""
    return F.when(F.col("n_reads") < min_reads, "few reads").when(F.col("n_bases") < min_bases, "few bases").otherwise("ok")


def capped(n: Column, cap: Column) -> Column:
    return F.least(n, F.coalesce(cap, n))


def all_uninformative_to_one(consensus: DataFrame, keys: list[str]) -> DataFrame:
    """Where no window of a transcript is informative, each has one cluster."""
    most = F.max("n_clusters").over(Window.partitionBy(*keys))
    return consensus.withColumn("n_clusters", F.when(most == 0, F.lit(1).cast("long")).otherwise(F.col("n_clusters")))
