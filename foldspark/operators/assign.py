"""Reads to conformations: unique reads, assignment with ties, fractions, patterns, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .coverage import along, step
from .joins import cluster_scores


def unique_reads(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Equal reads (ends and mutated bases) counted once; a map-side aggregate, so copies cost nothing later."""
    return reads.groupBy(*keys, "begin", "end", "idx").agg(F.count(F.lit(1)).alias("occurrences"))


def assign(unique: DataFrame, weights: DataFrame, keys: list[str], skip_ambiguous: bool = False) -> DataFrame:
    """(unique read, cluster, reads assigned): the best score takes all; ties share evenly and leave the remainder out."""
    key = [*keys, "begin", "end", "idx"]
    scored = cluster_scores(unique.select(*key, "occurrences"), weights, keys)
    listed = scored.groupBy(*key, "occurrences").agg(F.collect_list(F.struct("cluster", "score")).alias("s"))
    best = F.array_max(F.transform("s", lambda x: x["score"]))
    tied = listed.withColumn("__best", best).withColumn("tied", F.sort_array(F.transform(F.filter("s", lambda x: x["score"] == F.col("__best")), lambda x: x["cluster"])))
    each = tied.withColumn("ties", F.size("tied").cast("long")).withColumn("cluster", F.explode("tied"))
    share = F.expr("occurrences div ties")
    out = each.select(*key, "cluster", "ties", (F.when(F.col("ties") > 1, F.lit(0).cast("long")).otherwise(share) if skip_ambiguous else share).alias("assigned"))
    return out


def read_clusters(reads: DataFrame, assigned: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """The cluster of each read: copies of a unique read are numbered in the order of a seeded hash and dealt out.

    They are numbered within stretches of the hash, and stretches counted before
    each other, so the copies of one read are no one task's work.
    """
    key = [*keys, "begin", "end", "idx"]
    hashed = reads.withColumn("__h", F.xxhash64(F.lit(seed), "read_id")).withColumn("__part", F.shiftright("__h", 54))
    parts = hashed.groupBy(*key, "__part").agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")
    local = F.row_number().over(Window.partitionBy(*key, "__part").orderBy("__h", "read_id")) - 1
    placed = hashed.withColumn("__local", local).join(parts.withColumn("__before", before).drop("__size"), [*key, "__part"])
    numbered = placed.withColumn("__n", F.col("__before") + F.col("__local")).drop("__h", "__part", "__local", "__before")
    upto = Window.partitionBy(*key).orderBy("cluster").rowsBetween(Window.unboundedPreceding, 0)
    slots = assigned.withColumn("__to", F.sum("assigned").over(upto)).withColumn("__from", F.col("__to") - F.col("assigned"))
    slots = slots.groupBy(*key).agg(F.collect_list(F.struct("cluster", "__from", "__to")).alias("__slots"))
    found = F.filter("__slots", lambda s: (F.col("__n") >= s["__from"]) & (F.col("__n") < s["__to"]))
    return numbered.join(slots, key).withColumn("cluster", F.try_element_at(found, F.lit(1))["cluster"]).drop("__n", "__slots")


def cluster_fractions(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Each cluster's share of the assigned reads; 1 for a lone cluster without reads, else 0."""
    by = assigned.groupBy(*keys, "cluster").agg(F.sum("assigned").alias("n"))
    total, clusters = (f.over(Window.partitionBy(*keys)) for f in (F.sum("n"), F.count(F.lit(1))))
    share = F.when(F.col("total") > 0, F.col("n") / F.col("total")).when(F.col("clusters") == 1, 1.0).otherwise(0.0)
    return by.withColumn("total", total).withColumn("clusters", clusters).select(*keys, "cluster", "n", share.alias("fraction"))


def cluster_patterns(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Mutations of each cluster at each base."""
    return assigned.select(*keys, "cluster", F.explode("idx").alias("base"), "assigned").groupBy(*keys, "cluster", "base").agg(F.sum("assigned").alias("mutations"))


def cluster_coverage(assigned: DataFrame, keys: list[str], length: int | Column) -> DataFrame:
    """Assigned reads that cover each base of each cluster."""
    ends = F.array(step(F.col("begin"), F.col("assigned"), 0), step(F.col("end"), -F.col("assigned"), 0))
    steps = assigned.select(*keys, "cluster", F.explode(ends).alias("s")).select(*keys, "cluster", "s.*")
    return along(steps, [*keys, "cluster"], length).drop("mutations")


def region_reads_once(window_reads: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Reads of a region's windows, each once."""
    return window_reads.join(regions, [*keys, "window_idx"]).select(*keys, "region_idx", "read_id", "begin", "end").distinct()
