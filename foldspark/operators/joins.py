"""The joins: containment and overlap of reads and windows, co-mutation, scores, alignment of replicates.

Range joins are rewritten: the windows that a read covers follow from its ends by
arithmetic, so they are exploded and need no theta join. Co-mutated pairs come
from each read's own list, so no row meets another by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_reads(reads: DataFrame, size, count, step) -> DataFrame:
    """(read, window_idx) of the windows that a read covers whole, idx clipped to the window and counted from its start.

    size, count and step are numbers or columns of reads. Window i starts at
    floor(i * step + 0.5). The bounds are widened by one window and checked.
    """
    size, count, step = (x if isinstance(x, Column) else F.lit(x) for x in (size, count, step))
    step = step.cast("double")
    start = F.floor(F.col("window_idx") * step + 0.5)
    last = (count - 1).cast("long")
    low = F.when(step > 0, F.greatest(F.lit(0).cast("long"), F.floor((F.col("begin") - 1) / step))).otherwise(F.lit(0).cast("long"))
    high = F.when(step > 0, F.least(last, F.ceil((F.col("end") - size + 1) / step))).otherwise(last)
    some = reads.withColumn("__low", low).withColumn("__high", high).filter("__low <= __high")
    each = some.withColumn("window_idx", F.explode(F.sequence("__low", "__high"))).withColumn("start", start)
    inside = each.filter((F.col("begin") <= F.col("start")) & (F.col("end") >= F.col("start") + size))
    clipped = F.transform(F.filter("idx", lambda i: (i >= F.col("start")) & (i < F.col("start") + size)), lambda i: i - F.col("start"))
    return inside.withColumn("idx", clipped).drop("__low", "__high")


def region_reads(reads: DataFrame, regions: DataFrame, keys: list[str], min_mutations: int, length: Column | None = None) -> DataFrame:
    """Reads with enough mutations inside a region; regions has region_idx, start, stop, a few rows a key.

    With the sequence's length, a lone region that is the whole sequence takes all reads.
    """
    lists = regions.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("region_idx", "start", "stop"))).alias("__regions"))
    each = reads.join(lists, keys).withColumn("r", F.explode(F.filter("__regions", lambda r: (F.col("begin") < r["stop"]) & (F.col("end") > r["start"]))))
    inside = F.transform(F.filter("idx", lambda i: (i >= F.col("r.start")) & (i < F.col("r.stop"))), lambda i: i - F.col("r.start"))
    enough = F.size("idx") >= min_mutations
    if length is not None:
        enough = enough | ((F.size("__regions") == 1) & (F.col("r.start") <= 0) & (F.col("r.stop") >= length))
    return each.withColumn("idx", inside).filter(enough).withColumn("region_idx", F.col("r.region_idx")).drop("__regions", "r")


def comutation_pairs(idx: Column) -> Column:
    """All pairs i <= j of one read's mutated bases."""
    return F.flatten(F.transform(idx, lambda i: F.transform(F.filter(idx, lambda j: j >= i), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def comutation_matrix(reads: DataFrame, keys: list[str], occurrences: str | None = None) -> DataFrame:
    """Upper triangle with diagonal: reads that carry both bases; a row may stand for several reads."""
    n = F.lit(1).cast("long") if occurrences is None else F.col(occurrences)
    return reads.select(*keys, n.alias("__n"), F.explode(comutation_pairs(F.col("idx"))).alias("p")).groupBy(*keys, "p.i", "p.j").agg(F.sum("__n").alias("n"))


def comutation_weighted(matrix: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Cells over the root of both bases' weights; bases without weight are skipped."""
    some = weights.filter("weight > 0")
    a, b = (some.select(*keys, F.col("base").alias(c), F.col("weight").alias(f"w_{c}")) for c in "ij")
    return matrix.join(a, [*keys, "i"]).join(b, [*keys, "j"]).select(*keys, "i", "j", (F.col("n") / F.sqrt(F.col("w_i") * F.col("w_j"))).alias("w"))


def intersection_count(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("long")


def cluster_scores(reads: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Score of each read with each cluster: the sum of the cluster's weights at its mutated bases.

    The weights of a key come as dense arrays, one a cluster, made once a key:
    reads aren't multiplied by bases, and a weight is found by its place.
    """
    rows = weights.groupBy(*keys, "cluster").agg(F.map_from_entries(F.collect_list(F.struct(F.col("base").cast("int").alias("b"), F.col("weight").alias("v")))).alias("w"), F.max(F.col("base").cast("int")).alias("last"))
    dense = F.transform(F.sequence(F.lit(0), F.col("last")), lambda b: F.coalesce(F.element_at("w", b), F.lit(0.0)))
    table = rows.withColumn("w", dense).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cluster", "w"))).alias("__w"))
    each = reads.join(table, keys).select(reads["*"], F.explode("__w").alias("c"))
    score = F.aggregate("idx", F.lit(0.0), lambda s, i: s + F.coalesce(F.get(F.col("c.w"), i.cast("int")), F.lit(0.0)))
    return each.select(reads["*"], F.col("c.cluster").alias("cluster"), score.alias("score"))


def replicate_align(transcripts: DataFrame) -> DataFrame:
    """Transcripts that every replicate holds, with whether their sequences agree."""
    total = transcripts.agg(F.count_distinct("replicate")).first()[0]
    by = transcripts.groupBy("transcript_id").agg(F.count_distinct("replicate").alias("replicates"), (F.min("sequence") == F.max("sequence")).alias("same_sequence"), F.min("n_reads").alias("least_reads"))
    return by.filter((F.col("replicates") == total) & (F.col("least_reads") > 0))


def replicate_zip(rows: DataFrame, keys: list[str], columns: list[str], replicates: int) -> DataFrame:
    """Rows of all replicates of a key side by side, in the order of the replicates; keys that one lacks are left out."""
    zipped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("replicate", *columns))).alias("zipped"))
    return zipped.filter(F.size("zipped") == replicates)


def window_pair_overlap(windows: DataFrame, keys: list[str], size: int, step: float) -> DataFrame:
    """Pairs a < b of windows that overlap: neighbours up to the last that can begin before a ends."""
    reach = int(size / step) + 2 if step > 0 else 0
    a = windows.select(*keys, F.col("window_idx").alias("a"), F.col("start").alias("a_start"))
    b = windows.select(*keys, F.col("window_idx").alias("b"), F.col("start").alias("b_start"))
    near = a.withColumn("b", F.explode(F.sequence(F.col("a") + 1, F.col("a") + F.lit(max(reach, 1)))))
    return near.join(b, [*keys, "b"]).filter(F.col("b_start") < F.col("a_start") + size).select(*keys, "a", "b")
