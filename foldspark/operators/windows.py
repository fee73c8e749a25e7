"""Window grids, islands of equal labels, consensus over replicates and confidence segments."""

from __future__ import annotations

from dataclasses import dataclass
from math import floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    count: int
    step: float
    size: int
    length: int

    def start(self, i: int) -> int:
        return min(floor(i * self.step + 0.5), self.length - self.size)


def grid(length: int, size: int, offset: int) -> Grid:
    """As many windows as fit at the offset, spread evenly so that the last one ends with the transcript."""
    count = (length - size) // offset + 1
    return Grid(count, (length - size) / (count - 1) if count > 1 else 0.0, size, length)


def window_size(length: int, win_len: float, frac: float, median_read: int) -> int:
    if frac > 0:
        size = int(length * min(frac, 1.0))
    elif win_len <= 1:
        size = int(median_read * win_len)
    else:
        size = floor(win_len + 0.5)
    return min(size, length)


def window_offset(size: int, offset: float) -> int:
    return max(1, int(size * offset)) if offset < 1 else floor(offset + 0.5)


def window_grid(transcripts: DataFrame, size: int, offset: int) -> DataFrame:
    """Windows of transcripts (transcript_id, length), from arithmetic alone; shorter transcripts have one whole window."""
    wide = F.least(F.lit(size).cast("long"), F.col("length"))
    count = F.expr(f"(length - __size) div {offset} + 1")
    step = F.when(F.col("__n") > 1, (F.col("length") - F.col("__size")) / (F.col("__n") - 1)).otherwise(0.0)
    rows = transcripts.withColumn("__size", wide).withColumn("__n", count).withColumn("step", step)
    each = rows.withColumn("window_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    start = F.least(F.floor(F.col("window_idx") * F.col("step") + 0.5), F.col("length") - F.col("__size"))
    return each.withColumn("start", start).select("transcript_id", "window_idx", "start", (F.col("start") + F.col("__size")).alias("stop"))


def islands(df: DataFrame, keys: list[str], order: str, labels: list[str]) -> DataFrame:
    """df with island: the number of the run of equal labels along order."""
    along = Window.partitionBy(*keys).orderBy(order)
    change = F.lit(False)
    for c in labels:
        change = change | ~F.col(c).eqNullSafe(F.lag(c).over(along))
    first = F.row_number().over(along) == 1
    return df.withColumn("__new", (first | change).cast("int")).withColumn("island", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def cluster_spans(consensus: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of windows with equal n_clusters, [first, last + 1), with the least of their caps."""
    runs = islands(consensus, keys, "window_idx", ["n_clusters"])
    return runs.groupBy(*keys, "island").agg(F.min("window_idx").alias("first"), (F.max("window_idx") + 1).alias("stop"), F.first("n_clusters").alias("n_clusters"), F.min("cap").alias("cap"))


def merge_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbouring spans of equal label fused."""
    runs = islands(spans.drop("island"), keys, "first", ["n_clusters"])
    return runs.groupBy(*keys, "island").agg(F.min("first").alias("first"), F.max("stop").alias("stop"), F.first("n_clusters").alias("n_clusters"), F.min("cap").alias("cap"))


def span_neighbors(spans: DataFrame, keys: list[str]) -> DataFrame:
    along = Window.partitionBy(*keys).orderBy("first")
    return spans.withColumn("left_n", F.lag("n_clusters").over(along)).withColumn("right_n", F.lead("n_clusters").over(along))


def replicate_consensus(detected: DataFrame, keys: list[str]) -> DataFrame:
    """The lower median of the replicates' n_clusters and the share that agrees, in one aggregation by window."""
    by = detected.groupBy(*keys).agg(F.sort_array(F.collect_list("n_clusters")).alias("all"))
    median = F.element_at("all", F.floor((F.size("all") - 1) / 2).cast("int") + 1)
    agree = F.size(F.filter("all", lambda n: n == F.col("n_clusters"))) / F.size("all")
    return by.withColumn("n_clusters", median).withColumn("confidence", agree).select(*keys, "n_clusters", "confidence")


def confidence_segments(consensus: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Runs of equal (n_clusters, confidence) as base spans; consensus has window_idx and start."""
    runs = islands(consensus, keys, "window_idx", ["n_clusters", "confidence"])
    return runs.groupBy(*keys, "island").agg(F.min("start").alias("start"), (F.max("start") + size).alias("stop"), F.first("n_clusters").alias("n_clusters"), F.first("confidence").alias("confidence")).drop("island")


def eigengap_diff(values: DataFrame, keys: list[str]) -> DataFrame:
    """Differences of ascending eigenvalues (k, value)."""
    after = F.lead("value").over(Window.partitionBy(*keys).orderBy("k"))
    return values.withColumn("gap", after - F.col("value")).filter("gap is not null").select(*keys, "k", "gap")
