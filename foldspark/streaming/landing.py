"""Mutation maps that land in a directory, analysed as they come.

A transcript is complete within its files, so no watermark is needed: each batch of
files is one run. Replicates of one experiment land as ``<name>.<replicate>.mm`` and
are analysed together if they land in one batch; a file without a number is a lone
replicate. The checkpoint keeps what was seen. A batch's results go to a folder of
its number, written anew if the batch is repeated, so they are there once.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..params import Params
from ..plans.deconvolve import deconvolve
from ..sources.mm import read_mm


def watch(spark: SparkSession, landing: str, out: str, checkpoint: str, p: Params, once: bool = True) -> StreamingQuery:
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.mm").load(landing).select("path")

    def analyse(batch: DataFrame, number: int) -> None:
        # File names only: a batch has as many as landed since the last one.
        experiments: dict[str, list[str]] = {}
        for path in sorted(r["path"] for r in batch.collect()):
            experiments.setdefault(re.sub(r"(\.[0-9]+)?\.mm$", "", path), []).append(path)
        results = []
        for name, paths in experiments.items():
            transcripts, reads = read_mm(spark, [path.replace("file:///", "/").replace("file:/", "/") for path in paths])
            results.append(deconvolve(reads, transcripts, p).withColumn("source", F.lit(name)))
        if results:
            reduce(DataFrame.unionByName, results).write.mode("overwrite").json(f"{out}/batch={number}")

    query = files.writeStream.foreachBatch(analyse).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


def windowed_counts(events: DataFrame, size: str = "10 minutes", slide: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    """Sliding event-time windows, the streaming form of the base-coordinate grid."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
