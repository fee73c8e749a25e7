"""Simulated reads from known conformations.

Reads are numbered by spark.range; each draws from a generator seeded by its
number, so results don't depend on partitions or retries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, lgamma, log, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RATE = 0.01927


def stoichiometry(text: str | None, conformations: int) -> list[float]:
    """Percentages as shares; equal shares without a list of that length. They must add up to 1 within 0.03."""
    if text:
        shares = [float(x) / 100 for x in text.split(",")]
        if abs(sum(shares) - 1) > 0.03:
            raise ValueError("percentages must add up to 100")
        if len(shares) == conformations:
            return [s / sum(shares) for s in shares]
    return [1 / conformations] * conformations


def binomial_cdf(n: int, p: float, upto: float = 0.9999) -> np.ndarray:
    """P(X <= k) for k = 0, 1, ... until it passes ``upto``."""
    if not 0 < p < 1:
        return np.array([1.0]) if p <= 0 else np.array([0.0] * n + [1.0])
    out, total, k = [], 0.0, 0
    while total <= upto and k <= n:
        # In logarithms: the first terms of a long sequence are below the smallest number.
        total += exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p))
        out.append(total)
        k += 1
    return np.array(out)


def database_reads(spark: SparkSession, structures: DataFrame, read_length: int, n_reads: int | None = None, mean_coverage: float | None = None, shares: list[str] | None = None, rate: float = RATE, seed: int = 0) -> DataFrame:
    """Reads of all entries of a structure database (entry, sequence, profile_idx, profile), named RNA_1, RNA_2, ... in the order of the entries.

    Each entry gives n_reads, or as many as its mean coverage asks for. Of the lists
    of percentages in ``shares`` an entry takes the first one of its length. Each
    read draws from a generator of its own number, wherever it is made.
    """
    by = structures.groupBy("entry", "sequence").agg(F.transform(F.sort_array(F.collect_list(F.struct("profile_idx", "profile"))), lambda x: x["profile"]).alias("profiles"))
    # A row an entry, without its reads: numbered in one task, a few bytes each.
    numbers = structures.select("entry").distinct().withColumn("number", F.row_number().over(Window.orderBy("entry")))
    n = F.lit(n_reads) if n_reads is not None else F.ceil(F.lit(float(mean_coverage)) * F.length("sequence") / read_length)
    each = by.join(numbers, "entry").withColumn("read_id", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))).repartition("number", F.expr("read_id div 4096"))
    lists = [[float(x) for x in s.split(",")] for s in shares or []]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                k, length = len(r.profiles), len(r.sequence)
                own = next((s for s in lists if len(s) == k), None)
                mixed = np.cumsum(stoichiometry(",".join(map(str, own)) if own else None, k))
                opened = [np.flatnonzero(np.asarray(p) > 0) for p in r.profiles]
                draw = drawn(np.random.default_rng([seed, int(r.number), int(r.read_id)]), _cdf(length, rate), mixed, opened, length, read_length)
                out.append((f"RNA_{r.number}", r.sequence, int(r.read_id), *draw))
            yield pd.DataFrame(out, columns=["transcript_id", "sequence", "read_id", "begin", "end", "idx", "conformation"])

    return each.mapInPandas(run, "transcript_id string, sequence string, read_id long, begin int, end int, idx array<int>, conformation int")


@lru_cache(maxsize=256)
def _cdf(n: int, p: float) -> np.ndarray:
    return binomial_cdf(n, p)


def write_outputs(reads: DataFrame, structures: DataFrame, path: str) -> None:
    """A simulation's files: mutation maps, text lines of all reads, and the database with the counts that were observed."""
    from .sources.mm import write_mm
    from .sources.text import read_lines

    heads = reads.select("transcript_id", "sequence").distinct()
    write_mm(reads.select("transcript_id", "read_id", "begin", "end", "idx"), heads, f"{path}/mm")
    lines = read_lines(reads).select("transcript_id", F.col("read_id").alias("at"), "line").unionByName(heads.select("transcript_id", F.lit(-1).cast("long").alias("at"), F.concat_ws("\n", "transcript_id", "sequence").alias("line")))
    lines.repartition("transcript_id").sortWithinPartitions("transcript_id", "at").select("line").write.mode("overwrite").text(f"{path}/text")
    observed = reads.select("sequence", F.col("conformation").alias("profile_idx"), F.explode("idx").alias("base")).groupBy("sequence", "profile_idx", "base").agg(F.count(F.lit(1)).alias("n"))
    counted = observed.groupBy("sequence", "profile_idx").agg(F.map_from_entries(F.collect_list(F.struct("base", "n"))).alias("m"))
    zero = F.lit(0).cast("long")
    counts = F.array_join(F.transform(F.sequence(F.lit(0), F.length("sequence") - 1), lambda b: F.coalesce(F.element_at("m", b), zero).cast("string")), ",")
    marks = F.array_join(F.transform("profile", lambda x: F.when(x > 0, ".").otherwise("x")), "")
    per = structures.join(counted, ["sequence", "profile_idx"], "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<int,bigint>"))).select("entry", "sequence", "profile_idx", marks.alias("s"), counts.alias("c"))
    blocks = per.groupBy("entry", "sequence").agg(F.sort_array(F.collect_list(F.struct("profile_idx", "s", "c"))).alias("p"))
    text = F.concat_ws("\n", "sequence", F.array_join(F.transform("p", lambda x: x["s"]), "\n"), F.array_join(F.transform("p", lambda x: x["c"]), "\n"), F.lit(""))
    blocks.orderBy("entry").select(text).write.mode("overwrite").text(f"{path}/database")


def drawn(rng: np.random.Generator, cdf: np.ndarray, mixed: np.ndarray, opened: list[np.ndarray], length: int, read_length: int) -> tuple:
    """begin, end, mutated bases and conformation of one read."""
    c = min(int(np.searchsorted(mixed, rng.random())), len(opened) - 1)
    k = min(int(np.searchsorted(cdf, rng.random() * cdf[-1])), len(opened[c]))
    hits = np.sort(rng.choice(opened[c], k, replace=False))
    begin = int(rng.integers(0, max(length - read_length, 1)))
    end = min(begin + read_length, length)
    return begin, end, [int(x) for x in hits if begin <= x < end], c


def reads_for_coverage(coverage: float, length: int, read_length: int) -> int:
    """The first number of reads whose mean coverage reaches the one asked for: each adds its length, so no read needs to be looked at."""
    return ceil(coverage * length / read_length)


def simulate(spark: SparkSession, transcript_id: str, profiles: list[list[int]], n_reads: int, read_length: int, shares: list[float], rate: float = RATE, replicate: int = 0, seed: int = 0, partitions: int = 8) -> DataFrame:
    """Reads (canonical columns and the true conformation) of one transcript; a profile is positive at bases that can be modified."""
    length = len(profiles[0])
    cdf, mixed = binomial_cdf(length, rate), np.cumsum(shares)
    open_bases = [np.flatnonzero(np.asarray(p) > 0) for p in profiles]

    def draw(i: int) -> tuple:
        return drawn(np.random.default_rng([seed, replicate, i]), cdf, mixed, open_bases, length, read_length)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [draw(int(i)) for i in batch["id"]]
            yield pd.DataFrame({"replicate": replicate, "transcript_id": transcript_id, "read_id": batch["id"], "begin": [r[0] for r in rows], "end": [r[1] for r in rows], "idx": [r[2] for r in rows], "conformation": [r[3] for r in rows]})

    return spark.range(0, n_reads, 1, partitions).mapInPandas(run, "replicate int, transcript_id string, read_id long, begin int, end int, idx array<int>, conformation int")
