"""The whole analysis: reads to conformations, their shares and profiles.

Relational steps are DataFrame operations; four small kernels run on groups that
hold one window's reads or one transcript's windows. Each is a function of its
group and of a seed made from the group's key, so results don't depend on
partitions, retries or order. Rounds (a cluster that turns out too small or
redundant lowers the caps of its windows and the transcript is done again)
carry on with the unsettled transcripts only, from written tables.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import log
from ..kernels import detect as D
from ..kernels import graph_cut, merge, regions, smoothing, spectral
from ..operators import assign as A
from ..operators import coverage as C
from ..operators import filters as P
from ..operators import joins as J
from ..operators import windows as W
from ..params import Params
from ..schemas import MERGED, PTBA, REGIONS  # noqa: F401
from ..tables import kept, made, release

T = ["transcript_id"]
R = ["replicate", "transcript_id"]


def seed_of(*key) -> int:
    return zlib.crc32(":".join(map(str, key)).encode())


def allowed_bases(sequence: str, shape: bool) -> np.ndarray:
    return np.array([shape or c in "AC" for c in sequence.upper()], dtype=bool)


def grids(reads: DataFrame, transcripts: DataFrame, p: Params) -> DataFrame:
    """transcript_id, sequence, size, count and step: the same windows for all replicates."""
    length = F.length("sequence")
    medians = C.median_read_length(reads, T)
    one = transcripts.groupBy("transcript_id").agg(F.min("sequence").alias("sequence")).join(medians, "transcript_id", "left")
    if p.win_len_frac_rna_len > 0:
        size = F.floor(length * F.lit(min(p.win_len_frac_rna_len, 1.0)))
    elif p.win_len <= 1:
        size = F.floor(F.col("median_length") * F.lit(float(p.win_len)))
    else:
        size = F.lit(int(p.win_len + 0.5))
    sized = one.withColumn("size", F.greatest(F.lit(1), F.least(size, length)).cast("int"))
    offset = F.greatest(F.lit(1), F.floor(F.col("size") * F.lit(float(p.win_offset)))) if p.win_offset < 1 else F.lit(int(p.win_offset + 0.5))
    counted = sized.withColumn("offset", offset.cast("int")).withColumn("count", F.expr("cast((length(sequence) - size) div offset + 1 as int)"))
    step = F.when(F.col("count") > 1, (length - F.col("size")) / (F.col("count") - 1)).otherwise(0.0)
    return counted.withColumn("step", step).select("transcript_id", "sequence", "size", "count", "step")


def windowed(reads: DataFrame, grid: DataFrame) -> DataFrame:
    """One row for each distinct read and window that it covers, with how often the read occurs; mutated bases counted from the window's start.

    Reads are counted first, so copies cost a row, and windows carry no sequence.
    """
    placed = A.unique_reads(reads, R).join(grid.drop("sequence"), "transcript_id")
    return J.window_reads(placed, F.col("size"), F.col("count"), F.col("step")).select("replicate", "transcript_id", F.col("window_idx").cast("int").alias("window_idx"), F.col("start").cast("int").alias("start"), "occurrences", F.transform("idx", lambda i: i.cast("int")).alias("idx"))


K = [*R, "window_idx"]


def _probed(marks: DataFrame, grid: DataFrame, p: Params) -> DataFrame:
    """Marks (start, base) on bases that the probe may modify."""
    if p.shape:
        return marks
    letter = F.upper(F.substring("sequence", F.col("start") + F.col("base") + 1, F.lit(1)))
    return marks.join(grid.select("transcript_id", "sequence"), "transcript_id").filter(letter.isin("A", "C")).drop("sequence")


def _reads() -> Column:
    return F.sum("occurrences")


def _on_bases(win_reads: DataFrame, lists: DataFrame, keys: list[str], p: Params) -> DataFrame:
    """Reads with their marks on the listed bases only, if there are enough of them."""
    held = win_reads.join(lists.select(*keys, F.transform("kept", lambda b: b["base"]).alias("__bases")), keys)
    return held.withColumn("idx", F.filter("idx", lambda i: F.array_contains("__bases", i))).filter(F.size("idx") >= p.min_read_mutations).drop("__bases")


def window_counts(win_reads: DataFrame, grid: DataFrame, p: Params) -> DataFrame:
    """What detection needs of each replicate's window, one row each, of bounded size: n_reads, kept (base, mutations), n_filtered, cells (i, j, n).

    A transcript with a third of all reads gives no larger group than others: reads
    are counted on the map side, and the lists of bases that are joined back to
    them are written first, so that join can be broadcast or a hot key split.
    """
    sizes = win_reads.groupBy(*K).agg(_reads().alias("n_reads"), F.min("start").alias("start"))
    marks = win_reads.select(*K, "occurrences", F.explode("idx").alias("base")).groupBy(*K, "base").agg(_reads().alias("mutations"))
    good = (F.col("n_reads") >= p.min_base_coverage) & (F.col("mutations") / F.col("n_reads") > p.min_mutation_freq) & (F.col("mutations") > p.min_base_mutations)
    some = _probed(marks.join(sizes, K).filter(good), grid, p)
    lists = kept(some.groupBy(*K).agg(F.sort_array(F.collect_list(F.struct("base", "mutations"))).alias("kept")))
    reads = _on_bases(win_reads, lists, K, p)
    filtered = reads.groupBy(*K).agg(_reads().alias("n_filtered"))
    cells = J.comutation_matrix(reads, K, "occurrences").groupBy(*K).agg(F.collect_list(F.struct("i", "j", "n")).alias("cells"))
    whole = sizes.select(*K, "n_reads").join(lists, K, "left").join(filtered, K, "left").join(cells, K, "left")
    return whole.withColumn("n_filtered", F.coalesce("n_filtered", F.lit(0).cast("long")))


def matrix(cells, bases: np.ndarray) -> np.ndarray:
    """Cells (i, j, n) of the upper triangle as a symmetric matrix over bases."""
    place = {int(b): k for k, b in enumerate(bases)}
    out = np.zeros((len(bases), len(bases)))
    for c in cells if cells is not None else ():
        i, j = place.get(int(c["i"])), place.get(int(c["j"]))
        if i is not None and j is not None:
            out[i, j] = out[j, i] = c["n"]
    return out


def detect_windows(win_reads: DataFrame, grid: DataFrame, p: Params) -> DataFrame:
    """PTBA rows: the number of clusters of each replicate's window, from its counts."""

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples():
                listed = r.kept if r.kept is not None else []
                bases, mutations = (np.array([x[c] for x in listed], dtype=int) for c in ("base", "mutations"))
                d = D.detect_counts(int(r.n_reads), bases, mutations, np.full(len(bases), float(r.n_reads)), int(r.n_filtered), matrix(r.cells, bases), p, seed_of(p.seed, "detect", r.replicate, r.transcript_id, r.window_idx))
                out.append([r.replicate, r.transcript_id, r.window_idx, d.n_clusters, d.status, d.gaps, d.null_gaps])
            yield pd.DataFrame(out, columns=["replicate", "transcript_id", "window_idx", "n_clusters", "status", "gaps", "null_gaps"])

    return window_counts(win_reads, grid, p).repartition(*K).mapInPandas(run, PTBA)


def all_windows(grid: DataFrame) -> DataFrame:
    each = grid.withColumn("window_idx", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    start = F.least(F.floor(F.col("window_idx") * F.col("step") + 0.5), F.length("sequence") - F.col("size")).cast("int")
    return each.select("transcript_id", "window_idx", start.alias("start"), "size")


def consensus_of(detected: DataFrame, grid: DataFrame, replicates: DataFrame) -> DataFrame:
    """transcript_id, window_idx, start, size, n_clusters, confidence; a window without reads has no clusters."""
    every = all_windows(grid).join(replicates, "transcript_id")
    filled = every.join(detected.select(*R, "window_idx", "n_clusters"), [*R, "window_idx"], "left").withColumn("n_clusters", F.coalesce("n_clusters", F.lit(0)))
    return W.replicate_consensus(filled, ["transcript_id", "window_idx", "start", "size"])


def smoothed(consensus: DataFrame, caps: DataFrame, p: Params) -> DataFrame:
    """n_clusters capped, and relabelled by the options, one transcript a group."""
    capped = consensus.join(caps, ["transcript_id", "window_idx"], "left").withColumn("n_clusters", F.least("n_clusters", F.coalesce("cap", "n_clusters")).cast("int"))
    columns = ["transcript_id", "window_idx", "start", "size", "n_clusters", "confidence"]
    if not (p.max_ignore_wins or p.non_informative_to_surround or p.all_non_informative_to_one):
        return capped.select(*columns)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("window_idx")
        labels = [int(n) for n in rows["n_clusters"]]
        limits = [None if pd.isna(c) else int(c) for c in rows["cap"]]
        if p.non_informative_to_surround:
            labels = smoothing.fill_uninformative(labels, limits)
        if p.max_ignore_wins:
            labels = smoothing.collapse_outliers(labels, limits, p.max_ignore_wins, p.min_ext_wins)
        if p.all_non_informative_to_one and not any(labels):
            labels = [1] * len(labels)
        rows["n_clusters"] = labels
        return rows[columns]

    return capped.groupBy("transcript_id").applyInPandas(run, "transcript_id string, window_idx int, start int, size int, n_clusters int, confidence double")


def shared_counts(win_reads: DataFrame, grid: DataFrame, p: Params) -> DataFrame:
    """What a cut needs of each window, one row each: the bases that pass in every replicate, and cells (replicate, i, j, n) on them."""
    key = ["transcript_id", "window_idx"]
    sizes = win_reads.groupBy(*K).agg(_reads().alias("n_reads"), F.min("start").alias("start"))
    marks = win_reads.select(*K, "occurrences", F.explode("idx").alias("base")).groupBy(*K, "base").agg(_reads().alias("mutations"))
    good = (F.col("n_reads") >= p.min_base_coverage) & (F.col("mutations") / F.col("n_reads") > p.min_mutation_freq) & (F.col("mutations") >= p.min_base_mutations)
    passed = _probed(marks.join(sizes, K).filter(good), grid, p).groupBy(*key, "base").agg(F.count(F.lit(1)).alias("passed"))
    every = sizes.groupBy(*key).agg(F.count(F.lit(1)).alias("replicates"))
    shared = passed.join(every, key).filter("passed = replicates")
    lists = kept(shared.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("base"))).alias("kept")))
    cells = J.comutation_matrix(_on_bases(win_reads, lists, key, p), K, "occurrences")
    by_window = cells.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("replicate", "i", "j", "n"))).alias("cells"))
    return every.select(*key).join(lists, key, "left").join(by_window, key, "left")


def cut_windows(win_reads: DataFrame, labels: DataFrame, grid: DataFrame, p: Params) -> DataFrame:
    """transcript_id, window_idx, w: soft weights [base][cluster] of windows with more than one cluster, shared by replicates."""

    def weights(r) -> np.ndarray:
        size, k = int(r.size_), int(r.n_clusters)
        bases = np.array([x["base"] for x in r.kept], dtype=int) if r.kept is not None else np.zeros(0, dtype=int)
        groups: dict[int, list] = {}
        for c in r.cells if r.cells is not None else ():
            groups.setdefault(int(c["replicate"]), []).append(c)
        graphs = [matrix(cells, bases) for _, cells in sorted(groups.items())]
        # Looked at again after reads were filtered; a base without any co-mutation can't be cut.
        held = np.ones(len(bases), dtype=bool)
        for a in graphs:
            held &= np.diag(a) >= p.min_base_mutations
        graphs = [a[np.ix_(held, held)] for a in graphs]
        linked = np.all([(a - np.diag(np.diag(a))).sum(axis=1) > 0 for a in graphs], axis=0) if graphs else np.zeros(0, dtype=bool)
        if linked.sum() < 3:
            return np.ones((size, 1))
        cut = graph_cut.soft_cut([graph_cut.cut_graph(a[np.ix_(linked, linked)]) for a in graphs], k, p.soft_clustering_weight_module, p.soft_clustering_inits, p.soft_clustering_iters, seed_of(p.seed, "cut", r.transcript_id, r.window_idx))
        w = np.zeros((size, cut.shape[1]))
        w[bases[held][linked]] = cut
        return w

    def run(batches):
        for rows in batches:
            yield pd.DataFrame([[r.transcript_id, r.window_idx, weights(r).tolist()] for r in rows.itertuples()], columns=["transcript_id", "window_idx", "w"])

    key = ["transcript_id", "window_idx"]
    many = labels.filter("n_clusters > 1").select(*key, "n_clusters", F.col("size").alias("size_"))
    counts = shared_counts(win_reads.join(many.select(*key), key, "left_semi"), grid, p)
    return many.join(counts, key, "left").repartition(*key).mapInPandas(run, "transcript_id string, window_idx int, w array<array<double>>")


def merged_regions(labels: DataFrame, weights: DataFrame, win_reads: DataFrame, p: Params) -> DataFrame:
    """MERGED of each replicate: runs of windows merged, with the starts of the windows that each holds.

    coverage is summed over these windows: it weighs them in the merge, and counts a read once for each.
    """
    counts = win_reads.groupBy(*R, "window_idx").agg(_reads().alias("n_reads"))
    replicates = counts.select(*R).distinct()
    rows = labels.join(replicates, "transcript_id").join(counts, [*R, "window_idx"], "left").join(weights, ["transcript_id", "window_idx"], "left")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("window_idx")
        size, starts = int(rows["size"].iloc[0]), [int(s) for s in rows["start"]]
        cut = [None if w is None else np.array([list(x) for x in w]) for w in rows["w"]]
        # A cut may have fewer clusters than were asked for; its own number counts.
        ns = [int(n) if w is None else w.shape[1] for n, w in zip(rows["n_clusters"], cut, strict=True)]
        reads = [0 if pd.isna(c) else int(c) for c in rows["n_reads"]]
        out = []
        for i, r in enumerate(regions.regions(starts, ns, size, p.min_windows_overlap, p.report_non_informative)):
            if r.n_clusters:
                m = merge.merge_windows([merge.single(starts[j], np.ones((size, 1)) if cut[j] is None else cut[j], np.full(size, reads[j])) for j in r.windows])
                start, w, cover = m.begin, m.w.tolist(), m.coverage.astype(int).tolist()
            else:
                start, w, cover = starts[r.first], [[] for _ in range(size)], [reads[r.first]] * size
            out.append([int(key[0]), key[1], i, start, start + len(w), r.n_clusters, r.first, r.windows[-1] + 1, w, cover, [starts[j] for j in r.windows]])
        return pd.DataFrame(out, columns=["replicate", "transcript_id", "region_idx", "start", "end", "n_clusters", "win_begin", "win_end", "w", "coverage", "members"])

    return rows.groupBy(*R).applyInPandas(run, MERGED)


def region_precoverage(reads: DataFrame, found: DataFrame, grid: DataFrame) -> DataFrame:
    """replicate, transcript_id, region_idx, pre: reads over each base of a region, of those that cover one of its windows whole.

    A read meets the few regions of its transcript as a list, so it counts once
    for each, however many of the windows it covers.
    """
    keys = [*R, "region_idx"]
    lists = found.join(grid.select("transcript_id", "size"), "transcript_id").groupBy(*R).agg(F.collect_list(F.struct("region_idx", "start", F.col("end").alias("stop"), "members", "size")).alias("__regions"))
    each = reads.select(*R, "begin", "end").join(lists, R).withColumn("r", F.explode("__regions"))
    held = each.filter(F.exists("r.members", lambda m: (F.col("begin") <= m) & (F.col("end") >= m + F.col("r.size"))))
    n_bases = F.col("r.stop") - F.col("r.start")
    clipped = held.select(*R, "r.region_idx", n_bases.alias("n_bases"), F.greatest(F.col("begin") - F.col("r.start"), F.lit(0)).alias("begin"), F.least(F.col("end") - F.col("r.start"), n_bases).alias("end"))
    by_base = C.base_coverage(clipped, [*keys, "n_bases"], F.col("n_bases"))
    return by_base.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("base", "coverage"))), lambda x: x["coverage"]).alias("pre"))


def clusters_coverage(assigned: DataFrame, found: DataFrame) -> DataFrame:
    """replicate, transcript_id, region_idx, cover: assigned reads over each base of a region, a list for each cluster, also of those without reads."""
    keys = [*R, "region_idx"]
    n_bases = F.col("stop") - F.col("start")
    spans = found.filter("n_clusters > 0").select(*keys, "start", F.col("end").alias("stop"), "n_clusters")
    clipped = assigned.join(spans, keys).select(*keys, "cluster", "assigned", n_bases.alias("n_bases"), F.greatest(F.col("begin") - F.col("start"), F.lit(0)).alias("begin"), F.least(F.col("end") - F.col("start"), n_bases).alias("end"))
    by_base = A.cluster_coverage(clipped, [*keys, "n_bases"], F.col("n_bases"))
    lists = by_base.groupBy(*keys, "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("base", "coverage"))), lambda x: x["coverage"]).alias("c"))
    every = spans.withColumn("cluster", F.explode(F.sequence(F.lit(0), F.col("n_clusters") - 1))).join(lists, [*keys, "cluster"], "left")
    filled = every.withColumn("c", F.coalesce("c", F.array_repeat(F.lit(0).cast("long"), n_bases)))
    return filled.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("cluster", "c"))), lambda x: x["c"]).alias("cover"))


def assigned_reads(reads: DataFrame, found: DataFrame, grid: DataFrame, p: Params) -> DataFrame:
    """Unique reads of each region with their clusters; reads shorter than a window don't count."""
    keys = [*R, "region_idx"]
    each = found.select(*keys, F.posexplode("w").alias("base", "ws")).select(*keys, "base", F.posexplode("ws").alias("cluster", "weight")).withColumn("weight", F.col("weight").cast("double"))
    return A.assign(A.unique_reads(inside_regions(reads, found, grid, p), keys), each, keys, p.skip_ambiguous_assignments)


def inside_regions(reads: DataFrame, found: DataFrame, grid: DataFrame, p: Params) -> DataFrame:
    """Reads, one row for each region they have enough mutations in; idx counts from the region's start.

    Of a transcript that is one region all reads count.
    """
    long_reads = reads.join(grid.select("transcript_id", "size", "sequence"), "transcript_id").filter(P.long_enough(F.col("size")))
    if not p.shape:
        long_reads = long_reads.withColumn("idx", F.filter("idx", lambda i: F.upper(F.substring("sequence", i.cast("int") + 1, F.lit(1))).isin("A", "C")))
    spans = found.filter("n_clusters > 0").select(*R, "region_idx", "start", F.col("end").alias("stop"))
    sized = long_reads.withColumn("__length", F.length("sequence")).drop("size", "sequence")
    inside = J.region_reads(sized, spans, R, p.min_read_mutations, F.col("__length")).drop("__length")
    return inside.withColumn("idx", F.transform("idx", lambda i: i.cast("int")))


def dump_assignments(reads: DataFrame, found: DataFrame, grid: DataFrame, p: Params, path: str) -> None:
    """Each cluster's reads as a transcript of its own, ``<id>_<start>-<end>_c<cluster>``: mutation maps by replicate."""
    from ..sources.mm import write_mm

    keys = [*R, "region_idx"]
    placed = A.read_clusters(inside_regions(reads, found, grid, p), assigned_reads(reads, found, grid, p), keys, p.seed).filter("cluster is not null")
    spans = found.join(grid.select("transcript_id", "sequence"), "transcript_id")
    name = F.format_string("%s_%d-%d_c%d", "transcript_id", "start", "end", "cluster")
    whole = reads.select(*R, "read_id", "begin", "end", "idx")
    rows = placed.select(*keys, "read_id", "cluster").join(whole, [*R, "read_id"]).join(spans.select(*keys, "start", F.col("end").alias("stop"), "sequence"), keys)
    named = rows.withColumn("transcript_id", F.format_string("%s_%d-%d_c%d", "transcript_id", "start", "stop", "cluster"))
    every = spans.withColumn("cluster", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_clusters") - 1, F.lit(0))))).filter("n_clusters > 0")
    for replicate in sorted(r["replicate"] for r in found.select("replicate").distinct().collect()):
        heads = every.filter(F.col("replicate") == replicate).select(name.alias("transcript_id"), "sequence")
        write_mm(named.filter(F.col("replicate") == replicate).select("transcript_id", "read_id", "begin", "end", "idx"), heads, f"{path}/replicate={replicate}")


def fractions_of(assigned: DataFrame, found: DataFrame) -> DataFrame:
    """Share of every cluster of every region, also of those without reads."""
    keys = [*R, "region_idx"]
    every = found.filter("n_clusters > 0").select(*keys, F.explode(F.sequence(F.lit(0), F.col("n_clusters") - 1)).alias("cluster"))
    n = assigned.groupBy(*keys, "cluster").agg(F.sum("assigned").alias("assigned"))
    return A.cluster_fractions(every.join(n, [*keys, "cluster"], "left").withColumn("assigned", F.coalesce("assigned", F.lit(0).cast("long"))), keys)


def failing(fractions: DataFrame, patterns: DataFrame, found: DataFrame, p: Params) -> DataFrame:
    """Regions with a cluster that is too small or has another's pattern: replicate, transcript_id, region_idx."""
    keys = [*R, "region_idx"]
    small = fractions.filter(F.col("fraction") < p.min_cluster_fraction)
    listed = patterns.groupBy(*keys, "cluster").agg(F.sort_array(F.collect_list(F.struct("base", "mutations"))).alias("pattern"))
    same = listed.groupBy(*keys, "pattern").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    many = found.filter("n_clusters > 1").select(*keys)
    return many.join(small.select(*keys).unionByName(same.select(*keys)).distinct(), keys, "left_semi")


def lowered(caps: DataFrame, bad: DataFrame, found: DataFrame, labels: DataFrame) -> DataFrame:
    """Caps one below a failing region's number, for the windows inside it; never raised."""
    spans = found.join(bad, [*R, "region_idx"], "left_semi").select("transcript_id", F.col("start").alias("s"), F.col("end").alias("e"), (F.col("n_clusters") - 1).alias("cap"))
    inside = labels.join(spans, "transcript_id").filter((F.col("start") >= F.col("s")) & (F.col("start") + F.col("size") <= F.col("e")))
    return caps.unionByName(inside.select("transcript_id", "window_idx", "cap")).groupBy("transcript_id", "window_idx").agg(F.min("cap").cast("int").alias("cap"))


def results(found: DataFrame, precoverage: DataFrame, covers: DataFrame, fractions: DataFrame, patterns: DataFrame, labels: DataFrame, transcripts: DataFrame) -> DataFrame:
    """One row a transcript: id, sequence, nReads by replicate, windows by replicate, and clusters with confidence."""
    keys = [*R, "region_idx"]
    shares = fractions.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("cluster", "fraction"))), lambda x: F.round(x["fraction"], 3)).alias("stoichiometries"))
    lists = patterns.groupBy(*keys, "cluster").agg(F.map_from_entries(F.collect_list(F.struct(F.col("base").cast("int"), "mutations"))).alias("m"))
    per = lists.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cluster", F.map_entries("m").alias("e")))).alias("p"))
    whole = found.join(precoverage, keys, "left").join(covers, keys, "left").join(shares, keys, "left").join(per, keys, "left")
    pre = F.coalesce("pre", F.array_repeat(F.lit(0).cast("long"), F.col("end") - F.col("start")))
    counts = F.transform("p", lambda c: F.transform(F.sequence(F.lit(0), F.col("end") - F.col("start") - 1), lambda b: F.coalesce(F.element_at(F.map_from_entries(c["e"]), b), F.lit(0).cast("long"))))
    window = F.struct("start", "end", "stoichiometries", counts.alias("counts"), F.col("cover").alias("coverage"), pre.alias("preCoverage"), F.col("w").alias("weights"))
    by_replicate = whole.groupBy(*R).agg(F.sort_array(F.collect_list(F.struct("region_idx", window.alias("w")))).alias("ws"))
    windows = by_replicate.groupBy("transcript_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("replicate", "ws"))), lambda r: F.transform(r["ws"], lambda x: x["w"])).alias("windows"))
    sized = labels.select("transcript_id", "window_idx", "start", "size", "n_clusters", "confidence")
    runs = W.islands(sized, T, "window_idx", ["n_clusters", "confidence"]).groupBy("transcript_id", "island").agg(F.first("n_clusters").alias("nClusters"), F.round(F.first("confidence"), 3).alias("confidence"), F.min("start").alias("start"), (F.max(F.col("start") + F.col("size"))).alias("end"))
    clusters = runs.groupBy("transcript_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "nClusters", "confidence"))).alias("replicateClusters"))
    whole = heads_of(transcripts).join(windows, "transcript_id", "left").join(clusters, "transcript_id", "left").withColumnRenamed("transcript_id", "id")
    return whole.withColumn("errors", F.lit(None).cast("array<string>"))


def heads_of(transcripts: DataFrame) -> DataFrame:
    n_reads = F.transform(F.sort_array(F.collect_list(F.struct("replicate", "n_reads"))), lambda x: x["n_reads"])
    return transcripts.groupBy("transcript_id").agg(F.min("sequence").alias("sequence"), n_reads.alias("nReads"))


def unaligned(transcripts: DataFrame) -> DataFrame:
    """transcript_id and errors of the transcripts that can't be analysed: a replicate lacks them or their reads, or sequences differ."""
    total = transcripts.agg(F.count_distinct("replicate")).first()[0]
    by = transcripts.groupBy("transcript_id").agg(F.count_distinct("replicate").alias("replicates"), (F.min("sequence") == F.max("sequence")).alias("same"), F.min("n_reads").alias("least"))
    why = [F.when(F.col("replicates") < total, F.lit("missing in a replicate")), F.when(~F.col("same"), F.lit("sequences differ between replicates")), F.when(F.col("least") <= 0, F.lit("no reads in a replicate"))]
    return by.select("transcript_id", F.array_compact(F.array(*why)).alias("errors")).filter(F.size("errors") > 0)


def rejected(transcripts: DataFrame, errors: DataFrame, like: DataFrame) -> DataFrame:
    """Results that hold errors in the place of windows."""
    rows = heads_of(transcripts).join(errors, "transcript_id").withColumnRenamed("transcript_id", "id")
    return rows.select(*[c if c in rows.columns else F.lit(None).cast(like.schema[c].dataType).alias(c) for c in like.columns])


def deconvolve(reads: DataFrame, transcripts: DataFrame, p: Params, outputs: bool = False) -> DataFrame | None:
    """The result of every transcript; rounds go on until no region fails.

    A transcript that not all replicates hold, with reads and with one sequence, has
    no windows but errors.

    With outputs, what the options ask for besides is written: eigengaps, the raw
    numbers of clusters to ``p.output`` (the analysis ends there, without a result),
    and the assignments of settled transcripts, a folder a round.
    """
    errors, given = kept(unaligned(transcripts)), transcripts
    log.on("info", lambda: f"{errors.count()} transcripts can't be analysed")
    reads, transcripts = (x.join(errors, "transcript_id", "left_anti") for x in (reads, transcripts))
    grid = kept(grids(reads, transcripts, p))
    win_reads = kept(windowed(reads, grid))
    replicates = transcripts.select(*R).distinct()
    detected = kept(detect_windows(win_reads, grid, p))
    if outputs and p.save_eigengap_data:
        write_eigengaps(detected, grid, p.eigengap_data_out)
    if outputs and p.output_raw_n_clusters:
        write_raw_n_clusters(detected, grid, p.output)
        return None
    consensus = kept(consensus_of(detected, grid, replicates))
    caps = reads.sparkSession.createDataFrame([], "transcript_id string, window_idx int, cap int")
    every, out = (win_reads, reads, transcripts, consensus), None
    for number in itertools.count():
        labels = kept(smoothed(consensus, caps, p))
        found = kept(merged_regions(labels, kept(cut_windows(win_reads, labels, grid, p)), win_reads, p))
        assigned = kept(assigned_reads(reads, found, grid, p))
        patterns, fractions = A.cluster_patterns(assigned, [*R, "region_idx"]), kept(fractions_of(assigned, found))
        bad = kept(failing(fractions, patterns, found, p))
        again = bad.select("transcript_id").distinct()
        done = [x.join(again, "transcript_id", "left_anti") for x in (found, fractions, patterns, labels, transcripts)]
        settled = kept(results(done[0], region_precoverage(reads, done[0], grid), clusters_coverage(assigned, done[0]), *done[1:]))
        out = settled if out is None else out.unionByName(settled)
        if outputs and p.assignments_dump_dir and settled.limit(1).count():
            dump_assignments(reads.join(again, "transcript_id", "left_anti"), done[0], grid, p, f"{p.assignments_dump_dir}/round={number}")
        if not bad.limit(1).count():
            return out.unionByName(rejected(given, errors, out)) if errors.limit(1).count() else out
        log.on("debug", lambda: f"round {number}: {again.count()} transcripts go on")
        # A failing region lowers a cap each round, so the rounds end.
        lower = kept(lowered(caps, bad, found, labels))
        if not lower.join(caps.withColumnRenamed("cap", "old"), ["transcript_id", "window_idx"], "left").filter("old is null or cap < old").limit(1).count():
            raise RuntimeError(f"regions fail, but no cap falls: {again.limit(10).collect()}")
        caps = lower
        win_reads, reads, transcripts, consensus = (x.join(again, "transcript_id", "left_semi") for x in every)


def raw_n_clusters(detected: DataFrame, grid: DataFrame) -> DataFrame:
    """One row a replicate and window: transcript_id, start, end, n_clusters."""
    placed = detected.join(all_windows(grid), ["transcript_id", "window_idx"])
    return placed.select("replicate", "transcript_id", "start", (F.col("start") + F.col("size")).alias("end"), "n_clusters")


def write_raw_n_clusters(detected: DataFrame, grid: DataFrame, path: str) -> None:
    raw_n_clusters(detected, grid).write.mode("overwrite").option("sep", "\t").csv(path)


def eigengap_lines(detected: DataFrame, grid: DataFrame) -> DataFrame:
    """folder (transcript and 1-based replicate), file and line of the gaps and the permuted gaps, numbered from 1, in scientific notation."""
    placed = detected.filter(F.size("gaps") > 0).join(all_windows(grid), ["transcript_id", "window_idx"])
    window = F.format_string("window_%d-%d", F.col("start") + 1, F.col("start") + F.col("size"))
    of_data = F.transform("gaps", lambda g, i: F.struct(F.lit("eigengaps").alias("what"), (i + 1).alias("i"), F.lit(0).alias("k"), g.alias("g")))
    of_null = F.flatten(F.transform("null_gaps", lambda gs, i: F.transform(gs, lambda g, k: F.struct(F.lit("perturbed_eigengaps").alias("what"), (i + 1).alias("i"), k.alias("k"), g.alias("g")))))
    each = placed.select(F.format_string("%s_%d", "transcript_id", F.col("replicate") + 1).alias("folder"), window.alias("window"), F.explode(F.concat(of_data, of_null)).alias("x"))
    return each.select("folder", F.format_string("%s_%s", "window", "x.what").alias("file"), "x.i", "x.k", F.format_string("%d %.10e", "x.i", "x.g").alias("line"))


def write_eigengaps(detected: DataFrame, grid: DataFrame, path: str) -> None:
    """Text files ``folder=<transcript>_<replicate>/file=window_<start>-<end>_[perturbed_]eigengaps``, a line a gap."""
    rows = eigengap_lines(detected, grid)
    # The lines of one file go to one task, in order; a file holds at most a window's gaps times the permutations.
    rows.repartition("folder", "file").sortWithinPartitions("folder", "file", "i", "k").select("folder", "file", "line").write.mode("overwrite").partitionBy("folder", "file").text(path)


def write_eigenvectors(matrices: DataFrame, path: str) -> None:
    """For inspection: the eigenvectors of the Laplacians of matrices (keys, then size and cells (i, j, n)), a text line a row of numbers."""
    keys = [c for c in matrices.columns if c not in ("size", "cells")]

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples():
                vectors = spectral.eigenvectors(matrix(r.cells, np.arange(r.size)))
                out += [[":".join(str(getattr(r, k)) for k in keys), i, " ".join(f"{x:.10e}" for x in v)] for i, v in enumerate(vectors)]
            yield pd.DataFrame(out, columns=["of", "row", "line"])

    lines = matrices.mapInPandas(run, "of string, row int, line string")
    lines.repartition("of").sortWithinPartitions("of", "row").select("of", "line").write.mode("overwrite").partitionBy("of").text(path)


def document_of(result: DataFrame) -> DataFrame:
    """id and document: each transcript as JSON, its shares and weights with three decimals; what is absent is left out."""
    rounded = F.transform("windows", lambda r: F.transform(r, lambda w: w.withField("weights", F.transform(w["weights"], lambda b: F.transform(b, lambda x: F.round(x.cast("double"), 3))))))
    r = result.withColumn("windows", rounded)
    return r.select("id", F.to_json(F.struct(*[r[c] for c in r.columns])).alias("document"))


def write_result(result: DataFrame, p: Params, path: str) -> None:
    """For very many transcripts: JSON lines, one a transcript, and a file of the options beside them."""
    document_of(result).select("document").write.mode("overwrite").text(f"{path}/transcripts")
    result.sparkSession.createDataFrame([(p.to_json(),)], "params string").coalesce(1).write.mode("overwrite").text(f"{path}/params")


def write_document(result: DataFrame, p: Params, path: str) -> None:
    """One JSON document, {"params": ..., "transcripts": [...]}: a partition of results at a time passes through the driver."""
    import pyarrow.fs as pafs

    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with fs.open_output_stream(inner) as f:
        f.write(f'{{"params":{p.to_json()},"transcripts":['.encode())
        for i, row in enumerate(document_of(result).toLocalIterator()):
            f.write((b"," if i else b"") + row["document"].encode())
        f.write(b"]}")


def run(spark: SparkSession, p: Params) -> DataFrame | None:
    """From mutation map files (one a replicate) to the result, written to ``p.output``; none if only the raw numbers are asked for."""
    from ..sources.mm import read_mm

    log.set_level(p.log_level)
    transcripts, reads = read_mm(spark, list(p.mm), p.whitelist)
    log.on("info", lambda: f"{transcripts.select('transcript_id').distinct().count()} transcripts in {len(p.mm)} replicates")
    since = made()
    result = deconvolve(reads, transcripts, p, outputs=True)
    if result is not None:
        result = kept(result)
        write_document(result, p, p.output)
    release(spark, since, but=result)
    return result
