"""Registered queries of the kernels, sources and the whole analysis. Imported by the catalog."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import simulate
from .. import surrogate as S
from ..functions import stats
from ..functions import structures as ST
from ..kernels import detect, distributions, graph_cut, merge, regions, smoothing, spectral
from ..operators import assign as A
from ..operators import joins as J
from ..params import Params
from ..sources import mm, text
from ..tables import kept, shared_dir, table
from . import deconvolve as P
from .catalog import GRID, RUNS, SIZE, STEP, UNIQUE, _joined, query, rounded

KEYS = ["transcript_id", "replicate"]


def folder(spark) -> str:
    path = shared_dir(spark)
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path


def typed_reads(spark, d) -> DataFrame:
    """The surrogate reads in the canonical types."""
    r = S.reads(spark, d)
    return r.select(F.col("replicate").cast("int").alias("replicate"), F.concat(F.lit("T"), "transcript_id").alias("transcript_id"), "read_id", F.col("begin").cast("int").alias("begin"), F.col("end").cast("int").alias("end"), F.transform("idx", lambda x: x.cast("int")).alias("idx"))


SEQUENCE = "ACGT" * (S.LENGTH // 4)


def heads(spark, replicates: int = 3) -> DataFrame:
    return spark.createDataFrame([(r, t, f"T{t}", SEQUENCE, 1) for r in range(replicates) for t in range(4)], "replicate int, ordinal int, transcript_id string, sequence string, n_reads long")


# Sources and sinks


@query(f"""with {UNIQUE} select 'T' || transcript_id as transcript_id, "begin", "end", idx, occurrences from uniq""")
def mm_scan(spark, d):
    """All surrogate reads written as mutation maps and read back."""
    path = folder(spark)
    mm.write_mm(typed_reads(spark, d), heads(spark, 1), path, 2)
    files = [r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.mm").load(path).select("path").collect()]
    reads = mm.read_mm(spark, [f.replace("file:/", "file:///", 1) if f.startswith("file:/") and not f.startswith("file:///") else f for f in files])[1]
    by = reads.groupBy("transcript_id", "begin", "end", "idx").agg(F.count(F.lit(1)).alias("occurrences"))
    return by.select("transcript_id", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), _joined("idx").alias("idx"), "occurrences")


@query("select p_partkey, try_cast(string_split(s, ',')[1] as int) as a, try_cast(string_split(s, ',')[2] as int) as b, try_cast(string_split(s, ',')[3] as int) as c from (select p_partkey, p_partkey || ',' || p_brand || ',' || p_size as s from part)", views=False)
def tokenizer(spark, d):
    s = table(spark, d, "part").select("p_partkey", text.split_numbers(F.concat_ws(",", "p_partkey", "p_brand", "p_size")).alias("n"))
    return s.select("p_partkey", F.col("n")[0].alias("a"), F.col("n")[1].alias("b"), F.col("n")[2].alias("c"))


# Windows from options


@query(f"""with m as (select 'T' || transcript_id as transcript_id, list_sort(list(e - b)) as l from reads group by 1),
s as (select transcript_id, greatest(1, least(cast(floor(l[len(l) // 2 + 1] * 0.9) as int), {S.LENGTH})) as size from m),
o as (select *, greatest(1, cast(floor(size * 0.2) as int)) as off from s), c as (select transcript_id, size, ({S.LENGTH} - size) // off + 1 as n from o)
select transcript_id, cast(size as int) as size, cast(n as int) as count, case when n > 1 then round(({S.LENGTH} - size) / (n - 1), 9) else 0.0 end as step from c""")
def window_size_and_offset(spark, d):
    g = P.grids(typed_reads(spark, d), heads(spark), Params(win_len=0.9, win_offset=0.2))
    return rounded(g.select("transcript_id", "size", "count", "step"), "step")


# Spectral kernels and the null model


@query("select transcript_id, read_id % 3 as replicate, base, count(*) as mutations from mutations group by all")
def perturb_invariants(spark, d):
    """Mutations of each base after every base's marks were dealt to other reads: as before. From counts, a row a transcript and replicate."""
    reads = S.reads(spark, d)
    marks = reads.select(*KEYS, F.explode("idx").alias("base")).groupBy(*KEYS, "base").agg(F.count(F.lit(1)).alias("n"))
    lists = marks.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("base", "n"))).alias("marks"))
    rows = reads.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_reads")).join(lists, KEYS)

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples():
                rng = np.random.default_rng(P.seed_of(r.transcript_id, r.replicate))
                dealt = detect.null_adjacency(int(r.n_reads), np.array([x["n"] for x in r.marks]), 1, rng)[0]
                out += [(r.transcript_id, r.replicate, x["base"], int(n)) for x, n in zip(r.marks, np.diag(dealt), strict=True)]
            yield pd.DataFrame(out, columns=[*KEYS, "base", "mutations"])

    return rows.mapInPandas(run, "transcript_id long, replicate long, base long, mutations long")


def _matrices(spark, d, keys: list[str]) -> DataFrame:
    """Keys and cells (i, j, n), one row each: the co-mutation matrix, of bounded size whatever the number of reads."""
    return J.comutation_matrix(S.reads(spark, d), keys).groupBy(*keys).agg(F.collect_list(F.struct("i", "j", "n")).alias("cells"))


def _mapped(matrices: DataFrame, keys: list[str], one, columns: list[str], schema: str) -> DataFrame:
    """The rows that one(dense matrix, *keys) gives for each matrix."""

    def run(batches):
        for b in batches:
            out = [(*key, *x) for *key, cells in b[[*keys, "cells"]].itertuples(index=False) for x in one(P.matrix(cells, np.arange(S.LENGTH)), *key)]
            yield pd.DataFrame(out, columns=[*keys, *columns])

    return matrices.repartition(*keys).mapInPandas(run, ", ".join([*(f"{k} long" for k in keys), schema]))


@query()
def eigengaps(spark, d):
    return _mapped(_matrices(spark, d, KEYS), KEYS, lambda a, *_: enumerate(spectral.eigengaps(a).round(9)), ["k", "gap"], "k int, gap double")


@query()
def ptba(spark, d):
    """Clusters detected in every window of every replicate."""
    p = Params(min_base_coverage=1, min_filtered_reads=20, min_mutation_freq=0.0, shape=True)
    unique = A.unique_reads(S.reads(spark, d), KEYS)
    w = J.window_reads(unique, SIZE, GRID.count, GRID.step)
    rows = w.select(F.col("replicate").cast("int").alias("replicate"), F.col("transcript_id").cast("string").alias("transcript_id"), F.col("window_idx").cast("int").alias("window_idx"), F.col("start").cast("int").alias("start"), "occurrences", F.transform("idx", lambda i: i.cast("int")).alias("idx"))
    grid = spark.createDataFrame([(str(t), "A" * S.LENGTH) for t in range(4)], "transcript_id string, sequence string")
    return P.detect_windows(rows, grid, p).select("replicate", "transcript_id", "window_idx", "n_clusters", "status")


@query()
def weibull_fit(spark, d):
    fitted = stats.weibull_fit(table(spark, d, "events").filter("value > 0"), ["event_type"], "value")
    return rounded(fitted.select("event_type", "shape", "scale"), "shape", "scale", digits=5)


@query()
def ks_critical(spark, d):
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"n": b["id"], "critical": [round(distributions.ks_critical(int(n), 0.10), 6) for n in b["id"]]})

    sizes = table(spark, d, "lineitem").select(F.ceil("l_quantity").cast("long").alias("id")).distinct()
    return sizes.mapInPandas(run, "n long, critical double")


# Runs and regions


def _labels(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select((F.col("user_id") % 8).alias("transcript_id"), F.col("event_id").alias("window_idx"), (F.col("event_id") % 3 + F.expr("event_id div 5") % 2).cast("int").alias("n"))


def _relabelled(spark, d, how) -> DataFrame:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("window_idx")
        labels = how([int(n) for n in rows["n"]])
        return pd.DataFrame({"transcript_id": key[0], "window_idx": rows["window_idx"], "n_clusters": labels})

    e = table(spark, d, "events")
    labels = e.select(F.col("user_id").alias("transcript_id"), F.col("event_id").alias("window_idx"), (F.col("event_id") % 3).cast("int").alias("n"))
    return labels.groupBy("transcript_id").applyInPandas(run, "transcript_id long, window_idx long, n_clusters int")


@query()
def span_expander(spark, d):
    return _relabelled(spark, d, lambda x: smoothing.collapse_outliers(x, [None] * len(x), 1, 2))


@query()
def fill_uninformative(spark, d):
    return _relabelled(spark, d, lambda x: smoothing.fill_uninformative(x, [None] * len(x)))


@query(f"with {RUNS} select transcript_id, row_number() over (partition by transcript_id order by first) - 1 as region_idx, n_clusters, (stop_n - first_n)::bigint as windows from (select s.*, (select count(*) from labels_ l where l.transcript_id = s.transcript_id and l.window_idx < s.first) as first_n, (select count(*) from labels_ l where l.transcript_id = s.transcript_id and l.window_idx < s.stop) as stop_n from spans s) where n_clusters > 0")
def region_range(spark, d):
    """At the default overlap regions are the runs of equal labels above 0."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("window_idx")
        found = regions.regions(list(range(len(rows))), [int(n) for n in rows["n"]], 10)
        return pd.DataFrame([[key[0], i, r.n_clusters, len(r.windows)] for i, r in enumerate(found)], columns=["transcript_id", "region_idx", "n_clusters", "windows"])

    return _labels(spark, d).groupBy("transcript_id").applyInPandas(run, "transcript_id long, region_idx long, n_clusters long, windows long")


# Cuts, matching and merging


def _graphs(spark, d, cut, columns: list[str], schema: str) -> DataFrame:
    def one(a: np.ndarray, t: int):
        linked = np.flatnonzero((a - np.diag(np.diag(a))).sum(axis=1) > 0)
        return cut(t, linked, graph_cut.cut_graph(a[np.ix_(linked, linked)]))

    return _mapped(_matrices(spark, d, ["transcript_id"]), ["transcript_id"], one, columns, schema)


@query()
def soft_graph_cut(spark, d):
    """With 2 restarts of 20 starts and a weight step of 0.1: the defaults take minutes a transcript."""
    p = Params(soft_clustering_iters=2, soft_clustering_inits=20, soft_clustering_weight_module=0.1)

    def cut(t, bases, g) -> list:
        w = graph_cut.soft_cut([g], 2, p.soft_clustering_weight_module, p.soft_clustering_inits, p.soft_clustering_iters, P.seed_of("cut", t))
        return [(int(b), c, round(float(w[i, c]), 6)) for i, b in enumerate(bases) for c in range(w.shape[1])]

    return _graphs(spark, d, cut, ["base", "cluster", "weight"], "base int, cluster int, weight double")


@query()
def hard_graph_cut(spark, d):
    rounds = Params().soft_clustering_iters

    def cut(t, bases, g) -> list:
        return list(zip(map(int, bases), map(int, graph_cut.hard_cut(g, 3, rounds, P.seed_of("hard", t)))))

    return _graphs(spark, d, cut, ["base", "cluster"], "base int, cluster int")


@query()
def spectral_bipartition(spark, d):
    return _mapped(_matrices(spark, d, ["transcript_id"]), ["transcript_id"], lambda a, t: enumerate(map(int, spectral.bipartition(a))), ["base", "part"], "base int, part int")


@query("""with s as (select s_suppkey, s_acctbal as x, abs(s_acctbal) as y, s_acctbal / 2 as z, s_suppkey * 10.0 as u, s_suppkey * 5.0 as v, 100.0 as w from supplier)
select s_suppkey, round(least(abs(x-u)+abs(y-v)+abs(z-w), abs(x-u)+abs(y-w)+abs(z-v), abs(x-v)+abs(y-u)+abs(z-w), abs(x-v)+abs(y-w)+abs(z-u), abs(x-w)+abs(y-u)+abs(z-v), abs(x-w)+abs(y-v)+abs(z-u)), 6) as cost from s""", views=False)
def best_matching(spark, d):
    """The cheapest matching of two lists of three, in Arrow batches."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"s_suppkey": b["s_suppkey"], "cost": [round(merge.matching(np.abs(np.subtract.outer(np.array(list(p)), np.array(list(q)))))[0], 6) for p, q in zip(b["p"], b["q"])]})

    x, k = F.col("s_acctbal"), F.col("s_suppkey")
    rows = table(spark, d, "supplier").select("s_suppkey", F.array(x, F.abs(x), x / 2).alias("p"), F.array(k * 10.0, k * 5.0, F.lit(100.0)).alias("q"))
    return rows.mapInPandas(run, "s_suppkey long, cost double")


@query()
def window_distance(spark, d):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ws = [S.merge_window(r) for r in rows.sort_values("vec_id").itertuples()]
        return pd.DataFrame([[key[0], i, j, round(merge.distance(ws[i], ws[j])[0], 6)] for i in range(len(ws)) for j in range(i + 1, len(ws))], columns=["region", "a", "b", "distance"])

    return S.merge_windows(spark, d).groupBy("region").applyInPandas(run, "region long, a int, b int, distance double")


@query()
def merge_windows(spark, d):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m = merge.merge_windows([S.merge_window(r) for r in rows.sort_values("vec_id").itertuples()])
        return pd.DataFrame([[key[0], m.begin + i, c, round(float(m.w[i, c]), 6), int(m.coverage[i])] for i in range(len(m.w)) for c in range(2)], columns=["region", "base", "cluster", "weight", "coverage"])

    return S.merge_windows(spark, d).groupBy("region").applyInPandas(run, "region long, base int, cluster int, weight double, coverage long")


# Structures


def _structures(spark, d) -> DataFrame:
    k = (F.col("o_orderkey") % 9 + 1).cast("int")
    j = F.least(k, (F.col("o_orderkey") % 4 + 1).cast("int"))
    o = table(spark, d, "orders").select("o_orderkey", k.alias("k"), j.alias("j"))
    return o.select("o_orderkey", "k", "j", F.expr("repeat('(', k) || '...' || repeat(')', k)").alias("truth"), F.expr("repeat('(', j) || repeat('.', 2 * k + 3 - 2 * j) || repeat(')', j)").alias("predicted"))


@query("select o_orderkey, 0 as first, cast(2 * k + 2 as int) as partner, cast(k as int) as length from (select o_orderkey, o_orderkey % 9 + 1 as k from orders)", views=False)
def helices(spark, d):
    return _structures(spark, d).select("o_orderkey", F.explode(ST.helices_of("truth")).alias("h")).select("o_orderkey", "h.first", "h.partner", "h.length")


@query("select o_orderkey % 5 as g, 1.0::double as ppv, round(sum(least(k, o_orderkey % 4 + 1)) / sum(k), 9) as sensitivity from (select o_orderkey, o_orderkey % 9 + 1 as k from orders) group by 1", views=False)
def pair_stats(spark, d):
    p = _structures(spark, d).select((F.col("o_orderkey") % 5).alias("g"), ST.pairs_of("truth").alias("t"), ST.pairs_of("predicted").alias("p"))
    return rounded(ST.pair_stats(p, ["g"], "t", "p"), "sensitivity")


@query("select o_orderkey, o_orderkey % 3 <> 0 as balanced, cast(2 * (k - least(k, o_orderkey % 4 + 1)) as int) as distance from (select o_orderkey, o_orderkey % 9 + 1 as k from orders)", views=False)
def structure_distance(spark, d):
    s = _structures(spark, d)
    cut = F.when(F.col("o_orderkey") % 3 == 0, F.expr("substring(truth, 1, length(truth) - 1)")).otherwise(F.col("truth"))
    return s.select("o_orderkey", ST.is_balanced(cut).alias("balanced"), ST.hamming(F.col("truth"), F.col("predicted")).alias("distance"))


# The whole


@query()
def simulate_reads(spark, d):
    """Reads of two conformations for every part, 40 bases and 20 reads each."""
    bases = F.sequence(F.lit(0), F.lit(39))
    cut = (F.col("p_partkey") % 20 + 10).cast("int")
    profiles = F.array(F.transform(bases, lambda i: (i < cut).cast("int")), F.transform(bases, lambda i: (i >= cut).cast("int")))
    database = table(spark, d, "part").select(F.col("p_partkey").alias("entry"), F.lit("AC" * 20).alias("sequence"), F.posexplode(profiles).alias("profile_idx", "profile"))
    return simulate.database_reads(spark, database, 30, n_reads=20, shares=["70,30"], rate=0.08).drop("sequence").withColumn("idx", _joined("idx"))


def _whole(spark, d) -> tuple[DataFrame, DataFrame, Params]:
    """All surrogate reads, their transcripts, and default options on the surrogate's grid of windows.

    Windows without a detection take their neighbours' label, or 1 where a transcript
    has none, so that regions are built and merged on tables of any size.
    """
    reads = kept(typed_reads(spark, d))
    counts = reads.groupBy("replicate", "transcript_id").agg(F.count(F.lit(1)).alias("n_reads"))
    transcripts = heads(spark).drop("n_reads").join(counts, ["replicate", "transcript_id"])
    return reads, transcripts, Params(win_len=SIZE, win_offset=STEP / SIZE, non_informative_to_surround=True, all_non_informative_to_one=True)


@query()
def result_json(spark, d):
    """The nested result documents of all surrogate transcripts."""
    return P.document_of(P.deconvolve(*_whole(spark, d)))


@query()
def raw_n_clusters(spark, d):
    reads, transcripts, p = _whole(spark, d)
    grid = kept(P.grids(reads, transcripts, p))
    return P.raw_n_clusters(P.detect_windows(kept(P.windowed(reads, grid)), grid, p), grid)


@query()
def failing_regions(spark, d):
    """The windows' lowered caps when the smaller cluster of one of each transcript's two regions is called too small."""
    reads, transcripts, p = _whole(spark, d)
    spans = [(0, 2 * SIZE, SIZE), (SIZE, S.LENGTH, SIZE + SIZE // 4)]
    at = [(begin, end, [[float(b < cut), float(b >= cut)] for b in range(begin, end)]) for begin, end, cut in spans]
    found = spark.createDataFrame([(r["replicate"], r["transcript_id"], i, begin, end, 2, i * 2, i * 2 + 3, w, [1] * (end - begin)) for r in transcripts.select(*P.R).collect() for i, (begin, end, w) in enumerate(at)], P.REGIONS)
    grid = kept(P.grids(reads, transcripts, p))
    assigned = kept(P.assigned_reads(reads, found, grid, p))
    labels = P.all_windows(grid).withColumn("n_clusters", F.lit(2))
    bad = P.failing(P.fractions_of(assigned, found), A.cluster_patterns(assigned, [*P.R, "region_idx"]), found, Params(min_cluster_fraction=0.3))
    caps = spark.createDataFrame([], "transcript_id string, window_idx int, cap int")
    return P.lowered(caps, bad, found, labels)
