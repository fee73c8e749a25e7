"""Registered queries of sources, sinks, matrix slices, weights and kernels that SQL can check. Imported by the catalog."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import simulate
from .. import surrogate as S
from ..functions import arith, stats, udtf
from ..functions import structures as ST
from ..kernels import distributions, graph_cut, merge, regions, smoothing, spectral
from ..operators import assign as A
from ..operators import coverage as C
from ..operators import filters as P
from ..operators import graph as G
from ..operators import joins as J
from ..operators import matrix as M
from ..operators import windows as W
from ..params import Params
from ..sources import mm, text
from ..tables import table
from . import deconvolve as D
from .catalog import ASSIGNED, CLIPPED, GRID, KEPT, PAIRS, RUNS, SIZE, T, UNIQUE, WEIGHTS, WIN, _assigned, _joined, _kept, _pairs, _weights, query, rounded
from .kernel_queries import KEYS, _labels, _mapped, _matrices, _structures, _whole, folder, heads, typed_reads


def _files(spark, path: str) -> list[str]:
    files = [r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.mm").load(path).select("path").collect()]
    return [f.replace("file:/", "file:///", 1) if f.startswith("file:/") and not f.startswith("file:///") else f for f in files]


# Sources and sinks


@query("select 'T' || transcript_id as transcript_id, count(*) as n_reads from reads group by 1")
def mmi_scan(spark, d):
    """Headers alone, found by the index files: reads are skipped."""
    path = folder(spark)
    mm.write_mm(typed_reads(spark, d), heads(spark, 1), path)
    return mm.read_mm(spark, _files(spark, path))[0].groupBy("transcript_id").agg(F.sum("n_reads").alias("n_reads"))


@query("select distinct 'T' || transcript_id as transcript_id, true as marked from reads")
def trailer_check(spark, d):
    """Every file of written maps ends in the marker; one without it is an error."""
    path = folder(spark)
    mm.write_mm(typed_reads(spark, d), heads(spark, 1), path)
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.mm").load(path).select("path", F.substring("content", -7, 7).cast("string").alias("end"))
    ends = whole.agg(F.bool_and(F.col("end") == mm.TRAILER.decode()).alias("marked"))
    return mm.read_mm(spark, _files(spark, path))[0].select("transcript_id").distinct().crossJoin(ends)


@query("select read_id % 3 as replicate, 'T' || transcript_id as transcript_id, count(*) as n_reads, sum(bases)::bigint as bases from (select transcript_id, read_id, sum(base) as bases from mutations group by all) group by all")
def multi_file(spark, d):
    """Three replicates, written as maps of their own and read as one source."""
    reads, found = typed_reads(spark, d), None
    for replicate in range(3):
        path = folder(spark)
        mm.write_mm(reads.filter(F.col("replicate") == replicate), heads(spark, 1), path, 1)
        one = mm.read_mm(spark, _files(spark, path))[1].withColumn("replicate", F.lit(replicate).cast("long"))
        found = one if found is None else found.unionByName(one)
    total = F.aggregate("idx", F.lit(0).cast("long"), lambda s, x: s + x)
    return found.groupBy("replicate", "transcript_id").agg(F.count(F.lit(1)).alias("n_reads"), F.sum(total).alias("bases"))


@query(f"""with {UNIQUE} select "begin", "end", idx, sum(occurrences)::bigint as occurrences from uniq group by all""")
def ringmap_text_scan(spark, d):
    """All surrogate reads written as start, end and 0/1 marks, and read back."""
    path = folder(spark)
    marks = F.array_join(F.transform(F.sequence(F.col("begin"), F.col("end") - 1), lambda i: F.when(F.array_contains("idx", i), "1").otherwise("0")), "")
    S.reads(spark, d).select((F.col("begin") + 1).alias("start"), F.col("end").alias("stop"), marks.alias("hits")).write.csv(path, sep="\t")
    read = text.read_matrix(spark, path)
    return read.groupBy(F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), _joined("idx").alias("idx")).agg(F.count(F.lit(1)).alias("occurrences"))


@query("select lower(s_name) as id from supplier", views=False)
def whitelist_scan(spark, d):
    path = folder(spark)
    table(spark, d, "supplier").select(F.concat(F.lit("  "), F.upper("s_name"), F.lit(" "))).write.text(path)
    return mm.read_whitelist(spark, path)


@query("""with s as (select p_partkey, p_partkey % 5 + 1 as k from part),
t as (select repeat('ACGT', k + 1) as sequence, k, 4 * (k + 1) as n from s)
select sequence, repeat('(', k) || repeat('.', n - 2 * k) || repeat(')', k) as structure, (n - 2 * k) * k as total, count(*) as entries, true as valid from t group by all""", views=False)
def structures_scan(spark, d):
    """A database of structures written as text blocks and read back, with its check of the counts."""
    path, k = folder(spark), F.col("p_partkey") % 5 + 1
    s = table(spark, d, "part").select(k.cast("int").alias("k"))
    free = F.expr("4 * (k + 1) - 2 * k")
    structure = F.concat(F.expr("repeat('(', k)"), F.repeat(F.lit("."), free), F.expr("repeat(')', k)"))
    counts = F.array_join(F.concat(F.array_repeat(F.lit("0"), F.col("k")), F.array_repeat(F.col("k").cast("string"), free), F.array_repeat(F.lit("0"), F.col("k"))), ",")
    s.select(F.concat_ws("\n", F.expr("repeat('ACGT', k + 1)"), structure, counts, F.lit(""))).write.text(path)
    read = text.read_structures(spark, path)
    wrong = text.bad_profiles(read).select("entry").distinct().withColumn("wrong", F.lit(True))
    whole = read.join(wrong, "entry", "left")
    return whole.groupBy("sequence", "structure").agg(F.max(F.aggregate("profile", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"), F.count(F.lit(1)).alias("entries"), F.max(F.col("wrong").isNull()).alias("valid"))


@query("select event_id, json_extract(props, '$.k')::bigint as k from events", views=False)
def json_fixture(spark, d):
    """JSON lines behind a header, read with a schema."""
    path, e = folder(spark), table(spark, d, "events")
    line = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"props":'), "props", F.lit("}"))
    e.select(F.concat(F.lit("header\n"), line)).write.text(path)
    return text.read_json_lines(spark, path, "event_id long, props struct<k:long>").select("event_id", "props.k")


#: The options with their defaults, as they stand in the result document.
DEFAULTS = """('processors', '0'), ('shape', 'false'), ('outputRawNClusters', 'false'), ('minBaseCoverage', '100'), ('minBaseMutations', '2'), ('minMutationFreq', '0.005'),
('maxMutationFreq', '0.35'), ('minReadMutations', '2'), ('minFilteredReads', '100'), ('minPermutations', '10'), ('maxPermutations', '100'), ('ignoreFirstEigengap', 'false'),
('eigengapCumRelThresh', '0.1'), ('eigengapAbsThresh', '0.03'), ('alpha', '0.01'), ('beta', '0.2'), ('minNullStdev', '0.025'), ('extraPermutations', '50'), ('minWinBases', '10'),
('lookaheadEigengaps', '0'), ('saveEigengapData', 'false'), ('eigengapDataOut', './eigengap_data'), ('minClusterFraction', '0.005'), ('softClusteringInits', '500'),
('softClusteringIters', '50'), ('softClusteringWeightModule', '0.005'), ('winLen', '100'), ('winLenFracRnaLen', '0.0'), ('winOffset', '0.01'), ('maxIgnoreWins', '0'), ('minExtWins', '6'),
('nonInformativeToSurround', 'false'), ('allNonInformativeToOne', 'false'), ('reportNonInformative', 'false'), ('skipAmbiguousAssignments', 'false'), ('minWindowsOverlap', '1.0')"""


@query(f"select * from (values {DEFAULTS}) as t(name, value)", views=False)
def params_json(spark, d):
    one = spark.createDataFrame([(Params().to_json(),)], "params string")
    parsed = one.select(F.explode(F.from_json("params", "map<string,string>")).alias("name", "value"))
    return parsed.filter("value is not null and name not in ('mm', 'output', 'logLevel', 'maxClusters')")


@query("""select transcript_id, read_id, b::varchar || '-' || e::varchar || ' ' || string_agg(base, ',' order by base) as line from reads join mutations using (transcript_id, read_id) group by transcript_id, read_id, b, e""")
def read_text(spark, d):
    """Reads as the simulator's text lines."""
    return text.read_lines(S.reads(spark, d)).select("transcript_id", "read_id", "line")


@query(f"with {ASSIGNED} select 'T' || transcript_id || '_0-{S.LENGTH}_c' || cluster as transcript_id, sum(assigned)::bigint as n_reads from assigned group by all")
def assignment_dump(spark, d):
    """Reads dealt to their clusters, written as a map of pseudo-transcripts, and read back."""
    reads = typed_reads(spark, d).withColumn("transcript_id", F.substring("transcript_id", 2, 9).cast("long"))
    assigned = _assigned(spark, d).withColumn("idx", F.transform("idx", lambda x: x.cast("int"))).withColumn("begin", F.col("begin").cast("int")).withColumn("end", F.col("end").cast("int"))
    placed = A.read_clusters(reads, assigned, T).filter("cluster is not null").withColumn("transcript_id", F.format_string(f"T%d_0-{S.LENGTH}_c%d", "transcript_id", "cluster"))
    path = folder(spark)
    mm.write_mm(placed.select("transcript_id", "read_id", "begin", "end", "idx"), placed.select("transcript_id").distinct().withColumn("sequence", F.lit("A" * S.LENGTH)), path)
    return mm.read_mm(spark, _files(spark, path))[0].groupBy("transcript_id").agg(F.sum("n_reads").alias("n_reads"))


# Filters and maps


@query("select transcript_id, read_id, count(*) filter (base % 4 in (0, 1)) as n from mutations group by all")
def assignment_base_filter(spark, d):
    """Only the alphabet counts when reads are assigned."""
    bases = spark.range(S.LENGTH).filter(P.base_alphabet(S.nucleotide(F.col("id")))).crossJoin(spark.range(4).toDF("transcript_id")).select("transcript_id", F.col("id").alias("base"))
    return P.keep_bases(S.reads(spark, d), bases, T).select("transcript_id", "read_id", F.size("idx").cast("long").alias("n"))


@query(f"select transcript_id, read_id from reads where e - b >= {SIZE}")
def short_read_skip(spark, d):
    return S.reads(spark, d).filter(P.long_enough(SIZE)).select("transcript_id", "read_id")


@query(f"with {KEPT} select transcript_id, base, row_number() over (partition by transcript_id order by base) - 1 as \"column\", null::bigint as read_id, null::bigint as row from kept union all select transcript_id, null, null, read_id, row_number() over (partition by transcript_id order by read_id) - 1 from (select transcript_id, read_id from mutations group by all having count(*) >= 3)")
def index_maps(spark, d):
    """Kept bases to columns, and filtered rows to reads."""
    columns = _kept(spark, d).select("transcript_id", "base", (F.row_number().over(Window.partitionBy(*T).orderBy("base")) - 1).cast("long").alias("column"))
    rows = M.numbered(P.read_filter(S.reads(spark, d), 3), T).select("transcript_id", "read_id", "row")
    return columns.unionByName(rows, allowMissingColumns=True).select("transcript_id", "base", "column", "read_id", "row")


@query(f"with {ASSIGNED}, p as (select transcript_id, cluster, base, sum(assigned)::bigint as mutations from (select *, unnest(string_split(idx, ','))::bigint as base from assigned) where base % 3 = 0 group by all) select transcript_id, cluster, base, coalesce(mutations, 0) as mutations from grid cross join (values (0), (1)) as c(cluster) left join p using (transcript_id, cluster, base)")
def remap_patterns(spark, d):
    """Counts on a third of the bases put back on the whole region."""
    some = A.cluster_patterns(_assigned(spark, d), T).filter("base % 3 = 0")
    return M.remap_patterns(some, _weights(spark).select("transcript_id", "cluster", "base"), T)


@query("select transcript_id, read_id, sum(case when base < 10 then base else base - 15 end)::bigint as bases, count(*) as n from mutations where base < 10 or base >= 25 group by all")
def shed_columns(spark, d):
    left = M.without_columns(S.reads(spark, d), 10, 25).filter(F.size("idx") > 0)
    return left.select("transcript_id", "read_id", F.aggregate("idx", F.lit(0).cast("long"), lambda s, x: s + x).alias("bases"), F.size("idx").cast("long").alias("n"))


@query("select s_suppkey, substr(s_name, 1, 3) || substr(s_name, 7) as name from supplier", views=False)
def spliced_sequence(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", M.spliced(F.col("s_name"), 3, 6).alias("name"))


ROWS = "rows_ as (select *, row_number() over (partition by transcript_id order by read_id) - 1 as r, count(*) over (partition by transcript_id) as n from reads)"


@query(f"with {ROWS}, c as (select g.transcript_id, g.base, count(r.read_id) as coverage, any_value(r.n) as n from grid g left join rows_ r on r.transcript_id = g.transcript_id and b <= g.base and g.base < e group by all) select transcript_id, base, floor(coverage / n * (n - 90))::bigint as coverage, (select count(*) from rows_ r where r.transcript_id = c.transcript_id and (r.r < 10 or r.r >= 100)) as n_reads from c where n is not null")
def removed_rows(spark, d):
    """Coverage in proportion after rows 10 to 99 of each transcript went."""
    reads = S.reads(spark, d)
    n = reads.groupBy(*T).agg(F.count(F.lit(1)).alias("n"))
    left = M.without_rows(reads, T, 10, 100).groupBy(*T).agg(F.count(F.lit(1)).alias("n_reads"))
    scaled = M.scaled_coverage(F.col("coverage"), F.col("n"), F.col("n") - 90)
    return C.base_coverage(reads, T, S.LENGTH).filter("coverage > 0").join(n, T).join(left, T).select("transcript_id", "base", scaled.alias("coverage"), "n_reads")


@query(f"with {ROWS} select transcript_id, read_id from rows_ where r < 1000 union all select transcript_id, -unnest(generate_series(1, 1000 - n)) from (select transcript_id, any_value(n) as n from rows_ group by 1) where n < 1000")
def resized_rows(spark, d):
    return M.resized(S.reads(spark, d), T, 1000).select("transcript_id", "read_id")


@query("select r.transcript_id, r.read_id, b, e from reads r join orders on o_orderkey = r.read_id where o_orderstatus = 'F'")
def subset(spark, d):
    """The reads of listed numbers."""
    wanted = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("read_id")).crossJoin(spark.range(4).toDF("transcript_id"))
    return M.subset(S.reads(spark, d), wanted, T).select("transcript_id", "read_id", F.col("begin").alias("b"), F.col("end").alias("e"))


@query(f"with {UNIQUE}, o as (select transcript_id, \"begin\", \"end\", idx, string_split(idx, ',')::bigint[] as l from uniq) select transcript_id, \"begin\", \"end\", idx, rank() over (partition by transcript_id order by \"begin\", \"end\", l) as place from o")
def row_comparison(spark, d):
    """Distinct rows in order: by begin, end, then bases."""
    place = F.rank().over(Window.partitionBy(*T).orderBy(M.row_order())).cast("long")
    return A.unique_reads(S.reads(spark, d), T).withColumn("place", place).select("transcript_id", "begin", "end", _joined("idx").alias("idx"), "place")


@query("select transcript_id, read_id, count(*) as n from mutations group by all")
def row_shuffle(spark, d):
    """Each read's marks on other bases, drawn by its number: as many as before, all within the transcript."""

    def run(batches):
        for b in batches:
            n = []
            for t, r, idx in zip(b["transcript_id"], b["read_id"], b["idx"]):
                x = spectral.incidence([idx], S.LENGTH)
                n.append(int(spectral.rows_perturbed(x, np.random.default_rng([int(t), int(r)])).sum()))
            yield pd.DataFrame({"transcript_id": b["transcript_id"], "read_id": b["read_id"], "n": n})

    return S.reads(spark, d).select("transcript_id", "read_id", "idx").mapInPandas(run, "transcript_id long, read_id long, n long")


VECTORS = f"vectors as (select transcript_id, base, [base / 10.0, (base % 7) / 4.0, 1.0]::double[] as v from grid)"


@query(f"with {VECTORS} select m.transcript_id, m.read_id, round(sum(v[1]), 6) as x, round(sum(v[2]), 6) as y, sum(v[3]) as z from mutations m join vectors using (transcript_id, base) group by all")
def row_projection(spark, d):
    base = F.col("base")
    vectors = _weights(spark).filter("cluster = 0").select("transcript_id", "base", F.array(base / 10.0, base % 7 / 4.0, F.lit(1.0)).alias("vector"))
    p = M.projected(S.reads(spark, d), vectors, T)
    return p.select("transcript_id", "read_id", F.round(F.col("projection")[0], 6).alias("x"), F.round(F.col("projection")[1], 6).alias("y"), F.col("projection")[2].alias("z"))


@query("select l_orderkey, l_linenumber, round(1 - l_discount, 6) as other, round(1 - l_tax, 6) as other2, 1.0::double as first, 0.0::double as second, 0.0::double as gone, case when l_discount < l_tax then -1 when l_discount > l_tax then 1 else 0 end as compared from lineitem", views=False)
def weight_algebra(spark, d):
    """Complement, all weight in the first cluster, none, and the order of weights of one base and two clusters."""
    w = F.array(F.array("l_discount", "l_tax"))
    v = F.array(F.array("l_tax", "l_tax"))
    a, b = M.weight_order(w), M.weight_order(v)
    compared = F.when(a < b, -1).when(a > b, 1).otherwise(0)
    f = M.only_first(w)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(M.complement(w)[0][0], 6).alias("other"), F.round(M.complement(w)[0][1], 6).alias("other2"), f[0][0].alias("first"), f[0][1].alias("second"), M.removed(w)[0][1].alias("gone"), compared.alias("compared"))


@query("select o_orderkey, case o_orderkey % 4 when 0 then '1,2' when 1 then '0,2' when 2 then '0,1' else '0,1,2' end as others from orders", views=False)
def hard_complement(spark, d):
    label = F.when(F.col("o_orderkey") % 4 < 3, (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", _joined(M.hard_complement(F.array(label), 3)[0]).alias("others"))


@query("select o_orderkey, case when o_orderkey % 5 > o_orderkey % 3 then o_orderkey % 3 else o_orderkey % 5 end as n from orders", views=False)
def constraint_cap(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", P.capped(k % 5, k % 3).alias("n"))


@query(f"with {WIN}, c as (select transcript_id, replicate, window_idx, count(*) as n from win_reads group by all) select transcript_id, window_idx, list_sum(list(n order by replicate))::bigint as total, string_agg(n, ',' order by replicate) as by_replicate from c group by all having count(*) = 3")
def replicate_zip(spark, d):
    """Windows of all replicates side by side, joined by key."""
    w = J.window_reads(S.reads(spark, d), SIZE, GRID.count, GRID.step)
    n = w.groupBy("transcript_id", "replicate", F.col("window_idx").cast("long").alias("window_idx")).agg(F.count(F.lit(1)).alias("n"))
    zipped = J.replicate_zip(n, ["transcript_id", "window_idx"], ["n"], 3)
    return zipped.select("transcript_id", "window_idx", F.aggregate("zipped", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("total"), F.array_join(F.transform("zipped", lambda x: x["n"].cast("string")), ",").alias("by_replicate"))


# Scores, graphs and regions


@query(f"""with {PAIRS}, {WEIGHTS}, both_ as (select transcript_id, i, j, n from pairs where i < j union all select transcript_id, j, i, n from pairs where i < j),
s as (select e.transcript_id, a.cluster, sum(n * a.weight * b.weight) as inner_, sum(n * a.weight * (1 - b.weight)) as across_ from both_ e join weights a on a.transcript_id = e.transcript_id and a.base = e.i
  join weights b on b.transcript_id = e.transcript_id and b.base = e.j and b.cluster = a.cluster group by all)
select transcript_id, round(sum(cast(across_ as double) / cast(inner_ as double)), 6) as score from s group by 1""")
def cut_score_sum(spark, d):
    half = _pairs(spark, d).filter("i < j").select("transcript_id", "i", "j", F.col("n").alias("g"))
    edges = half.unionByName(half.select("transcript_id", F.col("j").alias("i"), F.col("i").alias("j"), "g"))
    return rounded(G.cut_scores(edges, _weights(spark), T).groupBy(*T).agg(F.sum("score").alias("score")), "score", digits=6)


@query("select user_id, min(value) as value, min(event_id) filter (value = m) as event_id from (select *, min(value) over (partition by user_id) as m from events where event_id % 11 <> 0) group by 1", views=False)
def best_of_n(spark, d):
    """The best of each user's tries; those without a number lose."""
    score = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return M.best_of(table(spark, d, "events").select("user_id", score.alias("value"), "event_id"), ["user_id"], "value", "event_id").filter("value is not null")


@query(f"with {CLIPPED} select g.transcript_id, g.base from grid g where g.base % 2 = 0 and not exists (select 1 from clipped c where c.transcript_id = g.transcript_id and c.n > 0 and (c.i + 7 * c.j) % 97 < 2 and (c.i = g.base or c.j = g.base))")
def graph_guard(spark, d):
    """Bases without weight to another, in a graph of some of the pairs."""
    pairs = G.adjacency_clip(_pairs(spark, d), T, 0.02).filter("(i + 7 * j) % 97 < 2")
    return M.isolated(pairs, _weights(spark).filter("cluster = 0 and base % 2 = 0"), T)


@query(f"""with {RUNS}, s as (select transcript_id, n_clusters, first, (select count(*) from labels_ l where l.transcript_id = s.transcript_id and l.window_idx < s.first) as a, (select count(*) from labels_ l where l.transcript_id = s.transcript_id and l.window_idx < s.stop) as z from spans s),
e as (select transcript_id, n_clusters, unnest(generate_series(a, z - 1)) as spot, 1 as windows from s where n_clusters = 0 union all select transcript_id, n_clusters, a, z - a from s where n_clusters > 0)
select transcript_id, row_number() over (partition by transcript_id order by spot) - 1 as region_idx, n_clusters, windows::bigint as windows from e""")
def uninformative_regions(spark, d):
    """Regions with those without clusters, one a window."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("window_idx")
        found = regions.regions(list(range(len(rows))), [int(n) for n in rows["n"]], 10, uninformative=True)
        return pd.DataFrame([[key[0], i, r.n_clusters, len(r.windows)] for i, r in enumerate(found)], columns=["transcript_id", "region_idx", "n_clusters", "windows"])

    return _labels(spark, d).groupBy("transcript_id").applyInPandas(run, "transcript_id long, region_idx long, n_clusters long, windows long")


@query(f"with {RUNS}, s as (select transcript_id, (select count(*) from labels_ l where l.transcript_id = s.transcript_id and l.window_idx < s.first) as a, (select count(*) from labels_ l where l.transcript_id = s.transcript_id and l.window_idx < s.stop) as z from spans s) select transcript_id, a::bigint as at, z::bigint as next from s")
def region_advance(spark, d):
    """From the first window on: behind each leading run of equal labels."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        labels = rows.sort_values("window_idx")["n"].tolist()
        starts, at, begun = range(len(labels)), 0, []
        while at < len(labels):
            begun.append(at)
            at = regions.advanced(starts, labels, at, len(labels), 10, 10, {})
        return pd.DataFrame({"transcript_id": key[0], "at": begun, "next": [*begun[1:], at]})

    return _labels(spark, d).groupBy("transcript_id").applyInPandas(run, "transcript_id long, at long, next long")


@query("""with l as (select user_id % 8 as transcript_id, event_id as window_idx, (event_id // 7) % 3 as n from events),
m as (select *, case when n is distinct from lag(n) over w then 1 else 0 end as c from l window w as (partition by transcript_id order by window_idx)),
r as (select *, sum(c) over (partition by transcript_id order by window_idx) as island from m),
s as (select transcript_id, island, count(*) as size, any_value(n) as label from r group by 1, 2),
o as (select *, case when size >= 2 then label when row_number() over w = 1 then coalesce(lead(label) over w, label) end as own from s window w as (partition by transcript_id order by island)),
f as (select transcript_id, island, last_value(own ignore nulls) over (partition by transcript_id order by island) as n_clusters from o)
select transcript_id, window_idx, n_clusters from r join f using (transcript_id, island)""", views=False)
def small_spans(spark, d):
    e = table(spark, d, "events")
    labels = e.select((F.col("user_id") % 8).alias("transcript_id"), F.col("event_id").alias("window_idx"), (F.expr("event_id div 7") % 3).alias("n_clusters"))
    return M.without_small_spans(labels, T, 2)


WINDOWS = """w as (select vec_id, vec_id // 4 as region, vec_id % 4 as k, 16 * (vec_id % 4) as b, list_transform(embedding, lambda x: abs(x::double) / list_max(list_transform(embedding, lambda y: abs(y::double)))) as p from embeddings),
q as (select *, list_transform(p, lambda x: floor(least(greatest(x, 0), 1) * 255 + 0.5) / 255) as one, list_transform(p, lambda x: floor(least(greatest(1 - x, 0), 1) * 255 + 0.5) / 255) as two, b + len(p) as e from w),
pairs_ as (select x.region, x.k as a, y.k as b, greatest(x.b, y.b) as lo, least(x.e, y.e) as hi, least(x.b, y.b) as low, greatest(x.e, y.e) as high, x.b as xb, y.b as yb, x.one as x1, x.two as x2, y.one as y1, y.two as y2 from q x join q y on x.region = y.region and x.k < y.k),
cost as (select region, a, b, ((lo - low) + (high - hi)) * 0.25 as penalty, range(0, hi - lo) as spots, xb, yb, lo, x1, x2, y1, y2 from pairs_),
each_ as (select region, a, b, penalty, list_sum(list_transform(spots, lambda i: abs(x1[lo - xb + i + 1] - y1[lo - yb + i + 1]) + abs(x2[lo - xb + i + 1] - y2[lo - yb + i + 1]))) as same, list_sum(list_transform(spots, lambda i: abs(x1[lo - xb + i + 1] - y2[lo - yb + i + 1]) + abs(x2[lo - xb + i + 1] - y1[lo - yb + i + 1]))) as crossed from cost),
distances as (select region, a::integer as a, b::integer as b, least(same, crossed) + penalty as distance from each_)"""


@query(f"with {WINDOWS} select region, a, b, round(distance, 5) as distance from distances", views=False)
def window_pair_distance(spark, d):
    """Distances of single windows of two clusters: the cheaper of two matchings."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ws = [(int(r.vec_id) % 4, S.merge_window(r)) for r in rows.sort_values("vec_id").itertuples()]
        return pd.DataFrame([[key[0], a, b, round(merge.distance(v, w)[0], 5)] for i, (a, v) in enumerate(ws) for b, w in ws[i + 1 :]], columns=["region", "a", "b", "distance"])

    return S.merge_windows(spark, d).groupBy("region").applyInPandas(run, "region long, a int, b int, distance double")


@query(f"with {WINDOWS} select region, round(min(distance), 5) as distance from distances group by 1", views=False)
def closest_pair(spark, d):
    return window_pair_distance(spark, d).groupBy("region").agg(F.min("distance").alias("distance"))


# Distributions


@query("""with g as (select n, k, k / 14.0::double as d from (select unnest(generate_series(1, 20)) as n), (select unnest(generate_series(8, 13)) as k)),
t as (select n, k, d, unnest(generate_series(0, floor(n * (1 - d) + 1e-9)::int)) as j from g)
select n, k, round(least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)) * power(greatest(1 - d - j / n, 0), n - j) * power(d + j / n, j - 1) * d)), 9) as sf from t group by n, k, d""", views=False)
def ks_survival(spark, d):
    """The chance of a larger distance, for distances above one half, where a closed sum gives it."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame([[int(n), k, round(1 - distributions.ks_cdf(int(n), k / 14), 9)] for n in b["id"] for k in range(8, 14)], columns=["n", "k", "sf"])

    return spark.range(1, 21).mapInPandas(run, "n long, k long, sf double")


@query("select distinct ceil(l_quantity)::bigint as n, 0.1::double as level from lineitem", views=False)
def ks_critical_level(spark, d):
    """The critical distance is exceeded with probability 0.10."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame([[int(n), round(1 - distributions.ks_cdf(int(n), distributions.ks_critical(int(n), 0.10)), 6)] for n in b["id"]], columns=["n", "level"])

    sizes = table(spark, d, "lineitem").select(F.ceil("l_quantity").cast("long").alias("id")).distinct()
    return sizes.mapInPandas(run, "n long, level double")


@query("select event_type, round(quantile_cont(value, 0.5), 6) as gap, round(greatest(abs(quantile_cont(value, 0.5) - avg(value)) - stddev_samp(value) / 100, 0), 6) as distance from events group by 1", views=False)
def null_distance(spark, d):
    m = table(spark, d, "events").groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("gap"), F.avg("value").alias("mean"), (F.stddev_samp("value") / 100).alias("sd"))
    return m.select("event_type", F.round("gap", 6).alias("gap"), F.round(stats.null_distance(F.col("gap"), F.col("mean"), F.col("sd")), 6).alias("distance"))


@query("select distinct l_suppkey, true as stationary from lineitem", views=False)
def weibull_stationary(spark, d):
    """At each supplier's fit the likelihood's slope is zero, or the shape is at its bound of 1."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows["l_quantity"].to_numpy(dtype=float)
        shape, scale = distributions.weibull_fit(x)
        z = x / scale
        slope = 1 / shape + np.log(z).mean() - (z**shape * np.log(z)).mean()
        return pd.DataFrame([[key[0], bool(abs(slope) < 1e-6 or len(set(x)) == 1 or (shape == 1.0 and slope <= 0))]], columns=["l_suppkey", "stationary"])

    return table(spark, d, "lineitem").select("l_suppkey", "l_quantity").groupBy("l_suppkey").applyInPandas(run, "l_suppkey long, stationary boolean")


@query("""with g as (select n, k from (values (5), (30), (60)) as a(n), (select unnest(generate_series(0, 5)) as k)),
p as (select n, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.02) + (n - k) * ln(0.98)) as pmf from g) select n::bigint as n, k::bigint as k, round(sum(pmf) over (partition by n order by k), 9) as cdf from p""", views=False)
def binomial_cdf(spark, d):
    """The chance of at most k mutations in n bases."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame([[int(n), k, round(float(simulate.binomial_cdf(int(n), 0.02, 2.0)[k]), 9)] for n in b["n"] for k in range(6)], columns=["n", "k", "cdf"])

    return spark.createDataFrame([(5,), (30,), (60,)], "n long").mapInPandas(run, "n long, k long, cdf double")


@query("select o_orderkey, round((o_orderkey % 60 + 20) / 100.0, 9)::double as first, round(1 - (o_orderkey % 60 + 20) / 100.0, 9)::double as second from orders", views=False)
def stoichiometries(spark, d):
    """Lists of percentages as shares."""

    def run(batches):
        for b in batches:
            shares = [simulate.stoichiometry(x, 2) for x in b["listed"]]
            yield pd.DataFrame({"o_orderkey": b["o_orderkey"], "first": [round(s[0], 9) for s in shares], "second": [round(s[1], 9) for s in shares]})

    k = F.col("o_orderkey") % 60 + 20
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws(",", k.cast("string"), (100 - k).cast("string")).alias("listed")).mapInPandas(run, "o_orderkey long, first double, second double")


# Functions


@query("select p_partkey, gcd(p_partkey, p_size)::bigint as divisor, factorial((p_size % 15)::integer)::bigint as factorial, (p_size * (p_size - 1) // 2)::bigint as pairs from part", views=False)
def whole_number_math(spark, d):
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"p_partkey": b["p_partkey"], "divisor": [arith.gcd(int(x), int(y)) for x, y in zip(b["p_partkey"], b["p_size"])], "factorial": [arith.factorial(int(x) % 15) for x in b["p_size"]], "pairs": [arith.binomial(int(x), 2) for x in b["p_size"]]})

    return table(spark, d, "part").select("p_partkey", "p_size").mapInPandas(run, "p_partkey long, divisor long, factorial long, pairs long")


@query("""with t as (select s_suppkey, 60 + s_suppkey % 50 as length from supplier), n as (select *, (length - 29) // 7 + 1 as n from t), g as (select *, unnest(generate_series(0, n - 1)) as window_idx from n)
select s_suppkey, window_idx::integer as window_idx, least(cast(floor(window_idx * (case when n > 1 then (length - 29) / (n - 1) else 0.0 end) + 0.5) as integer), (length - 29)::integer) as start from g""", views=False)
def window_grid_udtf(spark, d):
    """The window grid as a table function in SQL."""
    udtf.register(spark)
    table(spark, d, "supplier").createOrReplaceTempView("foldspark_supplier")
    return spark.sql("select s_suppkey, w.window_idx, w.start from foldspark_supplier, lateral window_grid(cast(60 + s_suppkey % 50 as int), 29, 7) as w")


@query("""with c as (select l_orderkey, l_linenumber, floor(l_discount * 255 + 0.5)::bigint as a, floor(l_tax * 255 + 0.5)::bigint as b from lineitem)
select l_orderkey, l_linenumber, (a + b)::integer as added, case when a >= b then (a - b)::smallint end as subtracted, (a * b // 255)::integer as multiplied, (a // 3)::smallint as divided from c""", views=False)
def tiny_arithmetic(spark, d):
    a, b = stats.tiny_encode(F.col("l_discount")), stats.tiny_encode(F.col("l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", stats.tiny_add(a, b).alias("added"), stats.tiny_subtract(a, b).alias("subtracted"), stats.tiny_multiply(a, b).alias("multiplied"), stats.tiny_divide(a, F.lit(3)).alias("divided"))


@query("select o_orderkey, (2 * k + 3)::integer as first, (4 * k + 5 - (k - least(k, o_orderkey % 4 + 1)) - (k - least(k, o_orderkey % 4 + 1)))::integer as partner from (select o_orderkey, o_orderkey % 9 + 1 as k from orders)", views=False)
def structure_concat(spark, d):
    """The helix of a second structure behind a first one, and moved back to its own place."""
    both = _structures(spark, d).select("o_orderkey", "k", "j", ST.helices_of(ST.concatenated(F.col("truth"), F.expr("repeat('(', j) || repeat('.', 2 * k + 3 - 2 * j) || repeat(')', j)"))).alias("h"))
    second = both.select("o_orderkey", "k", "j", F.element_at("h", -1).alias("x"), ST.shifted(F.col("h"), F.lit(1)).alias("moved"))
    return second.select("o_orderkey", "x.first", (F.element_at("moved", -1)["partner"] - 1 - 2 * (F.col("k") - F.col("j"))).cast("int").alias("partner"))


# Kernels where SQL knows the answer


PLACES = "places as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as p, count(*) over (partition by user_id) as n from events)"


def _relabelled(spark, d, label, how) -> DataFrame:
    """Labels of each user's events, made of place p and number n, relabelled."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("event_id")
        return pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "n_clusters": how([int(x) for x in rows["label"]])})

    w = Window.partitionBy("user_id")
    placed = table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w.orderBy("event_id")).alias("p"), F.count(F.lit(1)).over(w).alias("n"))
    return placed.withColumn("label", F.expr(label)).groupBy("user_id").applyInPandas(run, "user_id long, event_id long, n_clusters int")


@query(f"with {PLACES}, z as (select *, n // 3 as a, n // 3 + n // 4 as b from places) select user_id, event_id, (case when p <= a then 1 when p > b then 2 when a = 0 then 2 when a >= n - b then 1 else 2 end)::integer as n_clusters from z", views=False)
def fill_one_run(spark, d):
    """One run without clusters between two others: the longer one takes it, the left one of equals."""
    return _relabelled(spark, d, "case when p <= n div 3 then 1 when p <= n div 3 + n div 4 then 0 else 2 end", lambda x: smoothing.fill_uninformative(x, [None] * len(x)))


@query(f"""with {PLACES}, z as (select *, n // 2 as a, n - n // 2 - 1 as c, case when user_id % 2 = 0 then 1 else 2 end as r from places),
t as (select *, case when a = 0 then case when c >= 3 then r else 3 end when c = 0 then case when a >= 3 then 1 else 3 end when r = 1 then case when a + c >= 3 then 1 else 3 end when a >= c then case when a >= 3 then 1 else 3 end else case when c >= 3 then r else 3 end end as mid from z)
select user_id, event_id, (case when p <= a then 1 when p = a + 1 then mid else r end)::integer as n_clusters from t where n > 8""", views=False)
def collapse_one_run(spark, d):
    """One window of another label goes to its neighbours: both if they agree, else the longer one."""
    out = _relabelled(spark, d, "case when p <= n div 2 then 1 when p = n div 2 + 1 then 3 when user_id % 2 = 0 then 1 else 2 end", lambda x: smoothing.collapse_outliers(x, [None] * len(x), 1, 3))
    many = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 8").select("user_id")
    return out.join(many, "user_id", "left_semi")


@query(f"with {PAIRS} select transcript_id, read_replicate as replicate, count(distinct base)::double as trace from (select a.transcript_id, a.read_id % 3 as read_replicate, a.base from mutations a join mutations b on a.transcript_id = b.transcript_id and a.read_id = b.read_id and a.base <> b.base) group by all")
def eigengap_trace(spark, d):
    """The eigenvalues, added up from their gaps, sum to the number of linked bases."""

    def one(a: np.ndarray, *_):
        gaps = spectral.eigengaps(a)
        return [(round(float((gaps * np.arange(len(gaps), 0, -1)).sum()), 6),)]

    return _mapped(_matrices(spark, d, KEYS), KEYS, one, ["trace"], "trace double").select("transcript_id", "replicate", "trace")


@query("select n_nationkey, base::integer as base, base < 6 as hard, base < 6 as soft, base < 6 as spectral from nation, (select unnest(generate_series(0, 11)) as base)", views=False)
def planted_cuts(spark, d):
    """Graphs of two blocks of six bases: which bases are with the first one, by hard cut, soft cut and bipartition."""

    def run(batches):
        for b in batches:
            out = []
            for k in b["n_nationkey"]:
                block = np.arange(12) // 6
                a = np.where(block[:, None] == block[None], 50.0 + k, 1.0)
                np.fill_diagonal(a, 100.0)
                g = graph_cut.cut_graph(a)
                hard, soft, parts = graph_cut.hard_cut(g, 2, 5, int(k)), graph_cut.soft_cut([g], 2, 0.25, 20, 3, int(k)).argmax(axis=1), spectral.bipartition(a)
                out += [(int(k), i, *(bool(x[i] == x[0]) for x in (hard, soft, parts))) for i in range(12)]
            yield pd.DataFrame(out, columns=["n_nationkey", "base", "hard", "soft", "spectral"])

    return table(spark, d, "nation").select("n_nationkey").mapInPandas(run, "n_nationkey int, base int, hard boolean, soft boolean, spectral boolean")


@query("""with w as (select vec_id, list_transform(embedding, lambda x: abs(x::double) / list_max(list_transform(embedding, lambda y: abs(y::double)))) as p from embeddings),
q as (select vec_id, unnest(range(0, len(p))) as base, p from w)
select vec_id, base::integer as base, round(floor(least(greatest(p[base + 1], 0), 1) * 255 + 0.5) / 255, 6) as first, round(floor(least(greatest(1 - p[base + 1], 0), 1) * 255 + 0.5) / 255, 6) as second, 150::bigint as coverage from q""", views=False)
def merge_of_equals(spark, d):
    """A window merged with itself, its clusters the other way round: relabelled, the same weights, both coverages."""

    def run(batches):
        for b in batches:
            out = []
            for vec, v in zip(b["vec_id"], b["embedding"]):
                w = np.abs(np.asarray(v, dtype=float))
                w = np.column_stack([w / w.max(), 1 - w / w.max()])
                m = merge.merge_windows([merge.single(0, w, np.full(len(w), 100)), merge.single(0, w[:, ::-1], np.full(len(w), 50))])
                out += [(int(vec), i, round(float(m.w[i, 0]), 6), round(float(m.w[i, 1]), 6), int(m.coverage[i])) for i in range(len(w))]
            yield pd.DataFrame(out, columns=["vec_id", "base", "first", "second", "coverage"])

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, base int, first double, second double, coverage long")


@query(f"""with {WIN}, n as (select w.transcript_id, w.replicate, window_idx, w.read_id, count(*) as marks from win_reads w join mutations m on m.transcript_id = w.transcript_id and m.read_id = w.read_id and m.base >= start and m.base < start + {SIZE} group by all),
f as (select transcript_id, replicate, window_idx, count(*) as n from n where marks >= 2 group by all), every_ as (select distinct transcript_id, replicate, window_idx from win_reads)
select transcript_id::varchar as transcript_id, replicate::integer as replicate, window_idx::integer as window_idx, coalesce(n, 0) < 100 as few_reads from every_ left join f using (transcript_id, replicate, window_idx)""")
def detection_guard(spark, d):
    """Windows that detection turns away for their few reads, after both filters."""
    p = Params(min_base_coverage=1, min_base_mutations=0, min_mutation_freq=0.0, min_permutations=1, max_permutations=1, shape=True)
    w = J.window_reads(A.unique_reads(S.reads(spark, d), KEYS), SIZE, GRID.count, GRID.step)
    rows = w.select(F.col("replicate").cast("int").alias("replicate"), F.col("transcript_id").cast("string").alias("transcript_id"), F.col("window_idx").cast("int").alias("window_idx"), F.col("start").cast("int").alias("start"), "occurrences", F.transform("idx", lambda i: i.cast("int")).alias("idx"))
    grid = spark.createDataFrame([(str(t), "A" * S.LENGTH) for t in range(4)], "transcript_id string, sequence string")
    return D.detect_windows(rows, grid, p).select("transcript_id", "replicate", "window_idx", (F.col("status") == "few reads").alias("few_reads"))


@query("select 'RNA_' || row_number() over (order by p_partkey) as transcript_id, 20::bigint as reads, 20::bigint as placed, 20::bigint as allowed from part", views=False)
def simulated_reads_hold(spark, d):
    """Every simulated read lies within its sequence, with marks in its extent and on its conformation's bases only."""
    bases = F.sequence(F.lit(0), F.lit(39))
    profiles = F.array(F.transform(bases, lambda i: (i < 20).cast("int")), F.transform(bases, lambda i: (i >= 20).cast("int")))
    database = table(spark, d, "part").select(F.col("p_partkey").alias("entry"), F.lit("AC" * 20).alias("sequence"), F.posexplode(profiles).alias("profile_idx", "profile"))
    r = simulate.database_reads(spark, database, 30, n_reads=20, shares=["70,30"], rate=0.2)
    placed = (F.col("begin") >= 0) & (F.col("end") == F.col("begin") + 30) & (F.col("end") <= 40)
    allowed = F.forall("idx", lambda i: (i >= F.col("begin")) & (i < F.col("end")) & ((i >= 20).cast("int") == F.col("conformation")))
    return r.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("reads"), F.count_if(placed).alias("placed"), F.count_if(allowed).alias("allowed"))


@query(f"select 'T' || transcript_id as id, '{'ACGT' * (S.LENGTH // 4)}' as sequence, count(*) filter (replicate = 0) as n0, count(*) filter (replicate = 1) as n1, count(*) filter (replicate = 2) as n2, true as covered from reads group by transcript_id")
def result_heads(spark, d):
    """What the result documents say of each transcript, read back as JSON, and whether their clusters span it."""
    schema = "sequence string, nReads array<long>, replicateClusters array<struct<start:int,end:int,nClusters:int,confidence:double>>"
    r = D.document_of(D.deconvolve(*_whole(spark, d))).select("id", F.from_json("document", schema).alias("x")).select("id", "x.*")
    covered = (F.element_at("replicateClusters", 1)["start"] == 0) & (F.array_max(F.transform("replicateClusters", lambda c: c["end"])) == S.LENGTH)
    return r.select("id", "sequence", *[F.col("nReads")[i].alias(f"n{i}") for i in range(3)], covered.alias("covered"))


@query("""with s as (select user_id, value, row_number() over w as i, count(*) over (partition by user_id) as n, sum(value) over (w rows unbounded preceding) / sum(value) over (partition by user_id) as share from events where value > 0 window w as (partition by user_id order by value, event_id)),
g as (select user_id, n, abs(1 - exp(-power(value / 40.0, 1.42)) - share) as gap from s), o as (select *, row_number() over (partition by user_id order by gap) as i from g)
select user_id, round(gap, 9) as distance from o where i = greatest(floor(n * 0.9), 1)""", views=False)
def fit_distance(spark, d):
    """How far each user's values are from a Weibull distribution: what the goodness of fit is judged by."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[key[0], round(distributions.fit_distance(rows["value"].to_numpy(), 1.42, 40.0), 9)]], columns=["user_id", "distance"])

    return table(spark, d, "events").filter("value > 0").select("user_id", "value").groupBy("user_id").applyInPandas(run, "user_id long, distance double")
