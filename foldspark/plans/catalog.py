"""The registered queries over the surrogate views, each with its SQL counterpart where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import surrogate as S
from ..functions import stats
from ..operators import assign as A
from ..operators import coverage as C
from ..operators import filters as P
from ..operators import graph as G
from ..operators import joins as J
from ..operators import sets as U
from ..operators import windows as W
from ..tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
T = ["transcript_id"]
SIZE, STEP = 20, 10  # window size and offset of the surrogate grid
GRID = W.grid(S.LENGTH, SIZE, STEP)


def query(sql: str | None = None, views: bool = True):
    """Register a query; its SQL may use the surrogate views and further ones before its select."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            text = sql.strip()
            ORACLE[f.__name__] = text if not views else f"with {S.SQL}, {text[5:]}" if text.startswith("with ") else f"with {S.SQL} {text}"
        return f

    return put


def rounded(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# Filters

@query("select s_suppkey, s_name from supplier where lower(s_name) in (select lower(s_name) from supplier where s_nationkey < 9)", views=False)
def whitelist_filter(spark, d):
    suppliers = table(spark, d, "supplier")
    wanted = suppliers.filter("s_nationkey < 9").select(F.upper("s_name").alias("id"))
    return P.whitelist_filter(suppliers, wanted, "s_name").select("s_suppkey", "s_name")


@query("select transcript_id, base, mutations from mutated where base % 4 in (0, 1)")
def base_alphabet_filter(spark, d):
    m = C.base_stats(S.reads(spark, d), T, S.LENGTH)
    return m.filter(P.base_alphabet(S.nucleotide(F.col("base")))).select("transcript_id", "base", "mutations")


def _bars(df: DataFrame, keys: list[str]) -> DataFrame:
    """Thresholds of the surrogate data that any scale factor leaves in the middle: 4/5 of the top coverage, the mean mutations."""
    w = Window.partitionBy(*keys)
    return df.withColumn("cov_bar", F.max("coverage").over(w) * 4 / 5).withColumn("mut_bar", F.avg("mutations").over(w))


BARS = "bars as (select *, max(coverage) over (partition by transcript_id) * 4 / 5 as cov_bar, avg(mutations) over (partition by transcript_id) as mut_bar from stats)"
KEPT = f"{BARS}, kept as (select transcript_id, base, coverage, mutations from bars where coverage >= cov_bar and mutations / coverage > 0.005 and mutations > mut_bar)"


def _kept(spark, d) -> DataFrame:
    barred = _bars(C.base_stats(S.reads(spark, d), T, S.LENGTH), T)
    return barred.filter(P.base_quality(F.col("cov_bar"), F.col("mut_bar"), 0.005)).select("transcript_id", "base", "coverage", "mutations")


@query(f"with {KEPT} select * from kept")
def base_quality_filter(spark, d):
    return _kept(spark, d)


@query(f"with {KEPT} select transcript_id, base, mutations from (select k.*, avg(mutations) over (partition by transcript_id) as bar from kept k) where mutations > bar")
def base_refilter(spark, d):
    k = _kept(spark, d).withColumn("bar", F.avg("mutations").over(Window.partitionBy(*T)))
    return k.filter(P.base_quality(F.lit(0), F.col("bar"), 0.0, first=False)).select("transcript_id", "base", "mutations")


RSTATS = """
rmut as (select m.transcript_id, m.read_id % 3 as replicate, base, count(*) as mutations from mutations m group by all),
rcov as (select r.transcript_id, r.replicate, g.base, count(*) as coverage from reads r join (select distinct base from grid) g on r.b <= g.base and g.base < r.e group by all),
rstats as (select c.transcript_id, c.replicate, c.base, coverage, coalesce(mutations, 0) as mutations from rcov c left join rmut m using (transcript_id, replicate, base)),
rbars as (select *, max(coverage) over (partition by transcript_id, replicate) * 7 / 10 as cov_bar, avg(mutations) over (partition by transcript_id, replicate) as mut_bar from rstats)
"""


@query(f"""with {RSTATS} select transcript_id, base, row_number() over (partition by transcript_id order by base) - 1 as "column"
from rbars group by transcript_id, base having count(*) = 3 and bool_and(coverage >= cov_bar and mutations / coverage > 0.005 and mutations >= 0.9 * mut_bar)""")
def replicate_base_filter(spark, d):
    keys = ["transcript_id", "replicate"]
    per = C.base_stats(S.reads(spark, d), keys, S.LENGTH)
    w = Window.partitionBy(*keys)
    barred = per.withColumn("cov_bar", F.max("coverage").over(w) * 7 / 10).withColumn("mut_bar", F.avg("mutations").over(w))
    passes = P.base_quality(F.col("cov_bar"), 0.9 * F.col("mut_bar"), 0.005, at_least=True)
    return P.replicate_bases(barred, T, passes).select("transcript_id", "base", F.col("column").cast("long").alias("column"))


@query("select transcript_id, read_id, count(*) as n from mutations group by all having count(*) >= 2")
def read_filter(spark, d):
    return P.read_filter(S.reads(spark, d), 2).select("transcript_id", "read_id", F.size("idx").cast("long").alias("n"))


MASK = "".join("1" if i % 3 else "0" for i in range(S.LENGTH))


@query("select transcript_id, read_id, count(*) filter (base % 3 <> 0) as n, coalesce(sum(base) filter (base % 3 <> 0), 0)::bigint as bases from mutations group by all")
def mask_filter(spark, d):
    kept = P.mask_filter(S.reads(spark, d), MASK)
    return kept.select("transcript_id", "read_id", F.size("idx").cast("long").alias("n"), F.aggregate("idx", F.lit(0).cast("long"), lambda s, x: s + x).alias("bases"))


@query("select transcript_id, base, string_agg(read_id, ',' order by read_id) as reads from mutations group by all")
def transpose(spark, d):
    t = P.transpose(S.mutations(spark, d), T)
    return t.select("transcript_id", "base", F.array_join(F.transform("read_ids", lambda x: x.cast("string")), ",").alias("reads"))


@query(f"with {KEPT}, rows_ as (select m.transcript_id, m.read_id, count(k.base) as n from mutations m left join kept k using (transcript_id, base) group by all) select * from rows_ where n >= 2")
def base_and_read_filter(spark, d):
    kept = P.keep_bases(S.reads(spark, d), _kept(spark, d), T)
    return P.read_filter(kept, 2).select("transcript_id", "read_id", F.size("idx").cast("long").alias("n"))


@query("""with w as (select transcript_id, replicate, count(*) as n_reads from reads group by all), b as (select transcript_id, read_id % 3 as replicate, count(distinct base) as n_bases from mutations group by all)
select *, case when n_reads < 3000 then 'few reads' when n_bases < 10 then 'few bases' else 'ok' end as status from w join b using (transcript_id, replicate)""")
def analysis_guards(spark, d):
    reads = S.reads(spark, d)
    keys = ["transcript_id", "replicate"]
    n = reads.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reads"))
    b = reads.select(*keys, F.explode("idx").alias("base")).groupBy(*keys).agg(F.count_distinct("base").alias("n_bases"))
    return n.join(b, keys).withColumn("status", P.analysis_guard(3000, 10))


# Coverage and mutations


@query("select * from coverage")
def base_coverage(spark, d):
    return C.base_coverage(S.reads(spark, d), T, S.LENGTH)


@query("select transcript_id, base, count(*) as mutations from mutations group by all")
def base_mutations(spark, d):
    return C.base_mutations(S.mutations(spark, d), T)


@query("with n as (select transcript_id, count(*) as n from reads group by 1) select transcript_id, base, count(*) as mutations, round(count(*) / any_value(n), 9) as mean from mutations join n using (transcript_id) group by 1, 2")
def matrix_sum_mean(spark, d):
    return rounded(C.column_means(S.reads(spark, d), T), "mean")


@query(f"select transcript_id, read_id, count(*) as mutations, round(count(*) / {S.LENGTH}, 9) as mean from mutations group by 1, 2")
def row_sum_mean(spark, d):
    return rounded(C.row_means(S.reads(spark, d), S.LENGTH).select("transcript_id", "read_id", "mutations", "mean"), "mean")


@query("select transcript_id, base, round(coverage / max(coverage) over (partition by transcript_id), 9) as weight from coverage")
def base_weights(spark, d):
    return rounded(C.base_weights(C.base_coverage(S.reads(spark, d), T, S.LENGTH), T), "weight")


@query("with l as (select transcript_id, list_sort(list(e - b)) as l from reads group by 1) select transcript_id, l[len(l) // 2 + 1] as median_length from l")
def median_read_length(spark, d):
    return C.median_read_length(S.reads(spark, d), T)


@query("with l as (select transcript_id, list_sort(list(coverage)) as l from coverage group by 1) select transcript_id, l[least(cast(floor(0.9 * len(l)) as bigint) + 1, len(l))] as p90 from l")
def coverage_p90(spark, d):
    return C.coverage_p90(C.base_coverage(S.reads(spark, d), T, S.LENGTH), T)


# Windows

WIN = f"""win as (select i as window_idx, cast(floor(i * {float(GRID.step)} + 0.5) as bigint) as start from (select unnest(generate_series(0, {GRID.count - 1})) as i)),
win_reads as (select r.*, window_idx, start from reads r join win on b <= start and e >= start + {SIZE})"""


@query("""with t as (select s_suppkey as transcript_id, 60 + s_suppkey % 50 as length from supplier),
n as (select *, (length - 29) // 7 + 1 as n from t), g as (select *, unnest(generate_series(0, n - 1)) as window_idx from n),
s as (select transcript_id, window_idx, length, least(cast(floor(window_idx * (case when n > 1 then (length - 29) / (n - 1) else 0.0 end) + 0.5) as bigint), length - 29) as start from g)
select transcript_id, window_idx, start, start + 29 as stop from s""", views=False)
def window_grid(spark, d):
    lengths = table(spark, d, "supplier").select(F.col("s_suppkey").alias("transcript_id"), (60 + F.col("s_suppkey") % 50).alias("length"))
    return W.window_grid(lengths, 29, 7)


@query(f"with {WIN} select transcript_id, read_id, window_idx, (select count(*) from mutations m where m.transcript_id = w.transcript_id and m.read_id = w.read_id and m.base >= start and m.base < start + {SIZE}) as n from win_reads w")
def window_reads(spark, d):
    w = J.window_reads(S.reads(spark, d), SIZE, GRID.count, GRID.step)
    return w.select("transcript_id", "read_id", F.col("window_idx").cast("long").alias("window_idx"), F.size("idx").cast("long").alias("n"))


REGIONS = "regions as (select * from (values (0, 5, 25), (1, 20, 41), (2, 50, 60)) as r(region_idx, start, stop))"


@query(f"""with {REGIONS} select r.transcript_id, r.read_id, region_idx, count(*) as n, sum(base - start)::bigint as shifted from reads r join regions on b < stop and e > start
join mutations m on m.transcript_id = r.transcript_id and m.read_id = r.read_id and m.base >= start and m.base < stop group by all having count(*) >= 2""")
def region_reads(spark, d):
    reads = S.reads(spark, d)
    regions = spark.createDataFrame([(t, *r) for t in range(4) for r in ((0, 5, 25), (1, 20, 41), (2, 50, 60))], "transcript_id long, region_idx int, start int, stop int")
    out = J.region_reads(reads, regions, T, 2)
    return out.select("transcript_id", "read_id", "region_idx", F.size("idx").cast("long").alias("n"), F.aggregate("idx", F.lit(0).cast("long"), lambda s, x: s + x).alias("shifted"))


@query(f"with {WIN} select a.window_idx as a, b.window_idx as b from win a join win b on a.window_idx < b.window_idx and b.start < a.start + {SIZE}")
def window_pair_overlap(spark, d):
    windows = W.window_grid(spark.createDataFrame([(0, S.LENGTH)], "transcript_id long, length long"), SIZE, STEP)
    return J.window_pair_overlap(windows, T, SIZE, GRID.step).select("a", "b")


# n_clusters of the surrogate: reads of a replicate that cover a window, mod 4.
DETECTED = f"{WIN}, detected as (select transcript_id, window_idx, replicate, count(*) % 4 as n_clusters from win_reads group by all)"


def _detected(spark, d) -> DataFrame:
    w = J.window_reads(S.reads(spark, d), SIZE, GRID.count, GRID.step)
    return w.groupBy("transcript_id", F.col("window_idx").cast("long").alias("window_idx"), "replicate").agg((F.count(F.lit(1)) % 4).alias("n_clusters"))


CONSENSUS = f"""{DETECTED}, median as (select transcript_id, window_idx, quantile_disc(n_clusters, 0.5) as n_clusters from detected group by all),
consensus as (select m.transcript_id, m.window_idx, any_value(m.n_clusters) as n_clusters, avg(case when d.n_clusters = m.n_clusters then 1.0 else 0.0 end) as confidence
  from median m join detected d using (transcript_id, window_idx) group by 1, 2)"""


@query(f"with {CONSENSUS} select transcript_id, window_idx, n_clusters, round(confidence, 9) as confidence from consensus")
def replicate_consensus(spark, d):
    return rounded(W.replicate_consensus(_detected(spark, d), ["transcript_id", "window_idx"]), "confidence")


# A long label sequence: events in order, labelled by their value.
LABELS = "labels_ as (select user_id % 8 as transcript_id, event_id as window_idx, event_id % 3 + (event_id // 5) % 2 as n_clusters, case when event_id % 7 = 0 then event_id % 4 end as cap from events)"
RUNS = f"""{LABELS}, marks as (select *, case when n_clusters is distinct from lag(n_clusters) over w or row_number() over w = 1 then 1 else 0 end as m from labels_ window w as (partition by transcript_id order by window_idx)),
runs as (select *, sum(m) over (partition by transcript_id order by window_idx) as island from marks),
spans as (select transcript_id, min(window_idx) as first, max(window_idx) + 1 as stop, any_value(n_clusters) as n_clusters, min(cap) as cap from runs group by transcript_id, island)"""


def _spans(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    labels = e.select((F.col("user_id") % 8).alias("transcript_id"), F.col("event_id").alias("window_idx"), (F.col("event_id") % 3 + F.expr("event_id div 5") % 2).alias("n_clusters"), F.when(F.col("event_id") % 7 == 0, F.col("event_id") % 4).alias("cap"))
    return W.cluster_spans(labels, T)


@query(f"with {RUNS} select transcript_id, first, stop, n_clusters, cap from spans")
def cluster_spans(spark, d):
    return _spans(spark, d).select("transcript_id", "first", "stop", "n_clusters", "cap")


@query(f"""with {RUNS}, capped as (select transcript_id, first, stop, least(n_clusters, coalesce(cap, n_clusters)) as n_clusters, cap from spans),
marks2 as (select *, case when n_clusters is distinct from lag(n_clusters) over w or row_number() over w = 1 then 1 else 0 end as m from capped window w as (partition by transcript_id order by first)),
runs2 as (select *, sum(m) over (partition by transcript_id order by first) as island from marks2)
select transcript_id, min(first) as first, max(stop) as stop, any_value(n_clusters) as n_clusters, min(cap) as cap from runs2 group by transcript_id, island""")
def merge_spans(spark, d):
    capped = _spans(spark, d).withColumn("n_clusters", P.capped(F.col("n_clusters"), F.col("cap")))
    return W.merge_spans(capped, T).select("transcript_id", "first", "stop", "n_clusters", "cap")


@query(f"with {RUNS} select transcript_id, first, n_clusters, lag(n_clusters) over w as left_n, lead(n_clusters) over w as right_n from spans window w as (partition by transcript_id order by first)")
def span_neighbors(spark, d):
    return W.span_neighbors(_spans(spark, d), T).select("transcript_id", "first", "n_clusters", "left_n", "right_n")


@query(f"""with {CONSENSUS}, c as (select c.*, start from consensus c join win using (window_idx)),
m as (select *, case when row_number() over w = 1 or n_clusters is distinct from lag(n_clusters) over w or confidence is distinct from lag(confidence) over w then 1 else 0 end as m from c window w as (partition by transcript_id order by window_idx)),
i as (select *, sum(m) over (partition by transcript_id order by window_idx) as island from m)
select transcript_id, min(start) as start, max(start) + {SIZE} as stop, any_value(n_clusters) as n_clusters, round(any_value(confidence), 9) as confidence from i group by transcript_id, island""")
def confidence_segments(spark, d):
    c = W.replicate_consensus(_detected(spark, d), ["transcript_id", "window_idx"])
    placed = c.withColumn("start", F.floor(F.col("window_idx") * F.lit(float(GRID.step)) + 0.5))
    return rounded(W.confidence_segments(placed, T, SIZE), "confidence")


@query(f"with {CONSENSUS} select transcript_id, window_idx, case when max(n_clusters) over (partition by transcript_id) = 0 then 1 else n_clusters end as n_clusters from consensus")
def uninformative_to_one(spark, d):
    c = W.replicate_consensus(_detected(spark, d), ["transcript_id", "window_idx"])
    return P.all_uninformative_to_one(c, T).select("transcript_id", "window_idx", "n_clusters")


@query("select user_id, k, round(lead(value) over (partition by user_id order by k) - value, 9) as gap from (select user_id, value, row_number() over (partition by user_id order by value, event_id) as k from events) qualify gap is not null", views=False)
def eigengap_diff(spark, d):
    """Differences of each user's ascending values."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("value", "event_id")).cast("long")
    values = table(spark, d, "events").select("user_id", place.alias("k"), "value")
    return rounded(W.eigengap_diff(values, ["user_id"]), "gap")


# The base-base graph

PAIRS = "pairs as (select a.transcript_id, a.base as i, b.base as j, count(*) as n from mutations a join mutations b on a.transcript_id = b.transcript_id and a.read_id = b.read_id and a.base <= b.base group by all)"
CLIPPED = f"{PAIRS}, clipped as (select p.transcript_id, p.i, p.j, case when p.n > 0.02 * coalesce(o.n, 0) then 0 else p.n end as n from pairs p left join pairs o on o.transcript_id = p.transcript_id and o.i = p.i and o.j = p.i where p.i < p.j)"
DEGREE = f"{CLIPPED}, degree as (select transcript_id, i, sum(n)::bigint as degree from (select transcript_id, i, n from clipped union all select transcript_id, j, n from clipped) group by 1, 2)"


def _pairs(spark, d) -> DataFrame:
    return J.comutation_matrix(S.reads(spark, d), T)


@query(f"with {PAIRS} select * from pairs")
def comutation_matrix(spark, d):
    return _pairs(spark, d)


@query(f"""with {PAIRS}, w as (select transcript_id, base, coverage / max(coverage) over (partition by transcript_id) as weight from coverage)
select p.transcript_id, i, j, round(n / sqrt(a.weight * b.weight), 9) as w from pairs p join w a on a.transcript_id = p.transcript_id and a.base = i join w b on b.transcript_id = p.transcript_id and b.base = j where a.weight > 0 and b.weight > 0""")
def comutation_weighted(spark, d):
    weights = C.base_weights(C.base_coverage(S.reads(spark, d), T, S.LENGTH), T)
    return rounded(J.comutation_weighted(_pairs(spark, d), weights, T), "w")


@query(f"with {CLIPPED} select * from clipped")
def adjacency_clip(spark, d):
    return G.adjacency_clip(_pairs(spark, d), T, 0.02)


@query(f"with {DEGREE} select * from degree")
def degree(spark, d):
    return G.degree(G.adjacency_clip(_pairs(spark, d), T, 0.02), T)


@query(f"""with {DEGREE}, u as (select transcript_id, i, degree, case when degree < 1e-4 then 1.0 else degree end as d from degree)
select c.transcript_id, c.i, c.j, round(-n / sqrt(cast(a.d as double) * cast(b.d as double)), 9) as cell from clipped c join u a on a.transcript_id = c.transcript_id and a.i = c.i join u b on b.transcript_id = c.transcript_id and b.i = c.j where n <> 0
union all select transcript_id, i, i, case when degree < 1e-4 then cast(degree as double) else 1.0 end from u""")
def normalized_laplacian(spark, d):
    return rounded(G.normalized_laplacian(G.adjacency_clip(_pairs(spark, d), T, 0.02), T), "cell")


WEIGHTS = f"weights as (select transcript_id, base, cluster, case when cluster = 0 then (base % 7 + 1) / 10.0 else 1 - (base % 7 + 1) / 10.0 end as weight from grid, (values (0), (1)) as c(cluster))"


def _weights(spark) -> DataFrame:
    w = (F.col("base") % 7 + 1) / F.lit(10.0)
    grid = spark.range(4).select(F.col("id").alias("transcript_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(S.LENGTH - 1).cast("long"))).alias("base"))
    return grid.withColumn("cluster", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("weight", F.when(F.col("cluster") == 0, w).otherwise(1 - w))


@query(f"""with {PAIRS}, {WEIGHTS}, both_ as (select transcript_id, i, j, n from pairs where i < j union all select transcript_id, j, i, n from pairs where i < j),
s as (select e.transcript_id, a.cluster, sum(n * a.weight * b.weight) as inner_, sum(n * a.weight * (1 - b.weight)) as across_ from both_ e join weights a on a.transcript_id = e.transcript_id and a.base = e.i
  join weights b on b.transcript_id = e.transcript_id and b.base = e.j and b.cluster = a.cluster group by all)
select transcript_id, cluster, round(cast(across_ as double) / cast(inner_ as double), 6) as score from s""")
def cut_score(spark, d):
    half = _pairs(spark, d).filter("i < j").select("transcript_id", "i", "j", F.col("n").alias("g"))
    edges = half.unionByName(half.select("transcript_id", F.col("j").alias("i"), F.col("i").alias("j"), "g"))
    return rounded(G.cut_scores(edges, _weights(spark), T), "score", digits=6)


# Assignment

UNIQUE = """listed as (select r.transcript_id, r.read_id, b, e, string_agg(base, ',' order by base) as idx from reads r join mutations using (transcript_id, read_id) group by all),
uniq as (select transcript_id, b as "begin", e as "end", idx, count(*) as occurrences from listed group by all)"""
ASSIGNED = f"""{UNIQUE}, {WEIGHTS}, un as (select *, row_number() over () as u from uniq), ub as (select u, transcript_id, unnest(string_split(idx, ','))::bigint as base from un),
scored as (select u, cluster, round(sum(weight), 6) as score from ub join weights using (transcript_id, base) group by all),
best as (select u, cluster, count(*) over (partition by u) as ties from (select *, rank() over (partition by u order by score desc) as r from scored) where r = 1),
assigned as (select transcript_id, "begin", "end", idx, cluster, ties, occurrences // ties as assigned from best join un using (u))"""


def _joined(idx: str):
    return F.array_join(F.transform(idx, lambda x: x.cast("string")), ",")


def _assigned(spark, d) -> DataFrame:
    # Weights in tenths are whole numbers of tenths: scores of equal reads tie exactly.
    tenths = _weights(spark).withColumn("weight", F.round(F.col("weight") * 10).cast("double"))
    return A.assign(A.unique_reads(S.reads(spark, d), T), tenths, T)


@query(f"with {UNIQUE} select * from uniq")
def unique_reads(spark, d):
    return A.unique_reads(S.reads(spark, d), T).select("transcript_id", "begin", "end", _joined("idx").alias("idx"), "occurrences")


@query(f"with {ASSIGNED} select * from assigned")
def read_assignment(spark, d):
    return _assigned(spark, d).select("transcript_id", "begin", "end", _joined("idx").alias("idx"), "cluster", "ties", "assigned")


@query(f"with {ASSIGNED} select transcript_id, cluster, n, round(n / sum(n) over (partition by transcript_id), 9) as fraction from (select transcript_id, cluster, sum(assigned)::bigint as n from assigned group by 1, 2)")
def cluster_fractions(spark, d):
    return rounded(A.cluster_fractions(_assigned(spark, d), T), "fraction")


@query(f"with {ASSIGNED} select transcript_id, cluster, base, sum(assigned)::bigint as mutations from (select *, unnest(string_split(idx, ','))::bigint as base from assigned) group by all")
def cluster_patterns(spark, d):
    return A.cluster_patterns(_assigned(spark, d), T)


@query(f"""with {ASSIGNED}, c as (select distinct transcript_id, cluster from assigned)
select transcript_id, cluster, base, coalesce(sum(assigned), 0)::bigint as coverage from c join grid using (transcript_id) left join assigned a using (transcript_id, cluster) where base >= "begin" and base < "end" group by all
union all select transcript_id, cluster, base, 0 from c join grid g using (transcript_id) where not exists (select 1 from assigned a where a.transcript_id = c.transcript_id and a.cluster = c.cluster and g.base >= "begin" and g.base < "end")""")
def cluster_base_coverage(spark, d):
    return A.cluster_coverage(_assigned(spark, d), T, S.LENGTH)


@query(f"""with {WIN}, once as (select distinct transcript_id, read_id, b, e from win_reads where window_idx in (1, 2))
select g.transcript_id, g.base, count(o.read_id) as coverage from grid g left join once o on o.transcript_id = g.transcript_id and g.base >= o.b and g.base < o.e group by all""")
def region_precoverage(spark, d):
    w = J.window_reads(S.reads(spark, d), SIZE, GRID.count, GRID.step).withColumn("window_idx", F.col("window_idx").cast("long"))
    regions = spark.createDataFrame([(t, i, 0) for t in range(4) for i in (1, 2)], "transcript_id long, window_idx long, region_idx int")
    return C.base_coverage(A.region_reads_once(w, regions, T), T, S.LENGTH)


@query("with p as (select a.transcript_id, a.read_id as a, b.read_id as b from reads a join reads b on a.transcript_id = b.transcript_id and b.read_id = a.read_id + 1) select p.*, (select count(*) from mutations x join mutations y on x.base = y.base where x.transcript_id = p.transcript_id and y.transcript_id = p.transcript_id and x.read_id = a and y.read_id = b) as common from p")
def intersection_count(spark, d):
    r = S.reads(spark, d)
    a = r.select("transcript_id", F.col("read_id").alias("a"), F.col("idx").alias("x"))
    b = r.select("transcript_id", (F.col("read_id") - 1).alias("a"), F.col("read_id").alias("b"), F.col("idx").alias("y"))
    return a.join(b, ["transcript_id", "a"]).select("transcript_id", "a", "b", J.intersection_count(F.col("x"), F.col("y")).alias("common"))


@query("""with t as (select transcript_id, replicate, count(*) as n_reads, substr('ACGTACGT', (transcript_id + case when transcript_id = 2 then replicate else 0 end) % 4 + 1, 4) as sequence from reads where not (transcript_id = 3 and replicate = 1) group by all)
select transcript_id, count(*) as replicates, min(sequence) = max(sequence) as same_sequence, min(n_reads) as least_reads from t group by 1 having count(*) = (select count(distinct replicate) from t)""")
def replicate_align(spark, d):
    shift = F.col("transcript_id") + F.when(F.col("transcript_id") == 2, F.col("replicate")).otherwise(F.lit(0))
    t = S.reads(spark, d).filter("not (transcript_id = 3 and replicate = 1)").groupBy("transcript_id", "replicate").agg(F.count(F.lit(1)).alias("n_reads"))
    return J.replicate_align(t.withColumn("sequence", F.substring(F.lit("ACGTACGT"), (shift % 4 + 1).cast("int"), F.lit(4))))


# Sets


@query("select transcript_id, count(*) as n, sum(read_id)::bigint as ids from (select * from reads where replicate = 0 union all select * from reads where replicate > 0) group by 1")
def concat(spark, d):
    r = S.reads(spark, d)
    both = U.concat(r.filter("replicate = 0"), r.filter("replicate > 0"))
    return both.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n"), F.sum("read_id").alias("ids"))


@query("""with a as (select transcript_id, base from mutations where read_id % 2 = 0), b as (select transcript_id, base from mutations where read_id % 2 = 1),
s as (select transcript_id, base, 1 as n from a union all select transcript_id, base, -1 from b) select transcript_id, base, sum(n)::bigint as surplus from s group by all having sum(n) <> 0""")
def dataset_equality(spark, d):
    m = S.mutations(spark, d)
    a, b = (m.filter(F.col("read_id") % 2 == r).select("transcript_id", "base") for r in (0, 1))
    return U.differences(a, b)


@query("select a.n_nationkey as c1, b.n_nationkey as c2, c.n_nationkey as c3 from nation a join nation b on a.n_nationkey < b.n_nationkey join nation c on b.n_nationkey < c.n_nationkey", views=False)
def combinations(spark, d):
    return U.combinations(table(spark, d, "nation"), "n_nationkey", 3)


# Statistics


@query("select event_type, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as stddev, count(value) as n from events group by 1", views=False)
def null_moments(spark, d):
    return rounded(stats.null_moments(table(spark, d, "events"), ["event_type"], "value"), "mean", "stddev", digits=6)


@query("select event_id, round(sum(value) over (partition by event_type order by value, event_id rows unbounded preceding) / sum(value) over (partition by event_type), 6) as share from events", views=False)
def normalized_cumsum(spark, d):
    return rounded(stats.normalized_cumsum(table(spark, d, "events"), ["event_type"], "value", "event_id").select("event_id", "share"), "share", digits=6)


@query("""with r as (select l_returnflag, rank() over (partition by l_returnflag order by l_quantity) - 1 + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2 as x,
rank() over (partition by l_returnflag order by l_extendedprice) - 1 + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2 as y from lineitem) select l_returnflag, round(corr(x, y), 6) as rho from r group by 1""", views=False)
def rank_spearman(spark, d):
    return rounded(stats.spearman(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), "rho", digits=6)


@query("""with c as (select event_type, sum(t * p)::double as tp, sum((1 - t) * p)::double as fp, sum(t * (1 - p))::double as fn, sum((1 - t) * (1 - p))::double as tn
from (select event_type, (value > 50)::int as t, (user_id % 2 = 0)::int as p from events) group by 1)
select event_type, round(case when sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) = 0 then 0.0 else (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) end, 9) as mcc from c""", views=False)
def mcc(spark, d):
    return rounded(stats.mcc(table(spark, d, "events"), ["event_type"], F.col("value") > 50, F.col("user_id") % 2 == 0), "mcc")


@query("with p as (select event_type, quantile_cont(value, 0.95) as top from events group by 1) select event_id, round(least(value / top, 1.0), 9) as winsorized from events join p using (event_type)", views=False)
def winsorize(spark, d):
    return rounded(stats.winsorize(table(spark, d, "events"), ["event_type"], "value").select("event_id", "winsorized"), "winsorized")


@query("select l_returnflag, round(covar_samp(l_quantity, l_discount), 6) as covariance, round(var_samp(l_quantity), 6) as variance from lineitem group by 1", views=False)
def covariance(spark, d):
    return rounded(stats.covariance(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount"), "covariance", "variance", digits=6)


@query(f"""with {PAIRS}, w as (select transcript_id, base, coverage / max(coverage) over (partition by transcript_id) as weight from coverage),
t as (select p.transcript_id, p.n / c.coverage as f, a.weight * b.weight as u from pairs p join coverage c on c.transcript_id = p.transcript_id and c.base = p.i join w a on a.transcript_id = p.transcript_id and a.base = p.i join w b on b.transcript_id = p.transcript_id and b.base = p.j where p.i < p.j)
select transcript_id, round(sum(f * u) / sum(u * u), 9) as fraction from t group by 1""")
def unfolded_fraction(spark, d):
    coverage = C.base_coverage(S.reads(spark, d), T, S.LENGTH)
    w = C.base_weights(coverage, T)
    a = w.select("transcript_id", F.col("base").alias("i"), F.col("weight").alias("a")).join(coverage.select("transcript_id", F.col("base").alias("i"), "coverage"), ["transcript_id", "i"])
    b = w.select("transcript_id", F.col("base").alias("j"), F.col("weight").alias("b"))
    pairs = _pairs(spark, d).filter("i < j").join(a, ["transcript_id", "i"]).join(b, ["transcript_id", "j"])
    return rounded(stats.unfolded_fraction(pairs.withColumn("f", F.col("n") / F.col("coverage")).withColumn("u", F.col("a") * F.col("b")), T), "fraction")


@query("select event_type, round(sum(ln(1.42) - 1.42 * ln(40.0) + (1.42 - 1) * ln(value) - power(value / 40.0, 1.42)), 3) as log_likelihood from events where value > 0 group by 1", views=False)
def weibull_log_likelihood(spark, d):
    return rounded(stats.weibull_log_likelihood(table(spark, d, "events").filter("value > 0"), ["event_type"], "value", 1.42, 40.0), "log_likelihood", digits=3)


@query("select event_id, round(2 * least(c, 1 - c), 9) as p from (select event_id, 1 - exp(-power(value / 40.0, 1.42)) as c from events where value > 0)", views=False)
def two_tailed_p(spark, d):
    e = table(spark, d, "events").filter("value > 0")
    return e.select("event_id", F.round(stats.two_tailed(stats.weibull_cdf(F.col("value"), 1.42, 40.0)), 9).alias("p"))


@query("""with c as (select vec_id as number, embedding as centre from embeddings where vec_id < 5),
x as (select e.vec_id, number, list_sum(list_transform(list_zip(centre, embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))) as dist from embeddings e, c)
select vec_id, arg_min(number, dist) as number, round(min(dist), 6) as distance from x group by 1""", views=False)
def nearest_centroid(spark, d):
    e = table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    c = e.filter("vec_id < 5").select(F.col("vec_id").alias("number"), F.col("embedding").alias("centre"))
    return rounded(stats.nearest_centroid(e, c, "vec_id", "embedding"), "distance", digits=6)


@query("select l_orderkey, l_linenumber, cast(floor(l_discount * 255 + 0.5) as smallint) as code, round(floor(l_discount * 255 + 0.5) / 255, 9) as decoded from lineitem", views=False)
def tiny_fraction(spark, d):
    code = stats.tiny_encode(F.col("l_discount"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", code.alias("code"), F.round(stats.tiny_decode(code), 9).alias("decoded"))


@query(f"with {KEPT}, {WEIGHTS}, k as (select w.* from weights w join kept using (transcript_id, base)) select g.transcript_id, g.base, c.cluster, coalesce(k.weight, 0.0)::double as weight from grid g, (values (0), (1)) as c(cluster) left join k on k.transcript_id = g.transcript_id and k.base = g.base and k.cluster = c.cluster")
def unfilter_weights(spark, d):
    full = _weights(spark)
    some = full.join(_kept(spark, d).select("transcript_id", "base"), ["transcript_id", "base"], "left_semi")
    return P.unfilter_weights(some, full.select("transcript_id", "base", "cluster"), T)


from . import kernel_queries, matrix_queries  # noqa: E402, F401 - they register their queries here
