from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark import simulate
from foldspark.params import Params
from foldspark.plans import deconvolve as D
from foldspark.sources import mm

LENGTH = 40
P = Params(win_len=40, min_permutations=10, max_permutations=25, soft_clustering_inits=5, soft_clustering_iters=2, soft_clustering_weight_module=0.1, min_base_coverage=50)


def profiles():
    return [[int(i < 20) for i in range(LENGTH)], [int(i >= 20) for i in range(LENGTH)]]


@pytest.fixture(scope="module")
def tables(spark):
    both, one = profiles(), [[1] * LENGTH]
    reads = None
    for replicate in (0, 1):
        for name, p, shares in (("two", both, [0.7, 0.3]), ("one", one, [1.0])):
            r = simulate.simulate(spark, name, p, 4000, LENGTH, shares, rate=0.08, replicate=replicate, seed=3)
            reads = r if reads is None else reads.unionByName(r)
    reads = reads.persist()
    heads = spark.createDataFrame([(r, i, t, "AC" * (LENGTH // 2), 4000) for r in (0, 1) for i, t in enumerate(("two", "one"))], "replicate int, ordinal int, transcript_id string, sequence string, n_reads long")
    return reads, heads


def test_simulated_reads_are_the_same_in_any_partitioning(spark):
    a, b = (sorted(map(str, simulate.simulate(spark, "t", profiles(), 500, 30, [0.5, 0.5], partitions=n).collect())) for n in (1, 7))
    assert a == b
    with pytest.raises(ValueError):
        simulate.stoichiometry("50,40", 2)
    assert simulate.stoichiometry("50,51", 2) == [50 / 101, 51 / 101] and simulate.stoichiometry("100", 2) == [0.5, 0.5]
    cdf = simulate.binomial_cdf(50, 0.02)
    assert abs(cdf[0] - 0.98**50) < 1e-12 and cdf[-1] > 0.9999 and (np.diff(cdf) > 0).all()
    long = simulate.binomial_cdf(40_000, simulate.RATE)
    assert long[0] == 0 and long[-1] > 0.9999 and abs(np.searchsorted(long, 0.5) - 40_000 * simulate.RATE) < 3
    assert simulate.binomial_cdf(5, 0.0).tolist() == [1.0] and simulate.binomial_cdf(3, 1.0).tolist() == [0, 0, 0, 1]


def test_conformations_are_recovered(spark, tables, tmp_path):
    reads, heads = tables
    # Besides, transcripts that can't be analysed: one that replicate 1 lacks, one without reads, one of two sequences.
    bad = [(0, 2, "lone", "AC", 5), *((r, 3, "none", "AC", 5 * r) for r in (0, 1)), *((r, 4, "differs", "AC"[r:] + "CA", 5) for r in (0, 1))]
    result = D.deconvolve(reads.drop("conformation"), heads.unionByName(spark.createDataFrame(bad, heads.schema)), P).persist()
    out = {r["id"]: r for r in result.collect()}
    errors = {i: r["errors"] for i, r in out.items()}
    assert errors == {"two": None, "one": None, "lone": ["missing in a replicate"], "none": ["no reads in a replicate"], "differs": ["sequences differ between replicates"]}
    assert out["none"]["windows"] is None and out["none"]["nReads"] == [0, 5]
    two = out["two"]
    assert two["nReads"] == [4000, 4000] and len(two["windows"]) == 2
    for replicate in two["windows"]:
        assert len(replicate) == 1 and (replicate[0]["start"], replicate[0]["end"]) == (0, LENGTH)
        shares = sorted(replicate[0]["stoichiometries"])
        assert len(shares) == 2 and abs(shares[1] - 0.7) < 0.1
        w = np.array(replicate[0]["weights"])
        labels = w.argmax(axis=1)
        assert len(set(labels[:20])) == len(set(labels[20:])) == 1 and labels[0] != labels[20]
    assert two["replicateClusters"][0]["nClusters"] == 2 and two["replicateClusters"][0]["confidence"] == 1.0
    assert all(len(w["stoichiometries"] or [1]) == 1 for r in out["one"]["windows"] or [] for w in r)
    D.write_result(result, P, f"{tmp_path}/out")
    lines = [json.loads(x) for f in (tmp_path / "out" / "transcripts").glob("*.txt") for x in f.read_text().splitlines()]
    assert {x["id"] for x in lines} == set(out)
    D.write_document(result, P, f"{tmp_path}/out.json")
    document = json.loads((tmp_path / "out.json").read_text())
    assert document["params"]["winLen"] == 40 and document["params"]["minBaseCoverage"] == 50 and len(document["params"]) == 42
    by = {x["id"]: x for x in document["transcripts"]}
    assert set(by) == set(out) and "windows" not in by["lone"] and "errors" not in by["two"]
    assert all(round(x, 3) == x for w in by["two"]["windows"][0] for b in w["weights"] for x in b)


def test_a_cluster_too_small_is_taken_back(spark, tables):
    reads, heads = tables
    p = Params(**{**P.__dict__, "min_cluster_fraction": 0.45})
    out = D.deconvolve(reads.drop("conformation").filter("transcript_id = 'two'"), heads.filter("transcript_id = 'two'"), p).collect()
    assert len(out) == 1 and all(w["stoichiometries"] == [1.0] for r in out[0]["windows"] for w in r)


def test_results_do_not_depend_on_partitions(spark, tables):
    reads, heads = tables
    some, head = reads.drop("conformation").filter("transcript_id = 'two'"), heads.filter("transcript_id = 'two'")
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 5):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.add(str([r.asDict(True) for r in D.deconvolve(some.repartition(n), head, P).collect()]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_streaming_and_dumps(spark, tables, tmp_path):
    from foldspark.streaming import landing

    reads, heads = tables
    rows = reads.filter("replicate = 0 and transcript_id = 'two'").orderBy("read_id").collect()
    (tmp_path / "in").mkdir()
    mm.write_file(f"{tmp_path}/in/a.mm", [("two", "AC" * (LENGTH // 2), [(r.begin, r.end, r.idx) for r in rows])])
    landing.watch(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck", P).awaitTermination(300)
    assert [r["id"] for r in spark.read.json(f"{tmp_path}/out").collect()] == ["two"]
    grid = D.grids(reads, heads, P)
    detected = D.detect_windows(D.windowed(reads.filter("transcript_id = 'two'"), grid), grid, P).persist()
    assert {tuple(r)[1:] for r in D.raw_n_clusters(detected, grid).collect()} == {("two", 0, LENGTH, 2)}
    D.write_raw_n_clusters(detected, grid, f"{tmp_path}/raw")
    D.write_eigengaps(detected, grid, f"{tmp_path}/gaps")
    files = {f"{f.parent.parent.name}/{f.parent.name}": f.read_text().splitlines() for f in (tmp_path / "gaps").rglob("*.txt")}
    assert set(files) == {f"folder=two_{r}/file=window_1-{LENGTH}_{what}" for r in (1, 2) for what in ("eigengaps", "perturbed_eigengaps")}
    gaps = detected.filter("replicate = 0").first()
    assert files[f"folder=two_1/file=window_1-{LENGTH}_eigengaps"] == [f"{i + 1} {g:.10e}" for i, g in enumerate(gaps["gaps"])]
    assert files[f"folder=two_1/file=window_1-{LENGTH}_perturbed_eigengaps"] == [f"{i + 1} {g:.10e}" for i, gs in enumerate(gaps["null_gaps"]) for g in gs]
    D.write_eigenvectors(spark.createDataFrame([("t", 3, [(0, 1, 5), (1, 2, 4)])], "id string, size int, cells array<struct<i:int,j:int,n:int>>"), f"{tmp_path}/vectors")
    assert len("".join(f.read_text() for f in (tmp_path / "vectors").rglob("*.txt")).splitlines()) == 3


def test_assignments_are_dumped_by_cluster(spark, tables, tmp_path):
    reads, heads = tables
    two = reads.filter("transcript_id = 'two' and replicate = 0").drop("conformation")
    grid = D.grids(two, heads.filter("transcript_id = 'two'"), P)
    w = [[float(i < 20), float(i >= 20)] for i in range(LENGTH)]
    found = spark.createDataFrame([(0, "two", 0, 0, LENGTH, 2, 0, 1, w, [1] * LENGTH)], D.REGIONS)
    D.dump_assignments(two, found, grid, P, str(tmp_path / "dump"))
    files = [str(f) for f in (tmp_path / "dump").rglob("*.mm")]
    transcripts, dumped = mm.read_mm(spark, files)
    names = {r.transcript_id: r.n_reads for r in transcripts.collect()}
    assert set(names) == {f"two_0-{LENGTH}_c0", f"two_0-{LENGTH}_c1"} and min(names.values()) > 0
    got = {r.transcript_id: r.m for r in dumped.groupBy("transcript_id").agg(F.max(F.array_max("idx")).alias("m")).collect()}
    assert got[f"two_0-{LENGTH}_c0"] < 20


WIN = 20
SEVERAL = Params(win_len=WIN, win_offset=0.25, all_non_informative_to_one=True)


@pytest.fixture(scope="module")
def several(spark):
    """A transcript of five windows that merge to one region, its reads, and its result: some reads cover no window, others up to three."""
    rows = [(r, "t", i, i % 13, min(LENGTH, i % 13 + (12, 20, 23, 31)[i % 4]), sorted({i % 13 + 2 - i % 13 % 2, i % 13 + 4 - i % 13 % 2})) for r in (0, 1) for i in range(80 + 7 * r)]
    reads = spark.createDataFrame(rows, "replicate int, transcript_id string, read_id long, begin int, end int, idx array<int>")
    heads = spark.createDataFrame([(r, 0, "t", "AC" * (LENGTH // 2), 80 + 7 * r) for r in (0, 1)], "replicate int, ordinal int, transcript_id string, sequence string, n_reads long")
    return rows, D.deconvolve(reads, heads, SEVERAL).collect()


def covered(rows: list) -> list[int]:
    return [sum(b <= x < e for _, _, _, b, e, _ in rows) for x in range(LENGTH)]


def test_pre_coverage_counts_each_read_of_a_region_once(several):
    rows, (result,) = several
    for replicate, (window,) in enumerate(result["windows"]):
        held = [x for x in rows if x[0] == replicate and any(x[3] <= s and x[4] >= s + WIN for s in range(0, LENGTH - WIN + 1, 5))]
        assert (window["start"], window["end"]) == (0, LENGTH) and window["preCoverage"] == covered(held)


def test_coverage_of_every_cluster_is_in_the_result(spark, several):
    rows, (result,) = several
    for replicate, (window,) in enumerate(result["windows"]):
        # The one region is the whole transcript: reads count whatever their mutations.
        held = [x for x in rows if x[0] == replicate and x[4] - x[3] >= WIN]
        assert window["coverage"] == [covered(held)]
    keys = "replicate int, transcript_id string, region_idx int"
    found = spark.createDataFrame([(0, "t", 0, 5, 15, 2)], f"{keys}, start int, end int, n_clusters int")
    assigned = spark.createDataFrame([(0, "t", 0, 0, 8, 1, 3), (0, "t", 0, 7, 30, 1, 2)], f"{keys}, begin int, end int, cluster int, assigned long")
    assert D.clusters_coverage(assigned, found).first()["cover"] == [[0] * 10, [3, 3, 5] + [2] * 7]


def test_rounds_go_on_until_no_region_fails(spark, monkeypatch):
    """A window of 23 clusters that fails with more than one, so its cap falls 22 times; the kernels are stand-ins."""
    empty = spark.createDataFrame([], "x int")
    region = "replicate int, transcript_id string, region_idx int"
    consensus = spark.createDataFrame([("t", 0, 0, 40, 23, 1.0)], "transcript_id string, window_idx int, start int, size int, n_clusters int, confidence double")
    seen = []

    def merged(labels, *_):
        seen.extend(r["n_clusters"] for r in labels.collect())
        return labels.select(F.lit(0).alias("replicate"), "transcript_id", F.lit(0).alias("region_idx"), "start", (F.col("start") + F.col("size")).alias("end"), "n_clusters")

    stands = {
        "kept": lambda df: spark.createDataFrame(df.collect(), df.schema), "grids": lambda *_: empty, "windowed": lambda *_: spark.createDataFrame([("t",)], "transcript_id string"), "detect_windows": lambda *_: empty,
        "consensus_of": lambda *_: consensus, "cut_windows": lambda *_: empty, "merged_regions": merged, "assigned_reads": lambda *_: spark.createDataFrame([], f"{region}, cluster int, idx array<int>, assigned long"),
        "fractions_of": lambda *_: spark.createDataFrame([], f"{region}, fraction double"), "failing": lambda fractions, patterns, found, p: found.filter("n_clusters > 1").select("replicate", "transcript_id", "region_idx"),
        "region_precoverage": lambda *_: empty, "clusters_coverage": lambda *_: empty, "results": lambda *x: x[0].select("transcript_id", "n_clusters"),
    }
    for name, f in stands.items():
        monkeypatch.setattr(D, name, f)
    reads = spark.createDataFrame([(0, "t")], "replicate int, transcript_id string")
    heads = spark.createDataFrame([(0, 0, "t", "AC" * 20, 9)], "replicate int, ordinal int, transcript_id string, sequence string, n_reads long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 1)
        assert [tuple(r) for r in D.deconvolve(reads, heads, P).collect()] == [("t", 1)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen == list(range(23, 0, -1))


def test_a_run_writes_what_its_options_ask_for(spark, several, tmp_path):
    rows, _ = several
    files = []
    for replicate in (0, 1):
        files.append(f"{tmp_path}/{replicate}.mm")
        mm.write_file(files[-1], [("t", "AC" * (LENGTH // 2), [(x[3], x[4], x[5]) for x in rows if x[0] == replicate])])
    asked = Params(**{**SEVERAL.__dict__, "mm": tuple(files), "output": f"{tmp_path}/raw", "output_raw_n_clusters": True, "save_eigengap_data": True, "eigengap_data_out": f"{tmp_path}/gaps"})
    assert D.run(spark, asked) is None
    assert len([line for f in (tmp_path / "raw").glob("*.csv") for line in f.read_text().splitlines()]) == 10 and (tmp_path / "gaps" / "_SUCCESS").exists()
    dumped = Params(**{**SEVERAL.__dict__, "mm": tuple(files), "output": f"{tmp_path}/out", "assignments_dump_dir": f"{tmp_path}/dump"})
    assert [r["id"] for r in D.run(spark, dumped).collect()] == ["t"]
    assert mm.read_mm(spark, [str(f) for f in (tmp_path / "dump").rglob("*.mm")])[0].count() == 2
