"""The analysis' registered queries cover their whole tables."""

from __future__ import annotations

import json
import os
import time

import numpy as np
import pytest

from foldspark.kernels import graph_cut
from foldspark.params import Params
from foldspark.plans import catalog, kernel_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
EVERY = {f"T{t}" for t in range(4)}


def test_the_analysis_runs_over_all_reads(spark):
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    documents = {r["id"]: json.loads(r["document"]) for r in catalog.QUERIES["result_json"](spark, SF).collect()}
    assert set(documents) == EVERY
    assert sum(sum(x["nReads"]) for x in documents.values()) == items.selectExpr("l_suppkey % 4", "l_orderkey").distinct().count()
    assert all((w["start"], w["end"]) == (0, 60) and len(w["preCoverage"]) == 60 for x in documents.values() for r in x["windows"] for w in r[:1] if len(r) == 1)


def test_raw_numbers_and_caps_cover_all_transcripts(spark):
    raw = {(r["replicate"], r["transcript_id"], r["start"]) for r in catalog.QUERIES["raw_n_clusters"](spark, SF).collect()}
    assert raw == {(r, t, s) for r in range(3) for t in EVERY for s in range(0, 41, 10)}
    caps = {tuple(r) for r in catalog.QUERIES["failing_regions"](spark, SF).collect()}
    assert caps >= {(t, w, 1) for t in EVERY for w in (2, 3, 4)} and {c for _, _, c in caps} == {1}


def test_registered_kernels_use_the_default_effort(spark, monkeypatch):
    asked, p = {}, Params()
    monkeypatch.setattr(kernel_queries, "_graphs", lambda spark, d, cut, columns, schema: cut(0, [0], None))
    monkeypatch.setattr(graph_cut, "soft_cut", lambda graphs, k, *x: asked.setdefault("soft", x[:3]) and np.ones((1, 2)))
    monkeypatch.setattr(graph_cut, "hard_cut", lambda g, k, rounds, seed: asked.setdefault("hard", rounds) and [0])
    monkeypatch.setattr(kernel_queries.P, "detect_windows", lambda rows, grid, p: asked.setdefault("ptba", p) and rows.selectExpr("*", "0 as n_clusters", "'' as status"))
    for name in ("soft_graph_cut", "hard_graph_cut", "ptba"):
        catalog.QUERIES[name](spark, SF)
    assert asked["soft"] == (0.1, 20, 2)  # reduced, as README and BASELINE say
    assert asked["hard"] == p.soft_clustering_iters and asked["ptba"].max_permutations == p.max_permutations


def test_region_advance_takes_linear_time(spark, tmp_path):
    """Every window of one transcript, in far less time than a pass over all windows for each run."""
    n = 120_000
    spark.range(n).selectExpr("id * 3 as event_id", "cast(8 as long) as user_id").repartition(2).write.parquet(f"{tmp_path}/events.parquet")
    labels = [e % 3 + e // 5 % 2 for e in range(0, 3 * n, 3)]
    at = [0, *(i for i in range(1, n) if labels[i] != labels[i - 1])]
    began = time.time()
    out = catalog.QUERIES["region_advance"](spark, str(tmp_path)).collect()
    assert time.time() - began < 20
    assert sorted(map(tuple, out)) == [(0, a, z) for a, z in zip(at, [*at[1:], n])]
