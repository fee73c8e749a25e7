"""Hole filling, the command line, messages, simulator files, distributed fits, and what failed writers leave."""

from __future__ import annotations

import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark import __main__ as cli
from foldspark import log, simulate, tables
from foldspark.functions import stats
from foldspark.kernels import distributions, smoothing
from foldspark.operators import matrix as M
from foldspark.sources import mm, text


def test_holes_are_filled():
    assert smoothing.fill_holes([1, 1, 1, 2, 1, 1], 1) == [1] * 6
    assert smoothing.fill_holes([1, 1, 1, 2, 3, 3], 1) == [1, 1, 1, 3, 3, 3]
    assert smoothing.fill_holes([2, 1, 1, 1], 1) == [1] * 4 and smoothing.fill_holes([1, 1, 1, 2], 1) == [1] * 4
    assert smoothing.fill_holes([1, 1, 2, 3, 1, 1], 1) == [1] * 6
    assert smoothing.fill_holes([1, 2, 3], 0) == [1, 2, 3] and smoothing.fill_holes([], 3) == [] and smoothing.fill_holes([1, 2], 2) == [1, 2]
    rng = random.Random(1)
    for _ in range(300):
        labels = [rng.randrange(3) for _ in range(rng.randrange(1, 25))]
        out = smoothing.fill_holes(labels, 2)
        runs = smoothing.runs_of(out, [None] * len(out))
        assert len(runs) == 1 or all(r.size > 2 for r in runs) or out == labels


def test_short_spans_as_one_by_one(spark):
    def plain(labels, least):
        out, at = list(labels), 0
        while at < len(out):
            end = at + 1
            while end < len(out) and out[end] == out[at]:
                end += 1
            if end - at < least:
                out[at:end] = [out[at - 1] if at else out[end] if end < len(out) else out[at]] * (end - at)
            at = end
        return out

    rng = random.Random(2)
    lists = [[rng.randrange(3) for _ in range(rng.randrange(1, 20))] for _ in range(60)]
    df = spark.createDataFrame([(t, i, n) for t, x in enumerate(lists) for i, n in enumerate(x)], "t int, window_idx int, n_clusters int")
    got = {(r.t, r.window_idx): r.n_clusters for r in M.without_small_spans(df, ["t"], 3).collect()}
    assert got == {(t, i): n for t, x in enumerate(lists) for i, n in enumerate(plain(x, 3))}


def test_numbers_span_stretches(spark, monkeypatch):
    monkeypatch.setattr(M, "SPAN", 7)
    df = spark.createDataFrame([(i % 3, i * 2) for i in range(200)], "t int, read_id long").repartition(4)
    for t in range(3):
        rows = sorted((r.read_id, r.row) for r in M.numbered(df, ["t"]).filter(F.col("t") == t).collect())
        assert [n for _, n in rows] == list(range(len(rows)))


def test_command_line():
    p = cli.params(["--mm", "a.mm", "--mm", "b.mm", "--win-len", "0.9", "--shape", "--max-clusters", "4", "--whitelist", "w.txt"])
    assert p.mm == ("a.mm", "b.mm") and p.win_len == 0.9 and p.shape and p.max_clusters == 4 and p.whitelist == "w.txt" and p.alpha == 0.01
    for bad in ([], ["--mm", "a", "--max-clusters", "0"], ["--mm", "a", "--log-level", "loud"]):
        with pytest.raises((SystemExit, ValueError)):
            cli.params(bad)


def test_messages():
    out, asked = io.StringIO(), []
    log.set_level("warn", out, colour=True)
    log.on("info", lambda: asked.append(1) or "no")
    log.on("error", lambda: "yes")
    assert "yes" in out.getvalue() and "\x1b[31m" in out.getvalue() and "no" not in out.getvalue() and not asked
    log.set_level("trace", out)
    log.on("trace", lambda: "fine")
    assert "[TRACE] fine" in out.getvalue()
    log.set_level("warn")


def test_simulated_files(spark, tmp_path):
    (tmp_path / "db.txt").write_text("ACACACACAC\n....xxxxxx\nxxxxx.....\n5,5,5,5,0,0,0,0,0,0\n0,0,0,0,0,5,5,5,5,5\n\nACGTAC\n......\n1,1,1,1,1,1\n\n")
    db = text.read_structures(spark, f"{tmp_path}/db.txt")
    reads = simulate.database_reads(spark, db, 6, mean_coverage=30, shares=["75,25"], rate=0.2).persist()
    n = {r.transcript_id: r.n for r in reads.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {"RNA_1": 50, "RNA_2": 30} and n["RNA_1"] == simulate.reads_for_coverage(30, 10, 6)
    again = simulate.database_reads(spark, db.repartition(3), 6, mean_coverage=30, shares=["75,25"], rate=0.2)
    assert sorted(map(str, reads.collect())) == sorted(map(str, again.collect()))
    simulate.write_outputs(reads, db, f"{tmp_path}/out")
    files = [str(f) for f in (tmp_path / "out" / "mm").glob("*.mm")]
    assert {r.transcript_id: r.n_reads for r in mm.read_mm(spark, files)[0].collect()} == n
    lines = "\n".join(f.read_text() for f in (tmp_path / "out" / "text").glob("*.txt")).split()
    assert {"RNA_1", "RNA_2", "ACACACACAC"} <= set(lines) and sum("-" in x for x in lines) == 80
    back = text.read_structures(spark, f"{tmp_path}/out/database")
    sums = {(r.sequence, r.profile_idx): sum(r.profile) for r in back.collect()}
    want = {(r.sequence, r.conformation): r.n for r in reads.groupBy("sequence", "conformation").agg(F.sum(F.size("idx")).alias("n")).collect()}
    assert sums == want and len(sums) == 3


def test_fits_from_sums_equal_the_kernel(spark):
    rng = np.random.default_rng(4)
    samples = {"a": 3.0 * rng.weibull(2.5, 700), "b": 0.01 * rng.weibull(0.6, 500) + 1e-9, "c": 50 * rng.weibull(9.0, 300)}
    df = spark.createDataFrame([(k, float(x)) for k, v in samples.items() for x in v], "k string, x double").repartition(3)
    for r in stats.weibull_fit(df, ["k"], "x").collect():
        assert np.allclose((r.shape, r.scale), distributions.weibull_fit(samples[r.k]), rtol=1e-5)


def test_failed_attempts_leave_no_files(tmp_path):
    writer = mm.MmWriter({"path": str(tmp_path)})
    names = [f"part-{writer.job}-00000-{i}.mm" for i in (1, 2)] + ["part-other-00000-1.mm"]
    for n in names:
        (tmp_path / n).write_bytes(b"x")
        (tmp_path / (n + "i")).write_bytes(b"x")
    writer.commit([mm.Written(f"{tmp_path}/{names[1]}"), None])
    assert {f.name for f in tmp_path.iterdir()} == {x + e for x in names[1:] for e in ("", "i")}
    writer.abort([])
    assert {f.name for f in tmp_path.iterdir()} == {names[2], names[2] + "i"}


def test_unwanted_reads_are_skipped(spark, tmp_path):
    entries = [(f"t{i}", "ACGT" * 5, [(0, 20, [1, 5])] * (50 * i)) for i in range(6)]
    for index in (True, False):
        path = f"{tmp_path}/{index}.mm"
        mm.write_file(path, entries, index)
        transcripts, reads = mm.read_mm(spark, [path])
        assert {r.transcript_id: r.n_reads for r in transcripts.collect()} == {f"t{i}": 50 * i for i in range(6)}
        assert reads.filter("transcript_id = 't4'").count() == 200


def test_what_was_made_is_released(spark):
    since = tables.made()
    df = spark.range(10)
    one, two = tables.kept(df), tables.kept(df)
    held = tables.cached(df)
    held.count()
    tables.release(spark, since, but=two)
    assert two.count() == 10 and not held.is_cached
    with pytest.raises(Exception, match="(?i)not.*exist|not_exist"):
        one.count()


def test_centroids_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points, centres = rng.normal(size=(60, 3)).round(2), rng.normal(size=(40, 3)).round(2)
    p = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(points)], "id long, v array<double>")
    c = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(centres)], "number long, centre array<double>")
    want = [(i, int(((centres - x) ** 2).sum(axis=1).argmin())) for i, x in enumerate(points)]
    for block in (1000, 7):
        monkeypatch.setattr(stats, "BLOCK", block)
        assert sorted((r.id, r.number) for r in stats.nearest_centroid(p, c, "id", "v").collect()) == want
