from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from foldspark.functions import structures as S
from foldspark.sources import mm, text


@pytest.fixture(scope="module")
def entries():
    rng = random.Random(1)
    out = []
    for t in range(7):
        length = rng.randrange(20, 41)
        reads = []
        for _ in range(rng.randrange(0, 60)):
            b = rng.randrange(length - 10)
            e = rng.randrange(b + 5, length + 1)
            reads.append((b, e, sorted(rng.sample(range(b, e), rng.randrange(0, 4)))))
        out.append((f"RNA_{t}", "".join(rng.choice("ACGTN") for _ in range(length)), reads))
    return out


def rows_of(df):
    return sorted((r.replicate, r.transcript_id, r.read_id, r.begin, r.end, tuple(r.idx)) for r in df.collect())


@pytest.mark.parametrize("index", [True, False])
def test_read(spark, tmp_path, entries, index):
    paths = [f"{tmp_path}/a.mm", f"{tmp_path}/b.mm"]
    mm.write_file(paths[0], entries, index)
    mm.write_file(paths[1], entries[::-1], index)
    transcripts, reads = mm.read_mm(spark, paths)
    want = sorted((r, t, i, b, e, tuple(x)) for r, list_ in ((0, entries), (1, entries[::-1])) for t, _, rs in list_ for i, (b, e, x) in enumerate(rs))
    assert rows_of(reads) == want
    assert sorted(map(tuple, transcripts.collect())) == sorted((r, o, t, s, len(rs)) for r, list_ in ((0, entries), (1, entries[::-1])) for o, (t, s, rs) in enumerate(list_))
    assert rows_of(reads.filter("transcript_id = 'RNA_3'")) == [w for w in want if w[1] == "RNA_3"]
    (tmp_path / "white.txt").write_text("rna_2\nRNA_5\n\n")
    assert rows_of(mm.read_mm(spark, paths, f"{tmp_path}/white.txt")[1]) == [w for w in want if w[1] in ("RNA_2", "RNA_5")]


def test_write_round_trip(spark, tmp_path, entries):
    mm.write_file(f"{tmp_path}/a.mm", entries)
    transcripts, reads = mm.read_mm(spark, [f"{tmp_path}/a.mm"])
    mm.write_mm(reads, transcripts, f"{tmp_path}/out", 3)
    files = sorted(str(p) for p in (tmp_path / "out").glob("*.mm"))
    assert 1 < len(files) <= 3
    again_t, again_r = mm.read_mm(spark, files)
    assert [r[1:] for r in rows_of(again_r.withColumn("replicate", F.lit(0)))] == [r[1:] for r in rows_of(reads)]
    assert sorted((r.transcript_id, r.sequence, r.n_reads) for r in again_t.collect()) == sorted((t, s, len(rs)) for t, s, rs in entries)


def test_bytes_are_those_of_the_format(tmp_path):
    mm.write_file(f"{tmp_path}/x.mm", [("ab", "ACGTN", [(1, 4, [3, 1])])])
    assert (tmp_path / "x.mm").read_bytes() == b"\x03\x00ab\0" + b"\x05\0\0\0" + bytes([0x01, 0x23, 0x40]) + b"\x01\0\0\0" + b"\x01\0\0\0\x03\0\0\0\x02\0\0\0\x01\0\0\0\x03\0\0\0" + b"[mmeof]"
    with pytest.raises(ValueError):
        mm.pack_bases("ACX")
    assert mm.unpack_bases(mm.pack_bases("ACGTNA"), 6) == "ACGTNA"


def test_missing_trailer_is_an_error(spark, tmp_path, entries):
    mm.write_file(f"{tmp_path}/a.mm", entries)
    data = (tmp_path / "a.mm").read_bytes()
    (tmp_path / "c.mm").write_bytes(data[:-1])
    with pytest.raises(Exception, match="no end marker"):
        mm.read_mm(spark, [f"{tmp_path}/c.mm"])[1].collect()


def test_read_matrix(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1\t10\t0100000001\n3\t5\t101\n1\t10\t0000000000\n")
    rows = text.read_matrix(spark, f"{tmp_path}/m.txt").orderBy("read_id").collect()
    assert [(r.begin, r.end, r.idx) for r in rows] == [(0, 10, [1, 9]), (2, 5, [2, 4]), (0, 10, [])]
    assert text.read_matrix(spark, f"{tmp_path}/m.txt", keep_fragments=False).count() == 2


def test_read_structures(spark, tmp_path):
    (tmp_path / "db").write_text("ACGUA\n(...)\n.....\n0,1,2,3,0\n1,1,1,1,1\n\nAAC\n...\n1,0,1\n")
    rows = text.read_structures(spark, f"{tmp_path}/db")
    assert [(r.sequence, r.profile_idx, r.profile) for r in rows.orderBy("entry", "profile_idx").collect()] == [("ACGUA", 0, [0, 1, 2, 3, 0]), ("ACGUA", 1, [1, 1, 1, 1, 1]), ("AAC", 0, [1, 0, 1])]
    assert [r.sequence for r in text.bad_profiles(rows).collect()] == ["AAC"]


def test_structure_functions(spark):
    assert S.pair_table("((.).)") == [5, 3, -1, 1, -1, 0]
    assert S.helices(S.pair_table("((..))(.)")) == [(0, 5, 2), (6, 8, 1)] and S.helices(S.pair_table("((..))(.)"), False) == [(0, 5, 2)]
    assert S.compatible((0, 9, 2), (2, 7, 2)) and not S.compatible((0, 5, 1), (3, 8, 1)) and not S.compatible((0, 5, 1), (5, 8, 1))
    with pytest.raises(ValueError):
        S.pair_table("(()")
    df = spark.createDataFrame([("((..))", "(....)"), ("(()", "..."), (")(", "..")], "a string, b string")
    out = df.select(S.pairs_of("a").alias("p"), S.is_balanced(F.col("a")).alias("ok"), S.hamming(F.col("a"), F.col("b")).alias("d"), S.helices_of("a").alias("h")).collect()
    assert [r.ok for r in out] == [True, False, False] and [r.d for r in out] == [2, 3, 2]
    assert out[0].p == [5, 4, -1, -1, 1, 0] and out[1].p is None and [tuple(h) for h in out[0].h] == [(0, 5, 2)]
    stats = S.pair_stats(df.limit(1).select(S.pairs_of("a").alias("t"), S.pairs_of("b").alias("p")), [], "t", "p").first()
    assert (stats.ppv, stats.sensitivity) == (1.0, 0.5)


def test_blocks_across_file_reads(tmp_path):
    rng = random.Random(4)
    reads = [(b := rng.randrange(50), b + 30, sorted(rng.sample(range(b, b + 30), rng.randrange(0, 9)))) for _ in range(500)]
    mm.write_file(f"{tmp_path}/x.mm", [("t", "A" * 90, reads), ("u", "C" * 10, [])])
    for size in (5, 64, 1 << 20):
        with open(f"{tmp_path}/x.mm", "rb") as f:
            h = mm.read_header(f)
            got = []
            for begin, end, counts, indices in mm.read_batches(f, h.n_reads, size):
                at = 0
                for b, e, k in zip(begin.tolist(), end.tolist(), counts.tolist()):
                    got.append((b, e, indices[at : at + k].tolist()))
                    at += k
            assert got == reads and mm.read_header(f).transcript_id == "u"
    import numpy as np

    parts = [np.array(x) for x in ([r[0] for r in reads], [r[1] for r in reads], [len(r[2]) for r in reads], [i for r in reads for i in r[2]])]
    assert mm.encode_reads(*parts) == b"".join(mm.encode_read(*r) for r in reads)
