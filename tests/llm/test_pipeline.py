from __future__ import annotations

import random
from array import array
from collections import Counter

import duckdb
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from foldspark.llm import bpe, mixing, toxicity
from tests.llm.test_ngram_join import brute as components_of
from tests.llm.test_secrets_mixing import brute as secrets_of


def corpus():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(500):
        text = [rng.choice(words) for _ in range(rng.randrange(8, 60))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            text[rng.randrange(len(text))] = "zounds"
        if rng.random() < 0.2:
            text.insert(3, "password=abcdef0123456789" + rng.choice("xyz"))
        if rows and rng.random() < 0.3:
            text = rng.choice(rows)[1].split()
            toxic = int("zounds" in text)
        rows.append((i, " ".join(text), "en", f"s{min(3, i % 8)}", 0))
        labels.append((i, 1, toxic))
    return [(i, t, g, s, len(t)) for i, t, g, s, _ in rows] + [(700, None, "en", None, None), (701, "", None, "s0", 0)], labels


def masked(text):
    out, at = "", 0
    for start, _, _, end in secrets_of(text):
        if start >= at:
            out += text[at:start] + "[secret]"
        at = max(at, end)
    return out + text[at:]


def test_run_equals_plain_python(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter((r.doc_id, r.lang, r.source, r.n_tokens, bytes(r.token_ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    tagger = toxicity.Tagger(toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    clean = [r for r in rows if tagger.score(r[1]) < 0.5]
    truth = {i for i, _, y in labels if y}
    assert {r[0] for r in rows} - {r[0] for r in clean} == truth
    stay = {i for i, _, c in components_of([(r[0], r[1]) for r in clean]) if i == c}
    left = [(i, t and masked(t), g, s, t if t is None else len(masked(t))) for i, t, g, s, _ in clean if str(i) in stay]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", left)
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = Counter()
    for i, t, g, s in con.sql(f"select doc_id, text, lang, source from ({mixing.duckdb_sql()})").fetchall():
        ids = array("I", encoding.encode_ordinary(t or ""))
        want[i, g, s, len(ids), ids.tobytes()] += 1
    assert got == want


def test_stages_keep_the_columns(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = docs.withColumn("meta.k", docs["doc_id"]).withColumn("copy", docs["lang"]).withColumn("score", docs["lang"]).withColumn("key", docs["lang"])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes


def test_hard_rows(spark, tmp_path):
    """Nulls everywhere, repeated ids, a very long text, ids as text, and no rows at all."""
    rows, labels = corpus()
    rows = [(f"d{i}", t, g, s, n) for i, t, g, s, n in rows[:200]]
    rows += [(None, None, None, None, None)] * 20 + [("d1", rows[1][1], "en", "s0", None)] * 3 + [("long", "word " * 200_000 + "password=abcdef0123456789xyz", "en", "s1", 5)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(f"d{i}", 1, y) for i, _, y in labels], "doc_id string, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r.n_tokens == 0 for r in out if r.doc_id is None) and all(r.n_tokens > 200_000 for r in out if r.doc_id == "long")
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id string, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).collect() == []
