from __future__ import annotations

import random

import numpy as np

from foldspark.llm import toxicity as T


def brute_odds(own, join):
    """Marginal log odds by summing over all labellings."""
    n, on = len(own), np.zeros(len(own))
    total = 0.0
    for code in range(1 << n):
        y = [code >> i & 1 for i in range(n)]
        s = np.exp(sum(o for o, v in zip(own, y) if v) + sum(join[2 * a + b] for a, b in zip(y, y[1:])))
        total += s
        on += s * np.array(y)
    return np.log(on / (total - on))


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = rng.integers(1, 7, 4)
        own, join = rng.normal(0, 2, sizes.sum()), tuple(rng.normal(0, 1.5, 4))
        ends = sizes.cumsum() - 1
        starts = ends + 1 - sizes
        got = T.log_odds(own, starts, ends, join)[0]
        want = np.concatenate([brute_odds(own[a : b + 1], join) for a, b in zip(starts, ends)])
        assert np.allclose(got, want, atol=1e-7)


def corpus(n, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    out = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(3, 80))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(["zounds", "blister", "grobiantum"]))
        out.append((i, " ".join(text), toxic))
    return out


def test_held_out_accuracy_and_spans(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(i, t, 0.0) for i, t, _ in rows] + [(None, "zounds", 0.0), (9001, None, 0.0), (9002, "", 0.0), (9003, "ab " * 60000 + "blister", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (9002, None)], "doc_id long, toxic int")
    chain = T.train(docs, labels)
    out = {r.doc_id: r for r in T.score(docs, chain).collect()}
    truth = {i: y for i, _, y in rows}
    assert np.mean([out[i].predicted == truth[i] for i in truth]) > 0.98
    assert out[9001].score == out[9002].score < 0.5
    assert out[9003].predicted == 1 and (out[9003].spans[0].start, out[9003].spans[0].end) == (180000, 180007)
    left = T.without_toxic(docs, chain)
    assert left.columns == docs.columns and left.count() == sum(r.score < 0.5 for r in out.values())


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    chain = T.train(docs, none)
    assert [r.predicted for r in T.score(docs, chain).collect()] == [0]
    assert T.score(docs.limit(0), chain).collect() == []


def test_strong_pairs_take_linear_time():
    import time

    rng = np.random.default_rng(2)
    own, join = rng.normal(0, 1, 200_000), (9.0, -9.0, -9.0, 9.0)
    began = time.time()
    T.log_odds(own, np.array([0, 70_000]), np.array([69_999, 199_999]), join)
    assert time.time() - began < 20
    for _ in range(10):
        own = rng.normal(0, 2, 9)
        assert np.allclose(T.log_odds(own, np.array([0, 4]), np.array([3, 8]), (7.0, -8.0, -6.0, 9.0))[0], np.concatenate([brute_odds(own[:4], (7.0, -8.0, -6.0, 9.0)), brute_odds(own[4:], (7.0, -8.0, -6.0, 9.0))]), atol=1e-6)


def test_query_equals_one_text_at_a_time(spark, tmp_path):
    """The registered query against plain Python: the same labelled texts, one fit, marginals of each text by itself by enumeration-free recursion."""
    from binascii import crc32

    from foldspark.llm import catalog

    rows, extra = corpus(700, 5), [(7, "another text of this id blister"), (None, "grobiantum x"), (9001, None), (9002, "")]
    docs = [(i, t) for i, t, _ in rows] + extra
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, `meta.k` int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = catalog.QUERIES["op4_toxicity"](spark, str(tmp_path)).collect()
    least = {}
    for i, t in docs:
        if i is not None and (i not in least or (t or "") < least[i]):
            least[i] = t or ""
    known = sorted((str(i), least[i], y) for i, _, y in rows if crc32(str(i).encode()) % 5)
    chain = T.fit([(t, y) for _, t, y in known])
    tagger = T.Tagger(chain)

    def one(text):
        words = [m for m in T.WORD.finditer(text or "")]
        fs = [T.features(m[0]) for m in words]
        own = np.array([chain.bias + sum(chain.weights.get(f, 0.0) for f in x) + (chain.before.get(fs[k - 1][0], 0.0) if k and fs[k - 1] else 0.0) + (chain.after.get(fs[k + 1][0], 0.0) if k + 1 < len(fs) and fs[k + 1] else 0.0) for k, x in enumerate(fs)])
        if not len(own):
            return tagger.scores_of(np.array([[chain.bias, 0.0]]))[0], ""
        a, b = np.array([0]), np.array([len(own) - 1])
        back = T._walked(own[::-1], a, b, (chain.join[0], chain.join[2], chain.join[1], chain.join[3]))[::-1] - own
        odds = T._walked(own, a, b, chain.join) + back
        p = T.sigmoid(odds)
        return tagger.scores_of(np.array([[odds.max(), np.log1p(p[p >= T.FLOOR].sum())]]))[0], ",".join(f"{m.start()}:{m.end()}" for m, x in zip(words, p) if x >= 0.5)

    want = sorted((str(i), i is not None and crc32(str(i).encode()) % 5 == 0, round(float(s), 6), spans) for i, t in docs for s, spans in [one(t)])
    assert sorted((str(r.doc_id), r.held_out, round(r.score, 6), r.spans) for r in out) == want
    assert all(r.predicted == (r.score >= 0.5) and r.n_spans == len(r.spans.split(",")) - (r.spans == "") for r in out)


def test_string_ids_other_names_and_the_bound_on_bytes(spark):
    rows = corpus(400, 9)
    docs = spark.createDataFrame([(f"d{i}", t, 1) for i, t, _ in rows] + [("d1", "x " * 300_000, 1)], "`my id` string, body string, `meta.k` int")
    labels = spark.createDataFrame([(f"d{i}", y) for i, _, y in rows], "`my id` string, toxic int")
    chain = T.train(docs, labels, id_col="my id", text_col="body")
    left = T.without_toxic(docs, chain, "body")
    assert left.columns == docs.columns and left.count() == sum(not y for _, _, y in rows) + 1
    few = T.labelled(docs, labels, 4000, 5000, "my id", "body", "toxic", T.FOLDS, T.HELD_OUT)
    assert 0 < len(few) < 60 and sum(len(t.encode()) for t, _ in few) <= 5000
    assert T.without_toxic(docs.limit(0), chain, "body").columns == docs.columns
