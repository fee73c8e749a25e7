from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from foldspark.llm import quality_rules as R
from foldspark.llm import quality_score as Q
from foldspark.llm import text_stats as S


def brute(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_base_statistics_equal_their_definition():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "b ", "é ", "\n", "a b c ", "#", "| ", "\t", "x\x0by ", "  ", "line one\n", "\x1c", "\xa0"]) for _ in range(rng.randrange(30)))
        assert S.base_stats(text)[:5] == brute(text), repr(text)


def test_exact_binomial():
    from math import comb

    for n, k, p in ((10, 3, 0.2), (50, 0, 0.05), (40, 39, 0.9)):
        assert abs(R.binomial_cdf(k, n, p) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-12
    assert abs(R.binomial_cdf(2, 60, R.upper_bound(2, 60, 0.05)) - 0.05) < 1e-9
    from math import exp as e

    assert abs(R.binomial_cdf(100, 10**8, 1e-6) - sum(e(-100) * 100.0**i / float(np.prod(np.arange(1, i + 1, dtype=float))) for i in range(101))) < 1e-4
    assert R.binomial_cdf(2 * 10**6 - 20_000, 10**8, 0.02) < 1e-40 and R.binomial_cdf(2 * 10**6 + 20_000, 10**8, 0.02) == 1.0
    assert R.upper_bound(5, 5, 0.05) == 1.0 and R.upper_bound(0, 0, 0.05) == 1.0
    assert R.certified([0, 0, 900], 1000, 0.01, 0.05) == 2 and R.certified([0], 20, 0.01, 0.05) == 0 and R.certified([], 0, 0.1, 0.1) == 0


def test_certified_cutoffs_seldom_exceed_the_risk():
    rng, bad = np.random.default_rng(4), 0
    shares = np.array([0.001, 0.004, 0.012, 0.03])  # true false rejections of four cutoffs
    for _ in range(400):
        u = rng.random(2000)
        passed = R.certified([int((u < s).sum()) for s in shares], 2000, 0.01, 0.05)
        bad += passed > 2
    assert bad / 400 < 0.05


def corpus(n=2500):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(60, 140))]
        good = int(rng.random() < 0.8)
        if not good:
            text = [w + "###" for w in text] if i % 2 else [w for w in text[:20] for _ in range(7)]
        rows.append((i, " ".join(text), ("en", "de", None)[i % 3], good))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    more = [(None, "x " * 80, "en", 0), (9000, None, "en", 0), (9001, "", None, 0), (9002, "w " * 100000, "fr", 0), (0, rows[0][1], "en", 1)]
    docs = spark.createDataFrame([(i, t, g, 1.0, True) for i, t, g, _ in rows + more], "doc_id long, text string, lang string, score double, kept boolean")
    labels = spark.createDataFrame([(i, q, 0) for i, _, _, q in rows] + [(None, 0, 0), (9000, None, 0), (0, 0, 0)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_rules(spark, tables):
    rows, docs, labels = tables
    out = R.apply_rules(docs, labels, risk=0.08).collect()
    assert len(out) == docs.count()
    truth = {i: q for i, _, _, q in rows}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert all(r.kept for r in out if truth.get(r.doc_id) == 1)
    assert not any(r.kept for r in out if truth.get(r.doc_id) == 0)


def test_rules_without_labels_or_rows(tables):
    _, docs, labels = tables
    out = R.apply_rules(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in out)
    assert R.apply_rules(docs.limit(0), labels).collect() == []


def test_isotonic_is_the_closest_rising_sequence():
    assert np.allclose(Q.isotonic(np.array([1.0, 3, 2, 2, 5]), np.array([1.0, 1, 1, 2, 1])), [1, 2.25, 2.25, 2.25, 5])
    x = np.random.default_rng(3).normal(size=200)
    assert (np.diff(Q.isotonic(x, np.ones(200))) >= -1e-12).all()


def test_features_approximate_a_gaussian_kernel():
    rng, d = np.random.default_rng(5), len(S.FEATURES)
    model = Q.Model(np.zeros(d), np.ones(d), rng.normal(0, 1 / np.sqrt(d), (d, 4000)), rng.uniform(0, 2 * np.pi, 4000), np.zeros(4001), np.zeros(0), np.zeros(0))
    x = rng.normal(size=(20, d))
    z = model.expand(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * d))
    assert np.abs(z @ z.T - want).max() < 0.08


def test_partition_sums_equal_one_sum(spark, tables):
    _, docs, labels = tables
    features = S.with_features(docs, ["doc_id"]).join(labels.dropna(), "doc_id").withColumnRenamed("quality", "__y").persist()
    d = len(S.FEATURES)
    rng = np.random.default_rng(6)
    model = Q.Model(np.zeros(d), np.ones(d), rng.normal(0, 0.2, (d, 12)), rng.uniform(0, 6, 12), np.zeros(13), np.zeros(0), np.zeros(0))
    local = features.select("__x", "__y").collect()
    z = model.expand(np.array([r[0] for r in local]))
    want = z.T @ np.column_stack([z, [r[1] for r in local]])
    assert np.allclose(Q.normal_equations(features.repartition(7), model, 3), want)
    assert np.allclose(Q.normal_equations(features.limit(0), model, 1), 0)
    features.unpersist()


def test_scores(spark, tables):
    rows, docs, labels = tables
    out = Q.score(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    truth = {i: q for i, _, _, q in rows}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 500 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    alone = Q.score(docs, labels.limit(0)).collect()
    assert {r.score for r in alone} == {0.5}
    assert Q.score(docs.limit(0), labels).collect() == []


def test_every_stratum_gets_cutoffs(spark):
    """Over 1000 strata; each of 900 documents, a ninth of them with long words and no label."""
    words = "array_join(transform(sequence(1, 60), i -> concat(if(id % 9 = 8, repeat('x', 120), 'w'), 1000 + i)), ' ')"
    docs = spark.range(9 * 1100).selectExpr("id as doc_id", "cast(id div 9 as string) as lang", f"{words} as text")
    labels = docs.filter("doc_id % 9 < 8").selectExpr("doc_id", "1 as quality")
    out = R.apply_rules(docs, labels, risk=0.9)
    assert out.filter("why like '%long words%'").count() == 1100 and out.filter("kept").count() == 8 * 1100


def brute_verdicts(rows, labels, risk, delta):
    """kept of every row, and each stratum's number of settings, by their definition."""
    ratios = {
        "symbols": lambda w, c, s, d, r, n: s / c,
        "duplicate lines": lambda w, c, s, d, r, n: d / n,
        "repeated words": lambda w, c, s, d, r, n: r / w,
        "long words": lambda w, c, s, d, r, n: c / w,
        "short words": lambda w, c, s, d, r, n: w / c,
    }
    good, level, failed = {i for i, q in labels if q}, [], []
    for _, text, _ in rows:
        w, c, s, d, r = brute(text)
        n = sum(bool(x.strip(" \t\x0b\x0c\r")) for x in (text or "").split("\n"))
        failed.append(w < 50 or 100 * r > 50 * w)
        level.append(0 if failed[-1] else min(sum(ratios[x.name](w, c, s, d, r, n) <= cut for cut in x.cutoffs) for x in R.RULES))
    strata = {}
    for (i, _, g), k, bad in zip(rows, level, failed):
        if i in good and not bad:
            strata.setdefault(g, {}).setdefault(i, []).append(k)
    held = {}
    for g, ids in strata.items():
        n, held[g] = len(ids), 0
        for setting in range(R.SETTINGS):
            wrong = sum(min(k) <= setting for k in ids.values())
            p = sum(float(np.exp(np.sum(np.log(np.arange(n - x + 1, n + 1))) - np.sum(np.log(np.arange(1, x + 1))) + x * np.log(risk) + (n - x) * np.log(1 - risk))) for x in range(wrong + 1))
            if p > delta / len(strata):
                break
            held[g] = setting + 1
    return [not bad and k >= held.get(g, 0) for (_, _, g), k, bad in zip(rows, level, failed)], held


def test_verdicts_equal_their_definition(spark):
    """Data that can't be separated: good documents spread over all settings; repeated ids count once."""
    rng, rows, labels = random.Random(3), [], []
    for i in range(2600):
        g = ("en", "de", "xx", None)[min(3, i % 7)]
        text = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(45, 120))]
        for _ in range(int(rng.expovariate(0.4))):
            text[rng.randrange(len(text))] = rng.choice(["#####", "x" * 90, "a b a b a b", "one line\none line\none line\n"])
        rows.append((i, " ".join(text), g))
        if i % 3:
            labels.append((i, int(rng.random() < 0.9)))
    rows += [(1, rows[5][1], rows[1][2])] * 300
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, `meta.k` int").repartition(5)
    got = sorted((r.doc_id, r.n_words, r.kept) for r in R.apply_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int"), risk=0.05).collect())
    kept, held = brute_verdicts(rows, labels, 0.05, 0.05)
    print(held)
    assert got == sorted((i, brute(t)[0], k) for (i, t, _), k in zip(rows, kept)) and 0 < min(held.values()) < R.SETTINGS


def test_scores_equal_plain_numpy(spark, tables):
    """The whole query against the same method on one machine."""
    rows, docs, labels = tables
    docs = docs.withColumn("meta.k", docs["kept"])
    got = sorted((str(r.doc_id), r.score) for r in Q.score(docs, labels).collect())
    texts = [(r.doc_id, S.feature_stats(r.text or "")) for r in docs.collect()]
    x = np.array([f for _, f in texts])
    d, size = x.shape[1], 160
    mean, sd, rng = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6), np.random.default_rng(11)
    model = Q.Model(mean, sd, rng.normal(0, 1 / np.sqrt(d), (d, size)), rng.uniform(0, 2 * np.pi, size), np.zeros(size + 1), np.zeros(0), np.zeros(0))
    known = {r.doc_id: r.y for r in labels.filter("quality is not null and doc_id is not null").selectExpr("doc_id", "quality as y").groupBy("doc_id").agg({"y": "max"}).withColumnRenamed("max(y)", "y").collect()}
    part = {r.doc_id: (r.f, r.p) for r in docs.filter("doc_id is not null").selectExpr("doc_id", "crc32(cast(doc_id as string)) % 3 as f", "pmod(xxhash64('calibrate', cast(doc_id as string)), 4) as p").collect()}
    fit = [i for i, (doc, _) in enumerate(texts) if doc in known and part[doc][0] != 1 and part[doc][1] > 0]
    z, y = model.expand(x[fit]), np.array([known[texts[i][0]] for i in fit])
    weights = np.linalg.solve(z.T @ z + 1e-3 * len(fit) / size * np.eye(size + 1), z.T @ y)
    rest = [i for i, (doc, _) in enumerate(texts) if doc in known and part[doc][0] != 1 and part[doc][1] == 0]
    raw = model.expand(x) @ weights
    bins = np.floor((np.clip(raw[rest], -0.5, 1.4999) + 0.5) * 512)
    at = [rest[k] for k in range(len(rest))]
    model.weights = weights
    model.raw = np.array([raw[at][bins == b].mean() for b in np.unique(bins)])
    counts = np.array([float((bins == b).sum()) for b in np.unique(bins)])
    model.calibrated = Q.isotonic(np.array([np.mean([known[texts[i][0]] for i, c in zip(at, bins) if c == b]) for b in np.unique(bins)]), counts)
    want = sorted((str(doc), s) for (doc, _), s in zip(texts, model.predict(x)))
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-6)
