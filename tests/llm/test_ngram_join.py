from __future__ import annotations

import random
import re

import numpy as np
import pytest

from foldspark.llm import ngram_join as J
from foldspark.llm.components import components, forest


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """n_shingles and component of every row."""
    sets = [shingle_set(t) for _, t in rows]
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                common = len(sets[i] & sets[j])
                if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                    part[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted((str(doc), len(sets[i]), str(least.get(root(i)) if doc is not None else None)) for i, (doc, _) in enumerate(rows))


def corpus(seed, n=260):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    family = [rng.choice(words) for _ in range(150)]
    texts = []
    for i in range(n):
        size = rng.choice([1, 3, 5, 6, 8, 12, 25, 60, 140])
        text = [rng.choice(words) for _ in range(size)]
        if rng.random() < 0.2:
            text[size // 2 : size // 2] = passage
        if rng.random() < 0.25:  # near copies of one text, with few and with many edits
            text = list(family)
            for _ in range(rng.randrange(0, 9)):
                text[rng.randrange(len(text))] = rng.choice(words) + str(rng.randrange(99))
        if texts and rng.random() < 0.3:
            text = rng.choice(texts).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(words).upper()
        texts.append(" ".join(text))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed) + [(5000, None), (5001, ""), (5002, " \n\t"), (None, "a b c d e f"), (None, None), (5003, "a b c d e f"), (5004, "A b  c d e\nf"), (3, "a b c d e f g h i j k l m n"), (5005, "x"), (5006, "X")]
    rows.append(rows[0])
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, `meta.k` int").repartition(3)
    want = brute(rows)
    for options in ({"long_list": 2, "block": 3},) if seed > 1 else ({}, {"long_list": 8, "block": 16}, {"long_list": 3, "block": 1000, "sample": 0.9}):
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.join(docs, **options).collect())
        # A repeated id with two texts: its rows may stand in either order.
        assert got == want, options
    left = sorted(str(r.doc_id) for r in J.one_of_each(docs).collect())
    stay = {i for i, _, c in want if i == c}
    assert left == sorted(i for i, _, _ in want if i in stay)


def test_every_boundary_gives_the_same(spark, monkeypatch):
    rows = corpus(9, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for light_to in (0, 20, 10**6):
        monkeypatch.setattr(J, "boundary", lambda costs: light_to)
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.join(docs).collect()) == want, light_to


def test_boundary_is_where_the_cost_is_least():
    assert J.boundary([(5, 3, 10), (10, 20, 30), (20, 300, 100), (40, 5000, 400)]) == 10
    assert J.boundary([]) == 0 and J.boundary([(5, 9.0, 1.0)]) == 0


def test_empty_table(spark):
    assert J.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_paths_and_stars(spark):
    rng = np.random.default_rng(4)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000 + int(a), 5000 + int(b)) for a, b in rng.integers(0, 400, (250, 2))]
    rng.shuffle(pairs)
    links = spark.createDataFrame([tuple(map(int, p)) for p in pairs], "a long, b long").repartition(7)
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {r.node: r.component for r in components(links, one_task=0).collect()}
    u, v = forest(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    want = {int(a): int(b) for a, b in zip(u, v)}
    want |= {b: b for b in want.values()}
    assert got == want


def family(n, seed=7):
    """Near copies of one text by the thousand, near misses of it, and near copies of a few others that share a passage with it."""
    rng, words = random.Random(seed), [f"w{i}" for i in range(40)]
    base = [f"b{i}" for i in range(150)]
    others = [base[:40] + [f"o{k}x{i}" for i in range(110)] for k in range(3)]
    rows = []
    for i in range(n):
        text = list(others[i % 3] if i % 10 == 0 else base)
        if i % 10 == 1:  # of other lengths
            text = text[: 60 + i % 90]
        for _ in range(rng.choice([0, 1, 1, 2]) if i % 5 else rng.choice([3, 4, 5])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    return rows


def test_families_of_near_copies_and_near_misses(spark):
    rows = family(700)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    for options in ({"long_list": 16, "block": 24},):
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.join(docs, **options).collect()) == want, options


def test_sets_that_agree_in_64_bits_stay_apart(spark, monkeypatch):
    """Every set gets one of four nodes; unrelated documents aren't joined all the same."""
    rows = corpus(4, 60)
    real = J.class_key
    monkeypatch.setattr(J, "class_key", lambda h: (real(h)[0] % 4, real(h)[1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    part = {i: c for i, _, c in brute(rows)}
    out = [(str(r.doc_id), str(r.component_id)) for r in J.join(docs).collect()]
    assert all(part[i] == part[c] for i, c in out) and len({c for _, c in out}) > 4
