from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from foldspark.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(x.lstrip("0") == "" or (len(x.lstrip("0")) < 4 and int(x.lstrip("0")) <= 255) for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_matches_equal_the_patterns():
    rng = random.Random(1)
    atoms = ["a", "b.c", "@", ".", "com", "1", "25", "255", "300", "+", "+1 ", "(988) ", "555-2485", " ", "-", "4111111111111111", "4111 1111 1111 1111", "é", "😀", "%", "_", "0", "1.2.3.4", "\n"]
    for _ in range(20000):
        text = "".join(rng.choice(atoms) for _ in range(rng.randrange(0, 14)))
        got = sorted((pii.KINDS[k], a, b) for k, a, b, ok in pii.base_matches(text) if ok)
        assert got == sorted(brute(text)), text


def test_long_runs_take_linear_time():
    assert pii.base_matches("1" * 200_000 + "a" * 200_000 + "@") == [(2, 0, 200_000, False)]
    assert pii.base_matches("0" * 5000 + ".1.1.1") == [(1, 0, 5006, True), (2, 0, 5000, False)]
    assert [c[:3] for c in pii.candidates("a" * 100_000 + "(at)" * 50_000)] == []
    assert len(pii.described("1.2.3.4," * 20_000)) == 20_000


def test_failed_matches_of_any_length_are_candidates():
    assert pii.candidates("call +1 (" + " " * 60 + ") 2 now") == [(3, 5, 72, False)]
    assert pii.candidates("9" * 60) == [(2, 0, 60, False)]
    long = "x" * 90
    assert pii.candidates(f"{long} (at) {long} [dot] com") == [(0, 0, 196, False)]
    assert pii.candidates("no 212-555-0187 and 123-45-6789") == [(3, 3, 15, False), (4, 20, 31, False)]


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(2)
    truth = rng.random(20000) < 0.4
    right = np.array([0.95, 0.9, 0.75, 0.6])
    votes = np.where(rng.random((20000, 4)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    p, rates, prior = pii.dawid_skene(patterns, counts.astype(float))
    assert abs(prior - 0.4) < 0.03
    assert np.allclose(rates[1, :, 2], right, atol=0.04) and np.allclose(rates[0, :, 0], right, atol=0.04)


def test_rows(spark):
    texts = [None, "", "mail bob.1@mail2.example.com or +1 (988) 555-2485 é 4111 1111 1111 1111", "ip 10.2.3.4 and 300.1.1.1", "call 212-555-0187 now", "call 212-555-0187 now", "plain words " * 30000]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, texts[2], 0)] + [(100 + i, f"words call +1 (212) 555-{i:04d} or 10.0.{i % 256}.7 end", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    out = pii.digest(pii.find(docs)).collect()
    assert len(out) == len(rows)
    by = {r[0]: r[1] for r in rows}
    order = {k: i for i, k in enumerate(pii.KINDS)}
    for r in out:
        want = sorted(brute(by[r.doc_id] or ""), key=lambda s: (order[s[0]], s[1]))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in pii.KINDS[:4]]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert set(f"{k}:{a}:{b}" for k, a, b in want) <= set(r.spans.split(","))


def test_empty_table(spark):
    assert pii.digest(pii.find(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def planted(n=4000, seed=5):
    """Texts with loose candidates that are personal data, or only look like it; the spans that should be added."""
    rng, rows, right, wrong = random.Random(seed), [], set(), set()
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]

    def digits(k):
        return "".join(rng.choice("123456789") for _ in range(k))

    def card():
        while True:
            c = digits(16)
            if not pii.luhn(c):
                return c

    for i in range(n):
        before, after = (" ".join(rng.choice(words) for _ in range(rng.randrange(3, 30))) for _ in "ab")
        kind = i % 8
        area, local = digits(3), f"{digits(3)}-{digits(4)}"
        lead, span, good = [
            ("call", f"({area}) {local}", True),
            ("phone", f"{area}-{local}", True),
            ("email", f"{rng.choice(words)} (at) {rng.choice(words)} (dot) com", True),
            ("ssn", f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{digits(4)}", True),
            ("version", f"{digits(4)}.{digits(3)}.{digits(2)}.{digits(1)}", False),
            ("order", card(), False),
            ("mail", f"{rng.choice(words)}.{rng.choice(words)}@{rng.choice(words)}.com", None),
            ("phone", f"+1 ({area}) {local}", None),
        ][kind]
        text = f"{before} {lead} {span} {after}"
        start = len(before) + len(lead) + 2
        rows.append((i, text))
        if good is not None:
            (right if good else wrong).add((i, start, start + len(span)))
    return rows, right, wrong


def test_added_spans_are_right(spark):
    rows, right, wrong = planted()
    out = pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    added = {(r.doc_id, s.start, s.end) for r in out for s in r.spans if not s.base}
    print(f"added {len(added)}: right {len(added & right)} of {len(right)}, wrong {len(added & wrong)} of {len(wrong)}")
    assert len(added & right) >= 0.9 * len(right) and len(added & wrong) <= 0.05 * len(wrong) and len(added - right) <= 0.05 * len(added)


def test_the_model_depends_on_counts_alone(spark):
    rows, _, _ = planted(800)
    docs = spark.createDataFrame(rows * 3 + [(None, rows[0][1])] * 2000, "doc_id long, text string")
    one, two = (pii.train(pii.extract(docs.repartition(n))) for n in (2, 7))
    assert (one.weights == two.weights).all() and one.posterior == two.posterior
    assert {k[0] for k in one.posterior} == set(range(5))


def test_any_other_names_and_string_ids(spark):
    docs = spark.createDataFrame([("a", "call 212-555-0187 now", 1), ("a", "mail x@y.com", 2), ("b", None, 3)], "doc_id string, text string, `meta.k` int")
    out = sorted((r.doc_id, r.n_email) for r in pii.digest(pii.find(docs)).collect())
    assert out == [("a", 0), ("a", 1), ("b", 0)]
